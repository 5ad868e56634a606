"""A hand-made catalogue and its change rows."""

import json

from pyspark.sql.types import StructType

from sleevenotes.schemas import CATALOG, CHANGE

ROWS = {
    "artist": [
        dict(id=1, gid="a1", name="Joy Division", sort_name="Joy Division", comment="", ended=True, type=1),
        dict(id=2, gid="a2", name="New Order", sort_name="New Order", comment="", ended=False, type=1),
        dict(id=3, gid="a3", name="Nobody", sort_name="Nobody", comment="", ended=None, type=9),
    ],
    "artist_type": [dict(id=1, name="Group")],
    "artist_meta": [dict(id=1, rating=85, rating_count=3)],
    "artist_gid_redirect": [dict(gid="x1", new_id=1), dict(gid="x0", new_id=1)],
    "artist_alias": [
        dict(artist=1, name="a", type=None), dict(artist=1, name=None, type=1), dict(artist=1, name="a", type=1),
        dict(artist=1, name="hint", type=2), dict(artist=2, name="b", type=1),
    ],
    "url": [dict(id=1, url="https://www.google.com/search"), dict(id=2, url="mailto:a@b.c"), dict(id=3, url="http://x.org")],
    "l_artist_url": [dict(entity0=1, entity1=1), dict(entity0=1, entity1=2), dict(entity0=2, entity1=3)],
    "l_release_group_url": [dict(entity0=10, entity1=3)],
    "tag": [dict(id=1, name="hip-hop"), dict(id=2, name="seen live"), dict(id=3, name="rock")],
    "genre": [dict(name="hip-hop"), dict(name="rock")],
    "artist_tag": [dict(artist=1, tag=1, count=2), dict(artist=1, tag=3, count=0), dict(artist=1, tag=2, count=5)],
    "release_group_tag": [dict(release_group=10, tag=3, count=1)],
    "release_group": [
        dict(id=10, gid="g10", name="Closer", comment="c", type=1, artist_credit=1),
        dict(id=11, gid="g11", name="Other", comment="", type=None, artist_credit=2),
        dict(id=12, gid="g12", name="Creditless", comment="", type=1, artist_credit=None),
    ],
    "release_group_primary_type": [dict(id=1, name="Album")],
    "release_group_secondary_type": [dict(id=1, name="Live"), dict(id=2, name="Demo")],
    "release_group_secondary_type_join": [dict(release_group=10, secondary_type=1), dict(release_group=10, secondary_type=2)],
    "release_group_meta": [
        dict(id=10, first_release_date_year=1999, first_release_date_month=None, first_release_date_day=5, rating=None, rating_count=None)
    ],
    "release_group_alias": [dict(release_group=10, name="Closer!", type=1), dict(release_group=10, name="R1", type=None)],
    "release_group_gid_redirect": [dict(gid="y1", new_id=10)],
    "artist_credit_name": [
        dict(artist_credit=1, artist=1, position=0), dict(artist_credit=1, artist=2, position=1),
        dict(artist_credit=2, artist=2, position=0),
    ],
    "release": [
        dict(id=100, gid="r100", name="R1", comment="", status=1, release_group=10),
        dict(id=101, gid="r101", name="Closer", comment="", status=None, release_group=10),
        dict(id=102, gid="r102", name="R2", comment="", status=1, release_group=11),
    ],
    "release_status": [dict(id=1, name="Official")],
    "release_gid_redirect": [dict(gid="z1", new_id=100)],
    "release_country": [
        dict(release=100, country=1, date_year=2001, date_month=None, date_day=None),
        dict(release=100, country=2, date_year=2005, date_month=6, date_day=7),
    ],
    "release_unknown_country": [dict(release=102, date_year=None, date_month=None, date_day=None)],
    "release_label": [dict(release=100, label=1), dict(release=100, label=1)],
    "label": [dict(id=1, name="Factory")],
    "area": [dict(id=1, name="UK"), dict(id=2, name="Moon")],
    "country_area": [dict(area=1)],
    "medium": [
        dict(id=1000, release=100, format=1, name="m2", position=2, track_count=4),
        dict(id=1001, release=100, format=None, name="m1", position=1, track_count=5),
        dict(id=1002, release=101, format=1, name="", position=1, track_count=1),
    ],
    "medium_format": [dict(id=1, name="CD")],
    "track": [
        dict(id=1, gid="t1", medium=1000, recording=1, artist_credit=1, name="One", length=10, number="A1", position=1, is_data_track=False),
        dict(id=2, gid="t2", medium=1001, recording=1, artist_credit=2, name="Two", length=None, number="1", position=1, is_data_track=False),
        dict(id=3, gid="t3", medium=1000, recording=2, artist_credit=1, name="Video", length=1, number="2", position=2, is_data_track=False),
        dict(id=4, gid="t4", medium=1000, recording=1, artist_credit=1, name="Data", length=1, number="3", position=3, is_data_track=True),
    ],
    "track_gid_redirect": [dict(gid="u1", new_id=1)],
    "recording": [dict(id=1, gid="c1", video=False), dict(id=2, gid="c2", video=True)],
    "recording_gid_redirect": [dict(gid="v1", new_id=1)],
    "index_listing": [
        dict(id=7, release=100, ordering=0, types=["Medium"]), dict(id=8, release=100, ordering=1, types=["Front", "Medium"]),
        dict(id=9, release=101, ordering=2, types=["Front"]), dict(id=6, release=100, ordering=0, types=None),
        dict(id=5, release=100, ordering=0, types=["Back"]),
    ],
}


def frame(spark, table, rows):
    schema = StructType.fromDDL(CATALOG[table])
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in rows], schema)


def catalog(spark, **replaced):
    return {t: frame(spark, t, replaced.get(t, ROWS[t])) for t in CATALOG}


def changes(spark, *rows):
    """Rows ``(seq, table, op, old, new)`` with dicts for old and new."""
    from datetime import datetime

    def text(row):
        return None if row is None else json.dumps(row)

    data = [(s, datetime(2024, 1, 1, 0, 0, s % 60), t, op, text(o), text(n)) for s, t, op, o, n in rows]
    return spark.createDataFrame(data, CHANGE)


def as_json(docs):
    """Documents as ``{id: text}``."""
    from sleevenotes.sources.documents import encode_json

    return {r.id: r.json for r in encode_json(docs).collect()}
