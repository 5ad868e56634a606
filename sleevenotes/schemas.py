"""Explicit schemas: catalogue tables, change feed and sync logs."""

from __future__ import annotations

from pyspark.sql.types import DataType, StructType

#: Columns the operators read, per catalogue table (Spark DDL).
CATALOG: dict[str, str] = {
    "artist": "id long, gid string, name string, sort_name string, comment string, ended boolean, type int",
    "artist_type": "id long, name string",
    "artist_meta": "id long, rating int, rating_count int",
    "artist_gid_redirect": "gid string, new_id long",
    "artist_alias": "artist long, name string, type int",
    "url": "id long, url string",
    "l_artist_url": "entity0 long, entity1 long",
    "l_release_group_url": "entity0 long, entity1 long",
    "tag": "id long, name string",
    "genre": "name string",
    "artist_tag": "artist long, tag long, count long",
    "release_group_tag": "release_group long, tag long, count long",
    "release_group": "id long, gid string, name string, comment string, type int, artist_credit long",
    "release_group_primary_type": "id long, name string",
    "release_group_secondary_type": "id long, name string",
    "release_group_secondary_type_join": "release_group long, secondary_type long",
    "release_group_meta": "id long, first_release_date_year int, first_release_date_month int, "
    "first_release_date_day int, rating int, rating_count int",
    "release_group_alias": "release_group long, name string, type int",
    "release_group_gid_redirect": "gid string, new_id long",
    "artist_credit_name": "artist_credit long, artist long, position int",
    "release": "id long, gid string, name string, comment string, status int, release_group long",
    "release_status": "id long, name string",
    "release_gid_redirect": "gid string, new_id long",
    "release_country": "release long, country int, date_year int, date_month int, date_day int",
    "release_unknown_country": "release long, date_year int, date_month int, date_day int",
    "release_label": "release long, label long",
    "label": "id long, name string",
    "area": "id long, name string",
    "country_area": "area int",
    "medium": "id long, release long, format int, name string, position int, track_count long",
    "medium_format": "id long, name string",
    "track": "id long, gid string, medium long, recording long, artist_credit long, name string, length int, "
    "number string, position int, is_data_track boolean",
    "track_gid_redirect": "gid string, new_id long",
    "recording": "id long, gid string, video boolean",
    "recording_gid_redirect": "gid string, new_id long",
    "index_listing": "id long, release long, ordering int, types array<string>",
}

#: Schema each table belongs to, for the schema allowlist; all others are in ``catalog``.
TABLE_SCHEMA: dict[str, str] = {"index_listing": "cover_art_archive"}
DEFAULT_TABLE_SCHEMA = "catalog"

#: Identity columns of a row. Tables not named are identified by all their columns.
PRIMARY_KEY: dict[str, list[str]] = {
    **{
        t: ["id"]
        for t in CATALOG
        if "id long" in CATALOG[t].split(", ")[0] and not t.endswith("_gid_redirect")
    },
    **{t: ["gid"] for t in CATALOG if t.endswith("_gid_redirect")},
    "artist_tag": ["artist", "tag"],
    "release_group_tag": ["release_group", "tag"],
    "artist_credit_name": ["artist_credit", "position"],
}

#: One row change: ``op`` is I, U or D; ``old`` and ``new`` are the rows as JSON objects.
CHANGE = "seq long, ts timestamp, tbl string, op string, old string, new string"

#: Append-only sync logs.
FLAGS = "entity string, gid string, seq long, ts timestamp, deleted boolean"
SYNCED = "entity string, gid string, seq long, ts timestamp"

LINK = "struct<target: string, type: string>"
IMAGE = "struct<CoverType: string, Url: string, remoteUrl: string>"
RATING = "struct<Count: int, Value: double>"
ALBUM_LIGHT = (
    "struct<id: string, oldids: array<string>, title: string, type: string, releasestatuses: array<string>, "
    f"secondarytypes: array<string>, releasedate: string, rating: {RATING}>"
)
ARTIST_DOC = (
    "id string, oldids array<string>, artistname string, sortname string, artistaliases array<string>, status string, "
    f"disambiguation string, type string, rating {RATING}, links array<{LINK}>, overview string, "
    f"albums array<{ALBUM_LIGHT}>, images array<{IMAGE}>, genres array<string>"
)
ARTIST_LIGHT_DOC = (
    "id string, oldids array<string>, artistname string, sortname string, artistaliases array<string>, status string, "
    f"disambiguation string, type string, rating {RATING}, links array<{LINK}>, overview string, "
    f"genres array<string>, images array<{IMAGE}>, albums array<string>"
)
MEDIUM = "struct<format: string, name: string, position: int>"
TRACK = (
    "struct<id: string, oldids: array<string>, recordingid: string, oldrecordingids: array<string>, artistid: string, "
    "trackname: string, durationms: int, mediumnumber: int, tracknumber: string, trackposition: int>"
)
RELEASE = (
    "struct<Id: string, Oldids: array<string>, Title: string, Disambiguation: string, Status: string, "
    "Releasedate: string, Label: array<string>, Country: array<string>, "
    f"Media: array<{MEDIUM}>, TrackCount: bigint, Tracks: array<{TRACK}>>"
)


def fields_of(struct: str) -> dict[str, DataType]:
    """Names and types of the fields of a struct type, in order."""
    return {f.name: f.dataType for f in StructType.fromDDL(f"v {struct}")["v"].dataType.fields}
