"""Release documents: dates, labels, countries, media and tracks of a release."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.assemble import Child, assemble, flat_tables, list_per_key, within
from ..schemas import MEDIUM, RELEASE, TRACK, fields_of
from ..sources.work import written
from .artist import Catalog, lead_credit, redirects


def release_base(cat: Catalog, group_ids: DataFrame | None = None) -> DataFrame:
    """Releases that have a status, with the release group's row id."""
    names = cat["release_status"].select(F.col("id").alias("status"), F.col("name").alias("status_name"))
    return (
        within(cat["release"], "release_group", group_ids)
        .join(names, "status")
        .select(
            F.col("id").alias("row_id"),
            "release_group",
            F.col("gid").alias("Id"),
            F.col("name").alias("Title"),
            F.col("comment").alias("Disambiguation"),
            F.col("status_name").alias("Status"),
        )
    )


def release_date(cat: Catalog, ids: DataFrame | None = None) -> Child:
    """Earliest full date over all countries, known and unknown; only without one the earliest filled date."""
    columns = ["release", "date_year", "date_month", "date_day"]
    parts = [F.col(c) for c in columns[1:]]
    known = within(cat["release_country"].select(columns), "release", ids)
    rows = known.unionByName(within(cat["release_unknown_country"].select(columns), "release", ids))
    full, filled = S.full_date(*parts), S.filled_date(*parts)
    dated = rows.select("release", full.isNull().alias("partial"), F.coalesce(full, filled).alias("date"))
    return Child(dated, "release", F.struct("partial", "date"), agg="min", where=F.col("date").isNotNull())


def release_labels(cat: Catalog, ids: DataFrame | None = None) -> Child:
    pairs = within(cat["release_label"].select("release", "label"), "release", ids)
    names = cat["label"].select(F.col("id").alias("label"), "name")
    return Child(pairs.join(names, "label"), "release", F.col("name"))


def release_countries(cat: Catalog, ids: DataFrame | None = None) -> Child:
    """Areas that are countries. The two small tables are joined one by one, each by its own checked size."""
    pairs = within(cat["release_country"].select("release", "country"), "release", ids)
    names = cat["area"].select(F.col("id").alias("country"), "name")
    rows = pairs.join(cat["country_area"].select(F.col("area").alias("country")), "country").join(names, "country")
    return Child(rows, "release", F.col("name"))


def release_media(cat: Catalog, ids: DataFrame | None = None) -> dict[str, Child]:
    """Media that have a format, by position; the track count is over all media."""
    media = within(cat["medium"].select("id", "release", "format", "name", "position", "track_count"), "release", ids)
    formats = cat["medium_format"].select(F.col("id").alias("format"), F.col("name").alias("format_name"))
    rows = media.join(formats, "format", "left")
    value = F.struct(F.col("format_name").alias("format"), "name", "position").cast(MEDIUM)
    order = (F.col("position"), F.col("id"))
    return {
        "Media": Child(rows, "release", value, order, where=F.col("format_name").isNotNull()),
        "TrackCount": Child(rows, "release", F.col("track_count"), agg="sum"),
    }


def release_groups(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """``(release, release_group)``, distinct. ``ids``: row ids of release groups to restrict to."""
    return within(cat["release"].select(F.col("id").alias("release"), "release_group"), "release_group", ids).distinct()


def placed_tracks(
    cat: Catalog, releases: DataFrame | None = None, column: str = "row_id", by_gid: bool = False, groups: DataFrame | None = None
) -> DataFrame:
    """All tracks with the release and the number of their medium, in one pass over tracks and media.

    ``releases``: frame with the ids of the releases to keep; applied to media before the track scan's first shuffle.
    ``by_gid``: the release is its gid instead of its row id; the media, which are fewer and narrower, meet the releases for it.
    ``groups``: :func:`release_groups`; only tracks of these releases are kept, and they get the release group in the same way.
    """
    media = cat["medium"].select(F.col("id").alias("medium"), "release", F.col("position").alias("mediumnumber"))
    media = within(media, "release", releases, column)
    if by_gid:
        media = media.join(cat["release"].select(F.col("id").alias("release"), "gid"), "release")
        media = media.select("medium", F.col("gid").alias("release"), "mediumnumber")
    if groups is not None:
        media = media.join(groups, "release")
    return cat["track"].join(media, "medium").drop("medium")


#: Columns of tracks that serve one field of theirs alone.
TRACK_TEXTS = {"name": "trackname", "length": "durationms", "number": "tracknumber"}
#: What the tracks of a release are in order of.
TRACK_ORDER = ("mediumnumber", "trackposition", "id")


def track_rows(
    cat: Catalog, releases: DataFrame | None = None, placed: DataFrame | None = None, fields: Collection[str] | None = None
) -> DataFrame:
    """``(release, track)``: audio tracks with medium, lead artist, recording and former ids; with the release group where ``placed`` has it.

    ``placed``: the :func:`placed_tracks`, if the caller has them; else they are read, of ``releases`` only. Of ``fields``, if given,
    only what these are made of is read; the fields that order the tracks stay.
    """
    wanted = fields_of(TRACK) if fields is None else {n: t for n, t in fields_of(TRACK).items() if n in fields or n in TRACK_ORDER}
    placed = placed_tracks(cat, releases) if placed is None else placed
    recordings = cat["recording"].filter("video = false").select(F.col("id").alias("recording"), F.col("gid").alias("recordingid"))
    if "oldrecordingids" in wanted:
        old_recordings = list_per_key(redirects(cat["recording_gid_redirect"]), "oldrecordingids")
        recordings = recordings.join(old_recordings.withColumnRenamed("new_id", "recording"), "recording", "left")
    lead = lead_credit(cat).select("artist_credit", F.col("artist_gid").alias("artistid"))
    none = F.array().cast("array<string>")
    values = {
        "id": F.col("gid"),
        "oldids": F.coalesce("oldids", none),
        "oldrecordingids": F.coalesce("oldrecordingids", none),
        "trackname": F.col("name"),
        "durationms": F.col("length"),
        "tracknumber": F.col("number"),
        "trackposition": F.col("position"),
    }
    track = F.struct(*[values.get(n, F.col(n)).cast(t).alias(n) for n, t in wanted.items()])
    # every join may move all tracks: those that make them wider come last
    rows = placed.filter("is_data_track = false")
    if "oldids" in wanted:
        old_tracks = list_per_key(redirects(cat["track_gid_redirect"]), "oldids")
        rows = rows.join(old_tracks.withColumnRenamed("new_id", "id"), "id", "left")
    rows = rows.join(lead, "artist_credit").join(recordings, "recording")
    return rows.select(*[c for c in ("release_group", "release") if c in placed.columns], track.alias("track"))


def release_children(
    cat: Catalog, base: DataFrame, ids: DataFrame | None = None, placed: DataFrame | None = None, tracks: Collection[str] | None = None
) -> dict[str, Child]:
    """The lists of releases. ``ids``: row ids of the releases to keep, if they are restricted; ``tracks``: fields of theirs, if not all."""
    wanted = base if ids is None else ids.select(F.col("id").alias("row_id"))
    return {
        "Oldids": redirects(cat["release_gid_redirect"], ids),
        "date": release_date(cat, ids),
        "Label": release_labels(cat, ids),
        "Country": release_countries(cat, ids),
        **release_media(cat, ids),
        "Tracks": Child(
            track_rows(cat, wanted, placed, tracks),
            "release",
            F.col("track"),
            tuple(F.col(f"track.{n}") for n in TRACK_ORDER),
        ),
    }


def _based(
    cat: Catalog,
    group_ids: DataFrame | None,
    ids: DataFrame | None,
    placed: DataFrame | None = None,
    tracks: Collection[str] | None = None,
) -> tuple[DataFrame, dict[str, Child]]:
    base = release_base(cat, group_ids)
    if ids is None and group_ids is not None:
        ids = written(base.select(F.col("row_id").alias("id")))
    return base, release_children(cat, base, ids, placed, tracks)


def release_tables(cat: Catalog, group_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Release documents as a head table and one table per list (``Tracks``, ``Media``, ...), keyed by ``row_id``."""
    base, children = _based(cat, group_ids, None)
    return flat_tables(base, "row_id", children)


def release_docs(
    cat: Catalog,
    group_ids: DataFrame | None = None,
    ids: DataFrame | None = None,
    placed: DataFrame | None = None,
    fields: Collection[str] | None = None,
    tracks: Collection[str] | None = None,
) -> DataFrame:
    """Release documents with the release group's row id, dealt by it if ``placed`` has it.

    Tracks are far more than releases. With the group on each of them, they are moved once, to where the group's document is made.

    ``group_ids``: row ids of release groups to restrict to. ``ids``: the row ids of their releases, ``placed``: their
    :func:`placed_tracks`, if the caller has them. ``fields``, ``tracks``: fields of the documents and of their tracks; only what these
    are made of is read. Without them all are built.
    """
    base, children = _based(cat, group_ids, ids, placed, tracks)
    names = [n for n in fields_of(RELEASE) if fields is None or n in fields]
    children = {n: c for n, c in children.items() if n in names or (n == "date" and "Releasedate" in names)}
    if placed is not None and "release_group" in placed.columns and "Tracks" in children:
        tracks_of = {"Tracks": children.pop("Tracks")}
        docs = assemble(assemble(base, "row_id", children), "row_id", tracks_of, by="release_group")
    else:
        docs = assemble(base, "row_id", children)
    date = S.date_text(F.col("date.date")).alias("Releasedate")
    return docs.select("row_id", "release_group", *[date if n == "Releasedate" else F.col(n) for n in names])
