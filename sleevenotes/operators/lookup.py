"""Lookups, attribute filters and sorts over finished documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.assemble import within
from .artist import Catalog, lead_credit


def by_id(docs: DataFrame, gid: str) -> DataFrame:
    """The document with this id; empty if there is none."""
    return docs.filter(F.col("id") == gid)


def by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """All documents whose id is in column ``id`` of ``ids``."""
    return within(docs, "id", ids)


def by_recordings(albums: DataFrame, recordings: DataFrame) -> DataFrame:
    """All albums that contain one of the recordings in column ``recordingid``.

    Only ids leave the nested lists; the documents meet the reduced album ids.
    """
    tracks = albums.select("id", F.explode("Releases").alias("release")).select(
        "id", F.explode("release.Tracks.recordingid").alias("recordingid")
    )
    found = within(tracks, "recordingid", recordings, "recordingid").select("id").distinct()
    return within(albums, "id", found)


def albums_of_recordings(cat: Catalog, recordings: DataFrame) -> DataFrame:
    """``(gid)`` of the release groups whose documents contain one of the recordings in column ``recordingid``.

    The same answer as :func:`by_recordings`, from key columns: no document is built to find it.
    """
    wanted = within(cat["recording"].filter("video = false").select("id", "gid"), "gid", recordings, "recordingid")
    tracks = within(cat["track"].filter("is_data_track = false"), "recording", wanted.select("id"))
    tracks = within(tracks, "artist_credit", lead_credit(cat), "artist_credit")
    media = within(cat["medium"].select("id", "release"), "id", tracks, "medium")
    releases = within(cat["release"].select("id", "status", "release_group"), "id", media, "release")
    releases = within(releases, "status", cat["release_status"])
    return within(cat["release_group"].select("id", "gid"), "id", releases, "release_group").select("gid")


def filter_by(docs: DataFrame, filterable: tuple[str, ...], **conditions: str) -> DataFrame:
    """Documents that meet all conditions; a condition on a list field asks for a member."""
    for name, value in conditions.items():
        if name not in filterable:
            raise ValueError(f"{name} is not filterable; use one of {filterable}")
        is_list = docs.schema[name].dataType.typeName() == "array"
        docs = docs.filter(F.array_contains(name, value) if is_list else F.col(name) == value)
    return docs


def sort_by(docs: DataFrame, *fields: str) -> DataFrame:
    """Documents by the fields, greatest first, absent last; ties by id."""
    return docs.orderBy(*[F.col(f).desc_nulls_last() for f in fields], "id")


def without_tracks(albums: DataFrame) -> DataFrame:
    """Albums whose releases come without their tracks."""
    return albums.withColumn("Releases", F.transform("Releases", lambda r: r.dropFields("Tracks")))
