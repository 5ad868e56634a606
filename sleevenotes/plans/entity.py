"""The two document families, described once, and the builds over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.assemble import within
from ..operators.album import album_base, album_docs, album_tables
from ..operators.artist import Catalog, artist_base, artist_docs, artist_tables
from ..operators.sync import mark_synced, unsynced
from ..sources.documents import DocumentStore
from ..sources.work import written

NIL_GID = "00000000-0000-0000-0000-000000000000"


@dataclass(frozen=True)
class Entity:
    """A document family: its table, how its documents are built (nested, their scalars, flat), and how they are searched.

    ``searchable``: document fields in order of weight. ``tie_breaks``: fields that order hits alike in all text
    measures, greatest first. ``unrepeated``: lists that are made distinct by the ids of what they name, so that no member comes twice.
    """

    name: str
    index: str
    build: Callable[..., DataFrame]
    base: Callable[..., DataFrame]
    tables: Callable[..., dict[str, DataFrame]]
    searchable: tuple[str, ...]
    filterable: tuple[str, ...]
    tie_breaks: tuple[str, ...]
    unrepeated: tuple[str, ...] = ()


ARTIST = Entity(
    name="artist",
    index="artists",
    build=artist_docs,
    base=artist_base,
    tables=artist_tables,
    # fixed values: the names and order that searches and filters are asked with
    searchable=("artistname", "sortname", "artistaliases"),
    filterable=("id", "oldids", "genres", "type", "status"),
    tie_breaks=("rating.Value",),
)
ALBUM = Entity(
    name="release_group",
    index="albums",
    build=album_docs,
    base=album_base,
    tables=album_tables,
    searchable=("title", "aliases", "artists.artistname"),
    filterable=("id", "oldids", "genres", "type", "artistid", "artistids"),
    tie_breaks=("rating.Value", "releasedate"),
    unrepeated=("artistids",),
)
ENTITIES = (ARTIST, ALBUM)


def documented(entity: Entity, cat: Catalog) -> DataFrame:
    """``(id, gid)`` of the entities that have a document: all artists, and release groups with a lead artist."""
    rows = cat[entity.name]
    if entity.name == "release_group":
        first = cat["artist_credit_name"].filter("position = 0").select("artist_credit", F.col("artist").alias("id"))
        rows = rows.join(within(first, "id", cat["artist"]), "artist_credit", "left_semi")
    return rows.select("id", "gid")


def page(entity: Entity, cat: Catalog, after: str = NIL_GID, size: int = 100, **options: object) -> DataFrame:
    """Documents of the first ``size`` entities with a gid beyond ``after``, by gid.

    The page is cut from the entity table before any document is assembled; its ids then restrict every child table.
    """
    ids = documented(entity, cat).filter(F.col("gid") > after).orderBy("gid").limit(size).select("id")
    return entity.build(cat, ids=written(ids), **options).orderBy("id")


def bulk_build(
    entity: Entity, cat: Catalog, store: DocumentStore, seq: int, ts: Column, version: int = 0, ranges: int = 1
) -> DataFrame:
    """Write all documents of a family as the store's base, then return their marks for the ``synced`` log.

    ``seq`` and ``ts``: the last change that the tables hold. If the write fails, nothing is marked. With ``ranges`` the build goes through
    so many ranges of ids one after the other; each finished range is noted, and a build that is started again with the same version
    skips it. The limits of the ranges are drawn once and stored.
    """
    if ranges == 1:
        store.write_base(entity.build(cat), version)
    else:
        ids = documented(entity, cat)
        for k, low, high in store.ranges(version, ids.select("gid"), ranges):
            if store.has(f"range-{k}", version):
                continue
            own = ids.filter((F.col("gid") >= low) & (F.col("gid") < high if high is not None else F.lit(True)))
            store.write_range(entity.build(cat, ids=written(own.select("id"))), k, version)
        store.finish_base(version)
    done = documented(entity, cat).select(F.lit(entity.name).alias("entity"), "gid")
    return mark_synced(done, F.lit(seq), ts)


def ids_of(entity: Entity, cat: Catalog, gids: DataFrame) -> DataFrame:
    """Row ids of gids (column ``gid``)."""
    return within(cat[entity.name].select("id", "gid"), "gid", gids, "gid").select("id")


def documents_of(entity: Entity, cat: Catalog, gids: DataFrame, **options: object) -> DataFrame:
    """Documents with the given gids (column ``gid``), built from their own rows only."""
    return entity.build(cat, ids=written(ids_of(entity, cat, gids)), **options)


def incremental_build(
    entity: Entity, cat: Catalog, state: DataFrame, **options: object
) -> tuple[DataFrame, DataFrame]:
    """Documents of all unsynced entities, and ``(id)`` of those that must go (tombstones).

    An unsynced entity that has no document any more, be it deleted or left without a lead artist, is a tombstone.
    The unsynced ids are written once and restrict every child table before assembly.
    """
    due = written(unsynced(state, entity.name).select("gid"))
    docs = entity.build(cat, ids=written(ids_of(entity, cat, due)), **options)
    gone = due.join(documented(entity, cat), "gid", "left_anti").select(F.col("gid").alias("id"))
    return docs, gone
