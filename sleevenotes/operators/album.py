"""Album documents: one per release group that has a lead artist."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.assemble import Child, assemble, flat_tables, repeated, within
from ..schemas import ARTIST_LIGHT_DOC, RELEASE, fields_of
from ..sources.work import written
from .artist import (
    Catalog,
    artist_light_docs,
    genres,
    group_release_date,
    lead_credit,
    led_groups,
    links,
    meta,
    redirects,
    secondary_types,
)
from .release import TRACK_TEXTS, placed_tracks, release_docs, release_groups


def album_base(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Scalar columns that do not come from the statistics table, with the row id and the lead artist's id."""
    kinds = cat["release_group_primary_type"].select(F.col("id").alias("type"), F.col("name").alias("type_name"))
    return (
        within(led_groups(cat), "id", ids)
        .join(kinds, "type", "left")
        .select(
            F.col("id").alias("row_id"),
            F.col("gid").alias("id"),
            F.col("comment").alias("disambiguation"),
            F.col("name").alias("title"),
            F.coalesce("type_name", F.lit(S.DEFAULT_ALBUM_TYPE)).alias("type"),
            F.col("artist_gid").alias("artistid"),
        )
    )


def group_artists(cat: Catalog, ids: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """``(release_group, artist_id, artist_gid)``, distinct: lead artists of the group and of all its tracks.

    Credits are made distinct per release group before they meet the artists, so a credit that holds a large share of
    all tracks is one row per group by then. ``placed``: the releases' ``placed_tracks`` with their groups, if the caller has them.
    """
    placed = placed_tracks(cat, groups=release_groups(cat, ids)) if placed is None else placed
    on_tracks = placed.select("release_group", "artist_credit")
    on_groups = within(cat["release_group"], "id", ids).select(F.col("id").alias("release_group"), "artist_credit")
    credits = on_tracks.unionByName(on_groups).filter("artist_credit is not null").distinct()
    return credits.join(lead_credit(cat), "artist_credit").select("release_group", "artist_id", "artist_gid").distinct()


def album_aliases(cat: Catalog, ids: DataFrame | None = None) -> Child:
    """Distinct aliases of the group and names of its releases that differ from the group's own name."""
    named = cat["release_group_alias"].filter(S.is_plain_alias(F.col("type"))).select("release_group", "name")
    releases = within(cat["release"].select("release_group", "name"), "release_group", ids)
    # names are made distinct per group before the join, so a group with very many releases meets it as few rows
    groups = cat["release_group"].select(F.col("id").alias("release_group"), F.col("name").alias("group_name"))
    differing = (
        releases.distinct().join(groups, "release_group").filter("name <> group_name").select("release_group", "name")
    )
    rows = within(named, "release_group", ids).unionByName(differing).distinct()
    return Child(rows, "release_group", F.col("name"))


def front_images(cat: Catalog, ids: DataFrame | None = None) -> dict[str, Child]:
    """The first image of type Front and the first of type Medium, by ordering, then image id."""
    releases = within(cat["release"].select(F.col("id").alias("release"), "release_group", "gid"), "release_group", ids)
    wanted = "array_contains(types, 'Front') or array_contains(types, 'Medium')"
    rows = cat["index_listing"].filter(wanted).join(releases, "release")
    entry = F.struct(F.col("ordering").isNull().alias("unordered"), "ordering", F.col("id").alias("image_id"), "gid")

    def first(kind: str) -> Child:
        return Child(rows, "release_group", F.when(F.array_contains("types", kind), entry), agg="min")

    return {"front": first("Front"), "medium": first("Medium")}


def images(release_id: Column, use_release_gid: bool = False) -> Column:
    """Cover, then Disc, those that exist.

    The address takes the album's id, as the existing documents have it; ``use_release_gid`` takes the id of the
    release the image belongs to.
    """

    def one(kind: str, name: str) -> Column:
        owner = F.col(f"{name}.gid") if use_release_gid else release_id
        return F.when(F.col(name).isNotNull(), S.image(kind, owner, F.col(f"{name}.image_id")))

    return F.filter(F.array(one("Cover", "front"), one("Disc", "medium")), lambda i: i.isNotNull())


def album_children(cat: Catalog, ids: DataFrame | None = None) -> dict[str, Child]:
    """The lists of albums except what they embed: their artists' and releases' documents."""
    return {
        "oldids": redirects(cat["release_group_gid_redirect"], ids),
        "aliases": album_aliases(cat, ids),
        "secondarytypes": secondary_types(cat, ids),
        "meta": meta(cat["release_group_meta"], ids),
        "links": links(cat["l_release_group_url"], cat, ids),
        "genres": genres(cat["release_group_tag"], "release_group", cat, ids),
        **front_images(cat, ids),
    }


def album_tables(cat: Catalog, ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Albums as a head table and one table per list, keyed by ``row_id``.

    ``artistids`` points to the artists and ``release_tables`` have the releases, so nothing is embedded.
    """
    children = album_children(cat, ids) | {
        "artistids": Child(group_artists(cat, ids), "release_group", F.col("artist_gid")),
    }
    return flat_tables(album_base(cat, ids), "row_id", children)


def album_docs(
    cat: Catalog,
    ids: DataFrame | None = None,
    use_release_gid: bool = False,
    embedded: Mapping[str, Collection[str]] | None = None,
) -> DataFrame:
    """Album documents.

    ``ids``: row ids of release groups to restrict to; many scans read it, so it should be a table and not a long plan.
    ``embedded``: the fields of the embedded ``artists``, ``Releases`` and ``Tracks`` that are wanted. An artist is embedded in very many
    albums, so a field that nobody reads is not carried there. What is not named has all its fields; every entry is there in any case.
    """
    fields = embedded or {}
    base = album_base(cat, ids)
    wanted = release_ids = None
    groups = release_groups(cat, ids)
    if ids is not None:
        groups = written(groups)
        release_ids = groups.select(F.col("release").alias("id"))
    own = None if "Releases" not in fields else {"Id", *fields["Releases"]}
    placed = placed_tracks(cat, groups=groups)
    if own is None or "Tracks" in own:
        unread = [c for c, f in TRACK_TEXTS.items() if f not in fields.get("Tracks", TRACK_TEXTS.values())]
        placed = listed = written(placed.drop(*unread))  # tracks are read once, for artists and for releases
    else:
        listed = None  # no release lists its tracks: they are read for the artists alone
    artists = written(group_artists(cat, ids, placed))  # feeds two lists
    if ids is not None:
        wanted = written(artists.select(F.col("artist_id").alias("id")).distinct())
    light = artist_light_docs(cat, wanted, None if "artists" not in fields else {"id", *fields["artists"]}, runs=("genres",))
    artist_types = fields_of(f"struct<{ARTIST_LIGHT_DOC}>")
    # equal genres go into the albums as one, and are written out there
    light_doc = F.struct(*[F.col(c) if c == "genres" else F.col(c).cast(artist_types[c]).alias(c) for c in artist_types if c in light.columns])
    # the pairs are narrow and the documents that join them wide: spread them first, not by the size of the pairs
    pairs = artists.select("release_group", F.col("artist_id").alias("row_id")).repartition("release_group", "row_id")
    embedded = pairs.join(light.select("row_id", light_doc.alias("artist")), "row_id")
    releases = release_docs(cat, ids, release_ids, listed, own, fields.get("Tracks"))
    types = {n: t for n, t in fields_of(RELEASE).items() if n in releases.columns}
    if "Tracks" in fields:
        types.pop("Tracks", None)  # as its rows are made: of the fields asked for
    release = F.struct(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in fields_of(RELEASE) if c in releases.columns])
    children = album_children(cat, ids) | {
        "artistids": Child(artists, "release_group", F.col("artist_gid")),
        "artists": Child(embedded, "release_group", F.col("artist"), (F.col("artist.id"),)),
        "Releases": Child(
            releases.select("release_group", release.alias("release")),
            "release_group",
            F.col("release"),
            (F.col("release.Id"),),
            dealt=listed is not None,
        ),
    }

    def whole(artist: Column) -> Column:
        return F.struct(*[(repeated(artist["genres"]) if c == "genres" else artist[c]).alias(c) for c in artist_types if c in light.columns])

    docs = assemble(base, "row_id", children)
    return docs.select(
        "id",
        "oldids",
        "disambiguation",
        "title",
        "aliases",
        "type",
        "secondarytypes",
        group_release_date("meta").alias("releasedate"),
        "artistid",
        "artistids",
        S.rating(F.col("meta.rating_count"), F.col("meta.rating")).alias("rating"),
        "links",
        "genres",
        images(F.col("id"), use_release_gid).alias("images"),
        "Releases",
        F.lit(None).cast("array<string>").alias("releasestatuses"),
        F.lit(None).cast("string").alias("overview"),
        (F.transform("artists", whole) if "genres" in light.columns else F.col("artists")).alias("artists"),
    )

