"""Ranked text search over documents: one query or a table of queries, by the same plan.

The index is the frame of postings ``(doc_id, attr_rank, item, pos, token)``. Query terms are matched against the
distinct tokens only, by equi join on shared pieces (see :func:`similar_tokens`); a stored index holds the pieces of all tokens.

Ranking has two phases. The first needs only which document has which token: it gives all measures but the distance of words, and bounds
for that. Documents that cannot reach the wanted rank under the best of their bounds, as enough others are ahead of them under the worst of
theirs, are dropped before any position is read (see :func:`candidates`).

Documents that are alike in all that a table of queries can read of them get the same measures, so only one of them is measured, and only the
first of them by the tie fields can be hits (see :func:`alike`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.work import written

# Fixed values of the ranking: word break, lengths from which one and two typos pass, distance of words apart.
WORD = r"[\p{L}\p{N}]+"
ONE_TYPO_LENGTH = 5
TWO_TYPOS_LENGTH = 9
APART = 8


@dataclass(frozen=True)
class Typos:
    """Term lengths from which one and two typos are allowed."""

    one: int = ONE_TYPO_LENGTH
    two: int = TWO_TYPOS_LENGTH

    def budget(self, length: Column) -> Column:
        return F.when(length < self.one, 0).when(length < self.two, 1).otherwise(2)


def tokens(text: Column) -> Column:
    # unlike split(), this compiles its pattern once and not for every text
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def postings(docs: DataFrame, searchable: tuple[str, ...]) -> DataFrame:
    """One row per word of the searchable fields, all fields in one pass over the documents.

    ``attr_rank`` counts from 1 in order of weight. A field that is a list has one ``item`` per element; words of
    different items are never close to each other.
    """

    def values(rank: int, field: str) -> Column:
        column = F.col(field)
        listed = column if docs.select(column).schema[0].dataType.typeName() == "array" else F.array(column)
        return F.transform(
            listed, lambda text, i: F.struct(F.lit(rank).alias("attr_rank"), i.cast("long").alias("item"), text.alias("text"))
        )

    entries = F.concat(*[values(i + 1, f) for i, f in enumerate(searchable)])
    items = docs.select(F.col("id").alias("doc_id"), F.inline(entries))
    words = items.select("doc_id", "attr_rank", "item", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    return words


def _piece(i: Column, n: Column, budget: Column) -> tuple[Column, Column]:
    """Start (from 0) and end of piece i of a term of length n."""
    pieces = budget + 1
    return F.floor(i * n / pieces).cast("int"), F.floor((i + 1) * n / pieces).cast("int")


def token_pieces(vocabulary: DataFrame, typos: Typos = Typos()) -> DataFrame:
    """``(n, i, piece, token)``: what piece i of a term of length n may be, if the token is within that length's budget.

    A term with budget b is cut into b + 1 even pieces; b edits cannot touch them all, so a similar token contains one
    piece unchanged, at most b places off (the partition scheme published as Pass-Join). A token of any length has
    a bounded number of pieces.
    """
    n, budget, size = F.col("n"), F.col("budget"), F.length("token")
    start, end = _piece(F.col("i"), n, budget)
    return (
        vocabulary.select("token", F.explode(F.sequence(F.greatest(size - 2, F.lit(1)), size + 2)).alias("n"))
        .withColumn("budget", typos.budget(n))
        .filter(F.abs(n - size) <= budget)
        .withColumn("i", F.explode(F.sequence(F.lit(0), budget)))
        .withColumn("first", F.greatest(start - budget, F.lit(0)))
        .withColumn("last", F.least(start + budget, size - (end - start)))
        .filter("first <= last")
        .withColumn("at", F.explode(F.sequence(F.col("first"), F.col("last"))))
        .select("n", "i", F.col("token").substr(F.col("at") + 1, end - start).alias("piece"), "token")
        .distinct()
    )


def similar_tokens(
    terms: DataFrame, vocabulary: DataFrame | None, typos: Typos = Typos(), pieces: DataFrame | None = None
) -> DataFrame:
    """``(term, token, typo)``: all pairs within each term's typo budget. Both inputs are distinct.

    The join is on equal pieces instead of on all pairs. With stored ``pieces`` (of the same ``typos``) only the terms are cut.
    """
    n, budget = F.col("n"), F.col("budget")
    start, end = _piece(F.col("i"), n, budget)
    cut = (
        terms.select("term", F.length("term").alias("n"))
        .withColumn("budget", typos.budget(n))
        .withColumn("i", F.explode(F.sequence(F.lit(0), budget)))
        .select("term", "n", "budget", "i", F.col("term").substr(start + 1, end - start).alias("piece"))
    )
    probes = pieces if pieces is not None else token_pieces(vocabulary, typos)
    pairs = probes.join(cut, ["n", "i", "piece"]).select("term", "token", "budget").distinct()
    typo = F.when(budget == 0, F.when(F.col("term") == F.col("token"), 0).otherwise(-1)).otherwise(
        F.least(F.levenshtein("term", "token", 2), F.lit(3))
    )
    return pairs.withColumn("typo", typo).filter((F.col("typo") >= 0) & (F.col("typo") <= budget)).drop("budget")


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, terms, term_no, term)``: distinct words of each query ``(query_id, query)``, in order."""
    words = F.array_distinct(tokens(F.col("query")))
    return queries.select("query_id", F.size(words).alias("terms"), F.posexplode(words).alias("term_no", "term"))


@dataclass(frozen=True)
class Index:
    """What searches read: postings, ``holders`` (token, doc_id, attr_rank: its best field), pieces of tokens, and tie fields by ``id``."""

    postings: DataFrame
    holders: DataFrame
    pieces: DataFrame
    documents: DataFrame
    typos: Typos = Typos()


def holders(words: DataFrame) -> DataFrame:
    """Which document has which token, with the rank of the best field that has it."""
    return words.groupBy("token", "doc_id").agg(F.min("attr_rank").alias("attr_rank"))


def index_of(words: DataFrame, docs: DataFrame, typos: Typos = Typos()) -> Index:
    """An index that is not stored, of postings and documents."""
    return Index(words, holders(words), token_pieces(words.select("token").distinct(), typos), docs, typos)


def write_index(docs: DataFrame, searchable: tuple[str, ...], tie_breaks: tuple[str, ...], path: str, typos: Typos = Typos()) -> None:
    """Store an :class:`Index` of documents.

    Postings and holders are laid out by token and document, so a query reads few row groups, and a token with very many postings
    spans several files instead of making one huge one. Pieces are laid out by piece.
    """
    spark = docs.sparkSession
    roots, texts = (sorted({f.split(".")[0] for f in fields}) for fields in (tie_breaks, searchable))
    # the documents are made once, for both parts of the index and for the sample that lays the postings out
    docs = written(docs.select("id", *sorted({*roots, *texts})))
    docs.select("id", *roots).write.mode("overwrite").parquet(f"{path}/documents")
    words = postings(docs, searchable)
    laid_out = words.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
    laid_out.write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(words.schema).parquet(f"{path}/postings")
    holding = holders(stored)
    holding.sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(f"{path}/holders")
    vocabulary = spark.read.schema(holding.schema).parquet(f"{path}/holders").select("token").distinct()
    cut = token_pieces(vocabulary, typos)
    cut.repartitionByRange("piece", "n").sortWithinPartitions("piece", "n").write.mode("overwrite").parquet(f"{path}/pieces")


def read_index(spark: SparkSession, path: str, typos: Typos = Typos()) -> Index:
    """A stored index; ``typos`` as it was written with."""
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "holders", "pieces", "documents")), typos)


def matched_terms(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, terms, term_no, token, typo)``: the tokens that match each word of each query."""
    terms = query_terms(queries)
    pairs = similar_tokens(terms.select("term").distinct(), None, index.typos, index.pieces)
    return terms.join(pairs, "term").select("query_id", "terms", "term_no", "token", "typo")


def measures(matched: DataFrame, holding: DataFrame) -> DataFrame:
    """Measures that need no positions, of every document with at least one word of a query.

    ``words`` that match, ``typo`` (sum of the least typos per matched word), ``attribute`` (rank of the best field), ``exactness`` (words
    matched without a typo); ``adjacent``: pairs of neighbouring query words of which both match, the only ones that can be near.
    """
    hits = matched.join(holding, "token").select("query_id", "terms", "doc_id", "term_no", "typo", "attr_rank")
    # one shuffle serves both aggregates
    words = hits.repartition("query_id", "doc_id").groupBy("query_id", "doc_id", "terms", "term_no").agg(
        F.min("typo").alias("typo"), F.min("attr_rank").alias("attr_rank")
    )
    found = words.groupBy("query_id", "doc_id", "terms").agg(
        F.count("*").alias("words"), F.sum("typo").alias("typo"), F.min("attr_rank").alias("attribute"),
        F.count_if(F.col("typo") == 0).alias("exactness"), F.collect_list("term_no").alias("nos"),
    )
    following = F.transform("nos", lambda no: no + 1)
    return found.withColumn("adjacent", F.size(F.array_intersect("nos", following))).drop("nos")


def farthest(terms: str = "terms") -> Column:
    """The proximity of a document where no two neighbouring query words are near each other."""
    return F.lit(APART) * (F.col(terms) - 1)


def candidates(found: DataFrame, limit: int) -> DataFrame:
    """The :func:`measures` of the documents that may be among the first ``limit`` of their query.

    A document is out if ``limit`` others are ahead of it whatever the positions are: their measures with the largest proximity
    that they can have come before its own with the smallest. What comes after these measures in the ranking is not needed for that, as
    documents that are level stay in.
    """

    def key(proximity: Column) -> Column:
        return F.struct(
            (-F.col("words")).alias("words"), F.col("typo"), proximity.alias("proximity"), F.col("attribute"),
            (-F.col("exactness")).alias("exactness"),
        )

    worst, best = key(farthest()), key(farthest() - (APART - 1) * F.col("adjacent"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("worst"))
    # Spark keeps at most ``limit`` rows per query and task before this shuffle
    first = found.select("query_id", worst.alias("worst")).withColumn("place", place).filter(F.col("place") <= limit)
    cuts = first.groupBy("query_id").agg(F.max("worst").alias("cut"), F.count("*").alias("n"))
    return found.join(cuts, "query_id").filter((F.col("n") < limit) | (best <= F.col("cut"))).drop("cut", "n")


def alike(words: DataFrame) -> DataFrame:
    """``(doc_id, like)``: documents with the same ``like`` have the same measures for every query that reads these postings alone.

    What counts of a document is which words its values have, how far apart, and the rank of each value's field; which of several alike values
    it is, and where in the value its words begin, does not. ``like`` is the SHA-256 of that. One shuffle, by document, serves both aggregates.
    """
    values = words.repartition("doc_id").groupBy("doc_id", "attr_rank", "item").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("w"))
    shifted = F.transform("w", lambda x: F.struct((x["pos"] - F.col("w")[0]["pos"]).alias("pos"), x["token"].alias("token")))
    read = values.select("doc_id", F.struct("attr_rank", shifted.alias("w")).alias("value"))
    whole = read.groupBy("doc_id").agg(F.sort_array(F.collect_set("value")).alias("read"))
    return whole.select("doc_id", F.sha2(F.to_json(F.struct("read")), 256).alias("like"))


def closeness(matched: DataFrame, index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(query_id, doc_id, closer)`` of the wanted ``(query_id, doc_id)``: by how much neighbouring words are nearer than APART.

    Per two neighbouring query words the least distance in one value counts; in reverse order it is one more than the places between them.
    """
    hits = matched.join(index, "token").join(wanted, ["query_id", "doc_id"])
    # every hit counts as left and right neighbour of a pair (pair i: words i and i + 1)
    no = F.col("term_no")
    roles = F.array(
        F.struct(F.when(no < F.col("terms") - 1, F.lit("left")).alias("role"), no.alias("pair")),
        F.struct(F.when(no > 0, F.lit("right")).alias("role"), (no - 1).alias("pair")),
    )
    used = hits.select("query_id", "doc_id", "attr_rank", "item", "pos", F.inline(roles)).filter("role is not null")
    before = (
        Window.partitionBy("query_id", "doc_id", "attr_rank", "item", "pair")
        .orderBy("pos")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    left = F.max(F.when(F.col("role") == "left", F.col("pos"))).over(before)
    right = F.max(F.when(F.col("role") == "right", F.col("pos"))).over(before)
    apart = F.when(F.col("role") == "right", F.col("pos") - left).when(
        F.col("role") == "left", F.col("pos") - right + 1
    )
    near = used.withColumn("near", F.least(apart, F.lit(APART))).groupBy("query_id", "doc_id", "pair").agg(F.min("near").alias("near"))
    return near.groupBy("query_id", "doc_id").agg(F.sum(F.lit(APART) - F.coalesce("near", F.lit(APART))).alias("closer"))


def with_proximity(found: DataFrame, matched: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``proximity``: per two neighbouring query words the least distance in one value, APART at most and if never together."""
    near = closeness(matched, index, found.filter("adjacent > 0").select("query_id", "doc_id"))
    return found.join(near, ["query_id", "doc_id"], "left").withColumn("proximity", farthest() - F.coalesce("closer", F.lit(0)))


def score(index: Index, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, words, typo, proximity, attribute, exactness)`` for every match of at least one word."""
    matched = matched_terms(index, queries)
    scored = with_proximity(measures(matched, index.holders), matched, index.postings)
    return scored.select("query_id", "doc_id", "words", "typo", "proximity", "attribute", "exactness")


def search_batch(
    index: Index, queries: DataFrame, limit: int = 10, tie_breaks: tuple[str, ...] = ("rating.Value",)
) -> DataFrame:
    """The best ``limit`` documents of each query, with their measures and ``rank``.

    Of documents that are :func:`alike` only the first is measured, and the first ``limit`` by the tie fields are ranked; Spark keeps at most so
    many per kind and task before a shuffle. So the pairs of queries and documents grow with the kinds of documents, not with their number.
    """
    matched = written(matched_terms(index, queries))
    words = index.postings.join(matched.select("token").distinct(), "token", "left_semi")
    keys = [f"tie_{i}" for i in range(len(tie_breaks))]
    ties = index.documents.select(
        F.col("id").alias("doc_id"), *[F.col(t).alias(k) for t, k in zip(tie_breaks, keys)]
    )
    among_equals = [*[F.col(k).desc_nulls_last() for k in keys], F.col("doc_id").asc()]
    order = [
        F.col("words").desc(),
        F.col("typo").asc(),
        F.col("proximity").asc(),
        F.col("attribute").asc(),
        F.col("exactness").desc(),
        *among_equals,
    ]
    of_kind = F.row_number().over(Window.partitionBy("like").orderBy(*among_equals))
    first = written(alike(words).join(ties, "doc_id").withColumn("place", of_kind).filter(F.col("place") <= limit))
    measured = first.filter("place = 1").select("doc_id", "like")
    words = written(words.join(measured.select("doc_id"), "doc_id", "left_semi"))
    found = written(candidates(measures(matched, holders(words)), limit))
    scored = with_proximity(found, matched, words).join(measured, "doc_id").drop("doc_id").join(first.drop("place"), "like")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ranked = scored.withColumn("rank", place).filter(F.col("rank") <= limit)
    return ranked.select(
        "query_id", "rank", "doc_id", "words", "typo", "proximity", "attribute", "exactness",
        *[F.col(k).alias(t.split(".")[-1].lower()) for t, k in zip(tie_breaks, keys)],
    )


def search_all(artists: Index, albums: Index, queries: DataFrame, limit: int = 5) -> DataFrame:
    """Artists, then albums, ``limit`` of each: ``(query_id, position, score, kind, doc_id)``.

    ``position`` orders the joint list; ``score`` is 1 for every hit.
    """
    first = search_batch(artists, queries, limit).select("query_id", "rank", "doc_id", F.lit("artist").alias("kind"))
    second = search_batch(albums, queries, limit, ("rating.Value", "releasedate")).select(
        "query_id", "rank", "doc_id", F.lit("album").alias("kind")
    )
    both = first.unionByName(second)
    # at most 2 x limit rows per query
    place = Window.partitionBy("query_id").orderBy(F.col("kind").desc(), "rank")
    return both.select(
        "query_id", F.row_number().over(place).alias("position"), F.lit(1).alias("score"), "kind", "doc_id"
    )


def items(hits: DataFrame, artists: DataFrame, albums: DataFrame) -> DataFrame:
    """Hits of :func:`search_all` with their documents: ``{score, artist, album}``, the other one null."""
    artist = artists.select(F.col("id").alias("doc_id"), F.struct(*artists.columns).alias("artist"))
    album = albums.select(F.col("id").alias("doc_id"), F.struct(*albums.columns).alias("album"))
    return hits.join(artist, "doc_id", "left").join(album, "doc_id", "left").select(
        "query_id", "position", "score", "artist", "album"
    )
