"""Personal data: base rules for four kinds, and bootstrapped contextual extraction of what those rules miss.

A place is a run of words that hold a digit or an @, which all that the base rules can match lies in; two regular expressions over the
text find the places and what is around them. Base rules run on the places. A place with a base span is a seed, with the span's text as its value; other places,
and their single words, are open slots if they look like an identifier (MIN_DIGITS digits or an @, at most LONGEST characters).

Lexical patterns of a slot are its two words before; the word before and the word after; the word before and the shape of the value. Patterns and
distinct values are a bipartite graph. In each round the confidence of a pattern for a kind is the sum of the scores of its values over their
number + 1, so that values not known count against it; patterns with SUPPORT and CONFIDENCE are kept, and a value that kept patterns extract gets the score
1 - prod(1 - confidence). Values with CONFIDENCE are known in the next round. After ROUNDS, or when nothing changes, all open slots with
a known value are added as spans of its kind. A value that has the form of a kind and fails its check (Luhn, parts over 255, digits) is a counterexample: it
weakens patterns and is never added.

All of it is column expressions; only places, patterns and values are shuffled, never texts, and values and patterns are counted before joins.

Defined cases: a null text is an empty one and has no spans. Positions are in code points, ends exclusive. Repeated rows and ids are judged each;
ids may be null and of any type. Without seeds nothing is added. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleevenotes.llm.text import SPACES, parts, positions
from sleevenotes.sources.work import shared_folder, written

KINDS = ("email", "ip", "card", "phone")
#: The base rules, written so that matching never goes back over what it has read.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MARKED = r"[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
PLACE = rf"(?<![^ \t-\r]){_MARKED}(?: [ ().-]*+{_MARKED})*+"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"
#: Characters before and after a place that patterns are made of.
AROUND = 48
MIN_DIGITS = 5
LONGEST = 64
SUPPORT = 5
CONFIDENCE = 0.8
ROUNDS = 4
BLOCK = 64


# -- matches with their positions ------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, though lambdas within the body read it for each of their elements."""
    return F.transform(F.array(value), body)[0]


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers of an array, in blocks, so that long arrays cost little more than their length."""

    def sums(part: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("s"), F.lit(0).alias("t"))
        return F.aggregate(
            part, start, lambda acc, x: F.struct(F.concat(acc.s, F.array(acc.t + x)).alias("s"), (acc.t + x).alias("t"))
        )

    def joined(blocks: Column) -> Column:
        return let(
            sums(F.transform(blocks, lambda b: b.t)).s,
            lambda ends: F.flatten(
                F.transform(blocks, lambda b, k: F.transform(b.s, lambda v: v + F.when(k > 0, F.get(ends, k - 1)).otherwise(0)))
            ),
        )

    def in_blocks(a: Column) -> Column:
        n = F.ceil(F.size(a) / BLOCK).cast("int")
        return let(F.transform(positions(n), lambda k: sums(F.slice(a, k * BLOCK + 1, BLOCK))), joined)

    return let(numbers, in_blocks)


def matches(text: Column, rule: str) -> Column:
    """The matches of a rule (``found``: start, value), and what is around them (``gaps``)."""

    def placed(m: Column) -> Column:
        steps = F.transform(
            m.all, lambda v, k: F.length(F.get(m.gaps, k)) + F.when(k > 0, F.length(F.get(m.all, k - 1))).otherwise(0)
        )
        return let(
            running_sums(steps),
            lambda starts: F.struct(
                F.transform(m.all, lambda v, k: F.struct(F.get(starts, k).alias("start"), v.alias("value"))).alias("found"),
                m.gaps.alias("gaps"),
            ),
        )

    cut = F.struct(F.split(text, rule, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(rule), F.lit(0)).alias("all"))
    return let(cut, placed)


def n_digits(value: Column) -> Column:
    return F.length(value) - F.length(F.translate(value, "0123456789", ""))


def luhn(value: Column) -> Column:
    """Whether the digits pass, every second from the right doubled."""
    digits = F.reverse(F.split(F.translate(value, " -", ""), ""))
    total = F.aggregate(
        F.transform(digits, lambda c, k: F.when(k % 2 == 0, F.ascii(c) - 48).otherwise(2 * (F.ascii(c) - 48) - F.when(c > "4", 9).otherwise(0))),
        F.lit(0), lambda t, v: t + v,
    )
    return total % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a match of a kind's rule."""
    if kind == "card":
        return F.when(n_digits(value).between(12, 19), luhn(value)).otherwise(F.lit(False))
    return {"email": F.lit(True), "ip": value.rlike(OCTETS), "phone": n_digits(value).between(9, 15)}[kind]


def passed(found: Column, rank: int, start: Column) -> Column:
    """Spans of the matches that pass their kind's check."""
    good = F.filter(found, lambda m: passes(KINDS[rank], m.value))
    return F.transform(
        good,
        lambda m: F.struct(
            (start + m.start).alias("start"), F.lit(rank).alias("rank"), (start + m.start + F.length(m.value)).alias("end"),
            m.value.alias("value"),
        ),
    )


def with_base_spans(df: DataFrame, text: str, start: str) -> DataFrame:
    """Adds ``base``: spans (start, rank, end, value) of column ``text`` by start, then kind, where ``start`` is added to positions."""
    each = [passed(matches(F.col(text), RULES[kind]).found, rank, F.col(start)) for rank, kind in enumerate(KINDS)]
    return df.withColumn("base", F.array_sort(F.concat(*each)))


# -- places and slots ------------------------------------------------------------------------------------------------


def places(docs: DataFrame) -> DataFrame:
    """Each row with a number of its own and its places: (start, value, before, after)."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def around(m: Column) -> Column:
        return F.transform(
            m.found,
            lambda p, k: F.struct(
                p.start.alias("start"), p.value.alias("value"), F.substring(F.get(m.gaps, k), -AROUND, AROUND).alias("before"),
                F.substring(F.get(m.gaps, k + 1), 1, AROUND).alias("after"),
            ),
        )

    return numbered.select("row", "doc_id", let(matches(F.col("text"), PLACE), around).alias("places"))


PREFIX = r"^(?:[A-Za-z_-]+[:=])?[^A-Za-z0-9+(]*"
SUFFIX = r"(?<![^A-Za-z0-9)])[^A-Za-z0-9)]++$"


def open_slots(rest: DataFrame) -> DataFrame:
    """Slots of places without base spans: the whole place (part 0) and, if it has several words, each word."""
    whole = F.struct(F.lit(0).alias("part"), F.lit(0).alias("offset"), F.col("value").alias("text"))

    def single(words: Column) -> Column:
        return let(
            running_sums(F.transform(words, lambda w: F.length(w) + 1)),
            lambda ends: F.transform(
                words,
                lambda w, k: F.struct((k + 1).alias("part"), (F.get(ends, k) - F.length(w) - 1).alias("offset"), w.alias("text")),
            ),
        )

    several = F.concat(F.array(whole), let(F.split("value", " "), single))
    each = F.when(F.contains("value", F.lit(" ")), several).otherwise(F.array(whole))
    rows = rest.select("row", "at", "start", "value", "before", "after", F.inline(each))
    skipped = F.length(F.regexp_extract("text", PREFIX, 0))
    rows = rows.withColumn("skipped", skipped).withColumn(
        "name", F.expr("substring(text, skipped + 1)")
    ).withColumn("name", F.regexp_replace("name", SUFFIX, ""))
    is_like = ((n_digits(F.col("name")) >= MIN_DIGITS) | F.contains("name", F.lit("@"))) & (F.length("name") <= LONGEST)
    first = F.col("offset") + F.col("skipped")
    ahead, behind = F.expr("substring(value, 1, offset + skipped)"), F.expr("substring(value, offset + skipped + length(name) + 1)")
    return rows.filter(is_like).select(
        "row", "at", "part", (F.col("start") + first).alias("start"), (F.col("start") + first + F.length("name")).alias("end"),
        F.lower("name").alias("value"), F.concat("before", ahead).alias("before"), F.concat(behind, "after").alias("after"),
        shape(F.col("name")).alias("shape"), is_counterexample(F.col("name")).alias("counter"),
    )


def seed_slots(found: DataFrame) -> DataFrame:
    """The first base span of each place that has one."""
    first = F.get("base", 0)
    offset = first.start - F.col("start")
    rows = found.withColumn("offset", offset).withColumn("name", first.value).withColumn("rank", first.rank)
    ahead, behind = F.expr("substring(value, 1, offset)"), F.expr("substring(value, offset + length(name) + 1)")
    return rows.select(
        F.lower("name").alias("value"), F.concat("before", ahead).alias("before"), F.concat(behind, "after").alias("after"),
        shape(F.col("name")).alias("shape"), "rank",
    )


def shape(value: Column) -> Column:
    """Letters as one a; runs of digits as S (up to 3), M (up to 7) or L; the rest as it is."""
    letters = F.regexp_replace(value, r"\p{L}+", "a")
    for rule, mark in ((r"[0-9]{8,}", "L"), (r"[0-9]{4,7}", "M"), (r"[0-9]{1,3}", "S")):
        letters = F.regexp_replace(letters, rule, mark)
    return letters


def is_counterexample(value: Column) -> Column:
    """Whether all of the value has the form of a kind whose check it fails, and of no kind whose check it passes."""
    forms = [(value.rlike(f"^{RULES[k]}$"), passes(k, value)) for k in KINDS]
    fails = reduce(Column.__or__, (form & ~good for form, good in forms))
    return fails & ~reduce(Column.__or__, (form & good for form, good in forms))


def patterns(slots: DataFrame) -> DataFrame:
    """Each slot's value with each of its patterns."""
    plain = lambda c: parts(F.translate(F.lower(c), "123456789", "000000000"), SPACES)
    cut = slots.withColumns({"_l": plain(F.col("before")), "_r": plain(F.col("after"))})
    left = lambda k: F.coalesce(F.get("_l", F.size("_l") - k), F.lit("^"))
    right = F.coalesce(F.get("_r", F.lit(0)), F.lit("$"))
    each = F.array(
        F.concat_ws(" ", left(2), left(1), F.lit("_")), F.concat_ws(" ", left(1), F.lit("_"), right),
        F.concat_ws(" ", left(1), F.lit("_"), F.concat(F.lit("like "), F.col("shape"))),
    )
    return cut.select("value", F.explode(each).alias("pattern"))


# -- scores ----------------------------------------------------------------------------------------------------------


def pattern_scores(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Kept patterns: pattern, rank of the kind, confidence."""
    scored = edges.join(known, "value", "left")
    sums = [F.sum(F.when(F.col("rank") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))]
    best = F.array_max(F.array(*(F.struct(F.col(f"s{k}").alias("sum"), F.lit(-k).alias("minus_rank")) for k in range(len(KINDS)))))
    totals = scored.groupBy("pattern").agg(F.count("*").alias("n"), *sums).select("pattern", "n", best.alias("best"))
    kept = totals.select("pattern", (-F.col("best.minus_rank")).alias("rank"), F.col("best.sum").alias("support"),
                         F.round(F.col("best.sum") / (F.col("n") + 1), 9).alias("confidence"))
    return kept.filter((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))


def discovered(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Values that kept patterns extract with enough confidence: value, rank, score."""
    doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
    each = edges.filter("open").join(kept.select("pattern", "rank", "confidence"), "pattern").groupBy("value", "rank").agg(
        F.round(1 - doubt, 9).alias("score")
    )
    best = each.groupBy("value").agg(F.max(F.struct("score", (-F.col("rank")).alias("minus_rank"))).alias("best"))
    return best.select("value", (-F.col("best.minus_rank")).alias("rank"), F.col("best.score").alias("score")).filter(
        F.col("score") >= CONFIDENCE
    )


@dataclass
class Extraction:
    """Tables in the shared folder: rows (row, doc_id), spans (row, start, end, rank, added), kept patterns, known values."""

    rows: DataFrame
    spans: DataFrame
    patterns: DataFrame
    values: DataFrame


def extracted(docs: DataFrame, rounds: int = ROUNDS) -> Extraction:
    folder = shared_folder(docs.sparkSession)
    rows = written(places(docs), folder)
    each = rows.select("row", F.posexplode("places").alias("at", "p")).select("row", "at", "p.*")
    found = written(with_base_spans(each, "value", "start"), folder)
    slots = written(open_slots(found.filter(F.size("base") == 0)), folder)
    seeds = written(seed_slots(found.filter(F.size("base") > 0)), folder)

    known_first = seeds.groupBy("value").agg(F.min("rank").alias("rank"), F.lit(1.0).alias("score"))
    pairs = patterns(seeds.select("value", "before", "after", "shape")).withColumn("open", F.lit(False)).unionByName(
        patterns(slots.select("value", "before", "after", "shape", "counter")).select("value", "pattern").withColumn("open", F.lit(True))
    )
    barred = slots.filter("counter").select("value").distinct().withColumn("barred", F.lit(True))
    distinct = pairs.groupBy("pattern", "value").agg(F.max("open").alias("open"))
    edges = written(
        distinct.join(barred, "value", "left").join(known_first.select("value", "rank"), "value", "left").select(
            "pattern", "value", (F.col("open") & F.col("barred").isNull() & F.col("rank").isNull()).alias("open")
        ),
        folder,
    )
    first = written(known_first, folder)
    known, n = first, -1
    kept = written(pattern_scores(edges, known), folder)
    for _ in range(rounds):
        new = written(discovered(edges, kept), folder)
        more = new.count()
        known = first.unionByName(new)
        if more == n or not more:
            break
        n, kept = more, written(pattern_scores(edges, known), folder)
    wanted = slots.filter("not counter").join(known.select("value", "rank"), "value")
    # a whole place hides its words
    added = wanted.join(wanted.filter("part = 0").select("row", "at", F.lit(True).alias("hidden")), ["row", "at"], "left").filter(
        "part = 0 or hidden is null"
    )
    base = found.select("row", F.inline("base")).select("row", "start", "end", "rank", F.lit(False).alias("added"))
    spans = base.unionByName(added.select("row", "start", "end", "rank", F.lit(True).alias("added")))
    return Extraction(rows.select("row", "doc_id"), spans, kept, known)


def documents_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each row's doc_id and ``spans``: (start, rank, kind, end, added) by start, then kind."""
    out = extracted(docs, rounds)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1)
    lists = out.spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "rank", "end", kind.alias("kind"), "added"))).alias("spans")
    )
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,added:boolean>>")
    return out.rows.join(lists, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(each, ",")
