"""Allow and block rules for URLs as a sort-merge range join.

A host is written with its labels reversed and each closed by a dot (``net.example.www.``), so a rule's host and all its subdomains
are one interval of keys. Rule hosts and page hosts are sorted together into ranges; a sweep over them keeps the stack of rule hosts that are
active, and each page takes the stack at its place. Below each rule host the rules' paths are intervals again
(``net.example.`` + NUL + ``/en/``), and a second sweep finds the longest path that fits. Of the rules found, the longest (host and path
together) decides.

The ranges are cut by key and row, so a host with any share of the pages is spread over many tasks; the stack that is active where a
range begins comes from the ranges before it, one row per range. Stacks are as deep as rules are nested, not as many as rules.

Defined cases: a null URL or one without ``://`` has empty host and path and no rule; a host or path in rules is compared as it
is, upper-case A-Z lower-cased in hosts only; of equal rules block wins; of rules of equal length the one with the longer host; without
a rule the default applies; repeated pages are judged each; empty tables of pages or rules are fine. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleevenotes.llm.text import ascii_lower
from sleevenotes.sources.work import shared_folder, written

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
END = "\U0010ffff"  # sorts after every other character
NUL = "\u0000"
RULE_TYPE = "host string, path string, action string"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def sweep(points: DataFrame, intervals: DataFrame, folder: str) -> DataFrame:
    """The points (key, row and more) with ``stack``: the payloads of the intervals that hold the key, outermost first.

    intervals: low (included), stack (payloads from the outermost to its own). They hold all keys that begin with low, so they are nested.
    """
    own = [c for c in points.columns if c not in ("key", "row")]
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in own]
    size = F.length("low")
    starts = intervals.select(F.col("low").alias("key"), F.lit(1).alias("kind"), size.alias("rank"), F.col("stack").alias("state"))
    outer = F.slice("stack", 1, F.size("stack") - 1)
    ends = intervals.select(F.concat("low", F.lit(END)).alias("key"), F.lit(0).alias("kind"), (-size).alias("rank"), outer.alias("state"))
    events = starts.unionByName(ends).select(*("key", "kind", "rank", "state"), F.lit(None).cast("long").alias("row"), *nothing)
    state_type = intervals.schema["stack"].dataType
    placed = points.select(
        "key", F.lit(2).alias("kind"), F.lit(0).alias("rank"), F.lit(None).cast(state_type).alias("state"), "row", *own
    )
    order = ("key", "kind", "rank", "row")
    ranged = written(
        placed.unionByName(events).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), folder
    )
    last = ranged.filter("kind < 2").groupBy("range").agg(F.max_by("state", F.struct("key", "kind", "rank")).alias("state"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    carried = (
        ranged.select("range").distinct().join(last, "range", "left")
        .select("range", F.last("state", ignorenulls=True).over(before).alias("carried"))
    )
    so_far = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = ranged.withColumn("seen", F.last("state", ignorenulls=True).over(so_far)).filter("kind = 2")
    stack = F.coalesce("seen", "carried", F.array().cast(state_type))
    return seen.join(F.broadcast(carried), "range").select("key", "row", *own, stack.alias("stack"))  # one row per range


def _nested(keys: DataFrame, outer: Column, payload: str) -> DataFrame:
    """low and stack of each key: itself and those keys of the same table that it begins with, by ``outer``, its candidates."""
    pairs = keys.select(F.col("low"), F.explode(outer).alias("begin")).distinct()
    found = pairs.join(keys.select(F.col("low").alias("begin"), payload), "begin")
    stacks = found.groupBy("low").agg(F.sort_array(F.collect_list(F.struct(F.length("begin").alias("n"), payload))).alias("s"))
    return stacks.select("low", F.transform("s", lambda x: x[payload]).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null) and verdict of each page."""
    folder = shared_folder(pages.sparkSession)
    tidy = (
        rules.filter("host is not null and path is not null and action is not null and host != ''")
        .groupBy(ascii_lower(F.col("host")).alias("host"), "path")
        .agg(F.max("action").alias("action"))  # 'block' after 'allow'
        .withColumn("reversed", reversed_host(F.col("host")))
    )
    tidy = written(tidy, folder)
    hosts = tidy.select(F.col("reversed").alias("low"), F.col("reversed").alias("payload")).distinct()
    labels = F.filter(F.split("low", "(?<=\\.)"), lambda x: x != "")
    begins = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), ""))
    host_intervals = _nested(hosts, begins, "payload")
    parsed = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row")
    ).withColumn("key", reversed_host(F.col("host")))
    located = written(sweep(parsed, host_intervals, folder), folder)

    path_keys = tidy.select(
        F.concat("reversed", F.lit(NUL), "path").alias("low"), F.struct("host", "path", "action").alias("payload"), "reversed", "path"
    )
    paths = F.transform(
        F.sequence(F.lit(0), F.length("path")), lambda k: F.concat("reversed", F.lit(NUL), F.substring(F.col("path"), F.lit(1), k))
    )
    path_intervals = _nested(path_keys, paths, "payload")
    probes = located.select("row", "path", F.explode("stack").alias("reversed")).select(
        "row", F.concat("reversed", F.lit(NUL), "path").alias("key")
    )
    fitting = sweep(probes, path_intervals, folder).filter(F.size("stack") > 0).select("row", F.element_at("stack", -1).alias("rule"))
    longest = F.struct(
        (F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("h"), F.col("rule.host").alias("host"),
        F.col("rule.path").alias("path"), F.col("rule.action").alias("action"),
    )
    best = fitting.groupBy("row").agg(F.max(longest).alias("best"))
    return located.join(best, "row", "left").select(
        "page_id", "host", located["path"], F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


def rules_frame(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules from (action, host/path) pairs."""
    rows = [(text.partition("/")[0], "/" + text.partition("/")[2], action) for action, text in rules]
    return spark.createDataFrame(rows, RULE_TYPE)
