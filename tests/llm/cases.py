"""Small tables with the odd rows that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names operators might want for themselves
        T.StructField("words", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("key", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("c0", T.StringType()),
    ]
)
PROSE = "The river bends below the old mill, and the road follows it north past farms and orchards. "
LONG = " ".join(f"word{i} goes here, then word{i * 7 % 1001} follows." for i in range(6_000))


def prose(k: int) -> str:
    return PROSE + " ".join(f"Traveller {k + i} met farmer {k * 3 + i} near gate {k * 7 + i}." for i in range(12))


def odd_documents(spark):
    extra = ("w", 1.0, 1, "l", "q", "c")
    rows = [
        (0, prose(0), "en", "a", 10, *extra),
        (1, prose(0), "en", "a", 10, *extra),
        (1, prose(0), "en", "a", 10, *extra),
        (2, None, None, None, None, *extra),
        (3, "", "en", "b", 0, *extra),
        (4, " \n\t ", None, "b", 4, *extra),
        (5, "?!? ... 123", "en", "b", 11, *extra),
        (None, prose(50), "en", "c", 10, *extra),
        (None, None, "en", "c", None, *extra),
        (6, LONG, "en", "c", len(LONG), *extra),
        (7, "one", "en", None, 3, *extra),
        (8, "two  words\x0b   and  \U0001f600 spaces  ", "en", "d", 9, *extra),
        (9, "same same same same same same " * 20, "en", "d", 9, None, None, None, None, None, None),
        *((20 + k, prose(100 * (k + 1)), "en", "e", 10, *extra) for k in range(8)),
        (40, "ÉCOLE École école straße ÀÉ " * 15, "fr", "e", 10, *extra),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
