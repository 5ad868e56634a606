"""Host names of other scripts in their ASCII form (punycode, RFC 3492), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of RFC 3492.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
PREFIX = "xn--"
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits that a number below 2^63 has at most.
MOST_DIGITS = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _times(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number has been written."""
    damped = F.when(first, F.floor(delta / DAMP)).otherwise(F.floor(delta / 2))
    spread = damped + F.floor(damped / points)
    limit = (BASE - T_MIN) * T_MAX // 2
    start = F.struct(spread.alias("d"), F.lit(0).cast("long").alias("k"))
    halved = F.aggregate(
        _times(MOST_DIGITS), start,
        lambda s, _: F.when(s.d > limit, F.struct(F.floor(s.d / (BASE - T_MIN)).alias("d"), (s.k + BASE).alias("k"))).otherwise(s),
    )
    return _let(halved, lambda s: s.k + F.floor((BASE - T_MIN + 1) * s.d / (s.d + SKEW)))


def _number(delta: Column, bias: Column) -> Column:
    """A number in digits whose weights depend on the bias."""

    def digit(q: Column) -> Column:
        return F.substring(F.lit(DIGITS), (q + 1).cast("int"), F.lit(1))

    def step(s: Column, k: Column) -> Column:
        return _let(
            F.greatest(F.lit(T_MIN).cast("long"), F.least(F.lit(T_MAX).cast("long"), k * BASE - s.bias)),
            lambda t: F.when(s.done, s)
            .when(s.q < t, F.struct(F.concat(s.out, digit(s.q)).alias("out"), s.q.alias("q"), s.bias.alias("bias"), F.lit(True).alias("done")))
            .otherwise(
                F.struct(
                    F.concat(s.out, digit(t + (s.q - t) % (BASE - t))).alias("out"), F.floor((s.q - t) / (BASE - t)).alias("q"),
                    s.bias.alias("bias"), F.lit(False).alias("done"),
                )
            ),
        )

    start = F.struct(F.lit("").alias("out"), delta.alias("q"), bias.alias("bias"), F.lit(False).alias("done"))
    return F.aggregate(_times(MOST_DIGITS), start, step, lambda s: s.out)


def _encoded(codes: Column) -> Column:
    """Code points of a label in punycode, without the prefix."""
    basic = F.filter(codes, lambda c: c < FIRST_CODE)
    others = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST_CODE)))
    n_basic = F.size(basic).cast("long")

    def state(out: Column, n: Column, delta: Column, bias: Column, h: Column) -> Column:
        return F.struct(out.alias("out"), n.alias("n"), delta.alias("delta"), bias.alias("bias"), h.alias("h"))

    def insert(s: Column, code: Column) -> Column:
        """All places of one code point."""

        def place(t: Column, c: Column) -> Column:
            written = state(
                F.concat(t.out, _number(t.delta, t.bias)), t.n, F.lit(0).cast("long"), _adapted(t.delta, t.h + 1, t.h == n_basic), t.h + 1
            )
            more = state(t.out, t.n, t.delta + 1, t.bias, t.h)
            return F.when(c == t.n, written).when(c < t.n, more).otherwise(t)

        begun = state(s.out, code, s.delta + (code - s.n) * (s.h + 1), s.bias, s.h)
        after = F.aggregate(codes, begun, place)
        return _let(after, lambda t: state(t.out, t.n + 1, t.delta + 1, t.bias, t.h))

    letters = F.array_join(F.transform(basic, lambda c: F.chr(c)), "")
    first = F.when(n_basic > 0, F.concat(letters, F.lit("-"))).otherwise(letters)
    long = lambda v: F.lit(v).cast("long")
    return F.aggregate(others, state(first, long(FIRST_CODE), long(0), long(FIRST_BIAS), n_basic), insert, lambda s: s.out)


def ascii_label(label: Column) -> Column:
    """A label of a host name as name servers know it; one in ASCII is as it was.

    The label is lower-cased before; other mappings of international names (compositions, wide forms) are not made.
    """
    codes = F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("long"))
    other = F.concat(F.lit(PREFIX), _let(codes, _encoded))
    return F.when(F.length(label) == F.octet_length(label), label).otherwise(other)
