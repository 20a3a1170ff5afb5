"""Aggregations over cells.

SUM in exact mode is correctly rounded and independent of order, and still aggregates map-side: each double is written as digits of
26 bits, counted from the lowest place of a window of magnitudes, and a group's sum is one sum of longs for each digit.  One window
holds the magnitudes from 2^-65 to 2^64, so nearly all groups have one; the others put theirs together.  All of it is columns of
Spark's own, without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    numeric: bool


# The aggregations and whether they take numbers only.
AGGREGATES = {"sum": Aggregate(True), "avg": Aggregate(True), "min": Aggregate(True), "max": Aggregate(True), "count": Aggregate(False)}
#: Sums with a finite number of at least this size are NaN.
HUGE = 2.0**960
#: Bits of a digit, digits of a window, digits from one window to the next, bits so; windows on either side of that of 1; minus the power of its lowest place,
#: two below that of its least number (which a logarithm may miss by one).  A digit's sum holds 2^34 rows and more.
DIGIT, DIGITS, STEP, WINDOWS = 26, 7, 5, 8
WIDTH = DIGIT * STEP
LOWEST = WIDTH // 2 + 54


def least(v: Column) -> Column:
    """MIN with NaN if any value is NaN, and -0.0 below 0.0."""
    low = F.min(v)
    negative = F.bool_or((v == 0) & (v.cast("string") == "-0.0"))
    return F.when(F.bool_or(F.isnan(v)), F.lit(float("nan"))).when((low == 0) & negative, F.lit(-0.0)).otherwise(low)


def most(v: Column) -> Column:
    """MAX; NaN if any value is NaN, and 0.0 above -0.0."""
    high = F.max(v)
    positive = F.bool_or((v == 0) & (v.cast("string") == "0.0"))
    return F.when(F.isnan(high), high).when((high == 0) & positive, F.lit(0.0)).otherwise(high)


def _whole(parts: Column) -> Column:
    """The correctly rounded sum of a group's windows.

    A lambda over an array of one element names a value that is used again: the expression stays small wherever Catalyst copies it to, and keys stay free for filters to pass."""
    zero, mask = F.lit(0).cast("long"), F.lit(2**DIGIT - 1).cast("long")
    once = lambda x, f: F.aggregate(F.array(x), F.lit(0.0), lambda _, y: f(y))
    at = lambda p, a: a - (p["w"] + WINDOWS) * STEP
    every = F.sequence(F.lit(0), F.lit(2 * WINDOWS * STEP + DIGITS + 2))
    # one window's digits, or those of several at their places among all; three more for carries
    several = F.transform(every, lambda a: F.aggregate(parts, zero, lambda s, p: s + F.when(at(p, a).between(0, DIGITS - 1), F.get(p["d"], at(p, a))).otherwise(zero)))
    digits = F.when(F.size(parts) > 1, several).otherwise(F.concat(parts[0]["d"], F.array(zero, zero, zero)))
    low = F.when(F.size(parts) > 1, F.lit(0)).otherwise((parts[0]["w"] + WINDOWS) * STEP)

    def carried(sums: Column) -> Column:
        step = lambda s, d: F.struct(F.shiftright(d + s["c"], DIGIT).alias("c"), F.concat(s["g"], F.array((d + s["c"]).bitwiseAND(mask))).alias("g"))
        return F.aggregate(sums, F.struct(zero.alias("c"), F.array().cast("array<bigint>").alias("g")), step)

    def rounded(g: Column, low: Column) -> Column:
        """One addition of two exact doubles, so it is rounded once; below 2^-1022 a sum of doubles is a double itself, and scaling it in two steps is exact."""
        pair = lambda k: F.get(g, k) * F.lit(2**DIGIT).cast("long") + F.get(g, k - 1)
        top = F.greatest(F.lit(3), F.array_max(F.transform(g, lambda d, i: F.when(d != 0, i).otherwise(F.lit(0)))))
        more = lambda k: F.when(F.exists(F.slice(g, F.lit(1), k - 3), lambda d: d != 0), F.lit(1)).otherwise(F.lit(0)).cast("long")
        power = lambda k: (k - 3 + low - WINDOWS * STEP) * DIGIT - LOWEST
        scale = lambda k: F.pow(F.lit(2.0), F.shiftright(power(k), 1)), lambda k: F.pow(F.lit(2.0), power(k) - F.shiftright(power(k), 1))
        return once(top, lambda k: (pair(k).cast("double") * 2.0 ** (2 * DIGIT) + pair(k - 2).bitwiseOR(more(k)).cast("double")) * scale[0](k) * scale[1](k))

    minus = lambda sums: F.transform(sums, lambda d: -d)
    return once(F.struct(digits.alias("d"), low.alias("low")), lambda x: once(carried(x["d"]), lambda s: F.when(s["c"] < 0, once(carried(minus(x["d"])), lambda t: -rounded(t["g"], x["low"]))).otherwise(rounded(s["g"], x["low"]))))


def exact_sum(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """keys, v (the sum) and n (rows) per group; no row without cells."""
    x = F.col(v)
    size, plain = F.abs(x), ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0)
    window = F.when(~plain | size.between(2.0 ** (-WIDTH // 2), 2.0 ** (WIDTH // 2 - 1)), F.lit(0)).otherwise(F.floor((F.floor(F.log2(size)) + WIDTH // 2) / WIDTH).cast("int"))
    df = df.select(*keys, x.alias("_v"), window.alias("_w"))
    x, size = F.col("_v"), F.abs(F.col("_v"))
    up = F.lit(LOWEST) - F.col("_w") * WIDTH
    half = F.shiftright(up, 1)
    scaled = F.when(F.isnan(x) | (size == float("inf")), F.lit(0.0)).when(F.col("_w") == 0, x * 2.0**LOWEST).otherwise(x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half))
    odd = F.when(F.isnan(x) | ((size >= HUGE) & (size != float("inf"))), F.lit(1)).when(x == float("inf"), F.lit(2)).when(x == float("-inf"), F.lit(4)).otherwise(F.lit(0))
    df = df.select(*keys, "_w", odd.alias("_odd"), scaled.alias("_y"))
    whole = [F.rint(F.col("_y") * 2.0 ** (-DIGIT * i)) for i in range(DIGITS)]
    digits = [(whole[i] - whole[i + 1] * float(2**DIGIT) if i + 1 < DIGITS else whole[i]).cast("long") for i in range(DIGITS)]
    part = df.groupBy(*keys, "_w").agg(*(F.sum(d).alias(f"_d{i}") for i, d in enumerate(digits)), F.count("*").alias("_n"), F.bit_or("_odd").alias("_odd"))
    part = part.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_w").alias("w"), F.array(*(f"_d{i}" for i in range(DIGITS))).alias("d"))).alias("_parts"), F.sum("_n").alias("n"), F.bit_or("_odd").alias("_odd")).where("n > 0")
    odd = F.col("_odd")
    special = F.when((odd.bitwiseAND(1) != 0) | (odd.bitwiseAND(6) == 6), F.lit(float("nan"))).when(odd.bitwiseAND(2) != 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    # a sum is never null, which this says to Catalyst: it drops filters for that
    return part.select(*keys, F.coalesce(F.when(odd != 0, special).otherwise(_whole(F.col("_parts"))), F.lit(0.0)).alias(v), "n")


def aggregate_all(df: DataFrame, keys: list[str], aggs: list[str], exact: bool = False) -> DataFrame:
    """keys and a column for each aggregation, from one pass over the cells; exact sums take one more beside MIN and MAX."""
    v = F.col("v")
    plain = {"sum": F.sum(v), "avg": F.avg(v), "min": least(v), "max": most(v), "count": F.count("*").cast("double")}
    summed = exact and bool({"sum", "avg"} & set(aggs))
    rest = [a for a in aggs if not summed or a in ("min", "max")]
    parts = []
    if summed:
        from_sum = {"sum": F.col("v"), "avg": F.col("v") / F.col("n"), "count": F.col("n").cast("double")}
        parts.append(exact_sum(df, keys).select(*keys, *(from_sum[a].alias(a) for a in aggs if a in from_sum)))
    if rest:
        parts.append(df.groupBy(*keys).agg(*(plain[a].alias(a) for a in rest), F.count("*").alias("_n")).where("_n > 0").drop("_n"))
    if len(parts) == 1:
        return parts[0]
    return parts[0].join(parts[1], keys) if keys else parts[0].crossJoin(parts[1])


def aggregate(df: DataFrame, keys: list[str], agg: str, exact: bool = False) -> DataFrame:
    """keys, v: the cells of df (key columns, v) aggregated; a group exists if it has a cell."""
    if agg in ("sum", "avg") and exact:
        out = exact_sum(df, keys)
        return out.select(*keys, (F.col("v") / F.col("n") if agg == "avg" else F.col("v")).alias("v"))
    v = F.col("v")
    how = {"sum": F.sum(v), "avg": F.avg(v), "min": least(v), "max": most(v), "count": F.count("*").cast("double"), "first": F.first(v)}[agg]
    out = df.groupBy(*keys).agg(how.alias("v"), F.count("*").alias("_n"))
    return out.where("_n > 0").drop("_n")  # without keys Spark gives a row even if there is no cell
