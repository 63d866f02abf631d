"""Exact order statistics and quantiles by rounds of counting, so that no task holds a group's values.

A double's bits, the lower 63 flipped if it is negative, are a long of the same order. Each round counts the values below a
known prefix of those bits by their next 16 bits, and finds the digit where each wanted rank falls; a group whose
remaining values are few takes all bits that are left at once. Four rounds at most, each one pass and one pre-aggregated shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.tables import written

ALL_BUT_SIGN = 2**63 - 1


def ordered_bits(value: Column) -> Column:
    """A long that sorts as the double does; both zeros are one, NaN comes last."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(ALL_BUT_SIGN)))


def double_of(bits: Column) -> Column:
    """The double of ordered_bits()."""
    raw = F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(ALL_BUT_SIGN)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _round(rows: DataFrame, wanted: DataFrame, keys: list[str], known: int, shift: int) -> DataFrame:
    """wanted(keys, prefix, rank, asked, n) with longer prefixes: the bits from `shift` up, of which those from `known` up were found."""
    below = rows.withColumn("prefix", F.lit(0).cast("long") if known == 64 else F.shiftright("o", known))
    if known < 64:
        below = below.join(wanted.select(*keys, "prefix").distinct(), [*keys, "prefix"], "left_semi")
    counts = below.groupBy(*keys, "prefix", F.shiftright("o", shift).alias("next")).agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*keys, "prefix")  # 65,536 digits, or the few values left
    place = counts.withColumn("rank", F.sum("n").over(inside.orderBy("next").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    none = F.lit(None).cast("long")
    both = place.select(*keys, "prefix", "rank", F.lit(0).alias("mark"), "next", "n", none.alias("asked")).unionByName(
        wanted.select(*keys, "prefix", "rank", F.lit(1).alias("mark"), none.alias("next"), none.alias("n"), "asked")
    )
    so_far = inside.orderBy("rank", "mark").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("digit", F.max(F.when(F.col("mark") == 0, F.struct("rank", "next", "n"))).over(so_far)).where("mark = 1")
    return found.select(*keys, F.col("digit.next").alias("prefix"), (F.col("rank") - F.col("digit.rank")).alias("rank"), "asked", F.col("digit.n").alias("n"))


def order_statistics(rows: DataFrame, asked: DataFrame, keys: list[str], whole: int = 100_000) -> DataFrame:
    """rows(keys, o) in ordered bits, asked(keys, asked, n): the values of 0-based ranks `asked` below each group's size n,
    ranks distinct -> keys, asked, value. Rows and ranks are read in each round, so both should be tables."""
    wanted, known = asked.select(*keys, F.lit(0).cast("long").alias("prefix"), F.col("asked").alias("rank"), "asked", "n"), 64
    while known:
        most = wanted.agg(F.max("n")).first()[0]
        shift = 0 if most is None or most <= whole else known - 16
        wanted, known = written(_round(rows, wanted, keys, known, shift)), shift
    return wanted.select(*keys, "asked", double_of(F.col("prefix")).alias("value"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], whole: int = 100_000) -> DataFrame:
    """Exact quantiles of value by keys, interpolated between neighbours -> keys, i (place in `at`), q. Nulls are left out, NaN
    counts as the largest; groups without a value, and null keys, have no row."""
    rows = written(df.where(F.col(value).isNotNull()).select(*keys, ordered_bits(F.col(value)).alias("o")).dropna(subset=keys or ["o"]))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0")
    spot = (F.col("n") - 1) * F.col("p")
    each = written(sizes.select(*keys, "n", F.inline(places)).select(*keys, "n", "i", spot.alias("spot"), F.floor(spot).alias("low"), F.ceil(spot).alias("high")))
    asked = each.select(*keys, "n", F.explode(F.array("low", "high")).alias("asked")).distinct()
    got = order_statistics(rows, asked, keys, whole)
    low, high = got.withColumnsRenamed({"asked": "low", "value": "a"}), got.withColumnsRenamed({"asked": "high", "value": "b"})
    met = each.join(low, [*keys, "low"]).join(high, [*keys, "high"])
    between = (F.col("high") - F.col("spot")) * F.col("a") + (F.col("spot") - F.col("low")) * F.col("b")
    return met.select(*keys, "i", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(between).alias("q"))
