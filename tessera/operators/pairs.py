"""First pair of elements that sums to a target, by an equi join with first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_sum(df: DataFrame, target: Column | float) -> DataFrame:
    """(series, pair) for rows (series, pos, x): [i, j] with the least j that has a partner before it, and the last such i.

    Only the last of equal elements before j matters; a series without a pair
    gives an empty array. NaN pairs with nothing.
    """
    rows = df.filter(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))).select("series", "pos", "x", ((target if isinstance(target, Column) else F.lit(target)) - F.col("x")).alias("need"))
    firsts = rows.groupBy("series", "x").agg(F.min("pos").alias("f")).select(F.col("series").alias("s"), F.col("x").alias("a"), "f")
    # a row has at most one first partner, so what the join gives grows as the rows do
    later = rows.join(firsts, (F.col("series") == F.col("s")) & (F.col("need") == F.col("a"))).filter("f < pos")
    best = later.groupBy("series").agg(F.min(F.struct(F.col("pos").alias("j"), "need")).alias("m")).select(F.col("series").alias("s"), "m.j", F.col("m.need").alias("wanted"))
    last = rows.join(best, (F.col("series") == F.col("s")) & (F.col("x") == F.col("wanted"))).filter("pos < j")
    pairs = last.groupBy("series").agg(F.max("pos").alias("i"), F.first("j").alias("j")).select("series", F.array("i", "j").alias("pair"))
    every = df.select("series").distinct().join(pairs, "series", "left")
    return every.select("series", F.coalesce("pair", F.array().cast("array<bigint>")).alias("pair"))
