"""Connected components of a graph given by edges, and joins that a hot key can't skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut_table, shuffles_removed

#: Keys with more than a HEAVY-th of all rows are joined by broadcast: at most HEAVY keys.
HEAVY = 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternates two star steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows, until nothing changes, in a
    number of rounds that grows as the logarithm of the longest path. Minima are
    aggregated before the shuffle; edges are written to the shared folder after
    each round. No edges, no rows.
    """
    now = cut_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).alias("m")
    with shuffles_removed(edges.sparkSession):
        before = now.agg(mark).first()["m"]
    while before["n"]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        handed = large.join(small.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_table(handed.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), now)
        with shuffles_removed(edges.sparkSession):
            after = now.agg(mark).first()["m"]
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, one row per ``key``, whose ``weight`` says how many rows have the key.

    Rows of heavy keys, of which there are at most HEAVY, meet a broadcast; the
    others are joined by shuffle, in which heavy rows are dealt by ``spread``.
    """
    with shuffles_removed(rows.sparkSession):
        total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(1, total // HEAVY)
    columns = [c for c in table.columns if c not in (key, weight)]
    heavy = table.filter(F.col(weight) > limit).select(F.col(key).alias("_hk"), F.struct(*columns).alias("_heavy"))
    light = table.filter(F.col(weight) <= limit).select(F.col(key).alias("_lk"), F.lit(False).alias("_lh"), F.struct(*columns).alias("_light"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left").withColumn("_h", F.col("_hk").isNotNull())
    out = out.withColumn("_k", F.when(F.col("_h"), F.xxhash64(spread)).otherwise(F.col(key)))
    out = out.join(light, (F.col("_k") == F.col("_lk")) & (F.col("_h") == F.col("_lh")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in columns])
