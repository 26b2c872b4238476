"""Numeric series: rows (series, pos, x), one list of numbers per ``series``.

Statistics are aggregated per series (partly before the shuffle) and joined back;
percentiles rank distinct values with their counts, so a series of many equal
values costs what its distinct values cost. NaN is outside the operators' domain.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
LOWEST, HIGHEST = -1000, 1000
THRESHOLD = 2.0
SCALE_FACTOR = 100
PERCENTILES = (25, 50, 75)
INVALID, OUT_OF_BOUNDS = "Input validation failed", "Bounds check failed"
INVALID_TRIM, INVALID_NORMALISED, INVALID_TRANSFORMED = "Invalid input data", "Invalid input for normalization", "Input validation failed in transformation"
#: Ranges of equal width that a series' values are counted in before any of them are ranked.
RANGES = 1024


def from_lists(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """Literal series; an empty list has no rows, so name it in ``report(..., names=)``."""
    rows = [(name, pos, None if x is None else float(x)) for name, xs in lists.items() for pos, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series string, pos bigint, x double")


def summary(df: DataFrame, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """All that is known of a series as a whole, in one aggregation: size, n, valid, in_bounds, mean, std_dev, lowest, highest."""
    kind = dict(df.dtypes)["x"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        raise ValueError(f"a series is numeric, not {kind}")
    x = F.col("x").cast("double")
    return df.groupBy("series").agg(
        F.count(F.lit(1)).alias("size"), F.count("x").alias("n"), F.every(F.col("x").isNotNull()).alias("valid"), F.every(F.coalesce(x.between(low, high), F.lit(False))).alias("in_bounds"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std_dev"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
    )


def validate(df: DataFrame) -> DataFrame:
    """(series, valid): no element is null. Text columns are refused when the plan is made."""
    return summary(df).select("series", "valid")


def within(df: DataFrame, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(series, in_bounds): every element lies in the closed range."""
    return summary(df, low, high).select("series", "in_bounds")


def stats(df: DataFrame) -> DataFrame:
    """(series, n, mean, std_dev, lowest, highest); the deviation is the population's, 0 under two elements."""
    return summary(df).select("series", "n", "mean", "std_dev", "lowest", "highest")


def _told(df: DataFrame, known: DataFrame, message: str) -> DataFrame:
    """The rows of valid series, and one row of a null place and the message for each of the others; columns of ``known`` go along."""
    valid = df.join(known.filter("valid"), "series").withColumn("error", F.lit(None).cast("string"))
    refused = known.filter("not valid").select("series", F.lit(message).alias("error"))
    return valid.unionByName(refused, allowMissingColumns=True)


def _near(threshold: float) -> Column:
    far = F.abs((F.col("x") - F.col("mean")) / F.nullif(F.col("std_dev"), F.lit(0.0)))
    return (F.col("n") < 2) | (F.col("std_dev") == 0) | (far <= threshold)


def trim(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows within ``threshold`` deviations of their series' mean, one pass, and a null ``error``; all of a constant or single series.

    A series with a null element has one row instead, which holds the error.
    """
    return _told(df, summary(df), INVALID_TRIM).filter(F.col("error").isNotNull() | _near(threshold)).select(*df.columns, "error")


def checked(known: DataFrame) -> DataFrame:
    """A ``summary`` with the error of its series, null for none; validity is told before bounds."""
    return known.withColumn("error", F.when(~F.col("valid"), F.lit(INVALID)).when(~F.col("in_bounds"), F.lit(OUT_OF_BOUNDS)))


def preprocess(df: DataFrame, threshold: float = THRESHOLD, low: float = LOWEST, high: float = HIGHEST) -> tuple[DataFrame, DataFrame]:
    """(trimmed rows of series that pass both checks, (series, error) of all)."""
    known = checked(summary(df, low, high))
    fine = known.filter("error is null").select("series", "n", "mean", "std_dev")
    return df.join(fine, "series").filter(_near(threshold)).select(*df.columns), known.select("series", "error")


def percentiles(df: DataFrame, wanted: Iterable[int] = PERCENTILES) -> DataFrame:
    """(series, p..): the element at 0-based index min(floor(n * p / 100), n - 1) of the sorted series.

    Distinct values are counted in ranges first; only the ranges in which a wanted
    element lies are sorted, each by itself, so no window sees a whole series.
    """
    wanted = list(wanted)
    if any(p < 0 for p in wanted):
        raise ValueError("percentiles are 0 or more")
    counts = df.filter("x is not null").groupBy("series", F.col("x").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    if not wanted:
        return counts.select("series").distinct()
    ends = counts.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n"))
    share = (F.col("x") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
    counts = counts.join(ends, "series").withColumn("range", F.least(F.coalesce(F.floor(share * RANGES), F.lit(0)), F.lit(RANGES - 1)).cast("int"))
    sizes = counts.groupBy("series", "range").agg(F.sum("c").alias("held"), F.first("n").alias("n"))
    upto = F.sum("held").over(Window.partitionBy("series").orderBy("range"))
    index = F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)
    asked = sizes.withColumn("upto", upto).withColumn("p", F.explode(F.array(*[F.lit(p).cast("long") for p in sorted(set(wanted))]))).withColumn("index", index)
    asked = asked.filter((F.col("index") < F.col("upto")) & (F.col("index") >= F.col("upto") - F.col("held")))
    asked = asked.groupBy("series", "range").agg(F.collect_list(F.struct("p", (F.col("index") - F.col("upto") + F.col("held")).alias("at"))).alias("asked"))
    ranked = counts.join(asked, ["series", "range"]).withColumn("upto", F.sum("c").over(Window.partitionBy("series", "range").orderBy("x")))
    hits = ranked.withColumn("hit", F.explode(F.filter("asked", lambda a: (a["at"] < F.col("upto")) & (a["at"] >= F.col("upto") - F.col("c")))))
    return hits.groupBy("series").agg(*[F.max(F.when(F.col("hit.p") == p, F.col("x"))).alias(f"p{p}") for p in wanted])


def percentile_map(df: DataFrame, wanted: Iterable[int] = PERCENTILES) -> DataFrame:
    """(series, percentiles map) for any list of percentiles."""
    names = [f"p{p}" for p in wanted]
    pairs = [c for n in names for c in (F.lit(n), F.col(n))]
    made = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return percentiles(df, wanted).select("series", made.alias("percentiles"))


def normalised(x: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(0.5)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


def _normal(df: DataFrame, message: str, factor: float | None = None) -> DataFrame:
    value = normalised(F.col("x").cast("double"), F.col("lowest"), F.col("highest"))
    return _told(df, summary(df), message).select("series", "pos", (value if factor is None else value * factor).alias("x"), "error")


def normalize(df: DataFrame) -> DataFrame:
    """(series, pos, x, error): min-max normalised; a series with a null element has one row, its error."""
    return _normal(df, INVALID_NORMALISED)


def scale(df: DataFrame, factor: float = SCALE_FACTOR) -> DataFrame:
    """As ``normalize``, times ``factor``."""
    return _normal(df, INVALID_NORMALISED, factor)


def transform(df: DataFrame, mode: str = "scale", factor: float = SCALE_FACTOR) -> DataFrame:
    """(series, pos, x, error): min-max normalised, normalised times ``factor``, or unchanged for any other mode; a series with a null element has one row, its error."""
    if mode == "normalize":
        return _normal(df, INVALID_TRANSFORMED)
    if mode == "scale":
        return _normal(df, INVALID_TRANSFORMED, factor)
    return _told(df, summary(df), INVALID_TRANSFORMED).select("series", "pos", F.col("x").cast("double").alias("x"), "error")


def _featured(df: DataFrame, known: DataFrame) -> DataFrame:
    """(series, features) of the trimmed series of which ``known`` (a checked summary) has no error."""
    kept = df.join(known.filter("error is null").select("series", "n", "mean", "std_dev"), "series").filter(_near(THRESHOLD)).select("series", "x")
    both = stats(kept).join(percentiles(kept), "series")
    fields = [F.col("mean"), F.col("std_dev"), F.col("lowest").alias("min"), F.col("highest").alias("max"), F.col("n").alias("count"), *[F.col(f"p{p}") for p in PERCENTILES]]
    return both.select("series", F.struct(*fields).alias("features"))


def features(df: DataFrame) -> DataFrame:
    """(series, features, error): of the trimmed series, or why it was refused."""
    known = checked(summary(df))
    return known.select("series", "error").join(_featured(df, known), "series", "left").select("series", "features", "error")


def skewness(found: Column) -> Column:
    """'positive' if the mean is over the median, else 'negative', ties and empty series included."""
    return F.when(F.coalesce(found["mean"], F.lit(0.0)) > F.coalesce(found["p50"], F.lit(0.0)), "positive").otherwise("negative")


def analysis(df: DataFrame) -> DataFrame:
    """(series, raw_features, transformed_count, skewness, error): features of the trimmed, length of the whole series; nulls and the error of a refused one."""
    known = checked(summary(df))
    both = known.select("series", "size", "error").join(_featured(df, known), "series", "left")
    fine = F.col("error").isNull()
    return both.select("series", F.col("features").alias("raw_features"), F.when(fine, F.col("size")).alias("transformed_count"), F.when(fine, skewness(F.col("features"))).alias("skewness"), "error")


def report(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One nested record per series, or its error; ``names`` (series) adds series that have no rows."""
    known = checked(summary(df))
    sizes = known.select("series", F.col("size").alias("input_size"), F.col("mean").alias("average"), "error")
    base = sizes if names is None else names.select("series").join(sizes, "series", "left")
    both = base.join(_featured(df, known), "series", "left")
    fine, size = F.col("error").isNull(), F.coalesce("input_size", F.lit(0)).cast("long")
    kept = F.coalesce(F.col("features")["count"], F.lit(0)).cast("long")
    told = F.struct(
        size.alias("input_size"),
        kept.alias("preprocessed_size"),
        F.col("features"),
        F.struct(F.col("features").alias("raw_features"), size.alias("transformed_count"), skewness(F.col("features")).alias("skewness")).alias("distribution_analysis"),
        size.alias("transformed_size"),
        F.coalesce("average", F.lit(0.0)).alias("average"),
        F.when(kept > 0, "success").otherwise("empty_result").alias("status"),
    )
    return both.select("series", F.when(fine, told).alias("report"), "error")
