import random
import statistics

import pytest

from tessera.functions.errors import strict
from tessera.operators import pairs, series

SAMPLE = [10, 15, 12, 18, 20, 100, 16, 14, 19, 17]


def test_report_of_the_sample_an_empty_and_a_refused_series(spark):
    df = series.from_lists(spark, {"sample": SAMPLE, "far": [5000], "edge": [-1000, 1000]})
    names = spark.createDataFrame([("sample",), ("far",), ("edge",), ("empty",)], "series string")
    got = {r["series"]: r for r in series.report(df, names).collect()}
    r = got["sample"]["report"]
    assert (r["input_size"], r["preprocessed_size"], r["status"], r["average"], r["transformed_size"]) == (10, 9, "success", 24.1, 10)
    f = r["features"]
    assert (f["count"], f["min"], f["max"], f["p25"], f["p50"], f["p75"]) == (9, 10, 20, 14, 16, 18)
    assert f["std_dev"] == pytest.approx(3.0912061651652) and f["mean"] == pytest.approx(15.6667, abs=1e-3)
    assert r["distribution_analysis"]["skewness"] == "negative"
    assert got["far"]["error"] == series.OUT_OF_BOUNDS and got["far"]["report"] is None and got["edge"]["error"] is None
    e = got["empty"]["report"]
    assert (e["input_size"], e["average"], e["features"], e["status"], e["distribution_analysis"]["skewness"]) == (0, 0, None, "empty_result", "negative")


def test_percentiles_against_a_plain_model(spark):
    rng = random.Random(1)
    lists = {str(k): [rng.randint(-9, 9) for _ in range(n)] for k, n in enumerate((1, 2, 5, 10, 37))}
    wanted = [0, 10, 25, 50, 90, 100, 150]
    for r in series.percentiles(series.from_lists(spark, lists), wanted).collect():
        xs = sorted(lists[r["series"]])
        assert [r[f"p{p}"] for p in wanted] == [xs[min(int(len(xs) * p / 100), len(xs) - 1)] for p in wanted]
    assert series.percentile_map(series.from_lists(spark, {"a": list(range(1, 11))}), [10, 90]).first()["percentiles"] == {"p10": 2, "p90": 10}
    with pytest.raises(ValueError):
        series.percentiles(series.from_lists(spark, {"a": [1]}), [-1])


def test_trim_and_transform(spark):
    df = series.from_lists(spark, {"s": SAMPLE, "one": [7], "same": [5, 5, 5], "three": [1, 2, 3]})
    kept = series.trim(df).groupBy("series").count().collect()
    assert {r["series"]: r["count"] for r in kept} == {"s": 9, "one": 1, "same": 3, "three": 3}
    value = lambda mode, name: [r["x"] for r in series.transform(df, mode).filter(f"series = '{name}'").orderBy("pos").collect()]
    assert value("normalize", "three") == [0, 0.5, 1] and value("scale", "three") == [0, 50, 100] and value("other", "three") == [1, 2, 3]
    assert value("normalize", "same") == [0.5] * 3 and value("normalize", "one") == [0.5]
    st = {r["series"]: r for r in series.stats(df).collect()}
    assert st["s"]["std_dev"] == pytest.approx(statistics.pstdev(SAMPLE)) and st["one"]["std_dev"] == 0


def test_validation(spark):
    df = series.from_lists(spark, {"fine": [1, 2.5], "hole": [1, None]})
    assert {r["series"]: r["valid"] for r in series.validate(df).collect()} == {"fine": True, "hole": False}
    assert {r["series"]: r["error"] for r in series.preprocess(df)[1].collect()} == {"fine": None, "hole": series.INVALID}
    with pytest.raises(ValueError):
        series.validate(spark.createDataFrame([("a", 0, "x")], "series string, pos long, x string"))


def test_two_sum(spark):
    df = series.from_lists(spark, {"a": [2, 7, 11, 15, 9], "b": [1, 2], "c": [3, 3, 6]})
    assert {r["series"]: r["pair"] for r in pairs.two_sum(df, 9.0).collect()} == {"a": [0, 1], "b": [], "c": [1, 2]}


def test_refused_series_tell_why(spark):
    df = series.from_lists(spark, {"hole": [1, None, 3], "far": [5000, 1], "fine": [1, 2, 3]})
    told = lambda out: {r["series"]: r["error"] for r in out.collect()}
    for out, message in ((series.trim(df), "Invalid input data"), (series.normalize(df), "Invalid input for normalization"), (series.scale(df), "Invalid input for normalization"), *((series.transform(df, m), "Input validation failed in transformation") for m in ("scale", "normalize", "other"))):
        assert told(out) == {"hole": message, "far": None, "fine": None}
        rows = [r for r in out.collect() if r["series"] == "hole"]
        assert len(rows) == 1 and rows[0]["pos"] is None and rows[0]["x"] is None
        with pytest.raises(ValueError, match=message):
            strict(out)
    for out in (series.features(df), series.analysis(df), series.report(df)):
        assert told(out) == {"hole": series.INVALID, "far": series.OUT_OF_BOUNDS, "fine": None}
    refused = {r["series"]: r for r in series.analysis(df).collect()}["far"]
    assert (refused["raw_features"], refused["transformed_count"], refused["skewness"]) == (None, None, None)


def test_percentiles_of_far_apart_values(spark):
    rng = random.Random(8)
    lists = {str(k): [rng.choice([0.0, -0.5, 1e300, -1e300, rng.uniform(-1, 1), rng.gauss(0, 1e6)]) for _ in range(200)] for k in range(5)}
    for r in series.percentiles(series.from_lists(spark, lists), [0, 1, 50, 50, 99, 100]).collect():
        xs = sorted(lists[r["series"]])
        assert [r[f"p{p}"] for p in (0, 1, 50, 99, 100)] == [xs[min(int(200 * p / 100), 199)] for p in (0, 1, 50, 99, 100)]


def test_two_sum_against_a_plain_model(spark):
    rng = random.Random(4)
    lists = {str(k): [rng.choice([0.1, 0.2, 0.3, 1, 2, 3, 4]) for _ in range(rng.randint(0, 9))] or [7] for k in range(60)}
    want = {}
    for name, xs in lists.items():
        seen, want[name] = {}, []
        for j, x in enumerate(xs):
            if not want[name] and 4.2 - x in seen:
                want[name] = [seen[4.2 - x], j]
            seen[x] = j
    assert {r["series"]: r["pair"] for r in pairs.two_sum(series.from_lists(spark, lists), 4.2).collect()} == want
