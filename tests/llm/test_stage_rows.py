"""What the pipeline's stages do to rows of null and repeated ids, to columns whose names clash with theirs, and to empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, simhash

NAMES = ["size", "kept", "n_lines", "n_dropped", "keep", "row", "id", "a", "b", "root", "rank", "_source", "_kept", "_line_id", "_doc", "_text", "_place", "_new", "shard", "slot", "taken", "ids", "nth"]
SHARED = "a line that every one of these documents holds, word for word"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(21)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)) + "\n" + SHARED
    rows = [(None, text()) for _ in range(4)] + [(7, text()), (7, text()), (8, text()), (9, None), (None, None), (10, "")]
    rows += [(30, text()), (31, text()), (20, rows[6][1]), rows[6]]  # a copy under another id, and a row twice
    rows = [(k, t, "en", ["x", None][i % 2], len(t or "")) for i, (k, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(" "), F.coalesce(F.substring("text", 1, 9), F.lit("none"))).alias(n) for n in NAMES])


def told(row):
    return tuple(row[n] for n in NAMES)


@pytest.mark.parametrize("keep_first", [simhash.keep_first, dict(corpus_pipeline.STAGES)["near-dedup"]])
def test_near_dedup_keeps_unrelated_rows(spark, docs, keep_first):
    kept = keep_first(docs) if keep_first is simhash.keep_first else keep_first(spark, docs, "")
    rows = kept.collect()
    assert kept.columns == docs.columns and [f.dataType for f in kept.schema] == [f.dataType for f in docs.schema]
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
    # four unrelated texts without an id, two under 7, one of the copies 8, 8 and 20, and one of the texts without words (9, none, 10)
    assert ids == [(False, 7), (False, 7), (False, 8), (False, 9), (False, 30), (False, 31), *[(True, 0)] * 4]
    assert {r["text"] for r in rows} | {"", None} == {r["text"] for r in docs.collect()} | {"", None}
    assert all(told(r) in {told(x) for x in docs.collect() if x["doc_id"] == r["doc_id"] and x["text"] == r["text"]} for r in rows)
    empty = docs.limit(0)
    assert (keep_first(empty) if keep_first is simhash.keep_first else keep_first(spark, empty, "")).count() == 0


def test_line_dedup_leaves_other_columns(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["line dedup"]
    out = stage(spark, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(told, rows)) == sorted(map(told, docs.collect()))
    assert sum(SHARED in (r["text"] or "") for r in rows) == 1 and sum(r["text"] is None for r in rows) == 2
    assert next(r["doc_id"] for r in rows if SHARED in (r["text"] or "")) == 31
    assert stage(spark, docs.limit(0), "").count() == 0


def test_mixing_leaves_other_columns(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["mixing"]
    out = stage(spark, docs, "")
    rows = out.collect()
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {told(r) for r in rows} <= {told(r) for r in docs.collect()}
    assert sum(len(r["text"].split()) for r in rows) == sum(r["taken"] for r in mixing.mix(docs).collect())
    assert stage(spark, docs.limit(0), "").count() == 0


def test_shards_hold_all_that_the_mix_takes(spark, docs):
    """Slots of all shards add up to the mix, shards are full but for the last, and each has its sources by chance alone."""
    many = docs.select("doc_id", F.concat_ws(" ", *[F.col("text")] * 200).alias("text"), "source")
    plan = mixing.source_plan(mixing.laid_out(many))
    got = mixing.slots(plan, shard_slots=8).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == len(got) and {r["slot"] for r in got} <= set(range(8))
    words = {}
    for r in got:
        words[r["_source"]] = words.get(r["_source"], 0) + r["_words"]
    goal = {r["_source"]: r["target"] for r in plan.collect()}
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())
    shards = {(r["shard"], r["source"]): r["n_words"] for r in mixing.shard_counts(many).collect()}
    read = {}
    for r in mixing.mix(many).collect():
        assert sum(x["words"] for x in r["reads"]) == r["taken"]
        for x in r["reads"]:
            read[x["shard"]] = read.get(x["shard"], 0) + x["words"]
    assert read == {s: sum(n for (t, _), n in shards.items() if t == s) for s in {t for t, _ in shards}}


def test_source_counts_of_shards_are_drawn(spark):
    """Over many shards the count of a source has about the variance of a multinomial conditioned on the totals."""
    table = spark.createDataFrame([(k, " ".join(["w"] * 512), "s" if k % 4 else "t") for k in range(3000)], "doc_id long, text string, source string")
    got = mixing.slots(mixing.source_plan(mixing.laid_out(table)), shard_slots=100).filter("_source = 'ss'").groupBy("shard").count().collect()
    counts = [r["count"] for r in got][:-1]
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert 0.3 < spread / (mean * (1 - mean / 100)) < 2.5
