"""The pipeline's stages, each on its predecessor's rows, against brute force; and run() against its stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline

BAD = ["idiotic", "worthless", "pathetic", "stupid"]
SPACE = " \t\n\x0b\x0c\r"


def made(rng, toxic, lines):
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
    body = [" ".join(rng.choice(BAD) if toxic and rng.random() < 0.08 else word() for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(2, 5))]
    return "\n".join([*body, rng.choice(lines)])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    lines = [f"line number {k} that a great many of these documents share" for k in range(4)]
    toxic = {k for k in range(600) if k % 5 == 0}
    texts = {k: made(rng, k in toxic, lines) for k in range(600)}
    texts |= {600 + k: texts[7 * k + 1] for k in range(30) if 7 * k + 1 not in toxic}  # exact copies
    texts |= {700: "", 701: None, 702: " \n ", 703: "one"}
    rows = [(k, t, "en", ["a", "b", "c", None][k % 4], len(t or "")) for k, t in texts.items()]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, toxic


def by_id(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def without_repeated_lines(texts):
    key = lambda x: x.strip(SPACE).lower()
    held = {}
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(k)
    goes = lambda k, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != k
    return {k: "\n".join(x for x in (t or "").split("\n") if not goes(k, x)) for k, t in texts.items()}


def firsts(texts):
    """The smallest id of each component by the stage's contract: five-word shingles, a Jaccard similarity of 0.8 or more."""
    words = {k: (t or "").encode().lower().split() for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(k) for k in root}


def test_stages_and_run(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, toxic = folder
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, before = docs.columns, by_id(docs)

    clean = stage["toxicity"](spark, docs, path).persist()
    after = by_id(clean)
    gone = before.keys() - after.keys()
    assert clean.columns == names and all(before[k] == t for k, t in after.items())
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 0.02 * len(before) and {700, 701, 702, 703} <= after.keys()

    lined = stage["line dedup"](spark, clean, path).persist()
    assert lined.columns == names
    lines = by_id(lined)
    assert {k: t or "" for k, t in lines.items()} == without_repeated_lines(after)

    single = stage["near-dedup"](spark, lined, path).persist()
    kept = firsts(lines)
    assert single.columns == names and by_id(single) == {k: t for k, t in lines.items() if k in kept} and len(kept) < len(lines)

    mixed = stage["mixing"](spark, single, path).persist()
    assert mixed.columns == names
    size, taken, single_text = {}, {}, by_id(single)
    for r in single.collect():
        size[r["source"]] = size.get(r["source"], 0) + len((r["text"] or "").split())
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
        assert set(r["text"].split()) <= set((single_text[r["doc_id"]] or "").split())
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [5, 2, 1, 5], strict=True))
    goal, total, free = {}, 1.5 * sum(size.values()), set(size)
    while free:  # the sources above twice their size stop there, and the rest is shared again
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        goal |= {s: 2 * size[s] for s in over} if over else share
        total, free = total - sum(2 * size[s] for s in over), free - over if over else set()
    assert taken.keys() <= goal.keys() and all(abs(taken.get(s, 0) - goal[s]) <= 1 for s in goal)

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    ids = [(k, [*library.encode(t, add_special_tokens=False).ids, 0]) for k, t in texts]
    checks = {(k, a, b, zlib.crc32(np.array(x[a : a + b], "<u4").tobytes()), len(x)) for k, x in ids for a, b in [(0, len(x))] if len(x) <= 1024}
    rows = corpus_pipeline.run(spark, path).collect()
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        fits = [x for k, x in ids if k == r["doc_id"] and len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in fits)
    whole = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["length"] == r["doc_tokens"]}
    assert whole <= checks
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
