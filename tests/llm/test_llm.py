"""Operators on text and vectors, against brute force on small tables with nulls, empty texts, ties, repeated rows and odd columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, langid, linededup, mixing, nndescent, packing, simhash, suffixdedup, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, rank int, fp string, _start string"


def table(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % 3], len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:1]], SCHEMA), [*texts, texts[0]], [*range(len(texts)), 0]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    line = [" ".join(word() for _ in range(14)) for _ in range(6)]
    texts = ["", None, " \t\n ", "one", "UPPER lower\nx"]
    for i in range(60):
        body = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        body.insert(rng.randint(0, len(body)), rng.choice(line) if i % 3 else rng.choice(line).upper() + "  ")
        texts.append("\n".join(body))
    texts += [texts[10], texts[10], texts[11] + " more", "x" * 5000, "word " * 3000]
    return texts


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, corpus):
    df, texts, ids = table(spark, corpus)

    def fingerprint(text):
        words = [w for w in (text or "").encode().lower().split()]
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fingerprint(t) for t in texts]
    roots = groups(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((ids[i], fps[i], min(ids[j] for j in range(len(ids)) if roots[j] == roots[i])) for i in range(len(ids)))
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = [r["doc_id"] for r in simhash.keep_first(df).collect()]
    assert sorted(kept) == sorted({c for _, _, c in got})


def test_simhash_links_of_dense_fingerprints(spark):
    rng = np.random.default_rng(0)
    fps = [int(rng.integers(0, 2**63)) for _ in range(40)]
    fps += [fps[0] ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for k in (1, 2, 3, 4, 5, 6) for _ in range(40)]
    fps = sorted(set(fps))
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    place = {f: i for i, f in enumerate(fps)}
    near = {(place[r["a"]], place[r["b"]]) for r in edges}
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in near)
    both = near | {(b, a) for a, b in near}
    assert groups(len(fps), lambda i, j: (i, j) in both) == groups(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)


@pytest.mark.parametrize(("sampled", "hits"), [(64, 64), (1, 8), (1, 0)])
def test_line_dedup(spark, corpus, monkeypatch, sampled, hits):
    """All hashes streamed, those of over 8 lines apart, all apart."""
    monkeypatch.setattr(linededup, "SAMPLED", sampled)
    monkeypatch.setattr(linededup, "HITS", hits)
    df, texts, ids = table(spark, corpus)
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(strip).translate(lower)
    held = {}
    for i, t in zip(ids, texts, strict=True):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = set()
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        out.add((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = linededup.dedup_lines(df).collect()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got} == out and len(got) == len(ids)
    assert any(r["n_dropped"] for r in got) and linededup.dedup_lines(df.limit(0)).count() == 0
    assert linededup.apply(df).columns == df.columns


@pytest.mark.parametrize("suffixes", [suffixdedup.INDEX_SUFFIXES, 84 * 20, 84])
def test_repeated_strings(spark, corpus, suffixes):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    tails, passage = [letters(40) for _ in range(3)], letters(70)
    often = [letters(rng.randint(0, 40)) + "the very same words, " + rng.choice(tails) + letters(5) for _ in range(80)]
    often += [letters(30) + passage[rng.randint(0, 9) :] + letters(30) for _ in range(60)]
    twice = letters(60) + passage[:62] + letters(60)
    df, texts, ids = table(spark, [*corpus, *often, letters(9) + passage + letters(9), f"{twice}{twice}{twice}"])
    first = {}
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, t in zip(ids, texts, strict=True):
        b = (t or "").encode()
        cover = [False] * (len(b) + 1)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                cover[k : k + 50] = [True] * 50
        kept = bytes(c for c, gone in zip(b, cover, strict=False) if not gone)
        want.append((i, len(b), sum(cover), sum(cover[k] and (k == 0 or not cover[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in suffixdedup.dedup_strings(df, suffixes=suffixes).collect()) == sorted(want) and sum(w[2] for w in want) > 1000
    assert suffixdedup.dedup_strings(df.limit(0)).count() == 0


def test_mixing(spark, corpus):
    df, texts, ids = table(spark, corpus)
    rows = mixing.mix(df).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((i, len((t or "").encode().split())) for i, t in zip(ids, texts, strict=True))
    sizes, taken, goal = {}, {}, {}
    for r in rows:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        sizes[r["source_size"]] = sizes.get(r["source_size"], 0) + r["size"]
        goal[r["source_size"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(k == v for k, v in sizes.items()) and all(abs(taken[k] - goal[k]) <= 1 for k in goal)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for s, t in goal.items())
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in mixing.mix(df.repartition(3)).collect())
    words = mixing.mixed_texts(df).select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("w")).collect()
    assert sum(r["w"] for r in words) == sum(taken.values())
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_stop_at_the_cap(spark):
    got = mixing.targets(spark.createDataFrame([("sa", 1000), ("sb", 10), ("sc", 100), ("z", 0)], "_source string, source_size long")).collect()
    assert {r["_source"]: round(r["target"], 6) for r in got} == {"sa": 1445.0, "sb": 20.0, "sc": 200.0, "z": 0.0}


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).select("p", mixing.permuted(F.col("p"), F.lit(n).cast("long"), F.lit(3), inverse=True).alias("q")).collect()
        assert sorted(r["p"] for r in got) == list(range(n)) and [r["q"] for r in got] == list(range(n))


def test_packing(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*corpus, "a  b  c\n\n d", "tab\t\tand \r\n", "<|endoftext|> it's", "naïve — 東京 " * 50]
    df, texts, ids = table(spark, texts)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(ids, texts, strict=True)}
    rows = packing.pack(df, path).collect()
    for r in rows:
        piece = np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(want[i]) for i in ids)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(ends.values()) // 1024) + 2
    assert packing.pack(df.limit(0), path).count() == 0


def test_best_fill_is_best():
    rng = random.Random(5)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        got = packing.best_fill(sorted(counts, reverse=True), counts, room)
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in got.items())


def test_token_counts(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = Tokenizer(models.Unigram(tokencount.vocabulary(path), 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    df, texts, ids = table(spark, [*corpus, " led", "a  b   c", "東京 \U0001f600\x01"])
    got = sorted((r["doc_id"], r["n_tokens"]) for r in tokencount.token_counts(df, path).collect())
    assert got == sorted((i, len(library.encode(t).ids) if t else 0) for i, t in zip(ids, texts, strict=True))


def test_toxicity_on_held_out_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
    bad = ["idiotic", "worthless", "pathetic", "stupid"]
    make = lambda toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.05 else word() for _ in range(150))
    data = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(900)]
    model = toxicity.fit_texts([t for t, _ in data[:600]], [k for _, k in data[:600]])
    import pyarrow as pa

    margins = toxicity.Margins(model.ordinary, model.toxic, model.carrier)
    x = toxicity.features(*margins.by_text(pa.array([*[t for t, _ in data[600:]], "", None])), model.threshold)
    p = 1 / (1 + np.exp(-x @ np.array(model.weights)))
    y = np.array([k for _, k in data[600:]])
    assert ((p[:-2] >= 0.3) == y).mean() > 0.95 and p[-1] < 0.3


def test_toxicity_without_labels(spark, corpus):
    df, _, ids = table(spark, corpus)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    assert sorted((r["doc_id"], r["predicted"]) for r in toxicity.classify(df, model).collect()) == sorted((i, 0) for i in ids)
    assert toxicity.reject(df, model).count() == len(ids)


def test_language(spark):
    rng = random.Random(7)
    parts = {"en": ["the", "and", "ing", "wh"], "fr": ["eau", "oui", "é", "ch"], "de": ["ung", "sch", "ü", "keit"]}
    rows = [(k, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30)), x) for k in range(300) for x in [rng.choice(list(parts))]]
    rows += [(900, None, "en"), (901, "123 !", "fr"), (902, "", None), (None, "the whand", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.predict(df, langid.fit(df)).collect()
    lang = {k: x for k, _, x in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert len(got) == len(rows) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    empty = df.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[100:160] = x[100] + 0.08 * rng.standard_normal((60, 16))
    x[200:210] = x[200]
    rows = [(i, [float(v) for v in x[i]], i % 3 if i < 100 or i >= 220 else 1, "s") for i in range(300)]
    rows += [(300, None, 1, "s"), (301, [0.0] * 16, 1, "s"), (302, [float("nan")] * 16, 1, "s"), (303, [1.0, None], 1, "s"), (304, rows[0][1], None, "s"), (None, rows[0][1], 0, "s")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string"), x, rows


def test_neighbours(spark, vectors):
    """Against brute force over rows, told apart whatever their ids: a row without an id, ids that several rows have, equal vectors."""
    df, x, rows = vectors
    more = [(50, rows[120][1], 1, "s"), (50, rows[7][1], 1, "s"), (1, rows[3][1], 1, "s"), (1, rows[3][1], 1, "s")]
    rows, df = [*rows, *more], df.unionAll(spark.createDataFrame(more, df.schema)).withColumns({n: F.lit("x") for n in ("id", "v", "n", "i", "kind", "rank")})
    got = [tuple(r) for r in ann.search(df, lambda key: key % 50 == 0).collect()]
    fine = [(r[0], np.array(r[1], float)) for r in rows if r[1] and len(r[1]) == 16 and np.isfinite(r[1]).all() and any(r[1])]
    unit = np.array([v / np.linalg.norm(v) for _, v in fine])
    want = []
    for at in (k for k, (i, _) in enumerate(fine) if i is not None and i % 50 == 0):
        cos = unit @ unit[at]
        order = sorted((k for k in range(len(fine)) if k != at), key=lambda k: (-round(cos[k], 12), fine[k][0] is None, fine[k][0] or 0))
        want += [(fine[at][0], rank + 1, fine[k][0], round(cos[k], 9)) for rank, k in enumerate(order[:5])]
    got = [(q, rank, v, round(score, 9)) for q, rank, v, score in got]
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.9 * len(set(want))
    assert {(0, 1, 304, 1.0), (0, 2, None, 1.0)} <= set(got) and sum(1 for q, rank, _, _ in got if (q, rank) == (50, 1)) == 3
    assert ann.search(df.limit(0), lambda key: key % 50 == 0).count() == 0


def test_neighbours_of_large_components(spark):
    rows = [(k, [1e200 * (k == j) + 1e199 for j in range(4)]) for k in range(4)] + [(50, [1e-200, 0.0, 0.0, 0.0]), (51, [1e200, 1e199, 1e199, 1e199])]
    got = [tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda key: key % 50 == 0, k=2).collect()]
    assert [(q, rank, v) for q, rank, v, _ in sorted(got)] == [(0, 1, 51), (0, 2, 50), (50, 1, 0), (50, 2, 51)] and all(0 < s <= 1 for *_, s in got)


def test_embedding_dedup(spark, vectors):
    df, x, rows = vectors
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:300]])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    roots = groups(300, lambda i, j: linked[i, j])
    # the row without an id equals vector 0 under the same label, and vector 300 of id 304 has no label
    zero = {i for i in range(300) if roots[i] == roots[0]}
    links = linked.sum(axis=1) + np.where(linked[0], 1, 0)
    want = [(i, int(links[i]) + (i == 0), roots[i], roots[i] == i) for i in range(300)] + [(i, 0, i, True) for i in range(300, 305)]
    want.append((None, int(linked[0].sum()) + 1, min(zero), False))
    got = [tuple(r) for r in nndescent.near_duplicates(df).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key) and nndescent.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_groups_as_large_as_lists_and_larger(spark):
    """Groups of 11 to 14 and of 500 distinct vectors, repeated rows, ids that are null or shared, string labels, values beyond single precision."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 24))
    rows = [(None if k % 7 == 0 else 1000 * g + k // 2, (centre[g] + 0.2 * rng.standard_normal(24)) * 1e150, f"l{g % 2}") for g, n in enumerate((11, 12, 13, 14, 500)) for k in range(n)]
    rows += [(9000 + k, rng.standard_normal(24) * 1e150, "l0") for k in range(300)]
    rows += [(9999, rows[0][1], "l0"), (9999, rows[0][1], "l0"), (9998, rows[0][1], None)]
    x = np.array([v / 1e150 for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & np.array([[a[2] == b[2] and a[2] is not None for b in rows] for a in rows])
    np.fill_diagonal(near, False)
    roots = groups(len(rows), lambda i, j: near[i, j])
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        want.append((r[0], int(near[i].sum()), component, r[0] == component))
    df = spark.createDataFrame([(i, v.tolist(), l) for i, v, l in rows], "vec_id long, embedding array<double>, label string").withColumns({n: F.lit("x") for n in ("id", "x", "n", "r", "key", "root")})
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r) for r in nndescent.near_duplicates(df).collect()), key=key) == sorted(want, key=key) and max(w[1] for w in want) > 300
