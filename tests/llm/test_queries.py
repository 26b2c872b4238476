"""The registered queries themselves, on a small folder of tables, against brute force and the registered SQL."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    line = "this line of more than forty characters stands in many documents"
    texts = ["\n".join([" ".join(word() for _ in range(30)), line.upper() if k % 2 else line, " ".join(word() for _ in range(9))]) for k in range(40)]
    texts += [texts[3], texts[4] + " more", None, "", "½", "x" * 3000]
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    vectors = np.random.default_rng(1).standard_normal((120, 8)).astype(np.float32)
    vectors[60:70] = vectors[50]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, dict(enumerate(texts)), vectors


def got(spark, folder, name):
    return {r[0]: r for r in QUERIES[name](spark, folder[0]).collect()}


def test_op1(spark, folder):
    texts, rows = folder[1], got(spark, folder, "op1_simhash")

    def fingerprint(text):
        words = (text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {k: fingerprint(t) for k, t in texts.items()}
    root = {k: k for k in fps}
    for _ in range(5):
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in rows.items()} == {k: (f"{fps[k]:016x}", root[k]) for k in fps}


def test_op2_and_op4(spark, folder):
    x = folder[2].astype(float) / np.linalg.norm(folder[2].astype(float), axis=1, keepdims=True)
    cos = x @ x.T
    found = {}
    for r in QUERIES["op2_neighbours"](spark, folder[0]).collect():
        assert r["query_id"] % 50 == 0 and abs(r["score"] - cos[r["query_id"], r["vec_id"]]) < 1e-12
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: sorted(v) for q, v in found.items()} == {q: [(i + 1, v) for i, v in enumerate(sorted((v for v in range(120) if v != q), key=lambda v: (-round(cos[q, v], 12), v))[:5])] for q in (0, 50, 100)}
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op4_embedding_dedup"](spark, folder[0]).collect()}
    near = (cos >= 0.93) & (np.arange(120)[:, None] % 2 == np.arange(120)[None, :] % 2)
    assert {k: v[0] for k, v in links.items()} == {k: int(near[k].sum()) - 1 for k in range(120)}
    assert links[50] == (5, 50, True) and links[62][1:] == (50, False) and links[61][1:] == (61, True)


def test_op3_op5_op7_op8(spark, folder):
    texts = folder[1]
    mix = got(spark, folder, "op3_mix")
    assert {k: r["size"] for k, r in mix.items()} == {k: len((t or "").split()) for k, t in texts.items()} and all(r["taken"] <= 2 * r["size"] for r in mix.values())
    assert got(spark, folder, "op5_token_counts").keys() == texts.keys()
    for name, modulus, held in (("op7_toxicity", 4, 2), ("op8_language", 3, 1)):
        rows = got(spark, folder, name)
        assert {k: r["held_out"] for k, r in rows.items()} == {k: zlib.crc32(str(k).encode()) % modulus == held for k in texts} and all(0 <= r["score"] <= 1 for r in rows.values())
        if name == "op7_toxicity":
            assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
        else:
            assert {rows[k]["lang_pred"] for k in (42, 43, 44)} == {"und"} and {r["lang_pred"] for r in rows.values()} <= {"en", "fr", "und"}


def test_op6(spark, folder):
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{folder[0]}/documents.parquet/*.parquet'")
    want = base.execute(ORACLES["op6_line_dedup"]).fetchall()
    have = QUERIES["op6_line_dedup"](spark, folder[0]).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, have)) == sorted(want) and sum(r[2] for r in want) > 30


def test_op9_and_op10(spark, folder):
    texts = folder[1]
    first = {}
    for k, t in texts.items():
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], k)
    for k, r in got(spark, folder, "op9_repeats").items():
        b = (texts[k] or "").encode()
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                cover[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(b), int(cover.sum()), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
    ends = {}
    rows = QUERIES["op10_pack"](spark, folder[0]).collect()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and {r["doc_id"] for r in rows} == texts.keys()
