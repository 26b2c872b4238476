"""The near-dedup stage's candidates come by SimHash: fingerprints, segments' bit counts, a grid join; the shingles only decide."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import nearcopies


def test_fingerprint_is_the_majority_of_its_hashes():
    rng = np.random.default_rng(4)
    mask, golden = 2**64 - 1, 0x9E3779B97F4A7C15
    for n in (1, 7, 301):
        hashes = np.sort(rng.integers(0, 2**64, n, np.uint64))
        for word, got in enumerate(nearcopies.fingerprint(hashes).tolist()):
            mixed = [(int(h) + golden * (word + 1)) & mask for h in hashes]
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                mixed = [((x ^ (x >> shift)) * factor) & mask for x in mixed]
            assert got == sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in mixed) > n)
    even = [np.sort(rng.integers(0, 2**64, 2, np.uint64)) for _ in range(50)]
    assert 0.48 < np.mean([np.bitwise_count(nearcopies.fingerprint(x)).sum() / nearcopies.BITS for x in even]) < 0.52


def test_grid_points_are_bit_counts_of_segments():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**64, (30, nearcopies.BITS // 64), np.uint64)
    words[1] = words[0] ^ np.uint64(1 << 9)
    parts = nearcopies.grid(50_000)
    assert len({tuple(sorted(p.ravel().tolist())) for p in parts}) == len(parts) and all(len(set(p.ravel().tolist())) == p.size for p in parts)
    points = nearcopies.grid_points(words, parts, 3)
    bit = lambda x, at: int(x[at // 64]) >> (at % 64) & 1
    for k in range(0, 30, 7):
        for j, part in enumerate(parts):
            counts = [sum(bit(words[k], int(at)) for at in segment) for segment in part]
            number = j + 3
            for count in counts:
                number = number * (nearcopies.SEGMENT + 1) + count
            assert points[k, j] == number


def test_large_cells_give_what_small_ones_do(monkeypatch):
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**64, (300, nearcopies.CARRIED), np.uint64)
    words[20:60] = words[0] ^ (np.uint64(1) << rng.integers(0, 64, (40, nearcopies.CARRIED)).astype(np.uint64))
    words[100:105] = words[99] ^ (np.uint64(1) << rng.integers(0, 64, (5, nearcopies.CARRIED)).astype(np.uint64))
    got = []
    for limit in (1024, 100):
        monkeypatch.setattr(nearcopies, "MATRIX", limit)
        pairs, large = nearcopies.near_in_cell(list(words.T.copy()))
        got.append(({tuple(sorted(p)) for p in pairs.tolist()}, sorted(sorted(x.tolist()) for x in large)))
    assert got[0] == got[1] == ({(i, j) for i in range(99, 105) for j in range(i + 1, 105)}, [[0, *range(20, 60)]])


def test_pairs_meet_by_their_fingerprints_alone(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for n in (8, 20, 100, 400):  # lone pairs of a similarity of 0.8 or little more
        for _ in range(40):
            words = [word() for _ in range(n)]
            texts += [" ".join(words), " ".join([*words, *[word() for _ in range((n - 4) // 4)]])]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == list(range(0, len(texts), 2))
    honest = nearcopies.proposed
    monkeypatch.setattr(nearcopies, "proposed", lambda nodes, parts, first: nearcopies.cut_table(honest(nodes, parts, first).limit(0)))
    assert sorted(r["doc_id"] for r in stage(spark, df, "").collect()) == list(range(len(texts)))
