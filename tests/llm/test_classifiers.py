"""Toxicity and language against plain re-implementations, and the chunk cache they and the tokenizers stand on."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import chunks, langid, toxicity

BAD = ["idiotic", "worthless", "pathetic", "stupid"]


def prose(rng, toxic, n=80):
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4)))
    return " ".join(rng.choice(BAD) if toxic and rng.random() < 0.08 else word() for _ in range(n))


def plain_margin(model, word):
    settings = zstandard.ZstdCompressionParameters(window_log=15, hash_log=12, chain_log=13, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda content: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(b" " + word.lower() + model.carrier))
    return max(0, size(model.ordinary) - size(model.toxic))


def plain_score(model, text):
    """One window a run of separators and the word after it; texts that end in separators have one without a word."""
    raw, pieces, at = (text or "").encode(), [], 0
    for k in range(1, len(raw) + 1):
        if k == len(raw) or (raw[k : k + 1] in b" \t\n\x0b\x0c\r" and raw[k - 1 : k] not in b" \t\n\x0b\x0c\r"):
            pieces.append(raw[at:k].strip(b" \t\n\x0b\x0c\r"))
            at = k
    margins = [plain_margin(model, p) for p in pieces]
    over = [m for m in margins if m >= model.threshold]
    x = [math.log1p(len(over)), math.log1p(sum(over)), math.log1p(1000 * len(over) / max(1, len(margins))), 1.0]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_toxicity_of_tables(spark):
    rng = random.Random(12)
    rows = [(k, prose(rng, k % 4 == 0), k % 4 == 0) for k in range(600)]
    more = [(700, None), (701, ""), (702, " \t\n "), (None, rows[0][1]), (0, rows[0][1]), (703, "Stupid,  idiotic\nworthless stupid pathetic idiotic "), (704, "é漢 stupid" * 3)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + more, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("score", "held_out", "toxic", "_kept")})
    labels = spark.createDataFrame([(k, 1, int(y)) for k, _, y in rows] + [(None, 1, 1), (5000, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model).collect()
    texts = [t for _, t, _ in rows] + [t for _, t in more]
    want = {t: plain_score(model, t) for t in [*texts[::25], *[t for _, t in more]]}
    of = {k: t for k, t, _ in rows} | {k: t for k, t in more if k is not None}
    checked = [(r["score"], want[of[r["doc_id"]]]) for r in got if r["doc_id"] is not None and of[r["doc_id"]] in want]
    assert len(got) == len(texts) and len(checked) > 25 and all(abs(a - b) < 1e-9 for a, b in checked)
    toxic = {k for k, _, y in rows if y}
    assert sum((r["predicted"] == 1) != (r["doc_id"] in toxic) for r in got if r["doc_id"] is not None and r["doc_id"] < 600) <= 12
    assert {r["predicted"] for r in got if r["doc_id"] in (700, 701, 702)} == {0} and {r["predicted"] for r in got if r["doc_id"] == 703} == {1}
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.classify(docs.limit(0), model).count() == 0 and toxicity.reject(docs.limit(0), model).count() == 0


def plain_logits(model, text):
    text, mask = text.lower(), (1 << 64) - 1
    total, grams = np.zeros(len(model.languages)), 0
    for n in (1, 2, 3):
        for at in range(len(text) - n + 1):
            mixed = n
            for c, factor in zip(text[at : at + n], (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=False):
                mixed = (mixed ^ ord(c)) * factor & mask
            total += model.weights[((mixed ^ mixed >> 15) * 0x2C1B3C6D & mask) >> 12 & langid.BUCKETS - 1]
            grams += 1
    return (total / max(1, grams) + model.bias) / model.temperature


@pytest.mark.parametrize("part", [langid.PART, 64])
def test_language_of_texts(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    rng = np.random.default_rng(2)
    model = langid.Model(["a", "b", "c"], rng.standard_normal((langid.BUCKETS, 3)).astype(np.float32), rng.standard_normal(3), 0.7)
    texts = ["Le chat", "x", "", None, "½ ²", "Ⅷ", "12 !", "ß" * 90, "Ünï " * 100, "ab" * 70 + " ΑΣ", "漢字 kanji", "a"]
    languages, scores = langid.predict_texts(model, texts)
    for text, language, score in zip(texts, languages, scores, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (language, score) == ("und", 0)
            continue
        logits = plain_logits(model, text)
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert language == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-6


def test_document_frequencies(spark, monkeypatch):
    texts = ["abc", "abd", "", "ab" * 50, "zz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found, rows = langid.document_frequencies(df)
    of = lambda gram: int(langid._one(gram, len(gram))[0])
    assert rows == 5 and [found[of(g)] for g in ("a", "ab", "abc", "zz", "ba")] == [3, 3, 1, 1, 1]


def test_language_rows(spark):
    """Repeated rows are answered alike, ids of any kind, a language that only few have, extra columns."""
    rng = random.Random(5)
    parts = {"en": ["the", "and", "ing"], "de": ["ung", "sch", "keit"]}
    rows = [(k, " ".join("".join(rng.choice(parts[x]) for _ in range(2)) for _ in range(20)), x) for k in range(200) for x in ["en" if k % 2 else "de"]]
    rows += [(0, rows[0][1], "de"), (None, rows[1][1], "en"), (300, "½ 12", "en"), (301, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(1) for n in ("lang_pred", "held_out", "bucket", "n")})
    got = [tuple(r) for r in langid.predict(df, langid.fit(df)).collect()]
    assert len(got) == len(rows) and sum(r[0] == 0 for r in got) == 2 and len({r for r in got if r[0] == 0}) == 1
    assert {r[2] for r in got if r[0] in (300, 301)} == {"und"} and not any(r[1] for r in got if r[0] is None)


@pytest.mark.parametrize("block", [chunks.BLOCK, 16, 3])
def test_chunk_cache(monkeypatch, block):
    monkeypatch.setattr(chunks, "BLOCK", block)
    lengths = lambda cs: (np.array([len(c) for c in cs], np.uint32), np.ones(len(cs), np.int64))
    texts = ["a bb  ccc", "", " x ", "y" * 300 + " z" * 5, None, "bb a", "y" * 300]
    for _ in range(2):
        cache = chunks.ChunkCache(lengths, b" ")
        data, offsets = chunks.buffers(pa.array(texts))
        numbers, firsts = cache.lookup(data, offsets)
        values = cache.flat(numbers)[0].tolist()
        got = [values[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        assert got == [[1, 3, 5], [], [2, 1], [300, 2, 2, 2, 2, 2], [], [2, 2], [300]]
        monkeypatch.setattr(chunks, "_TABLE", np.zeros_like(chunks._TABLE))  # now all chunks of a length have one key


def test_a_very_long_text_in_bounded_memory():
    """A text of 24 MB takes less than 14 bytes a byte more than itself."""
    import tracemalloc

    lengths = lambda cs: (np.array([len(c) for c in cs], np.uint32), np.ones(len(cs), np.int64))
    cache = chunks.ChunkCache(lengths, b" ")
    data, offsets = chunks.buffers(pa.array(["some words and others " * (1 << 20) + "z" * (1 << 20)]))
    tracemalloc.start()
    numbers, _ = cache.lookup(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(numbers) == 4 * (1 << 20) + 1 and peak < 14 * len(data)
