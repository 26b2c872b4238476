"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to buckets; a feature is an
n-gram's share in its text times its inverse document frequency over all texts
one may learn from. Weights are trained by follow-the-regularised-leader with
an elastic net on a bounded sample and are sparse; a temperature fitted on rows
left out of the training calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, fold, released

BUCKETS, GRAMS, SCALE = 1 << 15, 3, 40.0
#: About so many rows of each language are learnt from, by hash of their id and text, of texts of so many characters at most.
ROWS_A_LANGUAGE, LEARN_CHARS = 600, 1 << 16
#: Languages of which a model's numbers still fit in the driver: more are an error, not left out.
LANGUAGES = 1024
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.01, 4
UNDETERMINED = "und"
#: Characters handled at a time.
PART = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


@dataclass(frozen=True, eq=False)
class Model:
    languages: list[str]
    weights: np.ndarray  # BUCKETS x languages, the inverse document frequencies multiplied in
    bias: np.ndarray
    temperature: float


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PART characters together."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= PART:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def buckets_of(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-gram: buckets of all n-grams of the texts in order, and where each text's begin (n + 1)."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    out = []
    for n in range(1, GRAMS + 1):
        mixed = np.full(max(0, len(chars) - n + 1), n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ chars[k : len(chars) - n + 1 + k]) * _MIX[k]
        codes = ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(12)).astype(np.int64) & (BUCKETS - 1)
        valid = np.ones(len(codes), bool)
        for back in range(1, n):  # n-grams that would begin in one text and end in another
            at = ends[:-1] - back
            at = at[(at >= 0) & (at < len(codes))]
            valid[at] = False
            short = ends - back
            valid[short[(short >= 0) & (short < len(codes))]] = False
        counts = np.concatenate([[0], np.cumsum(np.maximum(sizes - n + 1, 0))])
        codes = codes[valid]
        if len(codes) != counts[-1]:  # texts shorter than an n-gram overlap several others
            codes = np.concatenate([codes[:0], *[_one(t, n) for t in lowered]])
        out.append((codes, counts))
    return out


def _one(text: str, n: int) -> np.ndarray:
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(chars) < n:
        return np.zeros(0, np.int64)
    mixed = np.full(len(chars) - n + 1, n, np.uint64)
    for k in range(n):
        mixed = (mixed ^ chars[k : len(chars) - n + 1 + k]) * _MIX[k]
    return ((mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x2C1B3C6D) >> np.uint64(12)).astype(np.int64) & (BUCKETS - 1)


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Buckets of a long text's n-grams, PART characters at a time."""
    lowered = text.lower()
    for at in range(0, len(lowered), PART):
        for n in range(1, GRAMS + 1):
            yield _one(lowered[at : at + PART + n - 1], n)


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([codes for codes, _ in buckets_of([text])])
    counts = np.bincount(codes, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, SCALE * counts[at] * idf[at] / max(1, len(codes))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of ``texts`` (text) each bucket occurs, and how many there are; counted where the texts are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            rows += len(column)
            for a, b in _parts(column):
                if len(column[b - 1] or "") > PART:
                    seen = np.zeros(BUCKETS, bool)
                    for codes in _blocks(column[b - 1]):
                        seen[codes] = True
                    total += seen
                    b -= 1
                for begin in range(a, b, 64):
                    some = column[begin : min(b, begin + 64)]
                    seen = np.zeros((len(some), BUCKETS), bool)
                    for codes, counts in buckets_of(some):
                        seen[np.repeat(np.arange(len(some)), np.diff(counts)), codes] = True
                    total += seen.sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(lambda batches: released(counted(batches)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out[:-1], int(out[-1])


def train(texts: list[str], languages: list[str], idf: np.ndarray) -> Model:
    """Follow-the-regularised-leader on four fifths of the rows, the temperature on the rest."""
    names = sorted(set(languages))
    y = np.array([names.index(x) for x in languages])
    rows = [_features(t, idf) for t in texts]
    left_out = np.arange(len(rows)) % 5 == 4 if len(rows) >= 20 else np.zeros(len(rows), bool)
    k = len(names)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    order = np.random.default_rng(11)
    learnt = np.flatnonzero(~left_out)
    for _ in range(EPOCHS):
        for i in order.permutation(learnt):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    held = np.flatnonzero(left_out) if left_out.any() else learnt
    logits = np.array([rows[i][1] @ w[rows[i][0]] + w[BUCKETS] for i in held]).reshape(len(held), k)

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(held) else 1.0
    return Model(names, (w[:BUCKETS] * idf[:, None] * SCALE).astype(np.float32), w[BUCKETS].astype(np.float64), float(temperature))


def fit(docs: DataFrame, modulus: int = 3, held_out: int = 1, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """Learn from the text and non-null lang of rows outside the held-out fold.

    Document frequencies are counted over all those rows; the weights are fitted
    on about ``rows_a_language`` of each language (fewer, if it has fewer), of
    texts of LEARN_CHARS characters at most, drawn by hash; more than LANGUAGES
    languages are an error. Null and empty texts and rows without a language teach
    nothing; repeated rows are rows like others; null ids are in no held-out fold;
    an empty table gives a model that knows no language. Extra columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~fold(F.col("doc_id"), modulus, held_out))
    frequency, rows = document_frequencies(known)
    idf = np.log((1 + rows) / (1 + frequency)) + 1
    known = known.filter(F.length("text").between(1, LEARN_CHARS))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their weights don't fit in the driver")
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows_a_language / r["n"])) for r in counts], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    sample = known.join(F.broadcast(shares), "lang").filter(draw < F.col("_share")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample], idf)


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and probability of each text; UNDETERMINED and 0 without a letter (or without a model)."""
    k = len(model.languages)
    logits = np.zeros((len(texts), k))
    for a, b in _parts(texts):
        if len(texts[b - 1] or "") > PART:
            total, grams = np.zeros(k), 0
            for codes in _blocks(texts[b - 1]):
                total += np.bincount(codes, minlength=BUCKETS) @ model.weights
                grams += len(codes)
            logits[b - 1] = total / max(grams, 1) + model.bias
            b -= 1
        total, grams = np.zeros((b - a, k)), np.zeros(b - a)
        for codes, counts in buckets_of(texts[a:b]):
            owner = np.repeat(np.arange(b - a), np.diff(counts))
            gathered = model.weights[codes]
            for j in range(k):
                total[:, j] += np.bincount(owner, gathered[:, j], b - a)
            grams += np.diff(counts)
        logits[a:b] = total / np.maximum(grams, 1)[:, None] + model.bias
    has = np.array([any(map(str.isalpha, t or "")) for t in texts], bool) & (k > 0)
    if not k:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    s = logits / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [model.languages[j] if h else UNDETERMINED for j, h in zip(best, has, strict=True)], np.where(has, p.max(axis=1), 0.0)


def predict(docs: DataFrame, model: Model, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text is looked at.

    A null text, or one without a letter (Unicode category L), is ``und`` with
    score 0; of equally likely languages the first by name is told. Null ids are in
    no held-out fold; repeated rows get equal answers; texts are read whole, a long
    one PART characters at a time; an empty table gives no rows; other columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = predict_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(predicted(batches)), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", fold(F.col("doc_id"), modulus, held_out).alias("held_out"), "lang_pred", "score")
