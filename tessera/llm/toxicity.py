"""Toxicity by compression distance.

Two zstandard raw-content dictionaries of equal length are made: the ordinary one
holds what ordinary text repeats, by the library's trainer, and a stretch of
ordinary text; the toxic one the same base and, in place of the stretch, the word
stems that toxic text uses in many more contexts than ordinary text does. The
library's trainer on toxic text isn't used for it: measured, its choice tells
toxic texts worse (figures in the README). A window, one word before a carrier
that both dictionaries hold, is compressed with each; the bytes that the toxic
dictionary saves are its margin. A document's margins over a calibrated threshold, set
against its length, give its probability through a logistic curve fitted on
labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkCache, buffers, resident
from tessera.llm.common import bounded_batches, fold, released

#: Labelled rows of each class that a fit reads at most, by hash of their id, of texts of so many characters at most.
TOXIC_ROWS, ORDINARY_ROWS, LEARN_CHARS = 1200, 2400, 1 << 16
#: Stretches of 256 bytes, spread evenly over the ordinary texts of a fit, that the trainer reads at most.
STRETCHES = 40_000
SEPARATORS = b" \t\n\x0b\x0c\r"
BASE_BYTES, CARRIER_BYTES = 4096, 24
#: A stem: at least this many contexts, this much likelier in toxic text, this many deviations.
STEM_CONTEXTS, STEM_RATIO, STEM_DEVIATIONS, STEM_BYTES = 6, 8.0, 6.0, range(4, 13)
#: A stem gives way to a longer one that keeps this share of its contexts.
STEM_KEEPS = 0.9
PUNCTUATION = b".,;:!?|()[]\"'"


@dataclass(frozen=True)
class Model:
    """Dictionaries, the margin threshold, and the logistic curve over a document's features."""

    ordinary: bytes
    toxic: bytes
    carrier: bytes
    threshold: int
    weights: tuple[float, ...]


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def _contexts(texts: list[str]) -> tuple[Counter, int]:
    """For each word the number of distinct words before it, copies of a text counting once, and how many pairs there are."""
    numbers: dict[bytes, int] = {b"": 0}
    pairs = []
    for text in texts:
        ids = np.array([0, *[numbers.setdefault(w, len(numbers)) for w in _words(text)]], np.int64)
        pairs.append(ids[:-1] << 32 | ids[1:])
    distinct = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    counts = np.bincount(distinct & 0xFFFFFFFF, minlength=len(numbers)).tolist()
    words: Counter = Counter()
    for word, n in zip(numbers, counts, strict=True):
        words[b" " + word.strip(PUNCTUATION)] += n
    return words, max(1, len(distinct))


def _stems(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    words, n = _contexts(toxic)
    ours: Counter = Counter()
    for size in STEM_BYTES:  # a stem has no more contexts than the shorter ones it extends
        counts: Counter = Counter()
        for led, k in words.items():
            if len(led) >= size and (size == STEM_BYTES[0] or led[: size - 1] in ours):
                counts[led[:size]] += k
        ours.update({stem: k for stem, k in counts.items() if k >= STEM_CONTEXTS})
    words, m = _contexts(ordinary)
    theirs: Counter = Counter()
    for led, k in words.items():
        for size in STEM_BYTES:
            if len(led) < size or led[:size] not in ours:
                break
            theirs[led[:size]] += k
    found = {}
    for stem, a in ours.items():
        expected = (a + theirs[stem]) * n / (n + m)
        deviations = (a - expected) / math.sqrt(expected)
        ratio = (a + 0.5) / n / ((theirs[stem] + 0.5) / m)
        if ratio >= STEM_RATIO and deviations >= STEM_DEVIATIONS:
            found[stem] = deviations
    short = {longer[:-cut] for longer in found for cut in range(1, len(longer) - 3) if ours[longer] >= STEM_KEEPS * ours[longer[:-cut]]}
    kept: list[bytes] = []
    for stem in sorted(set(found) - short, key=lambda x: (-found[x], x)):
        if not any(stem.startswith(k) or k.startswith(stem) for k in kept):
            kept.append(stem)
    return kept


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, bytes]:
    """(ordinary, toxic, carrier): the dictionaries' contents and the text both end with."""
    plain = [b" " + b" ".join(_words(t)) for t in ordinary] or [b" "]
    samples = [t[i : i + 256] for t in plain for i in range(0, len(t), 256)]
    samples = samples[:: -(-len(samples) // STRETCHES)]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()[-(BASE_BYTES * 3 // 4) :]
    except zstandard.ZstdError:  # too little text to choose from
        base = b"".join(samples)[:BASE_BYTES]
    base = base.rjust(64, b" ")
    own = b"".join(reversed(_stems(toxic, ordinary)))
    if not own:  # nothing stands out by stems: what toxic text repeats at all
        own = b" ".join(w for w, _ in Counter(w for t in toxic for w in set(_words(t))).most_common(64))
    step = max(1, len(samples) * 64 // max(1, len(own)))  # pieces from all over the ordinary text
    stretch = b"".join(s[:64] for s in samples[::step])[: len(own)].rjust(len(own), b" ")
    return stretch + base, own + base, base[-CARRIER_BYTES:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(
        window_log=15, hash_log=12, chain_log=13, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


class Margins:
    """Margins of a batch's windows by one model's dictionaries, each distinct window compressed once a worker."""

    def __init__(self, ordinary: bytes, toxic: bytes, carrier: bytes):
        self.ordinary, self.toxic, self.carrier = _compressor(ordinary), _compressor(toxic), carrier
        self.cache = ChunkCache(self._encode, SEPARATORS)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ordinary, toxic, carrier = self.ordinary.compress, self.toxic.compress, self.carrier
        margins = []
        for chunk in chunks:
            window = b" " + chunk.strip().lower() + carrier
            margins.append(max(0, len(ordinary(window)) - len(toxic(window))))
        return np.array(margins, np.uint32), np.ones(len(chunks), np.int64)

    def by_text(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Margins of all windows, and each text's first (n + 1)."""
        data, offsets = buffers(texts)
        numbers, firsts = self.cache.lookup(data, offsets)
        return self.cache.flat(numbers)[0].astype(np.int64), firsts


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[firsts[1:]] - total[firsts[:-1]]


def features(margins: np.ndarray, firsts: np.ndarray, threshold: int) -> np.ndarray:
    """By text: log of windows over the threshold, log of the bytes they save, their share in a thousand, one."""
    over = margins >= threshold
    hits, saved, windows = _sums(over.astype(np.int64), firsts), _sums(np.where(over, margins, 0), firsts), np.diff(firsts)
    share = np.log1p(1000 * hits / np.maximum(windows, 1))
    return np.stack([np.log1p(hits), np.log1p(saved), share, np.ones(len(hits))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[np.ndarray, float]:
    w = np.zeros(x.shape[1])
    penalty = np.diag([*[ridge] * (x.shape[1] - 1), 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - np.clip(step, -4, 4)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit_texts(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries from two thirds of the texts; the threshold and the curve from the rest."""
    y = np.array(toxic, float)
    learn = np.arange(len(texts)) % 3 != 0
    if not (y[learn] == 1).any() or not (y[~learn] == 1).any():
        learn = np.ones(len(texts), bool)
    ours = [t for t, k, use in zip(texts, toxic, learn, strict=True) if k == 1 and use]
    theirs = [t for t, k, use in zip(texts, toxic, learn, strict=True) if k == 0 and use]
    ordinary, toxic_content, carrier = train_dictionaries(ours, theirs)
    measure, some, begins = Margins(ordinary, toxic_content, carrier), [], [np.zeros(1, np.int64)]
    for at in range(0, len(texts), 64):  # a few texts at a time, as the driver has little memory
        values, first = measure.by_text(pa.array(texts[at : at + 64], pa.string()))
        some.append(values)
        begins.append(first[1:] + begins[-1][-1])
    margins, firsts = np.concatenate(some), np.concatenate(begins)
    rest = ~learn if not learn.all() else learn
    best: tuple = (math.inf,)
    for threshold in range(1, 7):
        x = features(margins, firsts, threshold)
        w, loss = _logistic(x[rest], y[rest])
        loss += float(((x[rest] @ w >= math.log(0.3 / 0.7)) != (y[rest] == 1)).mean())
        if loss < best[0] - 1e-4:
            best = (loss, threshold, w)
    _, threshold, w = best
    return Model(ordinary, toxic_content, carrier, threshold, tuple(float(v) for v in w))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> tuple[list[str], list[int]]:
    """At most so many labelled texts of each class, by hash of their id.

    Ids first (id columns only), then the texts of those few. A null label or id
    is no label; an id labelled both ways counts as toxic; an id of several rows
    gives its smallest text.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    short = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)) <= LEARN_CHARS
    known = known.join(docs.filter(short).select("doc_id"), "doc_id", "left_semi")
    chosen: list = []
    for kind, rows in ((1, toxic_rows), (0, ordinary_rows)):
        chosen += known.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(short).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of toxic, of every row; only the text is looked at.

    A null text scores as an empty one, which has no window; equal texts score
    alike; texts are read whole, in blocks; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = resident(model, lambda: Margins(model.ordinary, model.toxic, model.carrier))
        for batch in batches:
            x = features(*margins.by_text(batch.column(1)), model.threshold)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(scored(batches)), "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Model:
    """Learn from labelled rows outside the held-out fold.

    Without a toxic label every text scores as ordinary. Null ids and labels and
    labels of no document teach nothing, nor do texts of more than LEARN_CHARS
    characters; repeated rows teach once. Extra columns of either table are ignored.
    """
    texts, toxic = labelled_sample(docs, labels, lambda key: ~fold(key, modulus, held_out) & key.isNotNull())
    if not any(toxic):
        return Model(b" " * 64, b" " * 64, b" " * CARRIER_BYTES, 1, (0.0, 0.0, 0.0, -30.0))
    return fit_texts(texts, toxic)


def classify(docs: DataFrame, model: Model, limit: float = 0.3, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``limit`` on) of every row; a null text is empty, a null id in no held-out fold."""
    scored = score(docs, model)
    return scored.select("doc_id", fold(F.col("doc_id"), modulus, held_out).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose text scores under ``limit``; equal rows go or stay together."""
    bounded_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = resident(model, lambda: Margins(model.ordinary, model.toxic, model.carrier))
        for batch in batches:
            x = features(*margins.by_text(batch.column(place).cast(pa.string())), model.threshold)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            yield batch.filter(pa.array(p < limit))

    return docs.mapInArrow(lambda batches: released(kept(batches)), docs.schema)
