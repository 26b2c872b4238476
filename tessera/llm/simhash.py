"""SimHash near-dedup.

A document's fingerprint has a bit for each bit that over half of its shingles'
hashes have. Distinct fingerprints are embedded as bit counts of short segments;
the Manhattan distance of two embeddings never exceeds the Hamming distance. Of
two fingerprints within 2r + 1 bits one half differs in at most r, so for r = 2
the halves' embeddings are at most 2 apart and both lie within 1 of a common
point of the integer grid: each fingerprint is sent to the grid points within 1
of each half's embedding, and those that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, cut, named, one_of_each, released
from tessera.llm.components import attach, components

SHINGLE, DISTANCE, SEGMENT_BITS, SEED = 4, 4, 2, 42
#: Shingles whose bits are counted at a time; a cell of more members is walked, not paired.
BLOCK, PAIRED = 1 << 15, 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; 0 for a null text or one without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(at, min(at + BLOCK, count))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, id, a, b (as by ``common.named``) and fp (the fingerprint as a signed long) of every row."""
    bounded_batches(docs.sparkSession)
    marks = ["doc_id", "id", "a", "b"]

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(4)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fps.view(np.int64))], [*marks, "fp"])

    return named(docs).select(*marks, "text").mapInArrow(lambda batches: released(fingerprinted(batches)), "doc_id long, id long, a long, b long, fp long")


def embedding(half: np.ndarray, segment_bits: int) -> np.ndarray:
    """Bit counts of the segments of 32-bit values, each count in its segment's own bits."""
    half = half.astype(np.uint64)
    width = 1
    while width < segment_bits:
        mask = np.uint64(sum(((1 << width) - 1) << at for at in range(0, 32, 2 * width)))
        half = (half & mask) + ((half >> np.uint64(width)) & mask)
        width *= 2
    return half


def grid_points(fps: np.ndarray, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint): the embedding of each half and its neighbours in one coordinate."""
    cells, owners = [], []
    index = np.arange(len(fps))
    for part in (0, 1):
        side = np.uint64(part << 40)
        own = embedding((fps >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF), segment_bits)
        cells.append(own | side)
        owners.append(index)
        for at in range(0, 32, segment_bits):
            count = (own >> np.uint64(at)) & np.uint64((1 << segment_bits) - 1)
            more, less = count < segment_bits, count > 0
            cells += [(own[more] + np.uint64(1 << at)) | side, (own[less] - np.uint64(1 << at)) | side]
            owners += [index[more], index[less]]
    return np.concatenate(cells), np.concatenate(owners)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def linked_in_cells(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal cell, rows sorted by cell: all of a small cell's, a spanning forest of a large one's."""
    n = len(cells)
    if n < 2:
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    size_of = np.repeat(sizes, sizes)
    rest = np.flatnonzero((size_of > 1) & (size_of <= PAIRED))
    step = 1
    while len(rest):
        rest = rest[rest + step < n]
        rest = rest[cells[rest] == cells[rest + step]]
        hit = rest[near(fps[rest], fps[rest + step], distance)]
        left.append(fps[hit])
        right.append(fps[hit + step])
        step += 1
    for s, size in zip(starts[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
        unseen = fps[s : s + size]
        while len(unseen):
            frontier, unseen = [unseen[0]], unseen[1:]
            while frontier and len(unseen):
                now = frontier.pop()
                hit = near(unseen, now, distance)
                found = unseen[hit]
                if len(found):
                    left.append(np.full(len(found), now))
                    right.append(found)
                    frontier.extend(found)
                    unseen = unseen[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def links(distinct: DataFrame, distance: int = DISTANCE, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(a, b): links that connect all of ``distinct`` (fp) that chains of links connect."""
    if not 0 <= distance <= 5:
        raise ValueError("grid points within 1 serve distances up to 5")
    if segment_bits not in (1, 2, 4):
        raise ValueError("segments of 1, 2 or 4 bits fill a half evenly")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                cells, owners = grid_points(part, segment_bits)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(part[owners].view(np.int64))], ["cell", "fp"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held, most = 0, 100_000

        def out(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = linked_in_cells(cells, fps, distance)
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"])

        for batch in batches:  # joined as seldom as doubles what is held, so that a large cell is copied few times
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            held += batch.num_rows
            if held >= most:
                cells, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
                last = int(np.searchsorted(cells, cells[-1]))
                if last:
                    yield out(cells[:last], fps[:last])
                    cells, fps = cells[last:].copy(), fps[last:].copy()
                parts, held = [(cells, fps)], len(cells)
                most = max(100_000, 2 * held)
        if held:
            yield out(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    spread_out = distinct.select("fp").mapInArrow(lambda batches: released(spread(batches)), "cell long, fp long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: released(compared(batches)), "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """doc_id, id, a, b, fp, root (a fingerprint that names the component) and component_id of every row of ``docs``."""
    rows = cut(fingerprints(docs, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct, distance, segment_bits))
    found = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = found.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps"))
    known = attach(cut(found.select("fp", "n", "root")), cut(by_root), "root", "fps", "fp")
    return attach(rows, cut(known.select("fp", "n", "root", "component_id")), "fp", "n", "doc_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links, of every row of ``docs`` (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased. A text of
    fewer words than a shingle is one shingle; a null text, or one without words,
    has fingerprint 0 and links like any other. Equal fingerprints are one node
    however many rows have them; equal rows and rows of equal id are rows like
    others. Null ids are kept and name no component unless all its ids are null;
    an empty table gives no rows; other columns are ignored. A text's words are
    held whole, its shingles BLOCK at a time.
    """
    return classes(docs, shingle, distance, segment_bits).select("doc_id", "fp", "component_id")


def firsts(found: DataFrame, root: str = "root") -> DataFrame:
    """(id, a, b) of the row of each component that has its smallest doc_id, a null one only where all are."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "id", "a", "b")).alias("m")
    return found.groupBy(root).agg(least).select("m.id", "m.a", "m.b")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs``, all columns as they were, with one row of each component: one of its smallest doc_id.

    Rows of other components stay whatever their ids: null and repeated ones name
    no row. Of rows of equal id and text in it a component keeps one.
    """
    return one_of_each(docs, firsts(classes(docs, shingle, distance)))
