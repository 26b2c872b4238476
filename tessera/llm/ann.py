"""Approximate nearest neighbours by multi-index hashing.

Unit vectors become binary codes, the signs of rotations learned by iterative
quantisation. A code falls into bytes, each with an index from value to rows.
Two codes within ``parts * (s + 1) - 1`` bits agree up to s bits in some byte
(pigeonhole), so probing the values within s of each of a query's bytes finds
every code within that radius; the codes found are compared whole and reranked
by cosine in double precision. A query's radius grows, s by s, until it holds
all codes that a row as near as the k-th found so far may have, by the deviation
of a code's bits from its angle: a query with close copies probes one value a
byte, one without probes most of them.

Rows are dealt to blocks; a block is indexed once, and all queries stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, cut, released, shuffle_partitions
from tessera.llm.vectors import dimension, matrix, unit, usable

#: Bits of a code; deviations of its distance that a radius allows; rows that a rotation is learned from at most; rows of a block.
BITS, SLACK, FIT_ROWS, ROW_BLOCK = 256, 2.0, 4096, 1 << 15
FOUND = "q long, query_id long, m long, vec_id long, score double"
_VALUES = [np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) == s).astype(np.uint8) for s in range(9)]


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = 20) -> np.ndarray:
    """A dim x bits map whose signs are the codes: principal axes turned until their signs lose least, repeated from new turns if bits exceed dimensions."""
    rng = np.random.default_rng(5)
    dim = x.shape[1]
    columns, width = [], 0
    _, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    while width < bits:
        k = min(dim, bits - width)
        first = axes[:, ::-1][:, :k]
        projected = x @ first
        turn = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ projected)
            turn = (u @ v).T
        columns.append(first @ turn)
        width += k
    return np.concatenate(columns, axis=1)


def codes(x: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(x @ rotation >= 0, axis=1)


class MultiIndex:
    """Byte tables over a block of codes: for each byte the rows in order of its value, and where each value begins."""

    def __init__(self, block: np.ndarray):
        self.words = np.ascontiguousarray(block).view(np.uint64)
        self.parts = block.shape[1]
        self.order = np.argsort(block, axis=0, kind="stable").T.astype(np.int32).ravel()
        counts = np.stack([np.bincount(block[:, j], minlength=256) for j in range(self.parts)])
        self.begin = (np.cumsum(counts, axis=1) - counts) + np.arange(self.parts)[:, None] * len(block)
        self.count = counts

    def probe(self, code: np.ndarray, s: int, seen: np.ndarray) -> None:
        """Mark in ``seen`` all rows that differ from ``code`` in exactly ``s`` bits of some byte."""
        part = np.repeat(np.arange(self.parts), len(_VALUES[s]))
        value = (code[:, None] ^ _VALUES[s][None, :]).ravel()
        begin, count = self.begin[part, value], self.count[part, value]
        ends = np.cumsum(count)
        seen[self.order[np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)]] = True

    def radius(self, s: int) -> int:
        """Bits within which all codes are found once the values up to ``s`` away are probed."""
        return self.parts * (s + 1) - 1 if s < 8 else 8 * self.parts

    def distances(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with ``query``, the same bits for equal rows wherever they stand; powers of two are taken out so that squares don't overflow."""
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


class Block:
    """An indexed block of rows."""

    def __init__(self, numbers: np.ndarray, x: np.ndarray, rotation: np.ndarray):
        self.numbers, self.x, self.units = numbers, x, unit(x)
        self.bits = rotation.shape[1]
        self.index = MultiIndex(codes(self.units, rotation))

    def wanted(self, cosine: float) -> float:
        """Bits by which the code of a row of this cosine may differ."""
        share = np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
        return self.bits * share + SLACK * np.sqrt(self.bits * share * (1 - share))

    def nearest(self, number: int, query: np.ndarray, query_unit: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places in the block, cosines) of the ``k`` nearest found, and all that rounding could put among them; never the row ``number``."""
        seen = np.zeros(len(self.numbers), bool)
        found, near = np.zeros(0, np.int64), np.zeros(0)
        for s in range(9):
            self.index.probe(code, s, seen)
            radius = self.index.radius(s)
            rows = np.flatnonzero(seen)
            away = self.index.distances(rows, code)
            fine = (away <= radius) & (self.numbers[rows] != number)
            rows, away = rows[fine], away[fine]
            if len(rows) < k and s < 8:
                continue
            some = rows
            if len(rows) > 4 * k:  # the nearest codes tell how far the others need be looked at
                some = rows[np.argpartition(away, 4 * k)[: 4 * k]]
            near = self.units[some] @ query_unit
            limit = self.wanted(np.partition(near, len(near) - k)[len(near) - k]) if len(near) >= k else self.bits
            if limit <= radius or s == 8:
                found = rows[away <= limit]
                near = self.units[found] @ query_unit
                break
        if len(near) > k:
            found = found[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9]
        return found, cosines(self.x[found], query)


def search(table: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding", bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``queries`` (a function of the key column) holds.

    Rows of a vector that can't be compared, or of another length than most, take
    no part. Rows are told apart whatever their keys: a query's own row alone is
    no candidate, rows of its key or of its vector are, and rows of a null key are
    candidates too. Ties go to the smaller key, null last. Queries of equal key
    each have their own answers. An empty table gives no rows; other columns are
    ignored. ``bits`` is a multiple of 64.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    rows = cut(rows.withColumn("n", F.monotonically_increasing_id()))
    width = dimension(rows, "v")
    rows = rows.filter(F.size("v") == width)
    sample = rows.orderBy(F.xxhash64("id", "n")).limit(FIT_ROWS).toArrow() if width else None
    fitted = unit(matrix(sample.column("v"), width)) if width and sample.num_rows else np.zeros((1, max(1, width)))
    rotation = learn_rotation(fitted, bits)
    blocks = max(1, -(-rows.count() // ROW_BLOCK))
    left = rows.select(F.pmod(F.xxhash64("n"), F.lit(blocks)).alias("i"), F.lit(0).cast("long").alias("kind"), "n", "id", "v")
    right = rows.filter(queries(F.col("id"))).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("i"), F.lit(1).cast("long").alias("kind"), "n", "id", "v")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, ids = None, [], None, None
        for batch in batches:
            sort = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, sort[1:] != sort[:-1], True]) if len(sort) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part, i, kind = batch.slice(a, b - a), sort[a] // 2, sort[a] % 2
                if i != at:
                    at, held, block = i, [], None
                if not kind:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    whole = pa.Table.from_batches(held)
                    ids = whole.column(3).combine_chunks()
                    block = Block(whole.column(2).to_numpy(), matrix(whole.column(4), width), rotation)
                x = matrix(part.column(4), width)
                units = unit(x)
                code, numbers = codes(units, rotation), part.column(2).to_numpy()
                out: list[list] = [[], [], []]
                for q in range(len(x)):
                    places, scores = block.nearest(numbers[q], x[q], units[q], code[q], k)
                    out[0].append(np.full(len(places), q))
                    out[1].append(places)
                    out[2].append(scores)
                owner, places, scores = (np.concatenate(c) for c in out)
                owner, places = owner.astype(np.int64), places.astype(np.int64)
                columns = [pa.array(numbers[owner]), part.column(3).take(pa.array(owner)), pa.array(block.numbers[places]), ids.take(pa.array(places)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["q", "query_id", "m", "vec_id", "score"])

    dealt = left.unionAll(right).repartition(shuffle_partitions(spark), "i").sortWithinPartitions("i", "kind", "n")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "m")
    found = dealt.mapInArrow(lambda batches: released(compared(batches)), FOUND).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
