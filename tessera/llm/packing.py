"""Packing: documents as token ids into sequences of a fixed capacity.

Each document's ids (with an end id) are cut into whole windows and one rest;
how often each rest length occurs fits in ``capacity - 1`` counters. Minimum bin
slack works on those counters alone: for the longest rest still there, a subset
sum over bitsets finds the multiset of further rests that fills a window closest
to its capacity, the counts are found by walking the bitsets back, and the
pattern is applied as often as the counters allow. Rests then get their place by
their rank among rests of equal length, ranks being dealt without gathering a
length in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkCache, buffers, resident
from tessera.llm.common import bounded_batches, cut, cut_table, ranked, released

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = PIECES + ", sequence_id long, offset long"
#: What byte-level BPE splits on where a chunk may begin, and the pattern it splits by.
SEPARATORS = b" \n\t\r"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Other white space in UTF-8: a text with any of it is encoded whole, not by chunks.
OTHER_SPACE = rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, equal to the ``tokenizers`` library's own."""

    def __init__(self, path: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # byte-level files write each byte as a printable character: itself, or the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token) and token != "<|endoftext|>"}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        probe = "It's 1999,\n\n  naïve  Größe — <|endoftext|> 東京\t x\r\n"
        if self.library.encode(probe, add_special_tokens=False).ids != self.fast.encode_ordinary(probe):
            raise ValueError(f"{path} isn't a byte-level BPE of the expected kind")
        self.other_space, self.may_be_space = re.compile(OTHER_SPACE), np.zeros(256, bool)
        self.may_be_space[[11, 12, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(token) for token in ranks]
        self.cache = ChunkCache(self._chunks, SEPARATORS)

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks between which the pattern always splits go through the encoder in one text, the others alone."""
        ids, sizes = [], np.zeros(len(chunks), np.int64)
        joined = np.array([c[0] in SEPARATORS and 32 < c[-1] < 127 for c in chunks], bool)
        together = np.flatnonzero(joined)
        if len(together):
            got = np.array(self.fast.encode_ordinary(b"".join([chunks[i] for i in together]).decode("utf-8")), np.int64)
            ends = np.cumsum([len(chunks[i]) for i in together])
            reached = np.cumsum(self.bytes_of[got])
            last = np.searchsorted(reached, ends)
            if not np.array_equal(reached[last], ends):
                raise ValueError("the tokenizer joined two chunks")
            sizes[together] = np.diff(last + 1, prepend=0)
            ids.append(got)
        alone = np.flatnonzero(~joined)
        for i in alone:
            got = self.fast.encode_ordinary(chunks[i].decode("utf-8"))
            sizes[i] = len(got)
            ids.append(np.array(got, np.int64))
        order = np.concatenate([together, alone])  # the chunks as their ids stand in the list
        flat = np.concatenate(ids)
        ends = np.cumsum(sizes[order])
        begins = np.empty(len(chunks), np.int64)
        begins[order] = ends - sizes[order]
        out_ends = np.cumsum(sizes)
        return flat[np.arange(len(flat)) + np.repeat(begins - (out_ends - sizes), sizes)].astype(np.uint32), sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian uint32 arrays."""
        data, offsets = buffers(texts)
        numbers, firsts = self.cache.lookup(data, offsets)
        ids, begins = self.cache.flat(numbers)
        bounds = begins[firsts]
        out = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        if len(data) and self.may_be_space[data].any():
            whole = data.tobytes()
            for i in {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in self.other_space.finditer(whole)}:
                text = whole[offsets[i] : offsets[i + 1]].decode("utf-8")
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: whole windows, then the rest (column ids: the piece's ids)."""
    bounded_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = resident(("byte bpe", tokenizer), lambda: ByteBpe(tokenizer))
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    row = (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None)
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = [pa.array(c, pa.int64()) for c in rows[:5]]
            if with_ids:
                names, columns = [*names, "ids"], [*columns, pa.array(rows[5], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(pieces(batches)), PIECES + ", ids array<int>" * with_ids)


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``lengths`` (each at most ``counts`` times) whose sum comes closest to ``room`` from below.

    Bit s of a bitset says that sum s can be reached; each length is added in
    binary shares of its count, and the walk back takes as few shares as it can.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room or reach >> room & 1:
            continue
        left, share = min(counts[length], room // length), 1
        while left > 0:
            n = min(share, left)
            steps.append((reach, length, n))
            reach |= reach << (length * n) & mask
            left, share = left - n, share * 2
    total, taken = reach.bit_length() - 1, {}
    for before, length, n in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return taken


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(counts by length, times used) in the order in which minimum bin slack takes them."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        pattern = best_fill([x for x in lengths if counts[x]], counts, capacity - longest)
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in pattern.items())
        out.append((pattern, times))
        for length, n in pattern.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return out


def _places(found: list[tuple[dict[int, int], int]], span: int) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces a sequence, offset of the first)."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for pattern, times in found:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Give every piece its sequence and offset.

    Only the histogram of lengths, at most ``capacity`` rows, comes to the
    driver, and the places by length that go back are as bounded: each pattern
    but the last few uses up a length.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(patterns(histogram, capacity), capacity)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    numbered = ranked(pieces, ["length"], order, sum(histogram.values()))
    columns = pieces.columns

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(columns.index("length")).to_numpy()
            rank = batch.column(len(columns)).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                at = np.flatnonzero(length == one)
                table = places[one]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                turn = rank[at] - row[:, 0]
                sequence[at] = row[:, 1] + turn // row[:, 2]
                offset[at] = row[:, 3] + turn % row[:, 2] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return numbered.select(*columns, F.col("rank").cast("long")).mapInArrow(lambda batches: released(put(batches)), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored) into sequences of ``capacity`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and with ``with_ids`` the ids. A null or empty text is its end id
    alone; null ids and repeated rows are packed like any other; an empty table
    gives no rows. Sequences are gapless from offset 0, numbered from 0.
    """
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, with_ids)
    if not with_ids:
        return place(cut(pieces), capacity)
    # the ids, by far the most of a piece, are written once and meet its place by one join
    pieces = cut_table(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    placed = place(pieces.drop("ids"), capacity)
    return placed.join(pieces.select("_piece", "ids").hint("merge"), "_piece").drop("_piece")
