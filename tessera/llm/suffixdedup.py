"""Removal of byte strings that also start in an earlier document.

Every string of ``length`` bytes holds an anchor, the GRAM-byte substring of least
hash among those in it, so equal strings hold equal anchors at equal places.
Anchors are dealt by hash; those of one document only are dropped, and of each
anchor's distinct contexts (the bytes that strings holding the anchor there can
reach) the earliest document's go on, all later ones being covered by it. Of equal
contexts in one batch only the earliest document's is dealt, so a group of copies
sends a few rows a batch.
Where an anchor has several contexts, these are indexed together: a Burrows-Wheeler
transform, kept as runs with the first place and the count before each run
sampled at its end, over which all contexts stream from right to left, each step
giving the interval of suffixes that share the next ``length`` bytes and, kept with
the interval, the earliest document among them. A string is a long match if that
document is earlier than its own.
An anchor with more contexts than an index takes isn't gathered: its contexts are
dealt again by the anchor with half of the reach before it, and by the anchor with
half of the reach after it, one of which every string holds. Where even those have
too many, the earliest document of each string is found by a salted aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import buffers
from tessera.llm.common import bounded_batches, cut_table, released, shuffle_partitions

LENGTH, GRAM = 50, 16
#: Bytes of text whose anchors a bucket gets, and suffixes that one key may bring to an index; keys are
#: indexed together up to a quarter of that.
BUCKET_BYTES, INDEX_SUFFIXES = 8 << 20, 1 << 20
OUT_ROWS = 1 << 14  # contexts that a batch gives on at a time
MOST_PARTITIONS = 1 << 17  # that buckets are dealt to; beyond, a partition takes several in turn
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BEFORE, AFTER = 0xFF, 0xFE  # bytes that UTF-8 doesn't have, around a text


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    n = len(data) - 7
    return np.lib.stride_tricks.as_strided(data, (n, 8), (1, 1)).copy().view("<u8").ravel() if n > 0 else np.zeros(0, np.uint64)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, context hash) of the anchors of a text; none under ``length`` bytes.

    A context is the ``length`` - GRAM bytes before the anchor, it, and as many after.
    """
    n, reach = len(text), length - GRAM
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    data = np.frombuffer(bytes([BEFORE]) * reach + text + bytes([AFTER]) * (reach + 8), np.uint8)
    eight = _eights(data)
    grams = n - GRAM + 1
    own = _mix(eight[reach : reach + grams] * _A ^ _mix(eight[reach + GRAM - 8 : reach + GRAM - 8 + grams] * _C))
    width = reach + 1  # grams in a string
    least, size = own, 1
    while size * 2 <= width:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    # a gram is an anchor if it is the least of some string that holds it
    spread = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    most, size = spread, 1
    while size * 2 <= width:
        most, size = np.maximum(most[:-size], most[size:]), size * 2
    if size < width:
        most = np.maximum(most[: len(most) - (width - size)], most[width - size :])
    at = np.flatnonzero(most[:grams] == own)
    context = np.zeros(len(at), np.uint64)
    total = 2 * reach + GRAM
    for k in [*range(0, total - 7, 8), total - 8]:
        context = _mix(context * _C ^ eight[at + k] * _A)
    return at, own[at], context


def _identity(docs: DataFrame) -> DataFrame:
    """doc (null ids before all others), row (with doc it names a row; of equal ids and texts the same) and text."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc.alias("doc"), F.xxhash64(doc, text).alias("row"), text.alias("text"))


def _concat(parts: list, kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _by_context(own: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that puts equal anchors with equal contexts together, where their groups start in it, and the groups of its entries."""
    order = np.argsort(_mix(own * _A ^ context * _C))
    a, b = own[order], context[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _later(own: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have an earlier document's entry of equal anchor and context beside them."""
    later = np.zeros(len(own), bool)
    if len(own):
        order, starts, group = _by_context(own, context)
        later[order] = doc[order] > np.minimum.reduceat(doc[order], starts)[group]
    return later


def dealt_anchors(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """One row per batch and bucket: packed hashes, context hashes, documents, rows and places of anchors.

    What an earlier document of the same batch covers is decided there: its rows
    and places go along in ``covered``, to a bucket that the batch's first row sets.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffers(batch.column(2))
            whole = data.tobytes()
            parts: list[list] = [[], [], [], [], []]
            for i in range(len(doc)):
                at, own, context = anchors(whole[offsets[i] : offsets[i + 1]], length)
                for part, values in zip(parts, (own, context, np.full(len(at), doc[i]), np.full(len(at), row[i]), at), strict=True):
                    part.append(values)
            own, context, docs, ids, at = (_concat(p, k) for p, k in zip(parts, ("u8", "u8", "i8", "i8", "i8"), strict=True))
            later = _later(own, context, docs)
            covered = docs[later].tobytes() + ids[later].tobytes() + at[later].astype("<u4").tobytes()
            own, context, docs, ids, at = (x[~later] for x in (own, context, docs, ids, at))
            bucket = (_mix(own ^ _C) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: list[list] = [[], [], []]
            if covered:
                out[0].append(int(row[0]) % buckets)
                out[1].append(None)
                out[2].append(covered)
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                some = order[bounds[b] : bounds[b + 1]]
                out[0].append(b)
                out[1].append(own[some].tobytes() + context[some].tobytes() + docs[some].tobytes() + ids[some].tobytes() + at[some].astype("<u4").tobytes())
                out[2].append(None)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["bucket", "packed", "covered"])

    return rows.mapInArrow(lambda batches: released(packed(batches)), "bucket long, packed binary, covered binary")


def shared_anchors(dealt: DataFrame) -> DataFrame:
    """(doc, row, at, anchor, whole): anchors of several documents; whole if an earlier document has the
    whole context, else the places in the context's first holder, where other contexts have the anchor too."""

    def compared(table: pa.Table) -> pa.Table:
        parts: list[list] = [[], [], [], [], []]
        for blob in table.column("packed").drop_null():
            raw = blob.as_buffer()
            n = len(raw) // 36
            for k in range(4):
                parts[k].append(np.frombuffer(raw, "<u8" if k < 2 else "<i8", n, 8 * n * k))
            parts[4].append(np.frombuffer(raw, "<u4", n, 32 * n))
        own, context, doc, row, at = (_concat(p, k) for p, k in zip(parts, ("u8", "u8", "i8", "i8", "u4"), strict=True))
        whole = chosen = np.zeros(len(own), bool)
        if len(own):
            order, starts, group = _by_context(own, context)
            own, doc, row, at = own[order], doc[order], row[order], at[order]
            first, last = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
            whole = doc > first[group]
            holders, by_anchor = _ranked(own[starts])  # of each context, the number of its anchor
            contexts = np.bincount(holders)
            opens = np.cumsum(contexts) - contexts
            several = np.minimum.reduceat(first[by_anchor], opens) < np.maximum.reduceat(last[by_anchor], opens)
            chosen = whole | (several & (contexts > 1))[holders[group]]
        found = [[doc[chosen]], [row[chosen]], [at[chosen].astype(np.int64)], [np.where(whole, np.uint64(0), own)[chosen].view(np.int64)], [whole[chosen]]]
        for blob in table.column("covered").drop_null():
            raw = blob.as_buffer()
            n = len(raw) // 20
            for column, values in zip(found, (np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n), np.frombuffer(raw, "<u4", n, 16 * n).astype(np.int64), np.zeros(n, np.int64), np.ones(n, bool)), strict=True):
                column.append(values)
        return pa.table(dict(zip(("doc", "row", "at", "anchor", "whole"), map(np.concatenate, found), strict=True)))

    return dealt.groupBy("bucket").applyInArrow(compared, "doc long, row long, at long, anchor long, whole boolean")


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of keys, and the order that sorts them (equal keys in any order)."""
    order = np.argsort(key)
    ordered = key[order]
    new = ordered[1:] != ordered[:-1]
    rank = np.zeros(len(key), np.int64)
    rank[order[1:]] = np.cumsum(new)
    return rank, order


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of rows of equal width, for strings of ``length``."""

    def __init__(self, rows: np.ndarray, doc: np.ndarray, length: int):
        m, width = rows.shape
        data = np.concatenate([rows, np.zeros((m, 1), np.uint8)], axis=1).ravel()  # 0 ends each row
        n, self.stride = len(data), width + 1
        padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
        key = _eights(padded)[:n].byteswap()
        rank, order = _ranked(key)
        span = 8
        while span < length:
            step = min(span, length - span)
            after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank, order = _ranked(rank * np.int64(n + 1) + after)
            span += step
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        transform = data[order - 1]  # the byte before each suffix
        starts = np.flatnonzero(np.r_[True, transform[1:] != transform[:-1]])
        sizes = np.diff(np.append(starts, n))
        by_byte = np.lexsort((starts, transform[starts]))
        self.n, self.run_byte, self.run_start, self.run_size = n, transform[starts][by_byte].astype(np.int64), starts[by_byte], sizes[by_byte]
        self.run_key = self.run_byte * (n + 1) + self.run_start
        ends = np.cumsum(self.run_size)
        opens = np.r_[True, self.run_byte[1:] != self.run_byte[:-1]]
        self.run_before = ends - self.run_size - (ends - self.run_size)[opens][np.cumsum(opens) - 1]  # equal bytes in the runs before
        self.first = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=256))])
        sorted_rank = rank[order]
        self.interval = sorted_rank  # ranks of length-byte prefixes number the intervals
        self.begin = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]])
        self.earliest = np.minimum.reduceat(doc[order // self.stride], self.begin)

    def step(self, interval: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The intervals of the strings that ``byte`` and then the strings of ``interval`` begin, which must occur."""
        at, byte = self.begin[interval], byte.astype(np.int64)
        run = np.maximum(np.searchsorted(self.run_key, byte * (self.n + 1) + at, "right") - 1, 0)
        before = self.run_before[run] + np.minimum(at - self.run_start[run], self.run_size[run])
        return self.interval[self.first[byte] + np.where(self.run_byte[run] == byte, before, 0)]


def long_matches(rows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each row and start 0..width - length, whether the string from there also stands in a row of an earlier document."""
    m, width = rows.shape
    out = np.zeros((m, width - length + 1), bool)
    index = RunIndex(rows, doc, length)
    now = index.interval[index.place[np.arange(m) * index.stride + width - length]]
    for start in range(width - length, -1, -1):
        out[:, start] = index.earliest[now] < doc
        if start:
            now = index.step(now, rows[:, start - 1])
    return out


def contexts_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, side, row, doc, at, context) of the anchors (doc, row, at, anchor, hot) ``wanted``.

    The key is the anchor, or for a hot one in turn: it and half of the reach
    before it (side 1) or after it (side 2), each with what strings that hold the
    key can reach.
    """
    reach = length - GRAM
    width, half = 2 * reach + GRAM, reach // 2
    wanted = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "anchor", "hot")).alias("wanted"))
    both = rows.join(wanted, ["doc", "row"]).select("row", "doc", "text", F.col("wanted.at").alias("at"), F.col("wanted.anchor").alias("anchor"), F.col("wanted.hot").alias("hot"))

    def out(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())], ["key", "side", "row", "doc", "at", "context"])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            whole = data.tobytes()
            columns: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                if len(columns[0]) >= OUT_ROWS:
                    yield out(columns)
                    columns = [[], [], [], [], [], []]
                row, doc, ats, keys, hots = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
                text = bytes([BEFORE]) * reach + whole[offsets[i] : offsets[i + 1]] + bytes([AFTER]) * reach
                last = len(text) - 2 * reach - length
                for at, key, hot in zip(ats, keys, hots, strict=True):
                    context = text[at : at + width]
                    dealt = [(key, 0, context)]
                    if hot:
                        before, after = context[half : reach + GRAM], context[reach : half + length]
                        dealt = [(xxhash.xxh64_intdigest(before, 1) - 2**63, 1, context[: half + length]), (xxhash.xxh64_intdigest(after, 2) - 2**63, 2, context[reach - half :])]
                    for own, side, reached in dealt:
                        for column, value in zip(columns, (own, side, row, doc, at << 32 | last, reached), strict=True):
                            column.append(value)
            yield out(columns)

    return both.mapInArrow(lambda batches: released(extracted(batches)), "key long, side long, row long, doc long, at long, context binary")


def _by_width(table: pa.Table, length: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """The contexts of anchors, then those of halves: rows, bytes, and for each start in them its place and whether a string starts there."""
    reach = length - GRAM
    sides = table.column("side").to_numpy()
    for some in (sides == 0, sides > 0):
        if some.any():
            part = table.filter(pa.array(some))
            texts = np.frombuffer(b"".join(part.column("context").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            packed = part.column("at").to_numpy()
            begin = (packed >> 32) - reach + np.where(sides[some] == 2, reach - reach // 2, 0)
            starts = begin[:, None] + np.arange(texts.shape[1] - length + 1)[None, :]
            yield part, texts, starts, (starts >= 0) & (starts <= (packed & 0xFFFFFFFF)[:, None])


def _of_several(table: pa.Table) -> pa.Table:
    """The rows of keys that several documents have, of a table sorted by key."""
    keys, doc = table.column("key").to_numpy(), table.column("doc").to_numpy()
    new = np.r_[True, keys[1:] != keys[:-1]]
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
    return table.filter(pa.array(several[np.cumsum(new) - 1]))


def indexed_matches(contexts: DataFrame, length: int, most: int) -> DataFrame:
    """(doc, row, first, last) by run indexes over all contexts of a key, of which no key has more than ``most``."""
    contexts = contexts.repartition(shuffle_partitions(contexts.sparkSession), "key").sortWithinPartitions("key")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for part, texts, starts, mine in _by_width(_of_several(table), length):
                hits = long_matches(texts, part.column("doc").to_numpy(), length) & mine
                edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                r, a = np.nonzero(edge == 1)
                _, b = np.nonzero(edge == -1)
                yield pa.RecordBatch.from_arrays([*(pa.array(part.column(c).to_numpy()[r]) for c in ("doc", "row")), pa.array(starts[r, a]), pa.array(starts[r, 0] + b - 1)], ["doc", "row", "first", "last"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= max(1, most // 4):
                keys = held.column("key").to_numpy()
                begin = int(np.searchsorted(keys, keys[-1]))
                if begin:
                    yield from out(held.slice(0, begin))
                    held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from out(held)

    return contexts.mapInArrow(lambda batches: released(matched(batches)), "doc long, row long, first long, last long")


def counted_matches(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, row, first, last) by the earliest document of each string, however many contexts a key has.

    Equal strings are salted by row: a salt's earliest document comes first, then
    the earliest of all salts, which goes back to each of them.
    """
    salts = shuffle_partitions(contexts.sparkSession)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, starts, mine in _by_width(pa.Table.from_batches([batch]), length):
                r, a = np.nonzero(mine)
                digests = [hashlib.blake2b(texts[i, k : k + length], digest_size=16).digest() for i, k in zip(r.tolist(), a.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part.column("row").to_numpy()[r]), pa.array(part.column("doc").to_numpy()[r]), pa.array(starts[r, a]), pa.array(digests, pa.binary())], ["row", "doc", "start", "string"])

    found = contexts.mapInArrow(lambda batches: released(strings(batches)), "row long, doc long, start long, string binary").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    salted = found.groupBy("string", "salt").agg(F.min("doc").alias("earliest"))
    earliest = salted.groupBy("string").agg(F.min("earliest").alias("earliest"))
    salted = salted.drop("earliest").join(earliest, "string")
    return found.join(salted, ["string", "salt"]).filter("doc > earliest").select("doc", "row", F.col("start").alias("first"), F.col("start").alias("last"))


def partial_matches(rows: DataFrame, shared: DataFrame, length: int, suffixes: int = INDEX_SUFFIXES) -> list[DataFrame]:
    """Tables of (doc, row, first, last): places where strings start that an earlier document has, from contexts that share an anchor only.

    Keys with more contexts than an index of ``suffixes`` takes are counted exactly
    and dealt by longer keys, those of them that have too many still by strings.
    """
    most = max(1, suffixes // (2 * (length - GRAM) + GRAM))
    wanted = shared.filter("not whole").select("doc", "row", "at", "anchor")
    hot = cut_table(wanted.groupBy("anchor").count().filter(F.col("count") > most).select("anchor", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return [indexed_matches(contexts_of(rows, wanted.withColumn("hot", F.lit(False)), length), length, most)]
    wanted = wanted.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    contexts = cut_table(contexts_of(rows, wanted, length))
    hotter = cut_table(contexts.filter("side > 0").groupBy("key").count().filter(F.col("count") > most).select("key"))
    if hotter.isEmpty():
        return [indexed_matches(contexts, length, most)]
    return [indexed_matches(contexts.join(hotter, "key", "left_anti"), length, most), counted_matches(contexts.join(hotter, "key", "left_semi"), length)]


def removed_spans(docs: DataFrame, length: int = LENGTH, suffixes: int = INDEX_SUFFIXES) -> DataFrame:
    """(doc, row, spans): by row of ``_identity(docs)``, packed pairs of the first and last place where removed strings start."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = _identity(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    shared = cut_table(shared_anchors(dealt_anchors(rows, buckets, length).repartition(min(buckets, MOST_PARTITIONS), "bucket")))
    reach = length - GRAM
    whole = shared.filter("whole").select("doc", "row", (F.col("at") - reach).alias("first"), F.col("at").alias("last"))
    for part in partial_matches(rows, shared, length, suffixes):
        whole = whole.unionAll(cut_table(part))
    return whole.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def dedup_strings(docs: DataFrame, length: int = LENGTH, with_text: bool = False, suffixes: int = INDEX_SUFFIXES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row (and kept, the bytes, ``with_text``).

    A byte goes if a string of ``length`` bytes over it also starts in a document
    of a smaller doc_id; strings don't cross documents and are judged on the
    input. A null text is empty; null ids are one document, the smallest; rows of
    equal id don't remove each other's bytes; an empty table gives no rows; other
    columns are ignored.
    """
    found = removed_spans(docs, length, suffixes)
    rows = _identity(docs).withColumn("doc_id", F.when(F.col("doc") != -(2**63), F.col("doc")))
    both = rows.join(found, ["doc", "row"], "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            whole = data.tobytes()
            out: list[list] = [[], [], [], [], []]
            for i, (first, last) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                text = whole[offsets[i] : offsets[i + 1]]
                n, gone, spans = len(text), 0, 0
                if first.is_valid and len(first) and n >= length:
                    a = np.maximum(first.values.to_numpy(), 0)
                    b = np.minimum(last.values.to_numpy(), n - length)
                    fine = a <= b
                    depth = np.bincount(a[fine], minlength=n + 1) - np.bincount(b[fine] + length, minlength=n + 1)
                    cover = np.cumsum(depth[:n]) > 0
                    gone = int(cover.sum())
                    spans = int(np.count_nonzero(cover[1:] & ~cover[:-1]) + cover[0])
                    text = np.frombuffer(text, np.uint8)[~cover].tobytes()
                for column, value in zip(out, (n, gone, spans, hashlib.sha256(text).hexdigest(), text if with_text else None), strict=True):
                    column.append(value)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            if with_text:
                names, columns = [*names, "kept"], [*columns, pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return both.mapInArrow(lambda batches: released(removed(batches)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
