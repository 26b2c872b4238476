"""Near copies by the Jaccard similarity of their shingles: SimHash proposes, the shingles themselves decide.

Documents of equal shingle sets are one node. A node's fingerprint has a bit for
each of BITS hashes that over half of its shingles have; of sets of similarity 0.8
15 % of the bits differ, of sets of 4 and 5 shingles FLIP. Drawn bits make up
parts, a part's segments of SEGMENT bits are embedded as their bit counts, and the
fingerprints of equal grid point of a part meet. Parts have as many segments as
keep about CELL unrelated nodes at a point, and there are as many parts as leave
MISSED of the pairs that differ in FLIP of their bits without one in common, by
calculation. Of those that meet, pairs whose fingerprints are near are compared
exactly: all of a small group of a cell; large groups that share members are one
family, whose members are compared with HUBS of them; members that still belong to
different components are at last compared tile by tile, and only links leave a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, bounds, cut_table, discarded, groups, named, one_of_each, ranked, released, shuffle_partitions, shuffles_removed
from tessera.llm.components import attach, components
from tessera.llm.simhash import firsts

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BITS, SEGMENT, FLIP, MISSED, CELL = 1024, 2, 0.1875, 1e-3, 256
#: Words of a fingerprint that go with its grid points, and bits in which the first two and all of them may differ.
CARRIED, NEAR_TWO, NEAR = 3, 44, 60
#: Parts whose grid points are shuffled at a time; rows of a cell compared as one matrix.
PARTS, MATRIX = 96, 1024
#: Shingles whose bits are counted at a time; near nodes of a cell compared whole at once; members of a family that all others are compared with; nodes whose texts are found by broadcast.
BLOCK, PAIRED, HUBS, BROADCAST = 4080, 16, 2, 1_000_000
#: Members of a tile at most, and hashes that a tile of the largest sets would hold.
TILE, TILE_HASHES = 1024, 4 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS bits of a set that isn't empty, as 64-bit words: what over half of its hashes have, of halves what one of them has, drawn for each word."""
    words = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones, one = np.zeros(BITS, np.int64), None
    for at in range(0, len(hashes), BLOCK):
        mixed = hashes[at : at + BLOCK, None] + words
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        if one is None:
            one = bits.reshape(len(bits), len(words), 64)[np.roll(mixed.argmin(axis=0), 1), np.arange(len(words))].ravel().astype(np.int64)
        for k in range(0, len(bits), 255):  # counts of bytes, eight at a time
            ones += bits[k : k + 255].view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * ones + one > len(hashes), bitorder="little").view(np.uint64)


def grid(nodes: int) -> np.ndarray:
    """(part, segment, bit): the bits of the segments of each part for so many nodes."""
    apart = math.log(max(1, nodes) / CELL) / -math.log(math.comb(2 * SEGMENT, SEGMENT) / 4**SEGMENT)
    segments = max(2, math.ceil(apart))
    kept, flipped = (1 - FLIP) ** 2, FLIP**2 / 2
    parts = math.ceil(-math.log(MISSED) / (kept + flipped) ** segments)
    drawn, each = np.random.default_rng(SEED), BITS // (SEGMENT * segments)
    dealt = [drawn.permutation(BITS)[: each * SEGMENT * segments].reshape(each, segments, SEGMENT) for _ in range(-(-parts // each))]
    return np.concatenate(dealt)[:parts]


def grid_points(words: np.ndarray, parts: np.ndarray, first: int) -> np.ndarray:
    """The grid point of each fingerprint (row) in each part (column), as a number; ``first`` is the number of the first part."""
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    points = np.broadcast_to(np.arange(first, first + len(parts)), (len(words), len(parts)))
    for k in range(parts.shape[1]):
        points = points * (SEGMENT + 1) + bits[:, parts[:, k]].sum(axis=2, dtype=np.int64)
    return points


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, id, a, b (as by ``common.named``), key (of the shingle set), size (of the set) and fp (its fingerprint's words) of every row."""
    marks = ["doc_id", "id", "a", "b"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(4)]
            keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
            fps = pa.array([fingerprint(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keys), pa.array([len(s) for s in sets], pa.int64()), fps], [*marks, "key", "size", "fp"])

    return named(docs).select(*marks, "text").mapInArrow(lambda batches: released(sketched(batches)), "doc_id long, id long, a long, b long, key long, size long, fp array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """key and hashes of each of ``nodes`` (key, first: a doc_id that has it)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "hashes"])

    wanted = nodes.select(F.col("first").alias("_first")).distinct()
    wanted = F.broadcast(wanted) if nodes.count() <= BROADCAST else wanted
    texts = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return cut_table(texts.mapInArrow(lambda batches: released(hashed(batches)), "key long, hashes array<long>").join(nodes.select("key"), "key", "left_semi").dropDuplicates(["key"]))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have at least ``similarity``."""
    left, right = sets.select(F.col("key").alias("a"), F.col("hashes").alias("_x")), sets.select(F.col("key").alias("b"), F.col("hashes").alias("_y"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("_x", "_y"))
    return cut_table(both.filter(shared >= F.lit(similarity) * (F.size("_x") + F.size("_y") - shared) - 1e-9).select("a", "b"))


def near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether fingerprints differ in few enough bits, by their carried words, an array each."""
    two = np.bitwise_count(left[0] ^ right[0]) + np.bitwise_count(left[1] ^ right[1])
    hit = two <= NEAR_TWO
    at = np.nonzero(hit)
    rest = two[at].astype(np.int64)
    for k in range(2, CARRIED):
        x, y = np.broadcast_arrays(left[k], right[k])
        rest += np.bitwise_count(x[at] ^ y[at])
    hit[at] = rest <= NEAR
    return hit


def near_in_cell(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(pairs of rows that are near, of small groups; rows of each larger group) of a cell; groups are what chains of near rows connect."""
    n = len(words[0])
    if n > MATRIX:
        return _near_in_large_cell(words)
    hit = near([w[:, None] for w in words], [w[None, :] for w in words])
    x, y = np.nonzero(hit)
    x, y = x[x < y], y[x < y]
    if len(x) <= PAIRED // 2:
        return np.stack([x, y], axis=1), []
    group = np.full(n, -1)
    large = []
    for k in np.unique(x).tolist():
        if group[k] >= 0:
            continue
        own, reached = hit[k], 0
        while reached < (reached := int(own.sum())):
            own = hit[own].any(axis=0)
        group[own] = k
        if reached > PAIRED:
            large.append(np.flatnonzero(own))
    within = np.zeros(n, bool)
    for rows in large:
        within[rows] = True
    return np.stack([x, y], axis=1)[~within[x]], large


def _near_in_large_cell(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    pairs, large, unseen = [np.zeros((0, 2), np.int64)], [], np.arange(len(words[0]))
    while len(unseen):
        group, waiting, unseen = [unseen[:1]], [unseen[0]], unseen[1:]
        while waiting and len(unseen):
            now = waiting.pop()
            hit = near([w[now] for w in words], [w[unseen] for w in words])
            group.append(unseen[hit])
            waiting.extend(unseen[hit].tolist())
            unseen = unseen[~hit]
        rows = np.concatenate(group)
        if len(rows) > PAIRED:
            large.append(rows)
        elif len(rows) > 1:
            found, _ = near_in_cell([w[rows] for w in words])
            pairs.append(rows[found])
    return np.concatenate(pairs), large


def proposed(nodes: DataFrame, parts: np.ndarray, first: int) -> DataFrame:
    """Of ``nodes`` (key, fp) that meet at a grid point of ``parts``: a and b, a pair whose fingerprints are near; or, if large, a member of a large group of such nodes and the least one."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(len(keys), BITS // 64)
            points = grid_points(words, parts, first)
            columns = [points.T.ravel(), np.tile(keys, len(parts)), *[np.tile(words[:, k].view(np.int64), len(parts)) for k in range(CARRIED)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            edges = bounds(table, 1)
            cells, keys = table.column(0).to_numpy(), table.column(1).to_numpy()
            words = [table.column(2 + k).to_numpy().view(np.uint64) for k in range(CARRIED)]
            pairs, members = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                found, large = near_in_cell([w[s:e] for w in words])
                if len(found):
                    pairs.append(keys[s:e][found])
                for rows in large:
                    own = keys[s:e][rows]
                    members.append(np.stack([own, np.full(len(own), own.min())], axis=1))
            two, one = np.concatenate(pairs), np.concatenate(members)
            both = np.concatenate([np.sort(two, axis=1), one])
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(np.arange(len(both)) >= len(two))], ["a", "b", "large"])

    names = ["cell", "key", *[f"w{k}" for k in range(CARRIED)]]
    points = nodes.select("key", "fp").mapInArrow(lambda batches: released(spread(batches)), ", ".join(f"{c} long" for c in names))
    dealt = points.repartition(shuffle_partitions(nodes.sparkSession), "cell").sortWithinPartitions("cell")
    return cut_table(dealt.mapInArrow(lambda batches: released(compared(batches)), "a long, b long, large boolean"))


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that connect all of ``nodes`` (key, first, size, fp) that chains of links connect."""
    known = nodes.filter("size > 0")
    parts = grid(known.count())
    passes = -(-len(parts) // PARTS)
    found_in = [proposed(known, parts[len(parts) * k // passes : len(parts) * (k + 1) // passes], len(parts) * k // passes) for k in range(passes)]
    met = found_in[0]
    for more in found_in[1:]:
        met = met.unionAll(more)
    large = cut_table(grouped(met.filter("large").select("a", "b")).join(nodes.select("key", "size"), "key"))
    pairs = cut_table(met.filter("not large").select("a", "b").unionAll(_with_hubs(large, similarity)).distinct())
    discarded(*found_in)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionAll(large.select("key")).distinct()
    sets = sets_of(docs, nodes.join(wanted, "key", "left_semi"), shingle)
    found = similar(pairs, sets, similarity)
    with shuffles_removed(docs.sparkSession):
        families = large.count()
    if families:
        rooted = large.join(components(found).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        split = rooted.groupBy("family").agg(F.min("root").alias("_least"), F.max("root").alias("_most")).filter("_least != _most")
        apart = cut_table(rooted.join(split.select("family"), "family").select("family", "key", "root", "size"), large)
        found = cut_table(found.unionAll(tiled(apart, sets, similarity)), found)
    discarded(sets, pairs)
    return found


def grouped(members: DataFrame) -> DataFrame:
    """(key, family): the nodes of large groups (a: member, b: the group's least one); groups of a common member are of one family."""
    least = members.groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("others"))
    others = least.select(F.explode("others").alias("a"), "b").distinct()
    return components(least.select("a", "b").unionAll(others)).select(F.col("node").alias("key"), F.col("root").alias("family"))


def _with_hubs(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of each of ``members`` (key, family, size) and each of HUBS members of its family, where their sizes allow ``similarity``."""
    member = F.struct("key", "size")
    drawn = [F.min_by(member, F.xxhash64("key", F.lit(k))) for k in range(HUBS)]
    both = members.join(members.groupBy("family").agg(F.array_distinct(F.array(*drawn)).alias("hubs")), "family").select("key", "size", F.explode("hubs").alias("hub"))
    fits = F.least("size", "hub.size") >= F.lit(similarity) * F.greatest("size", "hub.size") - 1e-9
    return both.filter((F.col("key") != F.col("hub.key")) & fits).select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b"))


def tiled(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the roots of ``members`` (family, key, root, size) of equal family, each tile's members held at once.

    A family's commonest root has tiles of its own, which meet only those of the others.
    """
    about = members.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    tile = max(1, min(TILE, TILE_HASHES // max(1, about["most"] or 1)))
    counts = members.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    sided = members.join(main, "family").select("family", "key", "root", (F.col("root") == F.col("main")).alias("side"))
    placed = ranked(sided, ["family", "side"], ["key"], max(1, about["n"])).withColumn("tile", F.floor(F.col("rank") / tile))
    last = placed.groupBy("family").agg(F.max(F.when(~F.col("side"), F.col("tile"))).alias("last"), F.max(F.when(F.col("side"), F.col("tile"))).alias("main_last"))
    # tiles of the others are numbered from 0, the commonest root's after them
    numbered = placed.join(last, "family").withColumn("tile", F.col("tile") + F.when(F.col("side"), F.col("last") + 1).otherwise(0))
    every = numbered.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + F.when(F.col("side"), 0).otherwise(F.col("main_last") + 1))))
    every = every.select("family", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "key", "root").join(sets, "key")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            edges = bounds(table, 3)
            i, j, tiles, keys, roots = (table.column(c).to_numpy() for c in range(1, 6))
            held = table.column(6).combine_chunks()
            links: list[tuple[int, int]] = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                _, codes = np.unique(held.slice(a, b - a).flatten().to_numpy(), return_inverse=True)
                ends = np.cumsum(held.slice(a, b - a).value_lengths().to_numpy())
                links += _forest(codes, ends, roots[a:b], tiles[a:b] == i[a], tiles[a:b] == j[a], keys[a:b], similarity)
            flat = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["a", "b"])

    dealt = every.select("family", "i", "j", "tile", "key", "root", "hashes").repartition(shuffle_partitions(members.sparkSession), "family", "i", "j")
    return dealt.sortWithinPartitions("family", "i", "j", "tile", "key").mapInArrow(lambda batches: released(compared(batches)), "a long, b long")


def _forest(codes: np.ndarray, ends: np.ndarray, roots: np.ndarray, left: np.ndarray, right: np.ndarray, keys: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of the left and of the right tile, of those that join the same roots one."""
    sizes, own = np.diff(ends, prepend=0), roots.copy()
    others = np.flatnonzero(right)
    begin = ends[others] - sizes[others]
    flat = codes[np.arange(sizes[others].sum()) + np.repeat(begin - (np.cumsum(sizes[others]) - sizes[others]), sizes[others])]
    opens = np.cumsum(sizes[others]) - sizes[others]
    seen, out = np.zeros(int(codes.max(initial=0)) + 1, bool), []
    for k in np.flatnonzero(left).tolist():
        mine = codes[ends[k] - sizes[k] : ends[k]]
        seen[mine] = True
        shared = np.add.reduceat(seen[flat].astype(np.int32), opens)
        seen[mine] = False
        hits = others[(own[others] != own[k]) & (shared >= similarity * (sizes[k] + sizes[others] - shared) - 1e-9)]
        for other, at in zip(*np.unique(own[hits], return_index=True), strict=True):
            out.append((int(keys[k]), int(keys[hits[at]])))
            own[own == other] = own[k]
    return out


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, id, a, b, root (a key that names the component) and component_id of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    sketched = cut_table(sketches(docs, shingle))
    nodes = cut_table(sketched.groupBy("key", "size", "fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    rows = cut_table(sketched.select("doc_id", "id", "a", "b", "key"), sketched)
    roots = components(links(docs, nodes, shingle, similarity))
    found = cut_table(nodes.select("key", "first", "n").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    discarded(nodes)
    by_root = found.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("keys"))
    known = attach(found.select("key", "n", "root"), cut_table(by_root), "root", "keys", "key")
    return attach(rows, cut_table(known.select("key", "n", "root", "component_id")), "key", "n", "doc_id")


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable by links, of every row of ``docs`` (doc_id, text).

    Texts link when the sets of their shingles have a Jaccard similarity of
    ``similarity`` or more; words are as in ``simhash.near_duplicates``. A text of
    fewer words than a shingle is one shingle; null texts and those without words
    link with each other. Equal rows and rows of equal id are rows like others;
    null ids are kept and name no component unless all its ids are null; an empty
    table gives no rows; other columns are ignored. A text's distinct shingles
    are held whole.
    """
    return classes(docs, shingle, similarity).select("doc_id", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns as they were, with one row of each component, as ``simhash.keep_first`` chooses it."""
    return one_of_each(docs, firsts(classes(docs, shingle, similarity)))
