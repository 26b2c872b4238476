"""Embedding near-dedup by NN-descent.

Equal vectors of a label become one node. A forest of random-hyperplane orders
gives each node first neighbours, in as many orders as the rows of its label
need for a pair at the threshold to stand close in one of them; rounds of
NN-descent then compare neighbours of neighbours and keep each node's nearest.
All links seen join their nodes' components, also those that no list has room
for. A node whose list holds links only is saturated: its list is enlarged to all
links it has in its component, whose members it is compared with tile by tile;
members that aren't saturated are compared with those that are, not with each
other. Fresh orders audit the links of all
nodes: they are added until they find hardly any link that was not known. Edges
at the threshold or above stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, bounds, cut, groups, ranked, released, shuffle_partitions
from tessera.llm.components import attach, components
from tessera.llm.vectors import dimension, matrix, unit, usable

#: Places that a node looks to either side in an order, neighbours kept, those of one order, reverse neighbours a round looks at.
REACH, NEIGHBOURS, FIRST, REVERSE = 128, 12, 6, 6
#: The share of pairs at the threshold that the first orders may leave apart; orders at least.
APART, LEAST_ORDERS = 1e-4, 4
#: The share of a fresh batch's links that must have been known; rounds of NN-descent; nodes of a tile.
RECALL, ROUNDS, TILE = 0.999, 1, 1024
#: What stands for the score where an edge says only that links join its nodes.
JOINED = 9.0
EDGES = "u long, v long, s double"


def _found(ids: np.ndarray, x: np.ndarray, rows: slice, among: slice, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each of ``rows`` the ``most`` nearest in ``among`` and links up to NEIGHBOURS; for all links there, edges to the smallest node that they join."""
    mine, others = ids[rows], ids[among]
    s = x[rows] @ x[among].T
    s[np.arange(len(mine)), np.arange(len(mine)) + rows.start - among.start] = -2.0
    k = min(NEIGHBOURS, len(others) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(s, near, axis=1)
    order = np.argsort(-score, axis=1)
    near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
    keep = (np.arange(k) < most) | (score >= threshold)
    u, v, score = np.repeat(mine, k)[keep.ravel()], others[near[keep]], score[keep]
    linked = s >= threshold
    if not linked.any():
        return u, v, score
    left, right = linked.any(axis=1), linked.any(axis=0)
    linked, mine, others = linked[left][:, right], mine[left], others[right]
    none = np.iinfo(np.int64).max
    own, before = mine.copy(), None
    while before is None or (own != before).any():
        before = own
        least = np.minimum(others, np.where(linked, own[:, None], none).min(axis=0))
        own = np.minimum(own, np.where(linked, least[None, :], none).min(axis=1))
    a, b = np.concatenate([mine, others]), np.concatenate([own, least])
    a, b = a[a != b], b[a != b]
    return np.concatenate([u, a]), np.concatenate([v, b]), np.concatenate([score, np.full(len(a), JOINED)])


def _batch(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    flat = lambda c, kind: pa.array(np.concatenate([p[c] for p in parts]) if parts else [], kind)
    return pa.RecordBatch.from_arrays([flat(0, pa.int64()), flat(1, pa.int64()), flat(2, pa.float64())], ["u", "v", "s"])


def _nearest(edges: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """Each node's ``most`` nearest, and all edges that say what links join."""
    one = edges.filter("u != v").groupBy("u", "v", (F.col("s") == JOINED).alias("_j")).agg(F.max("s").alias("s"))
    nth = F.row_number().over(Window.partitionBy("u", "_j").orderBy(F.desc("s"), "v"))
    return one.withColumn("_n", nth).filter(F.col("_j") | (F.col("_n") <= most)).select("u", "v", "s")


def orders(rows: Column, threshold: float) -> Column:
    """Orders for a label of so many nodes: two vectors at the threshold have equal signs for a hyperplane with
    probability 1 - angle / pi, and stand within REACH of each other where they have as many equal signs as halve the label to REACH."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    together = F.pow(F.lit(same), F.log2(F.greatest(rows / REACH, F.lit(1.0))))
    wanted = F.when(together < 1, F.ceil(F.lit(math.log(APART)) / F.log(1 - together)))
    return F.greatest(F.coalesce(wanted, F.lit(0)), F.lit(LEAST_ORDERS)).cast("int")


def in_orders(nodes: DataFrame, width: int, threshold: float, batch: int = 0) -> DataFrame:
    """Edges of ``nodes`` (id, label, x, orders) from as many orders as each has: nodes of a label stand by the signs of 32 random hyperplanes, of other ones for each ``batch``, and each is compared with those up to REACH places away at least."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, wanted = matrix(rows.column(2), width), rows.column(3).to_numpy()
            for t in range(int(wanted.max(initial=0))):
                planes = np.random.default_rng([3, batch, t]).standard_normal((width, 32))
                bits = np.packbits(x @ planes >= 0, axis=1).view(">u4").ravel().astype(np.int64)
                every = pa.RecordBatch.from_arrays([rows.column(1), pa.array(np.full(len(x), t)), pa.array(bits), rows.column(0), rows.column(2)], ["label", "tree", "code", "id", "x"])
                yield every.filter(pa.array(wanted > t))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            ids, x = table.column(3).to_numpy(), unit(matrix(table.column(4), width))
            edges = bounds(table, 2)
            parts = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for at in range(a, b, REACH) if b - a > 1 else ():
                    parts.append(_found(ids, x, slice(at, min(at + REACH, b)), slice(max(a, at - REACH), min(at + 2 * REACH, b)), FIRST, threshold))
                    if len(parts) >= 64:
                        yield _batch(parts)
                        parts = []
            yield _batch(parts)

    keyed = nodes.select("id", "label", "x", "orders").mapInArrow(lambda batches: released(ordered(batches)), "label long, tree long, code long, id long, x " + dict(nodes.dtypes)["x"])
    keys = ["label", "tree", "code", "id"]
    spread = keyed.repartitionByRange(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut(_nearest(spread.mapInArrow(lambda batches: released(compared(batches)), EDGES)))


def descend(nodes: DataFrame, graph: DataFrame, width: int, threshold: float, reverse: int = REVERSE) -> DataFrame:
    """One round: the neighbours of each node, and some nodes of which it is one, are compared with each other."""
    lists = graph.filter(F.col("s") != JOINED)
    back = lists.select(F.col("v").alias("w"), F.col("u").alias("a"))
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.xxhash64("a", "w")))
    back = back.withColumn("_n", nth).filter(F.col("_n") <= reverse).drop("_n")
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("a")).unionAll(back).distinct()
    around = around.join(nodes.select(F.col("id").alias("a"), "x"), "a").select("w", "a", "x")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            ids, x = table.column(1).to_numpy(), unit(matrix(table.column(2), width))
            edges = bounds(table, 1)
            every = [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if b - a > 1]
            yield _batch([_found(ids, x, one, one, 4, threshold) for one in every])

    found = around.repartition(shuffle_partitions(nodes.sparkSession), "w").sortWithinPartitions("w", "a").mapInArrow(lambda batches: released(compared(batches)), EDGES)
    return cut(_nearest(graph.unionAll(found)))


def linked(graph: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(u, v) of each link listed, both ways round; (node, root) of all that links join; (node, root) of the saturated."""
    near = graph.filter((F.col("s") >= threshold) & (F.col("s") != JOINED))
    both = cut(near.select("u", "v").unionAll(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    joined = graph.filter(F.col("s") == JOINED).select("u", "v")
    roots = components(both.unionAll(joined).select(F.col("u").alias("a"), F.col("v").alias("b")))
    full = near.groupBy("u").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= NEIGHBOURS).select("u")
    return both, roots, cut(full.join(roots, F.col("u") == F.col("node")).select("node", "root"))


def unknown(fresh: DataFrame, both: DataFrame, roots: DataFrame, wide: DataFrame, threshold: float) -> tuple[int, int]:
    """How many links ``fresh`` orders list, and how many of them are neither listed in ``both`` nor found by enlarging a list of ``wide``."""
    found = fresh.filter((F.col("s") >= threshold) & (F.col("s") != JOINED)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    known = both.withColumn("_known", F.lit(1))
    out = found.join(known, ["u", "v"], "left")
    for end, root, full in (("u", "_a", "_p"), ("v", "_b", "_q")):
        ends = roots.join(wide.select(F.col("node").alias("_node"), F.lit(True).alias("_full")), F.col("node") == F.col("_node"), "left")
        out = out.join(ends.select(F.col("node").alias(end), F.col("root").alias(root), F.col("_full").alias(full)), end, "left")
    enlarged = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)) & (F.coalesce("_p", F.lit(False)) | F.coalesce("_q", F.lit(False)))
    lost = F.col("_known").isNull() & ~enlarged
    row = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(lost.cast("long")), F.lit(0)).alias("lost")).first()
    return row["n"], row["lost"]


def tiles(members: DataFrame, rows: int, width: int, threshold: float) -> DataFrame:
    """(id, links): how many vectors each of ``members`` (root, id, n, x, wide) links with in its component, of those with ``wide`` if it hasn't it itself, of all if it has."""
    placed = ranked(members, ["root", "wide"], ["id"], rows).withColumn("tile", F.floor(F.col("rank") / TILE))
    last = placed.groupBy("root").agg(F.max(F.when(F.col("wide"), F.col("tile"))).alias("_wide"), F.max(F.when(~F.col("wide"), F.col("tile"))).alias("_rest"))
    placed = placed.join(last, "root")
    upto = lambda name: F.when(F.col(name).isNotNull(), F.sequence(F.lit(0).cast("long"), F.col(name))).otherwise(F.array().cast("array<long>"))
    pair = lambda kind, i, j: F.struct(F.lit(kind).cast("long").alias("kind"), i.alias("i"), j.alias("j"))
    with_wide = F.transform(upto("_wide"), lambda o: pair(0, F.least(F.col("tile"), o), F.greatest(F.col("tile"), o)))
    with_rest = F.transform(upto("_rest"), lambda o: pair(1, F.col("tile"), o))
    of_rest = F.transform(upto("_wide"), lambda o: pair(1, o, F.col("tile")))
    every = placed.withColumn("at", F.explode(F.when(F.col("wide"), F.concat(with_wide, with_rest)).otherwise(of_rest)))
    every = every.select("root", "at.kind", "at.i", "at.j", "tile", "wide", "id", "n", "x")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 4):
            edges = bounds(table, 4)
            kind, i, j, tile, wide, ids, n = (table.column(c).to_numpy() for c in range(1, 8))
            x = unit(matrix(table.column(8), width))
            out_ids, out_links = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = np.arange(a, b)
                left = here[wide[a:b] & (tile[a:b] == i[a])]
                right = here[~wide[a:b]] if kind[a] else here[tile[a:b] == j[a]]
                near = x[left] @ x[right].T >= threshold
                if not kind[a] and i[a] == j[a]:
                    np.fill_diagonal(near, False)
                else:
                    out_ids.append(ids[right])
                    out_links.append(n[left] @ near)
                out_ids.append(ids[left])
                out_links.append(near @ n[right])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(out_links).astype(np.int64))], ["id", "links"])

    keys = ["root", "kind", "i", "j"]
    dealt = every.repartition(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, "tile", "id")
    return dealt.mapInArrow(lambda batches: released(compared(batches)), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``table``.

    Vectors link when their labels are equal and not null and their cosine is
    ``threshold`` or more, in double precision. A row of a null label, of a vector
    that can't be compared or of one of another length than most links with
    nothing and is its own component. Equal rows, and rows of equal or null key,
    are rows like others and link with each other; a null key names a component
    only if all its keys are null, and is kept then. An empty table gives no rows;
    other columns are ignored.
    """
    bounded_batches(table.sparkSession)
    kinds = dict(table.dtypes)
    named = F.col(label).cast("long") if kinds[label] in ("tinyint", "smallint", "int", "bigint", "boolean") else F.when(F.col(label).isNotNull(), F.xxhash64(label))
    x = F.col(vector).cast("array<float>" if kinds[vector] == "array<float>" else "array<double>")
    rows = table.select(F.col(key).cast("long").alias("key"), named.alias("label"), x.alias("x"), F.monotonically_increasing_id().alias("r"))
    able = F.col("label").isNotNull() & usable(F.col("x"))
    plain = F.transform("x", lambda v: v + F.lit(0.0).cast(kinds[vector].removeprefix("array<").removesuffix(">") if kinds[vector] == "array<float>" else "double"))  # no -0.0
    rows = cut(rows.withColumn("x", F.when(able, plain)))
    width = dimension(rows.filter(F.col("x").isNotNull()), "x")
    part = rows.filter(F.size("x") == width) if width else rows.limit(0)
    nodes = cut(part.groupBy("label", "x").agg(F.min("r").alias("id"), F.min("key").alias("first"), F.count(F.lit(1)).alias("n")))
    count = nodes.count()
    if not count:
        return rows.select(F.col("key").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    sizes = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_rows"))
    nodes = cut(nodes.join(sizes, "label").withColumn("orders", orders(F.col("_rows"), threshold)).drop("_rows"))
    graph = in_orders(nodes, width, threshold)
    for _ in range(ROUNDS):
        graph = descend(nodes, graph, width, threshold)
    some = nodes.withColumn("orders", F.ceil(F.col("orders") / 2).cast("int"))
    batch, met = 0, False
    both, roots, wide = linked(graph, threshold)
    while not met:
        batch += 1
        fresh = in_orders(some, width, threshold, batch)
        links, lost = unknown(fresh, both, roots, wide, threshold)
        met = lost <= (1 - RECALL) * links
        if lost:
            graph = cut(_nearest(graph.unionAll(fresh)))
            both, roots, wide = linked(graph, threshold)
    full = wide.select(F.col("node").alias("_node"), F.lit(True).alias("_wide"))
    members = roots.join(wide.select("root").distinct(), "root").join(full, F.col("node") == F.col("_node"), "left")
    members = cut(members.select("root", F.col("node").alias("id"), F.coalesce("_wide", F.lit(False)).alias("wide")).join(nodes.select("id", "n", "x"), "id"))
    tiled = tiles(members, max(1, members.count()), width, threshold)
    # a saturated node's links are all in tiles; of the others' those with saturated nodes are, and the rest are listed
    listed = both.join(nodes.select(F.col("id").alias("v"), "n"), "v").join(full.select(F.col("_node").alias("v"), "_wide"), "v", "left").filter("_wide is null")
    listed = listed.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("listed"))
    found = nodes.select("label", "x", "id", "first", "n").join(roots, F.col("id") == F.col("node"), "left").join(listed, "id", "left").join(tiled, "id", "left").join(full, F.col("id") == F.col("_node"), "left")
    counted = F.coalesce("links", F.lit(0)) + F.when(F.col("_wide").isNull(), F.coalesce("listed", F.lit(0))).otherwise(0) + F.col("n") - 1
    marks = lambda: (F.xxhash64("label", "x").alias("h"), F.xxhash64(F.lit(1), "label", "x").alias("g"))
    found = cut(found.select(*marks(), "n", "first", counted.alias("n_links"), F.coalesce("root", "id").alias("root")))
    by_root = found.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("nodes"))
    found = attach(found, cut(by_root), "root", "nodes", "h")
    by_hash = found.groupBy("h").agg(F.collect_list(F.struct("g", "n_links", "component")).alias("same"), F.sum("n").alias("rows"))
    own = F.when(F.size("x") == width, marks()[0]).otherwise(F.xxhash64("r"))
    out = attach(rows.select("key", "r", own.alias("h"), marks()[1], (F.size("x") == width).alias("part")), cut(by_hash), "h", "rows", "r")
    mine = F.when(F.col("part"), F.element_at(F.filter("same", lambda y: y["g"] == F.col("g")), 1))
    links, component = F.coalesce(mine["n_links"], F.lit(0)).cast("long"), F.when(mine.isNull(), F.col("key")).otherwise(mine["component"])
    return out.select(F.col("key").alias("vec_id"), links.alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
