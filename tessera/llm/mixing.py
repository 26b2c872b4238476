"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, laid end to end as words, are packed into blocks of a
fixed length. The mix is a row of slots dealt to output shards: a pseudorandom
permutation of all slots draws every shard's source counts as a multinomial does,
conditioned on the totals, so that the mix meets each target exactly. The k-th
slot of a source reads, in its k // blocks-th pass over the source, the block
that a pseudorandom permutation of that source and pass assigns to k % blocks.
Documents, cut into the blocks they lie in, meet the slots by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunk_rows, cut_table, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; slots of an output shard; rounds of a permutation.
BLOCK, SHARD_SLOTS, ROUNDS = 512, 4096, 24
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows up to which a table by source is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Slots that one row unfolds to.
CHUNK_SLOTS = 4096


def permuted(index: Column, size: Column, *key: Column, inverse: bool = False) -> Column:
    """A keyed pseudorandom permutation of 0..size-1 (swap-or-not): in each round a
    number and its mirror image at a keyed point change places or not, as a hash
    of the larger of the two says."""
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*key, size, r), size) - x, size)
        return F.when(F.pmod(F.xxhash64(*key, r, F.greatest(x, mirror)), F.lit(2)) == 0, x).otherwise(mirror)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), index.cast("long"), turn)


def _source(column: Column) -> Column:
    """A key that is never null: 's' and the source, or 'z' for null, in the order of the sources."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("z"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (_source, source_size): ``share`` of all sizes by weight, none above ``cap`` times its size.

    In order of cap by weight, the sources that stop at their cap are those
    first whose fair share of what the ones before left reaches it; the rest
    share what is left by weight. One row per source goes through the windows.
    """
    at = Window.orderBy("_source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(at) - 1) % len(weights) + 1).cast("int"))
    out = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(cap))
    all_of = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("_cap") / F.col("_w"), "_source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(all_of) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / F.sum("_w").over(after))
    free = F.col("_level") * F.col("_w") < F.col("_cap")
    out = out.withColumn("_at", F.max(F.when(free, F.col("_level"))).over(all_of))
    return out.withColumn("target", F.when(free, F.col("_at") * F.col("_w")).otherwise(F.col("_cap"))).drop("_w", "_cap", "_level", "_at")


def laid_out(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, _source, size, _hash and _copy (which of equal rows), and its first word's place in its source.

    Places are sums over hash chunks of a source and then over its chunks, so no
    window sees a whole source. The table is written once, so that all that
    follows, reruns included, sees the same places.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source(F.col("source")).alias("_source"), size.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("_hash")))
    n = rows.count()
    chunks = max(1, -(-n // chunk_rows(n)))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_source", "_hash").orderBy("size")))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "_hash", "_copy"), F.lit(chunks)))
    sums = rows.groupBy("_source", "_chunk").agg(F.sum("size").alias("_words"))
    ahead = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_source", "_chunk", F.coalesce(F.sum("_words").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_source", "_chunk").orderBy("doc_id", "_hash", "_copy").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.join(sums, ["_source", "_chunk"]).withColumn("_start", F.col("_ahead") + F.col("_inside"))
    return cut_table(placed.select("doc_id", "_source", "size", "_hash", "_copy", "_start"))


def source_plan(placed: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per source: source_size, target, blocks, slots, and the words by which its last slots are cut."""
    out = targets(placed.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    size, goal = F.col("source_size"), F.col("_goal")
    out = out.withColumn("_goal", F.least(F.round("target").cast("long"), F.floor(size * F.lit(cap)).cast("long")))
    out = out.withColumn("_blocks", F.ceil(size / block).cast("long"))
    whole = F.when(size > 0, F.floor(goal / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    rest = goal - whole * size
    slots = whole * F.col("_blocks") + F.when(rest > 0, F.ceil(rest / block) + 1).otherwise(0)
    most = F.col("_blocks") * F.lit(int(-(-cap // 1)))
    out = out.withColumn("_slots", F.least(slots, most).cast("long"))
    some = F.greatest(F.col("_blocks"), F.lit(1))
    turns = F.floor(F.col("_slots") / some).cast("long")
    partial = F.col("_slots") - turns * some
    short_at = permuted(some - 1, some, F.lit(seed), F.col("_source"), turns, inverse=True)
    words = turns * size + partial * block - F.when((partial > short_at) & (size > 0), some * block - size).otherwise(0)
    out = out.withColumn("_over", F.greatest(words - goal, F.lit(0)))
    order = Window.orderBy("_source").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_first", F.coalesce(F.sum("_slots").over(order), F.lit(0)))
    return cut_table(out.withColumn("_all", F.sum("_slots").over(Window.partitionBy())))


def slots(plan: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """One row per slot of the mix: _source, shard, slot (in its shard), _turn (pass over the source), _block, _words to read."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_slots") - 1) / CHUNK_SLOTS).cast("long")))
    out = plan.filter("_slots > 0").withColumn("_c", chunk)
    out = out.repartition(shuffle_partitions(plan.sparkSession), "_source", "_c")
    first = F.col("_c") * CHUNK_SLOTS
    out = out.withColumn("_k", F.explode(F.sequence(first, F.least(first + CHUNK_SLOTS, F.col("_slots")) - 1)))
    out = out.withColumn("_turn", F.floor(F.col("_k") / F.col("_blocks")).cast("long"))
    out = out.withColumn("_block", permuted(F.pmod("_k", "_blocks"), F.col("_blocks"), F.lit(seed), F.col("_source"), F.col("_turn")))
    length = F.when(F.col("_block") == F.col("_blocks") - 1, F.col("source_size") - F.col("_block") * block).otherwise(F.lit(block))
    out = out.withColumn("_words", length.cast("long"))
    # the last three slots of a source take what its target leaves them
    later = Window.partitionBy("_source").orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)
    last = out.filter(F.col("_k") >= F.col("_slots") - 3)
    last = last.withColumn("_cut", F.greatest(F.lit(0), F.least(F.col("_words"), F.col("_over") - F.coalesce(F.sum("_words").over(later), F.lit(0)))))
    last = last.withColumn("_words", F.col("_words") - F.col("_cut")).drop("_cut")
    out = out.filter(F.col("_k") < F.col("_slots") - 3).unionByName(last).filter("_words > 0")
    place = permuted(F.col("_first") + F.col("_k"), F.col("_all"), F.lit(seed + 1))
    out = out.withColumn("_place", place)
    return out.select("_source", F.floor(F.col("_place") / shard_slots).alias("shard"), F.pmod("_place", F.lit(shard_slots)).alias("slot"), "_turn", "_block", "_words")


def shard_counts(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """(shard, source, n_slots, n_words): how much of each source each output shard of the mix holds; an empty table gives no rows."""
    plan = source_plan(laid_out(docs), weights, share, cap, seed=seed)
    source = F.when(F.col("_source").startswith("s"), F.substring("_source", 2, 2**31 - 1))
    return slots(plan, seed=seed).groupBy("shard", source.alias("source")).agg(F.count(F.lit(1)).alias("n_slots"), F.sum("_words").alias("n_words"))


def pieces(placed: DataFrame, taken: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join documents that have words with slots by block: each document's row once per piece read (at: its first word there, words), or once with nulls."""
    last = F.floor((F.col("_start") + F.col("size") - 1) / block)
    blocks = F.sequence(F.floor(F.col("_start") / block).cast("long"), last.cast("long"))
    parts = placed.filter("size > 0").withColumn("_block", F.explode(blocks))
    joined = parts.join(taken.select("_source", "_block", "_words", "_turn", "shard", "slot").hint("merge"), ["_source", "_block"], "left")
    begin = F.greatest(F.col("_start"), F.col("_block") * block)
    end = F.least(F.col("_start") + F.col("size"), F.col("_block") * block + F.col("_words"))
    joined = joined.withColumn("at", begin - F.col("_start"))
    return joined.withColumn("words", F.when(F.col("_words").isNull(), 0).otherwise(F.greatest(end - begin, F.lit(0))).cast("long"))


def _by_source(rows: DataFrame, plan: DataFrame, sources: int, columns: list[str]) -> DataFrame:
    table = plan.select("_source", *columns)
    return rows.join(F.broadcast(table) if sources <= BROADCAST_SOURCES else table, "_source")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source): size, source_size, target, taken and reads.

    ``reads`` tells, by output shard and slot, how many words that slot reads of
    the row. A null text has size 0; a null source is a source of its own, last in
    order; repeated rows are rows like others, of which each has its own place;
    null ids are kept; words are counted in the whole text; an empty table gives
    no rows. Other columns are ignored.
    """
    placed = laid_out(docs)
    plan = source_plan(placed, weights, share, cap, seed=seed)
    read = F.when(F.col("words") > 0, F.struct("shard", "slot", "words"))
    got = pieces(placed, slots(plan, seed=seed)).groupBy("_source", "_start", "size", "doc_id", "_hash", "_copy")
    got = got.agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(read)).alias("reads")).select("doc_id", "_source", "size", "taken", "reads")
    none = placed.filter("size = 0").select("doc_id", "_source", "size", F.lit(0).cast("long").alias("taken"), F.array().cast(got.schema["reads"].dataType).alias("reads"))
    every = _by_source(got.unionByName(none), plan, plan.count(), ["source_size", "target"])
    return every.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "reads")


def mixed_texts(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """The mix itself: one row per document and pass over its source, with the words taken, in the columns of ``docs``.

    A word
    carries the white space after it. A row all of whose words are taken keeps its
    text as it is; n_chars, where there is one, is counted anew for the others.
    Documents without words (null texts too) and those of which no word is taken
    have no row; other columns stay, whatever their names; null and repeated ids
    and equal rows are rows like others; an empty table gives no rows.
    """
    placed = laid_out(docs)
    plan = source_plan(placed, weights, share, cap, seed=seed)
    read = pieces(placed, slots(plan, seed=seed)).filter("words > 0").groupBy("doc_id", "_source", "_hash", "_copy", "size", "_turn")
    read = read.agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("_pieces"), F.sum("words").alias("_taken"))
    read = read.select(F.col("doc_id").alias("_i"), "_source", "_hash", "_copy", "size", "_pieces", "_taken")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), _source(F.col("source")).alias("_s"), F.xxhash64(F.col("text").cast("string")).alias("_h"))
    comparable = [F.col("row").getField(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    own = own.withColumn("_c", F.row_number().over(Window.partitionBy("_id", "_s", "_h").orderBy(F.xxhash64(*comparable))))
    both = own.join(read, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_s") == F.col("_source")) & (F.col("_h") == F.col("_hash")) & (F.col("_c") == F.col("_copy")))
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    some = F.array_join(F.flatten(F.transform(F.col("_pieces"), lambda p: F.slice(words, (p["at"] + 1).cast("int"), p["words"].cast("int")))), "")
    both = both.withColumn("_new", F.when(F.col("_taken") < F.col("size"), some))
    fresh = {"text": F.col("_new"), "n_chars": F.length("_new")}
    own = lambda n: F.col("row").getField(n)
    return both.select(*[(F.when(F.col("_new").isNull(), own(n)).otherwise(fresh[n].cast(docs.schema[n].dataType)) if n in fresh else own(n)).alias(n) for n in docs.columns])
