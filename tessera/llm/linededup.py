"""Line dedup, with DataFrame functions only.

A line is known by a 128-bit hash of its key. Hashes are dealt by range, sorted by
document and position within a hash, and streamed once to tell which lines stay.
Only hashes of a great many lines, as a thin sample shows (by which a hash's way
is chosen, not its result), are counted by aggregation instead. What comes back to a document is a run-length bitmap of the
lines it keeps, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, ascii_lower, cut_table

#: One line in so many is looked at to find hashes that are handled apart: those seen more often than HITS times
#: and than a HEAVY-th of all looked at, which are fewer than HEAVY (and broadcast).
SAMPLED, HITS, HEAVY = 64, 64, 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(_doc, _text, pos) of the lines to drop; _doc and _text name a row of ``docs`` as in ``keep_bitmaps``."""
    rows = docs.select(_doc(F.col("doc_id")).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"), F.posexplode(_lines(F.col("text").cast("string"))).alias("pos", "_line"))
    rows = rows.withColumn("_key", line_key(F.col("_line"))).filter(F.length("_key") >= min_chars)
    rows = cut_table(rows.select(F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), F.col("_key")).alias("_b"), "_doc", "_text", "pos"))
    some = rows.filter(F.pmod(F.xxhash64(F.lit(2), "_doc", "pos"), F.lit(SAMPLED)) == 0).groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    heavy = cut_table(some.filter(F.col("_n") > max(HITS, rows.count() // SAMPLED // HEAVY)).select("_a", "_b", F.lit(True).alias("_heavy")))
    rows = rows.join(F.broadcast(heavy), ["_a", "_b"], "left")
    apart = rows.filter("_heavy")
    held = apart.groupBy("_a", "_b", "_doc").agg(F.lit(1).alias("_one")).groupBy("_a", "_b").agg(F.count("_one").alias("_docs"), F.max("_doc").alias("_last"))
    apart = apart.join(F.broadcast(held.filter(F.col("_docs") >= min_docs)), ["_a", "_b"]).filter(F.col("_doc") != F.col("_last"))
    rest = rows.filter("_heavy is null").repartitionByRange("_a", "_b").sortWithinPartitions("_a", "_b", "_doc", "pos")
    line = Window.partitionBy("_a", "_b").orderBy("_doc")
    whole = Window.partitionBy("_a", "_b").orderBy("_doc").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = rest.withColumn("_nth", F.dense_rank().over(line)).withColumn("_docs", F.max("_nth").over(whole))
    rest = rest.filter((F.col("_docs") >= min_docs) & (F.col("_nth") < F.col("_docs")))
    return apart.select("_doc", "_text", "pos").unionAll(rest.select("_doc", "_text", "pos"))


def _doc(doc_id: Column) -> Column:
    """A document's number; null ids are one document before all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """For each row that loses lines: _doc, _text and ``dropped``, the positions it loses, ascending."""
    return dropped_lines(docs, min_chars, min_docs).groupBy("_doc", "_text").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap of a document, run-length: structs (first, n) of neighbouring lines that stay."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    between = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct((F.element_at(edges, i) + 1).alias("first"), (F.element_at(edges, i + 1) - F.element_at(edges, i) - 1).alias("n")))
    return F.filter(between, lambda r: r["n"] > 0)


def _deduped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row (all columns of ``docs``, whatever their names), n_lines, n_dropped, keep, kept."""
    found = keep_bitmaps(docs, min_chars, min_docs)
    own = docs.select(F.struct("*").alias("row"), _doc(F.col("doc_id")).alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_text"))
    both = own.join(found, ["_doc", "_text"], "left")
    text = F.col("row.text").cast("string")
    lines = _lines(text)
    both = both.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size("dropped"), F.lit(0)).cast("long"))
    both = both.withColumn("keep", F.when(F.col("dropped").isNull(), F.array(F.struct(F.lit(0).alias("first"), F.col("n_lines").cast("int").alias("n")))).otherwise(runs(F.col("dropped"), F.col("n_lines"))))
    joined = F.array_join(F.flatten(F.transform(F.col("keep"), lambda r: F.slice(lines, r["first"] + 1, r["n"]))), "\n")
    return both.withColumn("kept", F.when(F.col("n_dropped") == 0, F.coalesce(text, F.lit(""))).otherwise(joined))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep (the bitmap) and kept, the text without the lines it loses, of every row of ``docs``.

    Lines are what ``\\n`` separates; their keys are stripped of ASCII white space
    and lower-cased in A-Z. A key of ``min_chars`` code points or more that
    ``min_docs`` documents or more hold keeps its lines only in the largest doc_id
    holding it. A null or empty text is one empty line; null ids count as one
    document, the smallest; equal rows, and rows of equal id, lose equal lines; a
    text is split whole, in the memory of one row; an empty table gives no rows;
    other columns are ignored.
    """
    return _deduped(docs.select("doc_id", "text"), min_chars, min_docs).select("row.doc_id", "n_lines", "n_dropped", "keep", "kept")


def apply(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs``, its columns as they were, whatever their names, with the kept lines as text (n_chars counted anew where lines went)."""
    out = _deduped(docs, min_chars, min_docs)
    fresh = {"text": F.col("kept"), "n_chars": F.length("kept")}
    fresh = {n: column.cast(docs.schema[n].dataType) for n, column in fresh.items() if n in docs.columns}
    own = lambda n: F.col("row").getField(n)
    return out.select(*[(F.when(F.col("n_dropped") == 0, own(n)).otherwise(fresh[n]) if n in fresh else own(n)).alias(n) for n in docs.columns])
