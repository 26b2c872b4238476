"""Token counts under a unigram vocabulary, without making the tokens.

Aho-Corasick enumerates all pieces ending at each character; dynamic programming
keeps the best score of each prefix and the number of its pieces, no back
pointers. The rules are those of unigram tokenizers: a piece scores its
logarithm, a character that is no piece scores the least score less 10 and
counts as its bytes (or, without byte pieces, runs of them as one), sums are in
double precision, and of equal scores the piece that starts first wins. White
space becomes U+2581, one of which is put before a text that doesn't begin with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkCache, buffers, resident
from tessera.llm.common import bounded_batches, released

SPACE, UNKNOWN_PENALTY = "▁", 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, in order of id; control pieces and bytes included."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of texts; ``special`` pieces are never matched in text."""

    def __init__(self, pieces: list[tuple[str, float]], special: frozenset = frozenset({"<unk>", "<s>", "</s>"})):
        bytes_ = {f"<0x{b:02X}>" for b in range(256)}
        self.bytes = bytes_ <= {p for p, _ in pieces}
        usable = [(p, s) for p, s in pieces if p not in special and not (self.bytes and p in bytes_)]
        if any(SPACE in p.lstrip(SPACE) for p, _ in usable):
            raise ValueError("a piece runs across white space")
        self.automaton = ahocorasick.Automaton()
        for piece, score in usable:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in usable if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.cache = ChunkCache(self._chunks, b" ")

    def count(self, text: str) -> int:
        """Pieces of ``text``, in which white space is U+2581 already."""
        n = len(text)
        best, pieces, loose = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        single, unknown, done = self.single, self.unknown, 0

        def unmatched(upto: int) -> None:
            nonlocal done
            while done < upto:  # a character that is no piece, after all pieces that end with it
                done += 1
                char = text[done - 1]
                if char not in single and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    pieces[done] = pieces[done - 1] + (len(char.encode("utf-8")) if self.bytes else 0 if loose[done - 1] else 1)
                    loose[done] = True

        for at, (length, score) in self.automaton.iter(text):
            end = at + 1
            if done < at:
                unmatched(at)
            start = end - length
            candidate = best[start] + score
            if candidate > best[end]:
                best[end], pieces[end], loose[end] = candidate, pieces[start] + 1, False
        unmatched(n)
        return pieces[n]

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts = [self.count(c.decode("utf-8").replace(" ", SPACE)) for c in chunks]
        return np.array(counts, np.uint32), np.ones(len(chunks), np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Pieces of each text; a null or empty text has none."""
        texts = texts.fill_null("") if texts.null_count else texts
        ready = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.or_(pc.starts_with(texts, " "), pc.starts_with(texts, SPACE)))
        led = pc.if_else(ready, texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = buffers(led)
        numbers, firsts = self.cache.lookup(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.cache.flat(numbers)[0].astype(np.int64))])
        return total[firsts[1:]] - total[firsts[:-1]]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs`` (doc_id, text), by the vocabulary of the sentencepiece file ``model``.

    Null and empty texts count 0; null ids and repeated rows are rows like
    others; an empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("counter", model), lambda: Counter(vocabulary(model)))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1)))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda batches: released(counted(batches)), "doc_id long, n_tokens long")
