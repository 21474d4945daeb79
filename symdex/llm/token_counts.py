"""Token counts under a unigram vocabulary, by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's matches in a stretch of
text; dynamic programming over end positions carries the best score and the
number of pieces of the path that has it, and no back-pointers, as no pieces
are listed.

Tie rules are the tokenizer's: for each end position, candidates come in order
of their start and a later one must be strictly better; a character that is no
piece itself gives an unknown candidate of the lowest score minus 10, after
the matches, and counts as one piece for each of its UTF-8 bytes (byte
fallback).  Scores add as double-precision numbers.  Text is prepared as the
tokenizer's normaliser does it: a space is put before it and spaces become
the mark U+2581; nothing else changes.

If no piece holds a newline, or a mark after another character, the best path
of a text is that of its stretches cut there, and the count of a stretch
is kept for when it comes again.  Other vocabularies are run on whole texts.

Cases: a null text has a null count; an empty text has none (0); rows are
counted one by one, at any length; rows that repeat give equal counts; an empty
table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import chunks, distinct, small_batches

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Stretches a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64


class Unigram:
    """A vocabulary of scored pieces."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p in scores)
        self.known: dict[bytes, int] = {}

    def count(self, text: str) -> int:
        """Pieces of the best path over text that has been prepared."""
        n = len(text)
        best, pieces = [-np.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for end, (length, score) in self.automaton.iter(text):
                start = end + 1 - length
                score += best[start]
                if score > best[end + 1]:
                    best[end + 1] = score
                    pieces[end + 1] = pieces[start] + 1
            return pieces[n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(text):
            matches[end].append(found)
        for end in range(n):
            for length, score in matches[end]:
                start = end + 1 - length
                score += best[start]
                if score > best[end + 1]:
                    best[end + 1] = score
                    pieces[end + 1] = pieces[start] + 1
            if text[end] not in self.single and best[end] + self.unknown > best[end + 1]:
                best[end + 1] = best[end] + self.unknown
                pieces[end + 1] = pieces[end] + len(text[end].encode())
        return pieces[n]

    def stretch(self, b: bytes) -> int:
        """``count`` of a stretch of bytes with spaces in place of marks."""
        n = self.known.get(b)
        if n is None:
            n = self.count(b.decode().replace(" ", MARK))
            if len(b) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[b] = n
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The count of each text; null counts as empty."""
        n = np.zeros(len(texts), np.int64)
        some = np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
        spaced = pc.replace_substring(pc.binary_join_element_wise(" ", texts.cast(pa.string()), ""), MARK, " ")
        for c in chunks(spaced):
            cut = c.begins()[: len(c.data)]
            if self.cuts and len(cut):
                space, line = c.data == 32, c.data == 10
                cut = cut | line
                cut[1:] |= (space[1:] & ~space[:-1]) | line[:-1]
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(c.data))
            if not len(starts):
                continue
            first, which = distinct(c, starts, ends)
            whole = c.data.tobytes()
            own = np.array([self.stretch(whole[i:j]) for i, j in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
            n[c.first : c.first + c.rows] = np.bincount(c.row_of(starts), own[which], c.rows)
        return np.where(some, n, 0)


@lru_cache(2)
def load(path: str) -> Unigram:
    """The ordinary pieces of a SentencePiece model with byte fallback, and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError(f"{path} has no byte pieces")
    return Unigram({model.id_to_piece(i): float(model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))})


def n_tokens(text, path: str):
    """Column of token counts; ``path`` must name the model on every executor."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(load(path).counts(texts), mask=np.asarray(texts.is_null()))

    return count(text)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of each row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), n_tokens(F.col(text_col), path).alias("n_tokens"))
