"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Each rule is a condition under which a text is rejected, computed over the
bytes of a whole batch of texts.  On a sample of the table every rule's share
of rejected texts and its running time are measured, on an executor; rules then
run in order of rejection per second, and texts that one rule rejects are not
given to the next.  The order only decides cost: a text is kept if no rule
rejects it, whatever the order, so the result doesn't depend on the sample.

A word is a maximal run of characters other than space, newline, tab and
carriage return.  Cases: a null, empty or blank text is rejected (it has no
words); one-word texts are judged like others; a ratio's denominator is at
least 1; repeated rows are judged alike, at any length; columns pass through;
an empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .kernel import U64, Chunk, chunks, runs, small_batches

#: Rows of the sample on which cost and selectivity are estimated, as the aim.
SAMPLE_ROWS = 2000

SYMBOLS = "#$%&*|<>{}~^\\"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒẞ"


@dataclass(frozen=True)
class Rule:
    """``rejects`` says for each text of a chunk whether it goes; ``oracle`` says the same in DuckDB's SQL over {t}."""

    name: str
    rejects: Callable[[Chunk], np.ndarray]
    oracle: str


def _per_row(c: Chunk, marked: np.ndarray) -> np.ndarray:
    """How many marked bytes each row has."""
    total = np.zeros(len(marked) + 1, np.int32)
    np.cumsum(marked, out=total[1:])
    return np.diff(total[c.starts])


def _characters(c: Chunk) -> np.ndarray:
    return _per_row(c, (c.data & 0xC0) != 0x80)


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(x) for x in chars]] = True
    return table


def _marks(chars: str) -> Callable[[np.ndarray], np.ndarray]:
    """A function that marks one byte of each of the characters."""
    table = _table("".join(x for x in chars if x < "\x80"))
    longer: dict[bytes, np.ndarray] = {}
    for x in chars:
        b = x.encode()
        if len(b) > 1:
            longer.setdefault(b[:-1], np.zeros(256, bool))[b[-1]] = True

    def mark(data: np.ndarray) -> np.ndarray:
        found = table[data]
        for head, tail in longer.items():
            at = np.flatnonzero(data[: len(data) - len(head)] == head[0])
            for k in range(1, len(head)):
                at = at[data[at + k] == head[k]]
            found[at[tail[data[at + len(head)]]]] = True
        return found

    return mark


def _share(name: str, chars: str, over: float) -> Rule:
    mark = _marks(chars)
    sql = f"length({{t}}) - length(translate({{t}}, '{chars.replace('{', '{{').replace('}', '}}')}', '')) > {over} * greatest(length({{t}}), 1)"
    return Rule(name, lambda c: _per_row(c, mark(c.data)) > over * np.maximum(_characters(c), 1), sql)


_INSIDE = ~_table(" \n\t\r")
_WORDS_SQL = "list_filter(string_split(translate({t}, chr(10) || chr(9) || chr(13), '   '), ' '), lambda x: x <> '')"


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each word, and the number of words of each row."""
    starts, ends = runs(c, _INSIDE[c.data])
    row = c.row_of(starts)
    return row, c.hashes(starts, ends), np.bincount(row, minlength=c.rows)


def _blank(c: Chunk) -> np.ndarray:
    return _per_row(c, _INSIDE[c.data]) == 0


def _long_words(c: Chunk) -> np.ndarray:
    starts, _ = runs(c, _INSIDE[c.data])
    return _characters(c) > 40 * np.maximum(np.bincount(c.row_of(starts), minlength=c.rows), 1)


def _stutter(c: Chunk) -> np.ndarray:
    row, h, n = _words(c)
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=c.rows) > 0.2 * n


def _vocabulary(c: Chunk) -> np.ndarray:
    row, h, n = _words(c)
    key = (row.astype(U64) << U64(44)) | (h >> U64(20))
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> U64(44)).astype(np.int64), minlength=c.rows) < 0.05 * n


RULES = (
    Rule("blank", _blank, "coalesce(length(trim(translate({t}, chr(10) || chr(9) || chr(13), '   '))), 0) = 0"),
    _share("symbols", SYMBOLS, 0.03),
    _share("capitals", CAPITALS, 0.34),
    _share("exclamations", "!", 0.05),
    Rule("word_length", _long_words, f"length({{t}}) > 40 * greatest(len({_WORDS_SQL}), 1)"),
    Rule("stutter", _stutter, f"list_transform([{_WORDS_SQL}], lambda w: len(list_filter(list_zip(w, w[2:]), lambda p: coalesce(p[1] = p[2], false))) > 0.2 * len(w))[1]"),
    Rule("vocabulary", _vocabulary, f"list_transform([{_WORDS_SQL}], lambda w: len(list_distinct(w)) < 0.05 * len(w))[1]"),
)


def apply(rule: Rule, texts: pa.Array) -> np.ndarray:
    """Which of the texts the rule rejects; null is as empty."""
    return np.concatenate([rule.rejects(c) for c in chunks(texts)] or [np.zeros(0, bool)])


def order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules in order of rejection per cost, with each one's share rejected and seconds on the sample."""
    n = docs.count()
    sample = docs.select(F.col(text_col).alias("text"))
    if n > rows:
        sample = sample.sample(rows / n, seed=7)
    sample = scratch.table(sample, "rules")

    def measure(batches):
        for batch in batches:
            texts = batch.column(0)
            for k, rule in enumerate(rules):
                began = time.process_time()
                bad = int(apply(rule, texts).sum())
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(texts)]), pa.array([bad]), pa.array([time.process_time() - began])], ["k", "n", "bad", "seconds"])

    found = sample.mapInArrow(measure, "k bigint, n bigint, bad bigint, seconds double").groupBy("k").agg(F.sum("n"), F.sum("bad"), F.sum("seconds"))
    by = {r[0]: (r[2] / r[1], r[3]) for r in found.collect()}
    return sorted(((rule, *by.get(k, (0.0, 0.0))) for k, rule in enumerate(rules)), key=lambda x: (-x[1] / max(x[2], 1e-6), x[2]))


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects; columns as they were."""
    small_batches(docs.sparkSession)
    cascade = [rule for rule, *_ in order(docs, text_col, rules, rows)]

    @F.arrow_udf(T.BooleanType())
    def kept(texts: pa.Array) -> pa.Array:
        stays, alive = np.zeros(len(texts), bool), np.arange(len(texts))
        for rule in cascade:
            bad = apply(rule, texts)
            if bad.any():
                alive, texts = alive[~bad], pc.filter(texts, pa.array(~bad))
        stays[alive] = True
        return pa.array(stays)

    return docs.where(kept(F.col(text_col)))


def oracle(table: str = "documents", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> str:
    return f"SELECT * FROM {table} WHERE " + " AND ".join(f"NOT coalesce({r.oracle.format(t=text_col)}, false)" for r in rules)
