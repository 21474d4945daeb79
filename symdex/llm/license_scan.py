"""License scans as an exact set-similarity join.

A text block is a line, or a run of several lines that together have at most
``STRETCH`` times the template's number of tokens, as a notice may be wrapped.
Block and template are sets of tokens (runs of ASCII letters and digits after
lower-casing).  A pair matches if the block holds at least the share
``THRESHOLD`` of the template's tokens: for a template of n tokens that is
alpha = ceil(THRESHOLD * n) of them.  Of blocks that match, those count that
hold no smaller one that does, and such as share a line are listed as one, so a
notice is one row whatever its lines.

Tokens are ordered by the number of lines of the whole corpus that hold them,
rarest first, ties by the token; tokens of no template come before all others.
In that order, of two sets with alpha common tokens the first common one is
among the first n - alpha + 1 of the template and the first m - alpha + 1 of a
block of m (prefix filter); the block has at least alpha tokens, and of several
lines at most STRETCH * n (length filter); and a common token at place i of the
template and j of the block leaves at most min(n - i, m - j) for the overlap
(positional filter).  What passes is verified by counting.  No filter loses a
pair: a block has a line with a prefix token of its template, and the runs
around such lines are all that is looked at.

Only lines around a prefix token, found by hash, are cut into strings; a
hash collision can add a line to look at, and never lose one.

Cases: null, empty and token-less texts have no block that matches, and lines
without a token are passed over within a block; a block that matches several
templates gives a row for each; repeated rows and lines each give theirs, ties
of the order don't change the result; a template without tokens is an error; a
text or line may be of any length; an empty table gives an empty result; extra
columns are not carried.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Chunk, chunks, lines, runs, small_batches

THRESHOLD = 0.8
STRETCH = 2

TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}

_TOKEN = re.compile("[a-z0-9]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123)]] = True


def read_templates(folder: str) -> dict[str, str]:
    """Templates of a folder on the driver: full texts in files NAME.txt."""
    found = {}
    for name in sorted(os.listdir(folder)):
        if name.endswith(".txt"):
            with open(os.path.join(folder, name), encoding="utf-8-sig") as f:
                found[name.removesuffix(".txt")] = f.read()
    return found


def tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def needed(n: int, threshold: float) -> int:
    """Tokens of a template of n that a block must hold."""
    return max(1, ceil(threshold * n - 1e-9))


def _hash_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, and the word of each."""
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = Chunk(0, data, np.array([0, len(data)])).hashes(ends - [len(w) for w in words], ends)
    order = np.argsort(h)
    return h[order], order


def _hits(c: Chunk, table: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines (row, start, end), the distinct (line, word) pairs by hash, and the lines that have a token."""
    row, start, end = lines(c)
    first, last = runs(c, _INSIDE[c.data])
    if not len(first):
        return row, start, end, *[np.zeros(0, np.int64)] * 3
    h = c.hashes(first, last)
    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
    known = np.flatnonzero(table[k] == h)
    line = np.searchsorted(end, first, "right")  # ends ascend, and one row's last is the next one's start
    pair = np.unique(line[known] * len(table) + which[k[known]])
    return row, start, end, pair // len(table), pair % len(table), line[np.flatnonzero(np.diff(line, prepend=-1))]


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def block_frequencies(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """How many lines of the whole corpus hold each word."""
    table, which = _hash_table(words)

    def count(batches):
        held = np.zeros(len(words), np.int64)
        for batch in batches:
            for c in chunks(_lower(batch.column(0))):
                held += np.bincount(_hits(c, table, which)[4], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), pa.array(held)], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n"))
    found = dict(map(tuple, counted.collect()))  # one row for each template token
    return {w: found.get(k, 0) for k, w in enumerate(words)}


class Index:
    """Templates under the global order, and those of each prefix token."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], threshold: float):
        self.rank = {w: k for k, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
        self.sets = {name: sorted(tokens(t), key=self.rank.__getitem__) for name, t in templates.items()}
        self.alpha = {name: needed(len(s), threshold) for name, s in self.sets.items()}
        self.prefix: dict[str, list[str]] = {}
        for name, own in self.sets.items():
            for w in own[: len(own) - self.alpha[name] + 1]:
                self.prefix.setdefault(w, []).append(name)

    def overlap(self, name: str, block: set[str]) -> int:
        """How many of a template's tokens a block has, or 0 where that is too few."""
        own, alpha, m = self.sets[name], self.alpha[name], len(block)
        if m < alpha:
            return 0
        i = next((i for i, w in enumerate(own[: len(own) - alpha + 1]) if w in block), None)
        if i is None:
            return 0
        j = m - sum(self.rank.get(w, -1) >= self.rank[own[i]] for w in block)
        if j > m - alpha or min(len(own) - i, m - j) < alpha:
            return 0
        found = sum(w in block for w in own)
        return found if found >= alpha else 0

    def blocks(self, name: str, sets: Callable[[int], set[str]], n: int, at: int) -> list[tuple[int, int]]:
        """Smallest matching blocks (first, last) of the lines around line ``at`` of ``n`` that have tokens."""
        limit = STRETCH * len(self.sets[name])

        def reach(step: int) -> int:
            k, held = at, sets(at)
            while 0 <= k + step < n and len(held) <= limit:
                held = held | sets(k + step)
                k += step * (len(held) <= limit)
            return k

        low, high = reach(-1), reach(1)
        found: list[tuple[int, int]] = []
        for i in range(high, low - 1, -1):
            block: set[str] = set()
            last = found[-1][1] - 1 if found else high  # a smaller one is inside beyond that
            for j in range(i, last + 1):
                block = block | sets(j)
                if j > i and len(block) > limit:
                    break
                if self.overlap(name, block):
                    found.append((i, j))
                    break
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), n_lines, template, overlap, n_template of each match."""
    small_batches(docs.sparkSession)
    words = sorted(set().union(*(tokens(t) for t in templates.values())))
    if not all(tokens(t) for t in templates.values()):
        raise ValueError("a template has no token")
    index = Index(templates, block_frequencies(docs, text_col, words), threshold)
    prefix = sorted(index.prefix)
    table, which = _hash_table(prefix)
    kind = docs.schema[id_col].dataType

    def find(batches):
        for batch in batches:
            for c in chunks(_lower(batch.column(1))):
                row, start, end, line, word, full = _hits(c, table, which)
                begin = np.searchsorted(row, np.arange(c.rows))
                out: list[tuple[int, int, int, str, int]] = []
                found: dict[tuple[int, str], set[tuple[int, int]]] = {}
                first, last = np.searchsorted(row[full], [np.arange(c.rows), np.arange(1, c.rows + 1)])
                known: dict[int, set[str]] = {}

                def sets(k: int) -> set[str]:
                    """Tokens of the k-th line that has any."""
                    if k not in known:
                        known[k] = set(_TOKEN.findall(c.data[start[full[k]] : end[full[k]]].tobytes().decode()))
                    return known[k]

                for place, w in zip(np.searchsorted(full, line).tolist(), word.tolist()):
                    r = int(row[full[place]])
                    for name in index.prefix[prefix[w]] if prefix[w] in sets(place) else ():
                        blocks = index.blocks(name, lambda k: sets(k + int(first[r])), int(last[r] - first[r]), place - int(first[r]))
                        found.setdefault((r, name), set()).update(blocks)
                    if len(known) > 10_000:
                        known.clear()
                for (r, name), blocks in found.items():
                    joined: list[tuple[int, int]] = []
                    for i, j in sorted(blocks):
                        joined.append((joined.pop()[0], j) if joined and i <= joined[-1][1] else (i, j))
                    for i, j in joined:
                        a, z = (int(full[k + first[r]]) - int(begin[r]) for k in (i, j))
                        whole = set().union(*(sets(k + int(first[r])) for k in range(i, j + 1)))
                        out.append((r + c.first, a + 1, z - a + 1, name, len(whole.intersection(index.sets[name]))))
                if out:
                    at, no, height, name, n = zip(*sorted(out))
                    size = [len(index.sets[x]) for x in name]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(x, pa.int32()) for x in (no, height)], pa.array(name), *[pa.array(x, pa.int32()) for x in (n, size)]], ["doc_id", "line_no", "n_lines", "template", "overlap", "n_template"])

    return docs.select(id_col, text_col).mapInArrow(find, f"doc_id {kind.simpleString()}, line_no int, n_lines int, template string, overlap int, n_template int")


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, table: str = "documents") -> str:
    rows = ", ".join("('{}', [{}], {})".format(n, ", ".join(f"'{w}'" for w in sorted(tokens(t))), needed(len(tokens(t)), threshold)) for n, t in templates.items())
    return f"""
WITH RECURSIVE t(template, own, alpha) AS (VALUES {rows}),
d AS (SELECT doc_id, string_split(text, chr(10)) AS s, row_number() OVER () AS r FROM {table}),
l AS (SELECT r, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS no FROM d),
b AS (SELECT r, doc_id, no, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY no) AS k FROM b WHERE len(w) > 0),
g AS (
  SELECT r, k AS i, k AS j, template, own, alpha, w, len(list_intersect(own, w)) AS n FROM f, t
  UNION ALL
  SELECT g.r, i, f.k, template, own, alpha, list_distinct(g.w || f.w), len(list_intersect(own, g.w || f.w))
  FROM g JOIN f ON f.r = g.r AND f.k = g.j + 1 WHERE n > 0 AND n < alpha AND len(list_distinct(g.w || f.w)) <= {STRETCH} * len(own)
),
m AS (SELECT *, min(j) OVER (PARTITION BY r, template ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g WHERE n >= alpha),
o AS (SELECT *, lag(j) OVER (PARTITION BY r, template ORDER BY i) AS earlier FROM m WHERE later IS NULL OR later > j),
q AS (SELECT *, count(*) FILTER (earlier IS NULL OR earlier < i) OVER (PARTITION BY r, template ORDER BY i) AS part FROM o),
p AS (SELECT r, template, any_value(own) AS own, min(i) AS i, max(j) AS j FROM q GROUP BY r, template, part)
SELECT doc_id, min(no)::INT AS line_no, (max(no) - min(no) + 1)::INT AS n_lines, template, len(list_intersect(any_value(own), flatten(list(w))))::INT AS overlap, len(any_value(own))::INT AS n_template
FROM p JOIN f ON f.r = p.r AND f.k BETWEEN p.i AND p.j GROUP BY p.r, doc_id, template, p.i"""
