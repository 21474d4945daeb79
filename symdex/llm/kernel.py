"""Array primitives over the bytes of many texts at once.

Texts arrive as Arrow arrays.  They are cut into chunks of about
``CHUNK_BYTES`` (a longer text is a chunk of its own) and every step below is
a numpy operation over the bytes of a whole chunk, so the cost per text is
independent of the Python interpreter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 18
#: Bytes of an Arrow batch between the JVM and a Python worker, at most (beyond, a batch is one row).
BATCH_BYTES = 4 << 20
CHUNK_ROWS = 1 << 18
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
_power = np.ones(1, U64)
_inverse = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    global _power, _inverse
    if len(_power) <= n:
        size = ((n >> 18) + 1) << 18  # in steps, so that few lengths are made
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _power, _inverse = made
    return _power, _inverse


def small_batches(spark: SparkSession) -> None:
    """Caps this session's Arrow batches, whose copies are most of what a worker holds."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"\d+", spark.conf.get(key))[0])
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3: a bijection of 64-bit words."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Chunk:
    """Rows ``first``..``first + rows`` of an array: their bytes, and where each row starts."""

    def __init__(self, first: int, data: np.ndarray, starts: np.ndarray):
        self.first, self.data, self.starts, self.rows = first, data, starts, len(starts) - 1

    def begins(self) -> np.ndarray:
        """Marks the first byte of each row; one longer than the data."""
        at = np.zeros(len(self.data) + 1, bool)
        at[self.starts] = True
        return at

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The row within the chunk that holds each of the ascending ``positions``."""
        edges = np.searchsorted(positions, self.starts)
        return np.repeat(np.arange(self.rows), np.diff(edges))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes, from one prefix sum over the chunk."""
        n = len(self.data)
        power, inverse = _powers(n)
        total = np.zeros(n + 1, U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * power[:n], out=total[1:])
        h = (total[ends] - total[starts]) * inverse[starts]
        return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut an array of strings (null: empty) into chunks."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(starts, starts[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + CHUNK_ROWS, len(texts))
        own = starts[first : last + 1]
        yield Chunk(first, data[own[0] : own[-1]], own - own[0])
        first = last


def runs(chunk: Chunk, inside: np.ndarray, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spans of consecutive bytes that are ``inside``; none crosses a row, and ``split`` bytes begin a new one."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = chunk.begins()
    if split is not None:
        cut[:n] |= split
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | cut[:n])), np.flatnonzero(inside & (~after | cut[1:])) + 1


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line of every row, empty ones too, as split at newlines: row, start, end."""
    breaks = np.flatnonzero(chunk.data == 10)
    row = np.concatenate([np.arange(chunk.rows), chunk.row_of(breaks)])
    starts = np.concatenate([chunk.starts[:-1], breaks + 1])
    ends = np.concatenate([breaks, chunk.starts[1:]])
    order = np.argsort(row, kind="stable")  # a row's own start, then those after its breaks
    last = np.argsort(np.concatenate([row[chunk.rows :], np.arange(chunk.rows)]), kind="stable")
    return row[order], starts[order], ends[last]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given lengths: the group of each element, and its place within the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    return group, np.arange(len(group)) - first[group]


def distinct(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct spans by content: places of one span of each, and for every span which of these it equals.

    Spans are grouped by hash and then every span's bytes are compared with
    those of its group's first; a group with unequal contents is split, so a
    hash collision can't change a result.
    """
    h = chunk.hashes(starts, ends)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    like = first[inverse]
    length = ends - starts
    equal = length == length[like]
    group, k = ragged(np.where(equal, length, 0))
    if len(group):
        same = chunk.data[starts[group] + k] == chunk.data[starts[like[group]] + k]
        if not same.all():
            equal[group[~same]] = False
    if not equal.all():
        odd = np.flatnonzero(~equal)
        seen: dict[bytes, int] = {}
        first = list(first)
        for i in odd:
            b = chunk.data[starts[i] : ends[i]].tobytes()
            if b not in seen:
                seen[b] = len(first)
                first.append(i)
            inverse[i] = seen[b]
        first = np.array(first)
    return first, inverse
