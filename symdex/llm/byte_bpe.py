"""Byte-level BPE: encoding, with offsets, and decoding.

Pre-tokens are found without regular expressions.  Code points are mapped to
classes by a table; with a look at the next one or two characters each becomes
a symbol, and a symbol is a transition function over eight states (what kind
of token is open).  Composition of functions is associative, so the text is
cut into blocks, all blocks' functions are composed side by side, a scan over
the blocks gives the state at which each begins, and a second sweep gives the
state at every character; a token begins where the (state, symbol) pair says.
The pattern is the one of the vocabulary's publisher: contractions, an
optional space with letters, numbers or other characters, and white space.

Of the pre-tokens of a chunk only distinct ones are merged (lowest rank first,
leftmost among equals), and a worker remembers the merged ones, in arrays of
bounded size.  ``offsets`` has the byte at which each token begins in the
text's UTF-8, so a slice of a text can be decoded by itself.

Cases: a null text has null ids and offsets; an empty text has empty ones;
every string round-trips, special tokens' names being ordinary text; rows are
encoded one by one at any length, rows that repeat alike; an empty table gives
an empty result; extra columns are not carried.  Ids that
the vocabulary doesn't have are an error in decoding; bytes that aren't UTF-8
(a slice cut inside a character) decode to U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import Chunk, chunks, distinct, ragged, small_batches

CHUNK_BYTES = 1 << 18
BLOCK = 256
#: Pre-tokens remembered, bytes of the longest one, and bytes of all, which have as many ids at most.
REMEMBERED, REMEMBERED_BYTES, REMEMBERED_ALL = 500_000, 64, 6 << 20
SLOT_BITS = 21
NO_PAIR = 1 << 40

# states: what is open after a character
LETTERS, NUMBERS, OTHERS, SPACE, BLANKS, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
# symbols: a character and what follows it
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_BLANK, S_JOIN, S_LAST = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token begins, by symbol (+ 8 at a text's first character) and state."""
    to, begins = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    for symbol, joins, state in ((S_LETTER, (LETTERS, SPACE), LETTERS), (S_NUMBER, (NUMBERS, SPACE), NUMBERS), (S_OTHER, (OTHERS, SPACE), OTHERS), (S_BLANK, (BLANKS,), BLANKS), (S_JOIN, (), SPACE), (S_LAST, (), CLOSED)):
        to[symbol] = state
        begins[symbol, list(joins)] = False
    for symbol, state in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):
        to[symbol] = state  # a contraction, unless the apostrophe belongs to what is open
        to[symbol, [OTHERS, SPACE]] = OTHERS
        begins[symbol, [OTHERS, SPACE]] = False
    to[S_LETTER, ONE_LEFT], to[S_LETTER, TWO_LEFT] = CLOSED, ONE_LEFT
    begins[S_LETTER, [ONE_LEFT, TWO_LEFT]] = False
    to[8:] = to[:8, [CLOSED]]
    begins[8:] = True
    return to, begins


_TO, _BEGINS = _transitions()
_TO_FLAT, _BEGINS_FLAT = _TO.ravel().astype(np.int64), _BEGINS.ravel()


@lru_cache(1)
def _classes() -> np.ndarray:
    """Letter 0, number 1, other 2, apostrophe 3, space 4, other white space 5, by code point."""
    kind = {"L": 0, "N": 1}
    table = np.array([kind.get(unicodedata.category(chr(i))[0], 2) for i in range(0x110000)], np.uint8)
    table[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 5
    table[0x27], table[0x20] = 3, 4
    return table


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks texts' first characters."""
    n = len(points)
    kind = np.concatenate([_classes()[points], [9, 9]])
    follows = np.concatenate([points, np.zeros(2, points.dtype)])
    last = np.append(first[1:], True)  # nothing of the same text follows
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_OTHER, S_BLANK, S_BLANK], np.uint8)[kind[:n]]
    at = np.flatnonzero(kind[:n] == 3)
    if len(at):
        one = np.where(last[at], 0, follows[at + 1])
        two = np.where(last[at] | last[np.minimum(at + 1, n - 1)], 0, follows[at + 2])
        symbol[at[np.isin(one, [ord(x) for x in "stmd"])]] = S_SHORT
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbol[at[long]] = S_LONG
    blank = kind[:n] >= 4
    before = blank & ~last & (kind[1 : n + 1] < 4)  # the last blank before something else
    symbol[before] = np.where(kind[:n][before] == 4, S_JOIN, S_LAST)
    symbol[first] += 8
    return symbol


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """Marks the characters at which a token begins, by a blocked scan of transition functions.

    Three letters in a row leave the same state whatever was before, and
    further ones change nothing and begin nothing: those are left out first.
    """
    n = len(symbol)
    letter = symbol == S_LETTER
    kept = np.ones(n, bool)
    kept[3:] = ~(letter[3:] & letter[2:-1] & letter[1:-2] & letter[:-3])
    at = np.flatnonzero(kept)
    blocks = -(-len(at) // BLOCK)
    grid = np.full(blocks * BLOCK, 8, np.uint8)
    grid[: len(at)] = symbol[at]
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    own = np.tile(np.arange(8), (blocks, 1))
    for column in columns:  # compose each block's functions
        own += (column.astype(np.int64) << 3)[:, None]
        own = _TO_FLAT.take(own)
    step = 1
    while step < blocks:  # inclusive scan over the blocks by doubling
        own[step:] = np.take_along_axis(own[step:], own[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[CLOSED], own[:-1, CLOSED]])
    begins = np.empty((BLOCK, blocks), bool)
    for k, column in enumerate(columns):
        state += column.astype(np.int64) << 3
        begins[k] = _BEGINS_FLAT.take(state)
        state = _TO_FLAT.take(state)
    marked = np.zeros(n, bool)
    marked[at] = begins.T.ravel()[: len(at)]
    return marked


def pretokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of a chunk of UTF-8 texts."""
    lead = (c.data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if not len(at):
        return at, at
    points = np.frombuffer(c.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    starts = at[token_starts(symbols(points, c.begins()[at]))]
    return starts, np.append(starts[1:], len(c.data))


class Remembered:
    """Ids of pre-tokens, found by hash and compared by their bytes; some 50 MB when full, then it begins anew."""

    def __init__(self):
        self.n = 0
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)  # a later pre-token takes an earlier one's slot
        self.hashes = np.empty(REMEMBERED, np.uint64)
        self.begins, self.firsts = np.zeros(REMEMBERED + 1, np.int64), np.zeros(REMEMBERED + 1, np.int64)
        self.bytes, self.ids = np.empty(REMEMBERED_ALL, np.uint8), np.empty(REMEMBERED_ALL, np.int32)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, c: Chunk, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the spans of a chunk are known, and for those the numbers of ids and all ids."""
        entry, length = self.slots[self._slot(h)].astype(np.int64), ends - starts
        known = entry >= 0
        entry[~known] = 0
        known &= (self.hashes[entry] == h) & (self.begins[entry + 1] - self.begins[entry] == length)
        of, k = ragged(np.where(known, length, 0))
        known[of[c.data[starts[of] + k] != self.bytes[self.begins[entry[of]] + k]]] = False
        entry = entry[known]
        size = self.firsts[entry + 1] - self.firsts[entry]
        of, k = ragged(size)
        return known, size, self.ids[self.firsts[entry[of]] + k]

    def add(self, h: np.ndarray, words: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remembers pre-tokens by their hashes, with the number of ids of each and all ids."""
        data = np.frombuffer(b"".join(words), np.uint8)
        if self.n + len(words) > REMEMBERED or self.begins[self.n] + len(data) > REMEMBERED_ALL:
            self.n = 0
            self.slots.fill(-1)
        if not len(words) or len(words) > REMEMBERED or len(data) > REMEMBERED_ALL:
            return
        n, end = self.n, self.n + len(words)
        self.slots[self._slot(h)] = np.arange(n, end)
        self.hashes[n:end] = h
        for at, size, into, what in ((self.begins, [len(w) for w in words], self.bytes, data), (self.firsts, sizes, self.ids, ids)):
            at[n + 1 : end + 1] = at[n] + np.cumsum(size)
            into[at[n] : at[end]] = what
        self.n = end


class Vocabulary:
    """Ranks of byte strings, which are their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for b, i in ranks.items():
            tokens[i] = b
        self.lengths = np.array([len(b) for b in tokens], np.int64)
        self.tokens = pa.array(tokens, pa.large_binary())
        self.known = Remembered()
        pairs = sorted((ranks[b[:k]] << 32 | ranks[b[k:]], i) for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks)
        self.pairs = np.array([p for p, _ in pairs] + [1 << 62], np.int64)
        self.merged = np.array([i for _, i in pairs] + [NO_PAIR], np.int64)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids that pairs of ids merge to, NO_PAIR where they don't."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.merged[at], NO_PAIR)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each of many short pre-tokens."""
        sizes, ids = self._merge_short(words)
        flat, cuts = ids.tolist(), np.cumsum(sizes).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def _merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of many short pre-tokens: each round merges the best pair of every word that has one."""
        size = np.array([len(w) for w in words])
        n, width = len(words), int(size.max()) + 1
        data = np.frombuffer(b"".join(words), np.uint8)
        of, k = ragged(size)
        ids = np.full((n, width), -1, np.int64)
        ids[of, k] = self.single[data]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        rank = np.full((n, width), NO_PAIR, np.int64)
        inner = k + 1 < size[of]
        rank[of[inner], k[inner]] = self._rank(ids[of[inner], k[inner]], ids[of[inner], k[inner] + 1])
        alive = np.zeros((n, width), bool)
        alive[of, k] = True
        row = np.arange(n)
        while True:
            i = rank[row].argmin(axis=1)
            new = rank[row, i]
            row, i, new = row[new < NO_PAIR], i[new < NO_PAIR], new[new < NO_PAIR]
            if not len(row):
                break
            j = after[row, i]
            k = after[row, j]
            ids[row, i], alive[row, j], rank[row, j], after[row, i] = new, False, NO_PAIR, k
            inside = k < size[row]
            before[row[inside], k[inside]] = i[inside]
            rank[row, i] = np.where(inside, self._rank(new, ids[row, np.minimum(k, width - 1)]), NO_PAIR)
            p = before[row, i]
            has = p >= 0
            r, p = row[has], p[has]
            rank[r, p] = self._rank(ids[r, p], new[has])
        return alive.sum(axis=1), ids[alive]

    def _merge_long(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length, with a heap over a linked list: n log n."""
        n, ranks = len(word), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == k):
                continue
            alive[j], end[i] = False, k
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            p = before[i]
            if p >= 0 and (r := ranks.get(word[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of distinct pre-tokens."""
        parts, order, short = [], [], []
        for k, b in enumerate(words):
            if b in self.ranks:
                own = [self.ranks[b]]
            elif len(b) > REMEMBERED_BYTES:
                own = self._merge_long(b)
            else:
                short.append(k)
                continue
            order.append(k)
            parts.append(([len(own)], own))
        short.sort(key=lambda k: len(words[k]))
        for at in range(0, len(short), 4096):  # words of like length together
            order += short[at : at + 4096]
            parts.append(self._merge_short([words[k] for k in short[at : at + 4096]]))
        sizes, ids = (np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in (0, 1))
        return _picked(sizes, ids, np.argsort(order))

    def words(self, c: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of a chunk's distinct pre-tokens, from what is remembered where possible."""
        h = c.hashes(starts, ends)
        known, sizes, ids = self.known.find(c, starts, ends, h)
        new = np.flatnonzero(~known)
        if not len(new):
            return sizes, ids
        whole = c.data.tobytes()
        words = [whole[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist())]
        new_sizes, new_ids = self._merge(words)
        short = ends[new] - starts[new] <= REMEMBERED_BYTES
        self.known.add(h[new[short]], [w for w in words if len(w) <= REMEMBERED_BYTES], new_sizes[short], new_ids[np.repeat(short, new_sizes)])
        order = np.argsort(np.concatenate([np.flatnonzero(known), new]), kind="stable")
        return _picked(np.concatenate([sizes, new_sizes]), np.concatenate([ids, new_ids]), order)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each text; all ids; the byte of its text at which each token begins."""
        counts, ids, offsets = np.zeros(len(texts), np.int64), [], []
        for c in chunks(texts, CHUNK_BYTES):
            starts, ends = pretokens(c)
            if not len(starts):
                continue
            first, which = distinct(c, starts, ends)
            _, own = _picked(*self.words(c, starts[first], ends[first]), which)
            at = np.cumsum(self.lengths[own]) - self.lengths[own]  # tokens tile the chunk's bytes
            row = c.row_of(at)
            counts[c.first : c.first + c.rows] = np.bincount(row, minlength=c.rows)
            ids.append(own.astype(np.int32))
            offsets.append((at - c.starts[row]).astype(np.int32))
        none = np.zeros(0, np.int32)
        return counts, np.concatenate(ids or [none]), np.concatenate(offsets or [none])

    def _tokens(self, ids: np.ndarray) -> tuple[np.ndarray, pa.Buffer]:
        """Where each token of a run of ids begins, with the end of the last, and the run's bytes."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths)):
            raise ValueError("id outside the vocabulary")
        if not len(ids):
            return np.zeros(1, np.int64), pa.py_buffer(b"")
        _, cuts, data = self.tokens.take(pa.array(ids)).buffers()
        return np.frombuffer(cuts, np.int64)[: len(ids) + 1], data

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        cuts, data = self._tokens(ids)
        return data.slice(0, int(cuts[-1])).to_pybytes()

    def texts(self, ids: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.Array:
        """The texts that runs of ids stand for, as strings; ``ends`` has 0 and where each run ends."""
        cuts, data = self._tokens(ids)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(cuts[ends].tobytes()), data])
        if missing.any():
            made = pc.if_else(pa.array(missing), None, made)
        try:
            return made.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that aren't UTF-8
            return pa.array([None if b is None else b.decode(errors="replace") for b in made.to_pylist()], pa.string())


def _picked(sizes: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups in a row, with their sizes and values, those at ``which``, in that order."""
    begins = np.cumsum(sizes) - sizes
    of, k = ragged(sizes[which])
    return sizes[which], values[begins[which[of]] + k]


@lru_cache(2)
def load(path: str) -> Vocabulary:
    """A vocabulary in tiktoken's format; ``path`` must name it on every executor."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


_ENCODED = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("offsets", T.ArrayType(T.IntegerType()))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, offsets of each row, and if asked for, as decoded, the text that its ids stand for.

    The ids are decoded by the worker that made them: a worker of its own for that holds the vocabulary
    once more, and the ids and offsets would go to it and wait for its answer.
    """
    small_batches(docs.sparkSession)
    kind = T.StructType([*_ENCODED.fields, T.StructField("decoded", T.StringType())]) if decoded else _ENCODED

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        v, missing = load(path), np.asarray(texts.is_null())
        counts, ids, offsets = v.encode(texts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, offsets)]
        if decoded:
            made.append(v.texts(ids, ends, missing))
        return pa.StructArray.from_arrays(made, kind.names, mask=pa.array(missing))

    made = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("e"))
    n = F.when(F.col("e.ids").isNotNull(), F.size("e.ids"))
    return made.select("doc_id", n.alias("n_tokens"), *[F.col(f"e.{c}").alias(c) for c in kind.names])


def with_decoded(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` and, as decoded, the text that the ids of each row stand for."""
    small_batches(encoded.sparkSession)

    @F.arrow_udf(T.StringType())
    def run(ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("id outside the vocabulary")
        ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)), dtype=np.int64)])
        return load(path).texts(flat.to_numpy(), ends, np.asarray(ids.is_null()))

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids of each row stand for."""
    return with_decoded(encoded, path, ids_col).select(F.col(id_col).alias("doc_id"), F.col("decoded").alias("text"))
