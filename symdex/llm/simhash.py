"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's features are its distinct words, lower-cased, as runs of ASCII
letters, digits and non-ASCII bytes (a character of a script written without
spaces begins a word).  Its signature is WORDS SimHash words of 64 bits: for each
bit the majority of the features' hashes.  Two documents are near duplicates if
some word k of theirs differs in at most ``RADIUS`` bits, the next word (the
first after the last) in at most ``CHECK_RADIUS`` and all words together in at
most ``TOTAL``: several words each find pairs that one word loses by chance,
and all bits tell near from unlike where one word is alike by chance.

Search is exact for that definition, by covering masks at two levels.  A word's
bits are cut into RADIUS + f parts.  RADIUS differing bits touch at most RADIUS
parts, so at least f parts are untouched; a pair is looked for in the group of
its first f untouched ones (``plan``), whose bits agree and say to which shard
a signature goes.  The parts that a group passes over hold a differing bit
each, so what is left for the other bits is a smaller radius r, and there
covering LSH is used: each of these bits gets a vector m(i) of r + 1 bits and
each non-zero vector v gives a mask of the bits with <m(i), v> odd.  Any r
differing bits put at most r linear constraints on v, so some non-zero v avoids
them all and the pair agrees under that mask: 2**(r + 1) - 1 tables.  The number
of shards, f and how many passed-over parts leave the keys long enough follow
the number of signatures; nothing else does, and no bucket is capped.

A task reports a spanning forest of its pairs (not the pairs, of which a group
of thousands has millions): it keeps the component of each signature, drops
buckets that are in one component already, and lets a component in a large
bucket grow by comparing its members with what isn't in it, so a group of alike
texts costs about its size and not its square.  Groups are the connected
components of all forests.

Cases: null, empty and word-less texts match nothing; documents of equal word
sets are equal; a text is signed whole at any length; an empty table has no
group; rows that repeat a document are in one group with it; of each
group the row with the smallest doc_id stays (nulls last; among rows equal in
doc_id and text any one).  Extra columns pass through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .kernel import U64, chunks, mix, ragged, runs, small_batches

WORDS = 4
RADIUS = 8
CHECK_RADIUS = 16
#: Bits of all words in which near copies differ at most.
TOTAL = 44
#: Signatures of one shard, as the aim.
SHARD = 1 << 20
#: Tables that one task searches, at most.
TOGETHER = 128
#: Members beyond which a bucket's components are grown instead of comparing all its pairs.
LARGE = 256

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ALONE = np.zeros(256, bool)
_ALONE[[*range(0xE3, 0xEE), *range(0xF0, 0xF5)]] = True
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
#: A byte's bits, each in a byte of its own.
_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], U64)


def masks(radius: int = RADIUS, bits: int = 64) -> np.ndarray:
    """The covering masks: one for each non-zero vector of radius + 1 bits."""
    width = radius + 1
    rng = np.random.default_rng(20160101)
    m = np.concatenate([rng.permutation(np.arange(1, 1 << width)) for _ in range(bits // ((1 << width) - 1) + 1)])[:bits]
    v = np.arange(1, 1 << width)
    odd = np.bitwise_count(m[None, :] & v[:, None]) & 1
    return (odd.astype(U64) << np.arange(bits, dtype=U64)[None, :]).sum(axis=1, dtype=U64)


def plan(n: int, radius: int = RADIUS) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """The number of shards for n signatures, and a word's groups: (bits that a group agrees in, its covering masks).

    Keys are as long as n needs where passing over a part less makes them so.
    """
    shards, free = max(1, -(-n // SHARD)), 1
    while 4 * shards > 1 << (64 * free // (radius + free)) and radius + free < 16:
        free += 1
    edges_ = np.linspace(0, 64, radius + free + 1).astype(int)
    parts = [range(a, b) for a, b in zip(edges_[:-1], edges_[1:])]
    bits = lambda some: [i for p in some for i in parts[p]]
    groups_ = []
    for chosen in combinations(range(len(parts)), free):
        passed = [p for p in range(chosen[-1]) if p not in chosen]
        while True:
            rest = [i for i in range(64) if i not in set(bits([*chosen, *passed]))]
            if not passed or len(bits(chosen)) + len(rest) // 2 > n.bit_length() + 1:
                break
            passed.pop()
        own = masks(radius - len(passed), max(1, len(rest)))
        placed = np.full(len(own), sum(1 << i for i in bits(chosen)), U64)
        for k, i in enumerate(rest):
            placed |= ((own >> U64(k)) & U64(1)) << U64(i)
        groups_.append((sum(1 << i for i in bits(chosen)), placed))
    return shards, groups_


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """WORDS words for each text, and whether it has any feature."""
    words = np.zeros((len(texts), WORDS), U64)
    has = np.zeros(len(texts), bool)
    for c in chunks(pc.utf8_lower(texts)):
        starts, ends = runs(c, _WORD[c.data], _ALONE[c.data])
        if not len(starts):
            continue
        key = (c.row_of(starts).astype(U64) << U64(44)) | (c.hashes(starts, ends) >> U64(20))
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        feature = key & U64((1 << 44) - 1)
        rows, first, count = np.unique((key >> U64(44)).astype(np.int64), return_index=True, return_counts=True)
        blocks = -(-count // 255)  # a lane holds up to 255
        of, k = ragged(blocks)
        at = first[of] + 255 * k
        block_of_row = np.concatenate([[0], np.cumsum(blocks)[:-1]])
        ones = np.empty((len(rows), 8 * WORDS, 8), np.int64)
        for w, seed in enumerate(_SEEDS):
            each = mix(feature ^ U64(seed)).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                lanes = np.add.reduceat(_LANES[each[:, j]], at)
                ones[:, 8 * w + j] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_of_row, axis=0)
        bits = (2 * ones > count[:, None, None]).reshape(len(rows), 64 * WORDS)
        words[c.first + rows] = np.packbits(bits, axis=1, bitorder="little").view(U64)
        has[c.first + rows] = True
    return words, has


_COLUMNS = [f"w{k}" for k in range(WORDS)]
_SIGNATURE = T.StructType([T.StructField(c, T.LongType()) for c in [*_COLUMNS, "node"]])


@F.arrow_udf(_SIGNATURE)
def _signature(texts: pa.Array) -> pa.Array:
    words, has = signatures(texts)
    each = [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(WORDS)]
    return pa.StructArray.from_arrays([*each, pa.array(node(words))], _SIGNATURE.names, mask=pa.array(~has))


def node(words: np.ndarray) -> np.ndarray:
    """One 64-bit name for each signature."""
    h = np.full(len(words), _SEEDS[0], U64)
    for k in range(WORDS):
        h = mix(words[:, k] ^ mix(h))
    return h.view(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (label[a], label[b]):
            np.minimum.at(new, at, low)
        while True:
            further = new[new]
            if np.array_equal(further, new):
                break
            new = further
        if np.array_equal(new, label):
            return label
        label = new


def _near(words: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, check: int) -> np.ndarray:
    """Which of the pairs (i, j) are near by the first of ``words``."""
    near = np.flatnonzero(np.bitwise_count(words[0][i] ^ words[0][j]) <= radius)
    apart = np.bitwise_count(words[:, i[near]] ^ words[:, j[near]])
    return near[(apart[1] <= check) & (apart.sum(axis=0, dtype=np.int64) <= TOTAL)]


def _grown(words: np.ndarray, at: np.ndarray, label: np.ndarray, radius: int, check: int) -> list[tuple[int, int]]:
    """Joins of the components ``label`` of the members ``at`` of one bucket, by growing each to its end."""
    joins, out = [], np.arange(len(at))
    while len(out):
        own = label[out] == label[out[0]]
        first, queue, out = label[out[0]], out[own], out[~own]
        while len(queue) and len(out):
            some = queue[: max(1, (1 << 18) // len(out))]
            queue = queue[len(some) :]
            i, j = np.repeat(some, len(out)), np.tile(out, len(some))
            hit = np.unique(label[j[_near(words, at[i], at[j], radius, check)]])
            if len(hit):
                joins += [(int(x), int(first)) for x in hit]
                own = np.isin(label[out], hit)
                queue, out = np.concatenate([queue, out[own]]), out[~own]
    return joins


def forest(words: np.ndarray, table: np.ndarray, radius: int = RADIUS, check: int = CHECK_RADIUS) -> np.ndarray:
    """The component of each signature under the near pairs that agree under some mask of ``table``.

    ``words`` has a row for each word, the one that is masked first.  Buckets
    are made by sorting a product of the masked word, with the place below it;
    what the product lets collide is compared for nothing and does no harm.
    """
    n = words.shape[1]
    place, low = np.arange(n), U64((1 << max(1, (n - 1).bit_length())) - 1)
    label = place.copy()
    for mask in table:
        key = ((words[0] & mask) * U64(0x9E3779B97F4A7C15)) & ~low | place.view(U64)
        key.sort()
        same = np.zeros(n + 1, bool)
        same[1:n] = (key[1:] ^ key[:-1]) <= low
        member = np.flatnonzero(same[1:] | same[:-1])
        if not len(member):
            continue
        at = (key[member] & low).view(np.int64)
        first = np.flatnonzero(~same[:-1][member])
        own = label[at]
        mixed = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        size = np.diff(np.append(first, len(at)))
        joins = [np.zeros((0, 2), np.int64)]
        for b in np.flatnonzero(mixed & (size > LARGE)):
            some = at[first[b] : first[b] + size[b]]
            found = _grown(words, some, label[some], radius, check)
            joins.append(np.array(found, np.int64).reshape(-1, 2))
        little = np.repeat(mixed & (size <= LARGE), size)
        end = np.repeat(first + size, size)
        i, k = np.flatnonzero(little), 0
        while len(i):
            k += 1
            i = i[i + k < end[i]]
            j = i[own[i] != own[i + k]]
            j = j[_near(words, at[j], at[j + k], radius, check)]
            joins.append(np.stack([own[j], own[j + k]], axis=1))
        pair = np.concatenate(joins)
        if len(pair):
            used, where = np.unique(pair, return_inverse=True)
            where = where.reshape(-1, 2)
            to = place.copy()
            to[used] = used[components(len(used), where[:, 0], where[:, 1])]
            label = to[label]
    return label


def edges(signed: DataFrame, n: int, radius: int = RADIUS, check: int = CHECK_RADIUS) -> DataFrame:
    """Pairs of nodes (u, v), u > v, whose components are the groups; ``signed`` has n distinct signatures."""
    shards, groups_ = plan(n, radius)
    slices = [(agreed, masks_[i : i + TOGETHER]) for agreed, masks_ in groups_ for i in range(0, len(masks_), TOGETHER)]

    def spread(batches):
        for batch in batches:
            words = [batch.column(k).to_numpy().view(U64) for k in range(WORDS)]
            part, packed = [], []
            for w in range(WORDS):
                own = np.stack([*words[w:], *words[:w]], axis=1)
                agreed, placed, cut = None, own, np.array([0, len(own)])
                for t, (bits, _) in enumerate(slices, w * len(slices)):
                    if shards > 1 and bits != agreed:
                        agreed, to = bits, (mix((words[w] & U64(bits)) ^ U64(w)) % U64(shards)).astype(np.int64)
                        order = np.argsort(to, kind="stable")
                        placed, cut = own[order], np.searchsorted(to[order], np.arange(shards + 1))
                    for s in range(shards):
                        if cut[s] < cut[s + 1]:
                            part.append(t * shards + s)
                            packed.append(placed[cut[s] : cut[s + 1]].tobytes())
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary())], ["part", "packed"])

    def search(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        words = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("packed").to_pylist()), U64).reshape(-1, WORDS).T)
        rows, w = None, part // shards // len(slices)
        label = forest(words, slices[part // shards % len(slices)][1], radius, check)
        name = node(np.roll(words, w, axis=0).T)
        far = np.flatnonzero(label != np.arange(len(label)))
        u, v = name[far], name[label[far]]
        return pa.table({"u": pa.array(np.maximum(u, v)), "v": pa.array(np.minimum(u, v))})

    tasks = signed.sparkSession.sparkContext.defaultParallelism
    rows_ = signed.select(*_COLUMNS).repartition(max(tasks, shards))
    parts = WORDS * len(slices) * shards
    packed = rows_.mapInArrow(spread, "part bigint, packed binary").repartition(min(parts, 100_000), "part")
    return packed.groupBy("part").applyInArrow(search, "u bigint, v bigint").distinct()


def connect(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in an edge (u > v): alternating large and small stars until nothing moves."""
    def both(df):
        return df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = scratch.table(pairs, "edges")
    seen = mark(pairs)
    while True:
        near = both(pairs)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        pairs = scratch.table(small.where("u <> v").distinct(), "stars")
        now = mark(pairs)
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, check: int = CHECK_RADIUS) -> DataFrame:
    """Every row that shares its group with another: id, row_hash, copies, keep_id, keep_hash.

    A row is known by (id, row_hash); ``copies`` counts rows equal in both.
    The row whose (id, row_hash) is (keep_id, keep_hash) stays.
    """
    small_batches(docs.sparkSession)
    signed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row_hash"), _signature(F.col(text_col)).alias("s"))
    signed = scratch.table(signed.select("id", "row_hash", "s.*"), "signatures").where("node IS NOT NULL")
    points = scratch.table(signed.select(*_COLUMNS, "node").distinct(), "points")
    root = connect(edges(points, points.count(), radius, check))
    rooted = signed.join(root, "node", "left").select("id", "row_hash", F.coalesce("root", "node").alias("group_node"))
    rows = rooted.groupBy("group_node", "id", "row_hash").agg(F.count(F.lit(1)).alias("copies"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "row_hash")
    kept = rows.groupBy("group_node").agg(F.min(first).alias("k"), F.sum("copies").alias("size")).where("size > 1")
    return rows.join(kept, "group_node").select("id", "row_hash", "copies", F.col("k.id").alias("keep_id"), F.col("k.row_hash").alias("keep_hash"))


def pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of) for every row that would go; a repeated row has its own id in both."""
    g = groups(docs, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    gone = g.withColumn("gone", F.when(stays, F.col("copies") - 1).otherwise(F.col("copies"))).where("gone > 0")
    return gone.select(F.col("id").alias("doc_id"), F.col("keep_id").alias("duplicate_of"), F.explode(F.sequence(F.lit(1), F.col("gone").cast("int"))).alias("_n")).drop("_n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group; columns as they were."""
    g = groups(docs, id_col, text_col)
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    id_, hash_, stay, n, own = (scratch.fresh(k) for k in ("id", "hash", "stay", "n", "own"))
    marked = g.select(F.col("id").alias(id_), F.col("row_hash").alias(hash_), stays.alias(stay), F.col("copies").alias(n)).where(~F.col(stay) | (F.col(n) > 1))
    marked = scratch.table(marked, "gone")
    d = docs.withColumn(own, F.xxhash64(text_col))
    joined = d.join(marked, d[id_col].eqNullSafe(marked[id_]) & (d[own] == marked[hash_]), "left")
    single = joined.where(F.col(stay).isNull()).drop(id_, hash_, stay, n, own)
    several = joined.where(F.col(stay)).dropDuplicates([id_col, own]).drop(id_, hash_, stay, n, own)
    return single.unionByName(several)
