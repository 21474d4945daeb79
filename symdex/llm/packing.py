"""Best-fit packing planned on the length histogram.

Texts are cut into pieces of at most ``CAPACITY`` words (a text longer than
that gives full pieces and a rest) and the pieces are packed into sequences of
``CAPACITY``.  The plan is best-fit decreasing, made over counts: for each
length from the longest, the sequences with the least sufficient space take as
many pieces of that length as there are, whole groups of sequences at a time.
The histogram has at most CAPACITY entries whatever the corpus, so planning is
constant work; the plan says which sequences, at which offset, the pieces with
ranks ``lo <= rank < hi`` of a length take.  It has O(CAPACITY log CAPACITY)
rows: sequences of equal space are one group, a length takes groups whole but
for its last one, so it adds three groups at most, and as the space left is
less than half of what it was, a group is taken log2(CAPACITY) times at most.
That is 2 * 3 * 2048 * 11 rows for 2048, and the bound by which it is broadcast.

Pieces then take their slots by rank within length.  Ranks come from a window
over (length, bucket), the bucket being a hash of doc_id and text, and each
bucket's offset from a running sum over the table of counts, so no length is
ranked in one task and nothing of the pieces shuffles again: the offsets are
joined on what the window is partitioned by.  Order of rank: bucket, doc_id,
piece, text.

A word is a maximal run of characters other than space, tab, newline, vertical
tab, form feed and carriage return; a piece keeps the text between its first
and last word as it stands.

Cases: null, empty and blank texts have no piece and take no slot; rows that
repeat one another are packed one by one; a null doc_id is packed as null;
extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import scratch
from .kernel import chunks, runs, small_batches

CAPACITY = 2048
#: Pieces of one length that one window group ranks, as the aim.
BUCKET = 1 << 15

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def plan_bound(capacity: int) -> int:
    """The most rows that a plan has."""
    return 6 * capacity * max(1, capacity.bit_length())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, lo, hi, first_bin, bins, offset) of best-fit decreasing over counts.

    Rank lo + k of a row takes sequence first_bin + k % bins, at the offset plus length * (k // bins).
    """
    free: dict[int, list[tuple[int, int]]] = {}  # space: [(first bin, bins)], oldest first
    spaces: list[int] = []
    rows, bins = [], 0

    def add(space: int, first: int, n: int) -> None:
        if space:
            if space not in free:
                free[space] = []
                insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = free[space].pop()
                if not free[space]:
                    del free[space]
                    spaces.pop(k)
            else:
                space, first, n = capacity, bins, left
            # one by one, best fit would fill a sequence with this length before it goes on to the next
            each = space // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for some, at, levels in ((full, first, each), (1, first + full, rest)):
                if some and levels:
                    rows.append((length, rank, rank + some * levels, at, some, capacity - space))
                    rank += some * levels
                    add(space - levels * length, at, some)
            used = full + (rest > 0)
            if first == bins:
                bins += used
            elif used < n:
                add(space, first + used, n - used)
            left -= full * each + rest
    return rows


def _spans(texts: pa.Array):
    """For each chunk: the words' starts and ends, and the number of words of each row."""
    for c in chunks(texts):
        starts, ends = runs(c, _WORD[c.data])
        yield c, starts, ends, np.diff(np.searchsorted(starts, c.starts))


@F.arrow_udf(T.IntegerType())
def n_words(texts: pa.Array) -> pa.Array:
    """The number of words of each text."""
    return pa.array(np.concatenate([n for *_, n in _spans(texts)] or [np.zeros(0, np.int64)]), pa.int32())


def _cutter(capacity: int):
    @F.arrow_udf(T.ArrayType(T.StructType().add("piece", "integer").add("length", "integer").add("text", "string")))
    def cut(texts: pa.Array) -> pa.Array:
        counts, piece, length, text = [], [], [], []
        for c, starts, ends, n in _spans(texts):
            first = np.cumsum(n) - n
            for row, words in enumerate(n):
                k = 0
                for k, w in enumerate(range(0, words, capacity), 1):
                    last = min(w + capacity, words)
                    piece.append(k - 1)
                    length.append(last - w)
                    text.append(c.data[starts[first[row] + w] : ends[first[row] + last - 1]].tobytes().decode())
                counts.append(k)
        own = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), pa.array(length, pa.int32()), pa.array(text, pa.string())], ["piece", "length", "text"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), own)

    return cut


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: bin_id, bin_offset, doc_id, piece, n_words, text."""
    spark = docs.sparkSession
    small_batches(spark)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the number of buckets follows the number of rows, which needs no text
    buckets = max(1, -(-ids.count() // BUCKET))
    ids = ids.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)))

    n = F.col("n")
    sizes = F.array(F.struct(F.lit(capacity).alias("length"), F.floor(n / capacity).alias("n")), F.struct((n % capacity).cast("int").alias("length"), F.lit(1).cast("bigint").alias("n")))
    each = ids.select("bucket", n_words("text").alias("n")).select("bucket", F.explode(sizes).alias("s")).select("bucket", "s.*").where("length > 0 AND n > 0")
    counts = scratch.table(each.groupBy("length", "bucket").agg(F.sum("n").alias("n")), "counts")
    made = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    if len(made) > plan_bound(capacity):
        raise AssertionError("a plan of more rows than it can have")
    slots = F.broadcast(spark.createDataFrame(made, "length int, lo bigint, hi bigint, first_bin bigint, bins bigint, at int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    pieces = ids.select("doc_id", "bucket", F.explode(_cutter(capacity)("text")).alias("p")).select("doc_id", "bucket", "p.*")
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "text"))
    ranked = pieces.withColumn("k", rank - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("k") + F.col("before")).drop("before", "k", "bucket")
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["lo"]) & (ranked["rank"] < slots["hi"]))
    k = F.col("rank") - F.col("lo")
    at = (F.col("at") + ranked["length"] * F.floor(k / F.col("bins"))).cast("int")
    return placed.select((F.col("first_bin") + k % F.col("bins")).alias("bin_id"), at.alias("bin_offset"), "doc_id", "piece", ranked["length"].alias("n_words"), "text")
