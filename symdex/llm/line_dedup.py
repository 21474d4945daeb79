"""Line dedup by two Bloom filters and exact confirmation.

A line that occurs more than once in the corpus stays at its first occurrence
only.  The filters are cut into shards by the lines' hashes, as many as the
corpus needs, so that no task and no broadcast holds more than its part of
them.  Each task hashes its lines; of lines that repeat within it, it knows
that they do, and of every other hash a shard gets 8 bytes and the row's
number.  A shard sets a hash's bits in its "once-seen" filter and those that
were set before, by another task, in its "twice-seen" filter; each repeated
line has all its bits there.  Only what a shard suspects goes back to the rows,
and only suspected lines' texts shuffle: grouped by the exact text, a group of
one is a false suspect, and of the others the first occurrence stays.  A line
that a third of all rows hold is one hash for each task, and its texts are
counted before they shuffle.

Documents never move: they are written once, to the shared folder, in buckets
by the task that wrote them (``Rows``), and what is known of a row is sent to
the bucket that has it.

Order of occurrence: doc_id (nulls last), line number, a hash of the row's
text, then one of the rows equal in all of these.  Blank lines (nothing but
white space) are structure, and always stay.  A row that loses lines and has
nothing but blank lines left is dropped: all it said is said elsewhere.

Cases: null and empty texts pass unchanged; repeated rows keep the lines of
one of them (of rows with equal doc_id, line number and text, any one); a text is split at newlines only, at any length; an empty table
gives an empty table; other columns pass through, and ``n_chars``, where there
is one, is set to the new length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .kernel import U64, Chunk, chunks, lines, mix, ragged, small_batches

BITS_PER_LINE = 16
HASHES = 4
#: Hashes of one shard, as the aim.
SHARD_LINES = 1 << 20
#: Lines that a task compares with one another before it sends them.
HELD_LINES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _said(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each row, and place among all lines of the chunk and hash of each that isn't blank."""
    row, start, end = lines(c)
    full = np.concatenate([[0], np.cumsum(~_SPACE[c.data])])
    at = np.flatnonzero(full[end] > full[start])
    return np.bincount(row, minlength=c.rows), at, c.hashes(start[at], end[at])


def bits_of(h: np.ndarray, size: int) -> np.ndarray:
    """HASHES positions below ``size`` (a power of two) for each hash, one row each."""
    step = mix(h ^ U64(0x5BD1E9955BD1E995)) | U64(1)
    return np.stack([(h + U64(k) * step) & U64(size - 1) for k in range(HASHES)])


def suspects(h: np.ndarray) -> np.ndarray:
    """Which of these hashes may occur more than once, by a once-seen and a twice-seen filter."""
    size = 1 << max(6, (len(h) * BITS_PER_LINE - 1).bit_length())
    once, twice = np.zeros(size, bool), np.zeros(size, bool)
    p = bits_of(h, size).view(np.int64)
    step = 1 << 16
    for i in range(0, len(h), step):
        own = np.sort(p[:, i : i + step].T, axis=1)
        fresh = np.ones(own.shape, bool)  # a hash that sets a bit twice has seen it once
        fresh[:, 1:] = own[:, 1:] != own[:, :-1]
        place, times = np.unique(own[fresh], return_counts=True)
        twice[place[(times > 1) | once[place]]] = True
        once[place] = True
    return twice[p].all(axis=0)


class Rows:
    """A frame written in buckets, with ``uid``, a row's number, and ``home``, by which a bucket is told.

    All rows of one task are in one bucket, so nothing shuffles for it, and a
    join on (home, uid) moves the other side only.
    """

    def __init__(self, df: DataFrame, uid: str, home: str, size: Column):
        spark = df.sparkSession
        # a bucketed side serves a join on more columns than its own; either setting gives the same rows
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a value for each bucket, under Spark's own hash
        some = spark.range(24 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("b")).groupBy("b").agg(F.min("id").alias("id"))
        found = {r["b"]: r["id"] for r in some.collect()}  # as many as there are partitions
        self.homes = [found[b] for b in sorted(found)]
        self.uid, self.home = uid, home
        seen = Observation()
        numbered = df.withColumn(uid, F.monotonically_increasing_id()).observe(seen, F.sum(size).alias("n"))
        self.df = scratch.bucketed(numbered.withColumn(home, self.home_of(F.col(uid))), home, n)
        self.size = seen.get["n"] or 0
        self.buckets = n

    def home_of(self, uid: Column) -> Column:
        task = F.shiftrightunsigned(uid, 33)
        return F.element_at(F.array(*map(F.lit, self.homes)), (F.pmod(task, F.lit(len(self.homes))) + 1).cast("int"))

    def with_known(self, known: DataFrame, how: str) -> DataFrame:
        """Rows with what is ``known`` of them, a frame with one row for each uid at most."""
        there = known if self.home in known.columns else known.withColumn(self.home, self.home_of(F.col(self.uid)))
        return self.df.join(there.hint("shuffle_hash"), [self.home, self.uid], how)


def _sent(shards: int):
    """(shard, packed) of a frame (uid, text): hash and uid of every line, with -1 for a uid of which the task knows the line to repeat.

    Such lines' own (hash, uid) go beside, under shards of their own, to be passed on.
    """

    def out(h: np.ndarray, uid: np.ndarray, task: int):
        order = np.argsort(h, kind="stable")
        h, uid = h[order], uid[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(np.append(first, len(h)))
        again = np.repeat(times > 1, times)
        some = np.stack([h[first].view(np.int64), np.where(times > 1, -1, uid[first])], axis=1)
        to = (mix(h[first]) % U64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        some, cut = some[order], np.searchsorted(to[order], np.arange(shards + 1))
        part = [s for s in range(shards) if cut[s] < cut[s + 1]]
        packed = [some[cut[s] : cut[s + 1]].tobytes() for s in part]
        if again.any():
            part.append(shards + task)
            packed.append(np.unique(np.stack([h[again].view(np.int64), uid[again]], axis=1), axis=0).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(packed, pa.binary())], ["shard", "packed"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for c in chunks(batch.column(1)):
                total, at, h = _said(c)
                held.append((h, np.repeat(uid[c.first : c.first + c.rows], total)[at]))
                n += len(h)
                if n >= HELD_LINES:
                    h, own = (np.concatenate(x) for x in zip(*held))
                    yield out(h, own, int(own[0] >> 33))
                    held, n = [], 0
        if n:
            h, own = (np.concatenate(x) for x in zip(*held))
            yield out(h, own, int(own[0] >> 33))

    return run


def _suspected(shards: int):
    """(uid, h) of the lines that a shard suspects, or that tasks passed on."""

    def run(rows: pa.Table) -> pa.Table:
        some = np.frombuffer(b"".join(rows.column("packed").to_pylist()), np.int64).reshape(-1, 2)
        if rows.column("shard")[0].as_py() < shards:
            h, uid = np.ascontiguousarray(some[:, 0]).view(U64), some[:, 1]
            known = np.unique(h[uid < 0])
            hit = suspects(h)
            if len(known):
                hit |= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            some = some[hit & (uid >= 0)]
        return pa.table({"uid": pa.array(np.ascontiguousarray(some[:, 1])), "h": pa.array(np.ascontiguousarray(some[:, 0]))})

    return run


def _picked(batches):
    """The suspected lines of a frame (id, uid, own, text, hs): id, uid, own, no, line."""
    for batch in batches:
        ids, uid, own, texts, hs = (batch.column(k) for k in range(5))
        listed = np.repeat(np.arange(len(hs)), np.diff(hs.offsets.to_numpy()))
        values = hs.flatten().to_numpy().view(U64)
        wanted = np.unique(mix(values ^ mix(listed.astype(U64))))  # a collision is one more suspect
        for c in chunks(texts):
            row, start, end = lines(c)
            total, at, h = _said(c)
            of = row[at]
            hit = np.isin(mix(h ^ mix((of + c.first).astype(U64))), wanted)
            at, of = at[hit], of[hit]
            if not len(at):
                continue
            no = at - (np.cumsum(total) - total)[of]
            size = end[at] - start[at]
            which, k = ragged(size)
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            line = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(c.data[start[at][which] + k])))
            take = pa.array(of + c.first)
            yield pa.RecordBatch.from_arrays([ids.take(take), uid.take(take), own.take(take), pa.array(no.astype(np.int32)), line], ["id", "uid", "own", "no", "line"])


@F.arrow_udf(T.StructType().add("text", "string").add("left", "boolean"))
def _edited(texts: pa.Array, gone: pa.Array) -> pa.Array:
    made, left = [], []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
        if numbers:
            drop = set(numbers)
            kept = [x for i, x in enumerate(text.split("\n")) if i not in drop]
            made.append("\n".join(kept))
            left.append(any(x.strip(" \t\n\v\f\r") for x in kept))
        else:
            made.append(text)
            left.append(True)
    return pa.StructArray.from_arrays([pa.array(made, pa.string()), pa.array(left)], ["text", "left"])


_without = _edited.asNondeterministic()  # run once, not again for the filter on what is left


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each line only where it occurs first; columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    uid, home, gone, new = (scratch.fresh(k) for k in ("uid", "home", "gone", "new"))
    text = F.col(text_col)
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    rows = Rows(docs, uid, home, n_lines)
    shards = max(1, -(-rows.size // SHARD_LINES))

    sent = rows.df.select(uid, text_col).mapInArrow(_sent(shards), "shard bigint, packed binary")
    found = sent.groupBy("shard").applyInArrow(_suspected(shards), "uid bigint, h bigint")
    placed = found.withColumn(home, rows.home_of(F.col("uid"))).repartition(rows.buckets, home)  # as the rows are, so once
    hashes = placed.groupBy(home, "uid").agg(F.collect_list("h").alias("hs")).withColumnRenamed("uid", uid)
    kind = docs.schema[id_col].dataType.simpleString()
    some = rows.with_known(hashes, "inner").select(F.col(id_col).alias("id"), uid, F.xxhash64(text_col).alias("own"), text_col, "hs")
    one = scratch.table(some.mapInArrow(_picked, f"id {kind}, uid bigint, own bigint, no int, line string"), "lines")

    place = F.struct(F.col("id").isNull().alias("none"), "id", "no", "own", "uid")
    first = one.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("line", F.col("first.uid").alias("first_uid"), F.col("first.no").alias("first_no"))
    lost = one.join(first, "line").where("uid <> first_uid OR no <> first_no").groupBy("uid").agg(F.collect_list("no").alias(gone))
    lost = scratch.table(lost.withColumnRenamed("uid", uid), "gone")

    edited = rows.with_known(lost, "left").withColumn(new, _without(F.when(F.col(gone).isNotNull(), text), F.col(gone))).where(F.col(f"{new}.left"))
    made = {text_col: F.coalesce(f"{new}.text", text_col)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(f"{new}.text")).cast(docs.schema["n_chars"].dataType)
    edited = edited.withColumns(made)
    return edited.select(*[c for c, name in zip(scratch.columns(edited), edited.columns) if name in set(docs.columns)])
