"""URL filter by the ratio of two character language models.

Two smoothed variable-order Markov models are counted over all URLs of the
table, one over accepted and one over rejected ones.  A character's probability
starts from 1/256 and is refined through contexts of 0 to ``ORDER`` characters
by Witten-Bell smoothing,

    p_k(x | c) = (n(c x) + t(c) p_{k-1}(x | c')) / (n(c) + t(c)),

t(c) being the number of different characters seen after c; a context that a
model hasn't seen leaves the probability as it is, so each model uses its own
longest known context.  A URL's score is the log-likelihood under the accepted
model minus that under the rejected one, divided by its length in bytes.

Which URLs train as rejected is told by labels, a frame of (page_id, rejected);
a page without a label trains nothing.  Without labels, ``REJECTED_WORDS`` as
whole words of the host (between anything but letters and digits) tell, and all
others train as accepted.  A tenth of the URLs, by hash, isn't trained on: the
threshold is the score at which the sum of the two classes' error rates on it
is least (the middle of the widest range where it is; 0 if it lacks a class).

Counts are of (gram, class) over all URLs and grow with the table, so no task
holds the model.  URLs are cut into ranges by their text, as many as the table
needs (equal URLs by page_id), so that those of a range are alike; each range's
distinct grams are joined with the model, and the range is scored with its part
of it.

Before counting, a URL is lower-cased and loses its scheme.  Cases: a null URL,
or one with nothing but a scheme, has a null score and is kept; repeated URLs
count each time and score alike, ties at the threshold are kept; of several
labels of one page one that rejects wins; rows are scored one by one at any
length; extra columns are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .kernel import U64, chunks, small_batches

ORDER = 5
HELD_OUT = 10
#: URLs of one range, as the aim.
BUCKET = 1 << 15
#: Grams that a task counts before it sends them.
HELD = 1 << 20

REJECTED_WORDS = ("ads", "adult", "adults", "bet", "bets", "betting", "casino", "casinos", "escort", "escorts", "gamble", "gambling", "lottery", "payday", "pharma", "pills", "poker", "porn", "sex", "spam", "torrent", "torrents", "viagra", "warez", "xxx")

_VALUES = ("gram_a", "gram_r", "context_a", "context_r", "kinds_a", "kinds_r")


def _prepared(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")


def _rejected(url: Column) -> Column:
    return F.regexp_extract(_prepared(url), r"^[^/?#]*", 0).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(REJECTED_WORDS) + r")(?![\p{L}\p{N}])")


def _grams(urls: pa.Array):
    """For each chunk: the chunk, positions of characters, and their grams' keys by order (0 where too short)."""
    for c in chunks(pc.binary_join_element_wise("\x02", urls.cast(pa.string()), "")):
        row = np.repeat(np.arange(c.rows), np.diff(c.starts))
        place = np.arange(len(c.data)) - c.starts[row]
        at = np.flatnonzero(place > 0)
        keys, value = [], np.zeros(len(at), U64)
        for k in range(ORDER + 1):
            value = value | (c.data[np.maximum(at - k, 0)].astype(U64) << U64(8 * k))
            keys.append(np.where(place[at] >= k, value | U64((k + 1) << 56), U64(0)))
        yield c, row[at], keys


def _context(key: np.ndarray) -> np.ndarray:
    """The key of a gram without its last character."""
    return (((key >> U64(56)) - U64(1)) << U64(56)) | ((key & U64((1 << 56) - 1)) >> U64(8))


def count(urls: DataFrame) -> DataFrame:
    """The model of a frame (url, rejected): for each key the counts as gram and as context, by class."""

    def out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key, n, r = (np.concatenate(x) for x in zip(*held))
        found, which = np.unique(key, return_inverse=True)
        n, r = (np.bincount(which, x, len(found)).astype(np.int64) for x in (n, r))  # exact below 2**53
        return found, n, r

    def run(batches):
        held, size = [], 0
        for batch in batches:
            rejected = np.asarray(batch.column(1).fill_null(False))
            for c, row, keys in _grams(batch.column(0)):
                bad = rejected[c.first + row]
                both = np.concatenate(keys)
                bad = np.tile(bad, len(keys))[both > 0]
                found, which = np.unique(both[both > 0], return_inverse=True)
                held.append((found, np.bincount(which, minlength=len(found)), np.bincount(which[bad], minlength=len(found))))
                size += len(found)
                if size > HELD:
                    held = [out(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield batch_of(*held.pop())
                        size = 0
        if held:
            yield batch_of(*out(held))

    def batch_of(key: np.ndarray, n: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n - r), pa.array(r)], ["key", "a", "r"])

    grams = urls.mapInArrow(run, "key bigint, a bigint, r bigint").groupBy("key").agg(F.sum("a").alias("gram_a"), F.sum("r").alias("gram_r"))
    grams = scratch.table(grams, "grams")
    low = F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 56) - 1)), 8)
    context = F.shiftleft(F.shiftright("key", 56) - 1, 56).bitwiseOR(low)
    contexts = grams.groupBy(context.alias("key")).agg(F.sum("gram_a").alias("context_a"), F.sum("gram_r").alias("context_r"), F.count_if(F.col("gram_a") > 0).alias("kinds_a"), F.count_if(F.col("gram_r") > 0).alias("kinds_r"))
    model = grams.join(contexts, "key", "full")
    return scratch.table(model.select("key", *[F.coalesce(v, F.lit(0)).alias(v) for v in _VALUES]), "model")


def score(urls: pa.Array, keys: np.ndarray, values: list[np.ndarray]) -> pa.Array:
    """Scores of URLs under a model given as ascending keys and the columns _VALUES."""
    total, length = np.zeros(len(urls)), np.zeros(len(urls), np.int64)

    def find(key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, at, len(keys))

    padded = [np.append(v, 0).astype(np.float64) for v in values]
    for c, row, grams in _grams(urls):
        p = [np.full(len(row), 1 / 256), np.full(len(row), 1 / 256)]
        for key in grams if len(keys) else ():
            some = key > 0
            gram, context = find(key), find(np.where(some, _context(np.maximum(key, U64(1 << 56))), U64(1 << 63)))
            for m in (0, 1):
                n, kinds = padded[2 + m][context], padded[4 + m][context]
                p[m] = np.where(some & (n > 0), (padded[m][gram] + kinds * p[m]) / np.maximum(n + kinds, 1), p[m])
        total[c.first : c.first + c.rows] = np.bincount(row, np.log(p[0]) - np.log(p[1]), c.rows)
        length[c.first : c.first + c.rows] = np.bincount(row, minlength=c.rows)
    return pa.array(total / np.maximum(length, 1), mask=length == 0)


def _sorted(model: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    keys = model.column("key").to_numpy().view(U64)
    order = np.argsort(keys)
    return keys[order], [model.column(v).to_numpy()[order] for v in _VALUES]


def scored(urls: DataFrame, model: DataFrame, bucket: str = "__sx_bucket") -> DataFrame:
    """A frame with a column ``__sx_url``, and ``bucket`` that tells its ranges (each in one task), and the score beside them."""

    def need(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            own = np.asarray(batch.column(0))
            for c, row, grams in _grams(batch.column(1)):
                of = np.tile(own[c.first + row], 2 * len(grams))
                key = np.concatenate(grams)
                key = np.concatenate([key, np.where(key > 0, _context(np.maximum(key, U64(1 << 56))), U64(0))])
                for b in np.unique(of).tolist():
                    held.setdefault(b, []).append(np.unique(key[of == b]))  # 0 is the empty context
                    if len(held[b]) > 16:
                        held[b] = [np.unique(np.concatenate(held[b]))]
        for b, keys in held.items():
            key = np.unique(np.concatenate(keys)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b, np.int64)), pa.array(key)], [bucket, "key"])

    part = urls.select(F.col(bucket).cast("bigint").alias(bucket), "__sx_url").where("__sx_url IS NOT NULL").mapInArrow(need, f"{bucket} bigint, key bigint").distinct().join(model, "key")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        url = left.column("__sx_url").combine_chunks() if left.num_rows else pa.array([], pa.string())
        return left.append_column("score", score(url, *_sorted(right)))

    schema = T.StructType([*urls.schema.fields, T.StructField("score", T.DoubleType())])
    return urls.groupBy(bucket).cogroup(part.groupBy(bucket)).applyInArrow(run, schema)


def threshold(histogram: list[tuple[float, int, int]]) -> float:
    """From rows (score, accepted, rejected): the cut with the least sum of error rates, scores below it being rejected."""
    accepted, rejected = (sum(row[k] for row in histogram) for k in (1, 2))
    if not accepted or not rejected:
        return 0.0
    rows = sorted(histogram)
    lost, caught = 0, 0
    cuts = [(rejected / rejected, rows[0][0], rows[0][0])]
    for k, (s, a, r) in enumerate(rows):
        lost, caught = lost + a, caught + r
        high = rows[k + 1][0] if k + 1 < len(rows) else s + 1
        cuts.append((lost / accepted + (rejected - caught) / rejected, s, high))
    least = min(c[0] for c in cuts) + 1e-12
    ranges: list[tuple[float, float]] = []
    for k, (error, low, high) in enumerate(cuts):
        if error <= least:
            joined = bool(k) and cuts[k - 1][0] <= least
            ranges.append((ranges.pop()[0] if joined else low, high))
    low, high = max(ranges, key=lambda x: x[1] - x[0])
    return (low + high) / 2


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """page_id, url, rejected_seed (null without a label), score, kept of each row."""
    small_batches(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.nullif(_prepared(url), F.lit("")).alias("__sx_url"))
    if labels is None:
        rows = rows.withColumn("rejected_seed", F.coalesce(_rejected(F.col("url")), F.lit(False)))
    else:
        told = labels.groupBy("page_id").agg(F.max(F.col("rejected").cast("boolean")).alias("rejected_seed"))
        rows = rows.join(told, "page_id", "left")
    ranges = max(1, -(-rows.count() // BUCKET))
    rows = scratch.table(rows.repartitionByRange(ranges, "__sx_url", "page_id").withColumn("__sx_bucket", F.spark_partition_id().cast("bigint")), "urls")
    held_out = F.pmod(F.xxhash64("__sx_url"), F.lit(HELD_OUT)) == 0
    known = F.col("rejected_seed").isNotNull()
    model = count(rows.where("__sx_url IS NOT NULL").where(~held_out & known).select("__sx_url", "rejected_seed"))
    made = scratch.table(scored(rows, model), "scores")
    tested = made.where(held_out & known & F.col("score").isNotNull()).groupBy(F.round("score", 3).alias("s"))
    # some thousand rows: a score is a difference of logarithms for a byte
    cut = threshold([tuple(r) for r in tested.agg(F.count_if(~F.col("rejected_seed")), F.count_if("rejected_seed")).collect()])
    return made.select("page_id", "url", "rejected_seed", "score", F.coalesce(F.col("score") >= cut, F.lit(True)).alias("kept"))
