"""Document fingerprints by a homomorphic multiset hash.

A paragraph is expanded to ``LANES`` words of 32 bits by SHA-256 (of the
paragraph, then of that digest's hex and a counter) and a document's
fingerprint is the sum of its paragraphs' vectors, each word modulo 2**32.
Addition commutes, so the fingerprint doesn't depend on the paragraphs' order;
it counts repeats, and a paragraph is added or taken away by adding or
subtracting its vector, without the rest of the document.

A paragraph is a line with its outer white space (space, tab, vertical tab,
form feed, carriage return) removed; blank ones don't count.

Cases: a null text has a null fingerprint and belongs to no group; an empty or
blank text has no paragraph and the all-zero fingerprint; repeated rows have
equal fingerprints and each stays a row; ``copies`` and ``first_doc_id`` (null
if no row of the group has an id) are those of the group of equal
fingerprints; a text is read whole at any length; an empty table gives an empty
result; extra columns are not carried.

With 32 words of 32 bits, equal fingerprints of unlike documents by chance are
out of reach; documents made on purpose to collide are not, as a generalised
birthday search is far cheaper on sums than on a hash.  This tells equal texts
apart from unlike ones in a corpus, and proves nothing against its authors.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .kernel import small_batches

LANES = 32
_SPACE = " \t\v\f\r"
_TAGS = [b"%d" % k for k in range(LANES // 8)]


def vector(paragraph: bytes) -> np.ndarray:
    """The paragraph's lanes."""
    seed = sha256(paragraph).hexdigest().encode()
    return np.frombuffer(b"".join([sha256(seed + t).digest() for t in _TAGS]), ">u4").astype(np.uint32)


def paragraphs(text: str) -> list[bytes]:
    return [p.encode() for p in (x.strip(_SPACE) for x in text.split("\n")) if p]


def fingerprint(text: str) -> bytes:
    """The sum of the paragraphs' vectors, as big-endian bytes."""
    total = np.zeros(LANES, np.uint32)
    for p in paragraphs(text):
        total += vector(p)
    return total.astype(">u4").tobytes()


def combine(print_: bytes, added: list[str] = (), removed: list[str] = ()) -> bytes:
    """A fingerprint after paragraphs were inserted and deleted."""
    total = np.frombuffer(print_, ">u4").astype(np.uint32)
    for sign, texts in ((1, added), (-1, removed)):
        for t in texts:
            for p in paragraphs(t):
                total = total + vector(p) if sign > 0 else total - vector(p)
    return total.astype(">u4").tobytes()


@F.arrow_udf(T.StructType().add("n", "integer").add("print", "string"))
def _fingerprint(texts: pa.Array) -> pa.Array:
    n, made = [], []
    for t in texts:
        t = t.as_py()
        own = None if t is None else paragraphs(t)
        n.append(own and len(own) or 0)
        if own is None:
            made.append(None)
            continue
        # lanes of all paragraphs at once; the sum wraps modulo 2**32
        seeds = [sha256(p).hexdigest().encode() for p in own]
        lanes = np.frombuffer(b"".join([sha256(s + t).digest() for s in seeds for t in _TAGS]), ">u4").reshape(-1, LANES)
        made.append(lanes.sum(axis=0, dtype=np.uint32).astype(">u4").tobytes().hex())
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(made, pa.string())], ["n", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, fingerprint (hex) of each row."""
    small_batches(docs.sparkSession)
    made = docs.select(F.col(id_col).alias("doc_id"), _fingerprint(F.col(text_col)).alias("f"))
    return made.select("doc_id", F.col("f.n").alias("n_paragraphs"), F.col("f.print").alias("fingerprint"))


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint with the size and first doc_id of its group of equal ones."""
    made = scratch.table(fingerprints(docs, id_col, text_col), "fingerprints")
    sizes = made.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc_id"))
    several = sizes.where("copies > 1")  # most rows are alone: the join's right side is small
    joined = made.join(several, "fingerprint", "left")
    alone = F.col("fingerprint").isNotNull() & F.col("copies").isNull()
    return joined.select("doc_id", "n_paragraphs", "fingerprint", F.when(alone, 1).otherwise(F.col("copies")).alias("copies"), F.when(alone, F.col("doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"))


def oracle(table: str = "documents") -> str:
    lanes = " || ".join(f"printf('%08x', (sum(('0x' || substr(d[{k // 8 + 1}], {8 * (k % 8) + 1}, 8))::BIGINT) % 4294967296)::BIGINT)" for k in range(LANES))
    tags = ", ".join(f"sha256(s || '{k}')" for k in range(LANES // 8))
    space = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {space}) AS p FROM {table}),
v AS (SELECT doc_id, [{tags}] AS d FROM (SELECT doc_id, sha256(p) AS s FROM p WHERE p <> '')),
f AS (SELECT doc_id, count(*)::INT AS n, {lanes} AS x FROM v GROUP BY doc_id),
a AS (SELECT t.doc_id, coalesce(f.n, 0) AS n_paragraphs, CASE WHEN t.text IS NOT NULL THEN coalesce(f.x, repeat('0', {8 * LANES})) END AS fingerprint FROM {table} t LEFT JOIN f USING (doc_id))
SELECT *, CASE WHEN fingerprint IS NOT NULL THEN count(*) OVER (PARTITION BY fingerprint) END AS copies,
  CASE WHEN fingerprint IS NOT NULL THEN min(doc_id) OVER (PARTITION BY fingerprint) END AS first_doc_id FROM a"""
