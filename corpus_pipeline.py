"""A corpus pipeline: quality rules, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; its result is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symdex.llm import line_dedup, packing, quality_rules, scratch, simhash


#: Tables that the last stage wrote for itself.
_held: list[str] = []


def _stage(operator: Callable[..., DataFrame], docs: DataFrame) -> DataFrame:
    """Runs an operator; what the stage before wrote for itself goes first, as its result is elsewhere."""
    scratch.release(_held)
    with scratch.noted(_held):
        return operator(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that a quality rule rejects.

    Null, empty and blank texts are rejected, as they have no words; texts of
    any length are judged whole, equal rows alike; there are no ties; other
    columns pass through; an empty table stays empty.
    """
    return _stage(quality_rules.keep, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that occur earlier, and documents that consist of such lines.

    Null and empty texts pass; rows that repeat keep the lines of one of them;
    ties of doc_id go by line number, then by a hash of the text; other columns
    pass through, ``n_chars`` follows the text; an empty table stays empty.
    """
    return _stage(line_dedup.dedup, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest doc_id.

    Null, empty and word-less texts match nothing and stay; a null doc_id goes
    after all others, ties by a hash of the text; of equal rows one stays;
    other columns pass through; an empty table stays empty.
    """
    return _stage(simhash.dedup, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns pieces of the documents to training sequences.

    Null, empty and blank texts have no piece; longer texts than a sequence are
    cut; equal rows are packed one by one, a null doc_id as null; other columns
    are not carried; an empty table gives no piece.
    """
    return _stage(packing.pack, docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("best_fit_packing", pack)]

#: SimHash groups and best-fit plans can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch.root(spark) + "-stages"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}/{sf_dir.strip('/').replace('/', '-')}/{k}-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("STAGES is empty")
