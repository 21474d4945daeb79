"""Numbered lines of source files, from the index or from disk below an allowed root."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, CHARS, HARD_CHARS = 20, 4_000, 8_000


def caps(context: int = 0, max_chars: int = CHARS) -> tuple[int, int]:
    return max(0, min(context, CONTEXT)), max(200, min(max_chars, HARD_CHARS))


def numbered(number: Column, text: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), " "), F.lit("| "), text)


def snippet(bodies: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """(id, file_id, line, text) for each line of spans (id, file_id, start_line, end_line) with ``context`` lines around.

    A span without lines, or outside its file, gives nothing; one that ends
    before it starts is its first line.
    """
    context, _ = caps(context)
    some = spans.where("file_id IS NOT NULL AND start_line IS NOT NULL").select("id", F.col("file_id").alias("_f"), F.greatest(F.lit(1), F.col("start_line") - context).alias("_a"), (F.greatest("start_line", F.coalesce("end_line", "start_line")) + context).alias("_b"))
    joined = bodies.select("file_id", "content").join(some, F.col("file_id") == F.col("_f"))
    own = F.slice(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1), F.col("_a"), F.col("_b") - F.col("_a") + 1)
    lines = joined.select("id", "file_id", "_a", F.posexplode(own).alias("k", "own"))
    return lines.select("id", "file_id", (F.col("_a") + F.col("k")).cast("int").alias("line"), numbered(F.col("_a") + F.col("k"), F.col("own")).alias("text"))


def snippet_text(lines: DataFrame) -> DataFrame:
    """(id, text) with each snippet's lines joined in order."""
    return lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("_l")).select("id", F.array_join(F.col("_l.text"), "\n").alias("text"))


@dataclass(frozen=True)
class Snippet:
    ok: bool
    text: str
    path: str | None = None


def traverses(path: str) -> bool:
    return bool(re.search(r"(^|[\\/])\.\.([\\/]|$)|%2e%2e", path, re.I))


def read(root: str | None, path: str, start: int, end: int, context: int = 0, max_chars: int = CHARS) -> Snippet:
    """Lines of one file on the driver's disk, if it lies below ``root`` after links are followed."""
    context, max_chars = caps(context, max_chars)
    if traverses(path):
        return Snippet(False, "the path leaves its root")
    if not root:
        return Snippet(False, "no root is known to read below")
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, path.replace("\\", "/")))
    if full != base and not full.startswith(base.rstrip(os.sep) + os.sep):
        return Snippet(False, "the file is outside of the root")
    if not os.path.isfile(full):
        return Snippet(False, "there is no such file")
    with open(full, encoding="utf-8", errors="replace", newline=None) as f:
        lines = f.read().split("\n")
    first, last = max(1, start - context), min(len(lines), max(start, end) + context)
    text = "\n".join(f"{n:4d}| {lines[n - 1]}" for n in range(first, last + 1))
    return Snippet(True, text if len(text) <= max_chars else text[: max_chars - 1] + "…", full)
