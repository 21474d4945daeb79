"""Hotspots and index quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_lines, line_count
from .catalog import clamp, counted, with_types
from .relations import of_kind

METRICS = {"calls": "calls", "call": "calls", "fanout": "calls", "fanin": "fanin", "fan-in": "fanin", "consumers": "fanin", "refs": "fanin", "types": "types", "type": "types"}
_CODE = ("method", "constructor")


def metric(name: str | None) -> str:
    return METRICS.get((name or "").strip().lower(), "size")


def by_size(members: DataFrame, types: DataFrame, limit: int) -> DataFrame:
    """Longest methods: in lines where they are known, else in characters, the two compared as they are."""
    known = has_lines(F.col("start_line"), F.col("end_line"))
    key = F.when(known, line_count(F.col("start_line"), F.col("end_line"))).otherwise(F.col("size_chars"))
    label = F.when(known, F.concat(key.cast("string"), F.lit(" lines"))).otherwise(F.concat(F.col("size_chars").cast("string"), F.lit(" chars")))
    some = members.where(F.col("kind").isin(*_CODE)).select("id", "type_id", "name", "kind", "size_chars", key.cast("bigint").alias("score"), label.alias("label"))
    joined = with_types(some, types)
    return joined.orderBy(F.desc("score"), F.desc("size_chars"), "id").limit(clamp(limit, 1, 50)).select("id", "type_full_name", "name", "kind", "score", "label")


def _by_relations(members: DataFrame, types: DataFrame, n, limit: int) -> DataFrame:
    some = members.select("id", "type_id", "name", "kind", n.cast("bigint").alias("score")).where("score > 0")
    return with_types(some, types).orderBy(F.desc("score"), "id").limit(clamp(limit, 1, 50)).select("id", "type_full_name", "name", "kind", "score")


def by_calls(members: DataFrame, types: DataFrame, limit: int) -> DataFrame:
    return _by_relations(members.where(F.col("kind").isin(*_CODE)), types, F.size(of_kind(F.col("dependencies"), "calls")), limit)


def by_fan_in(members: DataFrame, types: DataFrame, limit: int) -> DataFrame:
    return _by_relations(members, types, F.size("consumers"), limit)


def by_members(types: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    counts = counted(types.select("id", "full_name", "kind", "size_chars"), members, "type_id", "score")
    return counts.orderBy(F.desc("score"), F.desc("size_chars"), "id").limit(clamp(limit, 1, 50)).select("id", "full_name", "kind", "score")


def hotspots(index, name: str | None, limit: int = 10) -> DataFrame:
    kind = metric(name)
    if kind == "calls":
        return by_calls(index.members, index.types, limit)
    if kind == "fanin":
        return by_fan_in(index.members, index.types, limit)
    return by_members(index.types, index.members, limit) if kind == "types" else by_size(index.members, index.types, limit)


def _percent(part, whole):
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def quality(types: DataFrame, members: DataFrame) -> DataFrame:
    """One row of counts, percentages, a grade and notes; one pass over each table.

    Percentages are rounded half to even; the grade is taken before rounding.
    """
    said = F.length(F.trim("summary")) > 0
    code = F.col("kind").isin(*_CODE)
    known = has_lines(F.col("start_line"), F.col("end_line"))
    t = types.agg(F.count(F.lit(1)).alias("type_count"), F.count_if(said).alias("types_said"), F.count_if(F.size("consumers") > 0).alias("types_consumed"))
    m = members.agg(
        F.count(F.lit(1)).alias("member_count"), F.count_if(code).alias("method_count"), F.count_if(said).alias("members_said"), F.count_if(code & (F.size(of_kind(F.col("dependencies"), "calls")) > 0)).alias("methods_calling"),
        F.count_if(code & (F.col("start_line").isNull() | F.col("file_id").isNull())).alias("methods_missing_location"), F.coalesce(F.avg(F.when(code & known, line_count(F.col("start_line"), F.col("end_line")))), F.lit(0.0)).alias("lines"),
    )
    row = t.crossJoin(m)  # single rows
    summary, calls = _percent(F.col("types_said"), F.col("type_count")), _percent(F.col("methods_calling"), F.col("method_count"))
    missing = F.col("methods_missing_location")
    points = F.when(summary >= 40, 2).when(summary >= 15, 1).otherwise(0) + F.when(calls >= 30, 2).when(calls >= 10, 1).otherwise(0) + F.when(missing == 0, 2).when(missing < F.col("type_count"), 1).otherwise(0)
    grade = F.when(F.col("type_count") == 0, "empty").when(points >= 5, "A").when(points >= 4, "B").when(points >= 2, "C").otherwise("D")
    notes = F.array_compact(
        F.array(
            F.when((F.col("type_count") > 0) & (summary < 15), "few types have a summary"), F.when((F.col("method_count") > 0) & (calls < 10), "few methods have calls"),
            F.when(missing > 0, "some methods have no location"), F.when(F.col("types_consumed") == 0, "no consumers are indexed"),
        )
    )
    return row.select(
        "type_count", "member_count", "method_count", "types_consumed", "methods_missing_location", F.bround(summary, 1).alias("type_summary_pct"), F.bround(_percent(F.col("members_said"), F.col("member_count")), 1).alias("member_summary_pct"),
        F.bround(calls, 1).alias("calls_pct"), F.bround("lines", 1).alias("avg_method_lines"), grade.alias("grade"), F.array_join(notes, "; ").alias("notes"),
    )
