"""Name resolution, listings and index status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import line_count


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def resolve_type(types: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """The best type by full name, id or name, in that order; at most one row."""
    q = F.lit(query)
    hit = (F.col("full_name") == q) | F.col("id").isin(query, f"type:{query}") | (F.col("name") == q)
    rank = F.when(F.col("full_name") == q, 0).when(F.col("id").isin(query, f"type:{query}"), 1).otherwise(2)
    found = types.where(hit).withColumn("match_rank", rank).orderBy("match_rank", "full_name", "id").limit(1)
    return _with_path(found, files)


def _with_path(rows: DataFrame, files: DataFrame) -> DataFrame:
    paths = files.select(F.col("id").alias("_file"), "relative_path", "absolute_path")
    return rows.join(paths, rows["file_id"] == F.col("_file"), "left").drop("_file")


def _member_rank(query: str, prefix: str) -> tuple[Column, Column]:
    pid = query if ":" in query else f"{prefix}:{query}"
    by_id = F.col("id").isin(query, pid)
    full = F.concat_ws(".", "type_full_name", "name") == query
    short = F.concat_ws(".", "type_name", "name") == query
    like = F.col("signature").ilike(f"%{query}%")
    hit = by_id | (F.col("signature") == query) | (F.col("name") == query) | full | short | like
    rank = F.when(by_id, 0).when(F.col("signature") == query, 1).when(full, 2).when(F.col("name") == query, 3).otherwise(4)
    return hit, rank


def with_types(members: DataFrame, types: DataFrame) -> DataFrame:
    named = types.select(F.col("id").alias("_type"), F.col("full_name").alias("type_full_name"), F.col("name").alias("type_name"))
    return members.join(named, members["type_id"] == F.col("_type")).drop("_type")


def resolve_member(members: DataFrame, types: DataFrame, files: DataFrame, query: str, strict: bool = False) -> DataFrame:
    """The best member by id, signature, full name or name; also by a part of its signature, unless ``strict``.

    If nothing is found and the query has no prefix, ids are tried with the
    prefixes property, field and event, in one plan: the rank of a retry is
    behind every rank of the first try.
    """
    joined = with_types(members, types)
    hit, rank = _member_rank(query, "method")
    if strict:
        hit = hit & (rank < 4)
    if ":" not in query:
        for k, prefix in enumerate(("property", "field", "event")):
            again = F.col("id") == f"{prefix}:{query}"
            rank = F.when(hit, rank).when(again, 5 + k)
            hit = hit | again
    found = joined.where(hit).withColumn("match_rank", rank).orderBy("match_rank", "type_full_name", "name", "id").limit(1)
    return _with_path(found, files)


def list_members(members: DataFrame, types: DataFrame, files: DataFrame, type_id: str | None = None, full_name: str | None = None, limit: int = 200) -> DataFrame:
    joined = with_types(members, types)
    joined = joined.where(F.col("type_id") == type_id) if type_id else joined.where(F.col("type_full_name") == full_name)
    return _with_path(joined.orderBy("kind", "name", "id").limit(limit), files)


def counted(parents: DataFrame, children: DataFrame, key: str, name: str, few: bool = False) -> DataFrame:
    """Parents with the number of their children, 0 included; ``few`` parents (at most 500) are sent to their children."""
    if few:
        children = children.join(F.broadcast(parents.select(F.col("id").alias("_few"))), F.col(key) == F.col("_few"), "left_semi")
    n = children.groupBy(F.col(key).alias("_parent")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.join(n, parents["id"] == F.col("_parent"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_parent", "_n")


def list_types(types: DataFrame, members: DataFrame, limit: int = 500) -> DataFrame:
    """The first types by full name; only their members are counted."""
    some = types.orderBy("full_name", "id").limit(clamp(limit, 1, 500))
    return counted(some, members, "type_id", "member_count", few=True).select("id", "full_name", "name", "kind", "accessibility", "summary", "member_count")


def list_projects(projects: DataFrame, types: DataFrame, files: DataFrame, limit: int = 200) -> DataFrame:
    some = projects.orderBy("name", "id").limit(clamp(limit, 1, 500))
    some = counted(some, types, "project_id", "type_count", few=True)
    return counted(some, files, "project_id", "file_count", few=True).select("id", "name", "path", "target_framework", "is_test", "type_count", "file_count")


def status(projects: DataFrame, files: DataFrame, types: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the size of each table."""
    made = None
    for name, df in (("project_count", projects), ("file_count", files), ("type_count", types), ("member_count", members), ("edge_count", edges)):
        one = df.agg(F.count(F.lit(1)).alias(name))
        made = one if made is None else made.crossJoin(one)  # single rows
    return made


def token_rollup(types: DataFrame, members: DataFrame) -> DataFrame:
    """Estimated tokens of each type: its own texts, its members' and its dependencies'."""
    from ..functions.scalars import pascal, tokens, tokens_of

    own = tokens_of(F.col("full_name"), F.col("summary"), pascal(F.col("kind")))
    each = members.select("type_id", tokens_of(F.col("signature"), F.col("summary"), F.col("return_type")).alias("t"))
    total = each.groupBy("type_id").agg(F.sum("t").alias("member_tokens"))
    deps = F.aggregate(F.transform("dependencies", lambda r: tokens(r["targetName"]) + tokens(pascal(r["kind"]))), F.lit(0), lambda a, x: a + x)
    joined = types.join(total, types["id"] == total["type_id"], "left")
    return joined.select("id", "project_id", (own + F.coalesce("member_tokens", F.lit(0)) + deps).cast("bigint").alias("token_estimate"))


def overview_tokens(solutions: DataFrame, projects: DataFrame, type_tokens: DataFrame) -> DataFrame:
    from ..functions.scalars import tokens, tokens_of

    named = projects.groupBy("solution_id").agg(F.sum(tokens(F.col("name"))).alias("p"))
    typed = projects.join(type_tokens.select("project_id", "token_estimate"), projects["id"] == F.col("project_id")).groupBy("solution_id").agg(F.sum("token_estimate").alias("t"))
    joined = solutions.join(named, solutions["id"] == named["solution_id"], "left").drop("solution_id").join(typed, F.col("id") == typed["solution_id"], "left")
    return joined.select("id", (tokens_of(F.col("name"), F.col("path")) + F.coalesce("p", F.lit(0)) + F.coalesce("t", F.lit(0))).cast("bigint").alias("token_estimate"))


def spans(rows: DataFrame) -> DataFrame:
    return rows.select("id", line_count(F.col("start_line"), F.col("end_line")).alias("line_count"))
