"""What changed since an index was built: fingerprints, staleness and reuse by project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REASONS_SHOWN = 5


def fingerprints(projects: DataFrame, files: DataFrame, options: str = "") -> DataFrame:
    """(id, fingerprint): SHA-256 of the project file's hash (its name, where it has none) and the sorted ``path:hash`` lines of its files.

    ``options`` names whatever else an index depends on; projects built with
    other options are other projects.
    """
    line = F.concat_ws(":", "relative_path", "content_hash")
    listed = files.groupBy("project_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("_files"))
    joined = projects.join(listed, projects["id"] == listed["project_id"], "left")
    head = F.concat(F.lit("proj:"), F.coalesce("file_hash", "name"))
    parts = [head, F.col("_files")] + ([F.lit(f"options:{options}")] if options else [])
    return joined.select("id", F.sha2(F.encode(F.concat_ws("\n", *parts), "UTF-8"), 256).alias("fingerprint"))


def file_changes(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(project_id, relative_path, reason) where the manifests (project_id, relative_path, content_hash) differ: missing, changed, unreadable or new."""
    old = indexed.select(F.col("project_id").alias("_p"), F.col("relative_path").alias("_f"), F.col("content_hash").alias("_h"), F.lit(True).alias("_old"))
    new = current.select("project_id", "relative_path", "content_hash", F.lit(True).alias("_new"))
    both = old.join(new, (F.col("_p") == F.col("project_id")) & (F.col("_f") == F.col("relative_path")), "full_outer")
    reason = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "new").when(F.col("content_hash").isNull(), "unreadable").when(~F.col("_h").eqNullSafe(F.col("content_hash")), "changed")
    return both.select(F.coalesce("project_id", "_p").alias("project_id"), F.coalesce("relative_path", "_f").alias("relative_path"), reason.alias("reason")).where("reason IS NOT NULL")


def stale_projects(projects: DataFrame, indexed: DataFrame, current: DataFrame, project_hashes: DataFrame | None = None) -> DataFrame:
    """Projects with any change: how many, by reason, and the first few.

    ``project_hashes`` (id, file_hash) are the project files as they are now; a
    project that isn't there is missing.
    """
    changes = file_changes(indexed, current).select(F.col("project_id").alias("id"), F.concat_ws(" ", "reason", "relative_path").alias("what"), "reason")
    if project_hashes is not None:
        now = project_hashes.select(F.col("id").alias("_id"), F.col("file_hash").alias("_now"))
        own = projects.select("id", "file_hash").join(now, F.col("id") == F.col("_id"), "left")
        reason = F.when(F.col("_id").isNull(), "missing").when(~F.col("_now").eqNullSafe(F.col("file_hash")), "changed")
        changes = changes.unionByName(own.select("id", F.concat(reason, F.lit(" project file")).alias("what"), reason.alias("reason")).where("reason IS NOT NULL"))
    found = changes.groupBy("id").agg(*[F.count_if(F.col("reason") == r).alias(f"{r}_files") for r in ("missing", "changed", "new")], F.count(F.lit(1)).alias("changes"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("what"))
    shown = changes.withColumn("_k", rank).where(F.col("_k") <= REASONS_SHOWN).groupBy("id").agg(F.sort_array(F.collect_list("what")).alias("reasons"))
    return found.join(shown, "id").join(projects.select("id", "name"), "id").select("id", "name", "missing_files", "changed_files", "new_files", "changes", F.array_join("reasons", "; ").alias("reasons"))


def is_stale(stale: DataFrame, solution_there: bool = True) -> DataFrame:
    return stale.agg((F.lit(not solution_there) | (F.count(F.lit(1)) > 0)).alias("is_stale"), F.count(F.lit(1)).alias("stale_projects"))


def can_reuse(old_options: dict, new_options: dict, same_solution: bool, changed_only: bool) -> bool:
    """Rows are reused only if whatever shaped them is as it was."""
    return bool(changed_only and same_solution and old_options == new_options)


def reuse_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action) from two sets of fingerprints: reuse, rebuild, add or drop."""
    a, b = old.select("id", F.col("fingerprint").alias("_old")), new.select("id", F.col("fingerprint").alias("_new"))
    action = F.when(F.col("_new").isNull(), "drop").when(F.col("_old").isNull(), "add").when(F.col("_old") == F.col("_new"), "reuse").otherwise("rebuild")
    return a.join(b, "id", "full_outer").select("id", action.alias("action"))


def merged(old_rows: DataFrame, new_rows: DataFrame, plan: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of reused projects from the old table and of all others that still exist from the new one.

    ``new_rows`` may hold just the projects that were extracted again.
    """
    acts = plan.select(F.col("id").alias("_p"), "action")
    reused = old_rows.join(acts.where("action = 'reuse'"), old_rows[key] == F.col("_p"), "left_semi")
    rebuilt = new_rows.join(acts.where("action IN ('add', 'rebuild')"), new_rows[key] == F.col("_p"), "left_semi")
    return reused.unionByName(rebuilt)
