"""Fact tables that a compiler front end wrote, and the build of an index from them.

A folder of facts has Parquet or JSON-lines tables: ``projects`` (id, name,
path, assembly, project_xml, file_hash, doc_count), ``documents``, ``types``
(declarations), ``members``, ``uses``, ``calls`` and ``refs`` as the operators
of ``operators.extraction`` take them.  Tables may be missing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies, scalars
from ..operators import change, extraction, relations
from ..plans.lineage import cut
from ..schema import REL, conform
from .config import Options

_SPAN = "file_id string, start_line int, end_line int, start_offset int, end_offset int, size_chars int"
FACTS = {
    "projects": "id string, name string, path string, assembly string, project_xml string, file_hash string, doc_count bigint",
    "documents": "id string, project_id string, relative_path string, absolute_path string, text string",
    "types": f"id string, project_id string, namespace string, name string, full_name string, kind string, accessibility string, is_static boolean, is_abstract boolean, is_sealed boolean, is_generated boolean, xml_doc string, relative_path string, {_SPAN}, ord bigint",
    "members": f"id string, type_id string, name string, kind string, signature string, accessibility string, is_static boolean, is_abstract boolean, is_async boolean, return_type string, xml_doc string, attributes array<string>, parent_attributes array<string>, implicit boolean, accessor boolean, backing boolean, {_SPAN}, ord bigint",
    "uses": "owner_id string, owner_kind string, role string, target_id string, target_name string, target_assembly string, is_type_parameter boolean, ord bigint",
    "calls": "owner_id string, target_id string, target_name string, target_assembly string, is_creation boolean, is_abstract boolean, file string, line int, ord bigint",
    "refs": "target_id string, container_id string, container_type_id string, container_kind string, display string, file string, line int, ord bigint",
    "overrides": "method_id string, overridden_id string",
}


class Facts:
    """Frames by name; a missing table is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark = spark
        self.tables = {}
        for name, ddl in FACTS.items():
            empty = spark.createDataFrame([], ddl)
            df = tables.get(name, empty)
            self.tables[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def read(spark: SparkSession, path: str) -> Facts:
    """Facts in a folder on the driver's file system, as NAME.parquet or NAME.jsonl with the schemas above."""
    found = {}
    for name, ddl in FACTS.items():
        if os.path.exists(f"{path}/{name}.parquet"):
            found[name] = spark.read.parquet(f"{path}/{name}.parquet")
        elif os.path.exists(f"{path}/{name}.jsonl"):
            found[name] = spark.read.schema(ddl).json(f"{path}/{name}.jsonl")
    return Facts(spark, found)


def indexed_projects(facts: Facts, options: Options) -> DataFrame:
    return extraction.classified_projects(facts["projects"], list(options.exclude_projects), options.include_tests).where("fate = 'indexed'")


def assemblies_hash(facts: Facts, options: Options) -> DataFrame:
    """One row: a hash of all assemblies that count as own, on which every project's relations depend."""
    names = indexed_projects(facts, options).select(F.lower("assembly").alias("a")).where("a IS NOT NULL").distinct()
    return names.agg(F.sha2(F.encode(F.array_join(F.sort_array(F.collect_list("a")), "\n"), "UTF-8"), 256).alias("hash"))


def build(facts: Facts, entry: str, options: Options = Options(), only: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index tables from facts, by the options' policies; of the projects in ``only`` (id), where it is given, with no bodies, consumers and edges."""
    spark = facts.spark
    solution = f"solution:{entry}"
    classed = indexed_projects(facts, options)
    projects = classed.select("id", F.lit(solution).alias("solution_id"), "name", scalars.normal_path(F.col("path")).alias("path"), scalars.framework(F.col("project_xml")).alias("target_framework"), policies.test_project(F.col("name"), F.col("path")).alias("is_test"), "file_hash")
    own = classed.select(F.col("id").alias("_p"))
    if only is not None:
        own = own.join(only.select("id"), F.col("_p") == F.col("id"), "left_semi")
    documents = facts["documents"].join(own, F.col("project_id") == F.col("_p"), "left_semi")
    files = extraction.source_files(documents, options.include_generated)
    kept = files.select(F.col("id").alias("_file"))
    declared = facts["types"].join(own, F.col("project_id") == F.col("_p"), "left_semi").where(policies.visible(F.col("accessibility"), options.include_private))
    declared = declared.join(kept, declared["file_id"] == F.col("_file"), "left_semi").withColumn("summary", policies.xml_summary(F.col("xml_doc")))
    if not options.include_generated:
        declared = declared.where(~F.coalesce("is_generated", F.lit(False)))
    types = extraction.merged_types(declared).withColumn("namespace_id", scalars.namespace_id(F.col("project_id"), F.coalesce("namespace", F.lit(""))))
    types = cut(types)  # whatever is made from them below starts there
    namespaces = types.select("namespace_id", "project_id", F.coalesce("namespace", F.lit("")).alias("name")).distinct().withColumnRenamed("namespace_id", "id")
    members = extraction.visible_members(facts["members"], options.include_private, options.include_generated)
    members = members.join(types.select(F.col("id").alias("_t")), F.col("type_id") == F.col("_t"), "left_semi").withColumn("summary", policies.xml_summary(F.col("xml_doc"))).withColumn("is_generated", F.lit(False))

    # light dependencies and calls, in one list per owner
    assemblies = classed.select("assembly")
    uses = extraction.kept_dependencies(extraction.declared_dependencies(facts["uses"]), assemblies, options.include_external)
    none = F.lit(None)
    rows = uses.select("owner_id", "kind", "target_id", "target_name", none.cast("string").alias("file"), none.cast("int").alias("line"), F.lit(0).alias("part"), "ord")
    calls = extraction.capped_calls(facts["calls"], assemblies, options.max_calls, options.include_external)
    rows = rows.unionByName(calls.select("owner_id", "kind", "target_id", "target_name", "file", "line", F.lit(1).alias("part"), F.col("call_rank").cast("bigint").alias("ord")))
    listed = extraction.relations(rows, "dependencies", ("part", "ord")).withColumnRenamed("id", "_o")
    empty = F.array().cast(f"array<{REL}>")

    def related(df: DataFrame) -> DataFrame:
        joined = df.join(listed, df["id"] == F.col("_o"), "left").drop("_o")
        return joined.withColumn("dependencies", F.coalesce("dependencies", empty))

    types, members = related(types).withColumn("consumers", empty), cut(related(members).withColumn("consumers", empty))
    members = members.withColumn("token_estimate", scalars.tokens_of(F.col("signature"), F.col("summary"), F.col("return_type")))
    from ..operators.catalog import token_rollup

    types = types.join(token_rollup(types, members).select("id", F.col("token_estimate").cast("int").alias("token_estimate")), "id")
    made = {
        "solutions": spark.createDataFrame([(solution, os.path.splitext(os.path.basename(entry))[0], entry, None)], "id string, name string, path string, file_hash string"),
        "projects": projects, "source_files": files, "namespaces": namespaces, "types": conform(types, "types"), "members": conform(members, "members"),
    }
    return made if only is not None else _finished(facts, options, made)


def _finished(facts: Facts, options: Options, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with what is made from the whole index: consumers of the types in scope, edges and bodies."""
    types, consumed = made["types"], None
    for scope in options.scopes():
        some = extraction.consumers(facts["refs"], extraction.scope_targets(types, made["projects"], scope))
        consumed = some if consumed is None else consumed.unionByName(some).dropDuplicates(["id"])
    types = types.withColumn("consumers", F.array().cast(f"array<{REL}>"))
    if consumed is not None:
        found = consumed.select(F.col("id").alias("_c"), F.col("consumers").alias("_found"))
        types = types.join(found, F.col("id") == F.col("_c"), "left").withColumn("consumers", F.coalesce("_found", "consumers")).drop("_c", "_found")
    made["types"], made["members"] = cut(conform(types, "types")), cut(conform(made["members"], "members"))
    made["edges"] = relations.to_edges(made["types"].select("id", "dependencies", "consumers").unionByName(made["members"].select("id", "dependencies", "consumers")))
    if options.index_body:
        kept = made["source_files"].select(F.col("id").alias("_file"))
        documents = facts["documents"].where("length(text) > 0")
        content = F.col("text")
        if options.max_body_chars:
            documents, content = documents.where(f"length(encode(text, 'UTF-8')) <= {2 * options.max_body_chars}"), F.substring("text", 1, options.max_body_chars)
        bodies = documents.join(kept, documents["id"] == F.col("_file"), "left_semi")
        made["bodies"] = bodies.select(F.col("id").alias("file_id"), "relative_path", "absolute_path", content.alias("content"))
    return made


def rebuild(facts: Facts, entry: str, options: Options, old: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """An index that takes the rows of unchanged projects from ``old``, and the plan (id, action).

    Fingerprints come from the files' hashes alone; only projects that changed
    are extracted.  Members follow their project by their type.  Bodies and
    consumers are those of a full build: they depend on options that don't
    shape a project's rows, and consumers on all projects.
    """
    classed = indexed_projects(facts, options)
    own = classed.select(F.col("id").alias("_p"))
    files = extraction.source_files(facts["documents"].join(own, F.col("project_id") == F.col("_p"), "left_semi"), options.include_generated)
    flags = repr(sorted(options.shaping().items()))
    plan = cut(change.reuse_plan(change.fingerprints(old["projects"], old["source_files"], flags), change.fingerprints(classed, files, flags)))
    new = build(facts, entry, options, plan.where("action IN ('add', 'rebuild')"))
    made = dict(new)
    for t in ("source_files", "namespaces", "types"):
        made[t] = change.merged(conform(old[t], t), conform(new[t], t), plan)
    made["projects"] = change.merged(conform(old["projects"], "projects"), conform(new["projects"], "projects"), plan, "id")

    def with_project(tables: dict[str, DataFrame]) -> DataFrame:
        owner = tables["types"].select(F.col("id").alias("_o"), "project_id")
        df = conform(tables["members"], "members")
        return df.join(owner, df["type_id"] == F.col("_o")).drop("_o")

    members = conform(change.merged(with_project(old), with_project(new), plan), "members")
    made["members"] = members.withColumn("consumers", F.array().cast(f"array<{REL}>"))
    return _finished(facts, options, made), plan
