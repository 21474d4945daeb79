"""Raw facts about source code turned into index tables.

The facts are tables (projects, documents, types, members, references between
them) that some compiler front end wrote; here they are filtered by policy,
merged and capped.  ``ord`` is the order of declaration within a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import policies
from ..plans.lineage import tasks
from ..schema import LOC, REL

CALL_LIMIT = 30
CONSUMER_LIMIT = 100


def unique_projects(projects: DataFrame) -> DataFrame:
    """One row for each path, case ignored: the one with most documents, then the first by name."""
    best = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy(F.desc("doc_count"), "name"))
    return projects.withColumn("_k", best).where("_k = 1").drop("_k")


def classified_projects(projects: DataFrame, exclude: list[str] | None = None, include_tests: bool = False) -> DataFrame:
    """Unique projects with their ``fate``: excluded, test, duplicate (an id that came before) or indexed."""
    own = unique_projects(projects)
    test = F.lit(False) if include_tests else policies.test_project(F.col("name"), F.col("path"))
    fate = F.when(F.coalesce(policies.excluded(F.col("name"), exclude or []), F.lit(False)), "excluded").when(test, "test").otherwise("indexed")
    own = own.withColumn("fate", fate)
    again = F.row_number().over(Window.partitionBy("id", "fate").orderBy("path")) > 1
    return own.withColumn("fate", F.when((F.col("fate") == "indexed") & again, "duplicate").otherwise(F.col("fate")))


def skipped_count(classified: DataFrame) -> DataFrame:
    """Projects left out as tests or by exclusion, one count for both."""
    return classified.agg(F.count_if(F.col("fate").isin("excluded", "test")).alias("skipped_projects"))


def source_files(documents: DataFrame, include_generated: bool = False) -> DataFrame:
    """Documents (id, project_id, relative_path, absolute_path, text) that the path policy keeps, hashed and measured."""
    kept = documents.where(~policies.skipped_document(F.col("absolute_path"), include_generated))
    return kept.select(
        "id", "project_id", "relative_path", "absolute_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.coalesce(F.length("text"), F.lit(0)).alias("length_chars"), policies.generated_path(F.col("absolute_path")).alias("is_generated")
    )


def merged_types(declarations: DataFrame) -> DataFrame:
    """One row for each type of its declarations (id, project_id, ..., ord, file_id, lines, summary, is_generated).

    The first declaration gives the row its columns and the primary location;
    each further one adds a location unless one with the same file (case
    ignored) and first line came before.  The first summary that says anything
    stays, and a type is generated if any of its declarations is.
    """
    place = F.struct(F.col("ord"), F.col("file_id").alias("fileId"), F.col("relative_path").alias("relativePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("size_chars").alias("sizeChars"))
    once = F.row_number().over(Window.partitionBy("id", F.upper(F.coalesce("file_id", F.lit(""))), "start_line").orderBy("ord"))
    said = F.nullif(F.trim("summary"), F.lit(""))
    merged = declarations.withColumn("_once", once).groupBy("id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_once") == 1, place))).alias("_places"),
        F.min_by("summary", F.when(said.isNotNull(), F.col("ord"))).alias("_summary"),
        F.coalesce(F.bool_or("is_generated"), F.lit(False)).alias("_generated"),
        F.min("ord").alias("_ord"),
    )
    first = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    primary = declarations.withColumn("_k", first).where("_k = 1").drop("_k", "summary", "is_generated", "ord")
    locations = F.transform("_places", lambda p, i: p.dropFields("ord").withField("isPrimary", i == 0))
    joined = primary.join(merged, "id").withColumn("locations", locations.cast(f"array<{LOC}>"))
    return joined.withColumnsRenamed({"_summary": "summary", "_generated": "is_generated"}).drop("_places", "_ord")


def duplicate_types(types: DataFrame) -> DataFrame:
    """Type ids that several projects claim, which an index can't hold."""
    return types.groupBy("id").agg(F.countDistinct("project_id").alias("projects")).where("projects > 1")


def visible_members(members: DataFrame, include_private: bool = False, include_generated: bool = False) -> DataFrame:
    """Members (type_id, id, kind, name, accessibility, implicit, accessor, attributes, parent_attributes, backing, ord) that policy keeps.

    Implicit members, accessors and fields behind an event or property go; of
    repeats within a type the first stays.  A constructor is named ``.ctor``
    and returns nothing.
    """
    kept = members.where(~F.coalesce("accessor", F.lit(False)) & ~F.coalesce("implicit", F.lit(False)) & ~F.coalesce("backing", F.lit(False)))
    kept = kept.where(F.coalesce(policies.visible(F.col("accessibility"), include_private), F.lit(False)))
    if not include_generated:
        kept = kept.where(~policies.generated_symbol(F.col("attributes"), F.col("implicit"), F.col("parent_attributes")))
    once = F.row_number().over(Window.partitionBy("type_id", "id").orderBy("ord"))
    kept = kept.withColumn("_k", once).where("_k = 1").drop("_k")
    constructor = F.col("kind") == "constructor"
    return kept.withColumn("name", F.when(constructor, ".ctor").otherwise(F.col("name"))).withColumn("return_type", F.when(~constructor, F.col("return_type")))


def declared_dependencies(uses: DataFrame) -> DataFrame:
    """Uses (owner_id, owner_kind, role, target_id, ...) with the kind of relation that each role makes.

    A base type is inherited (but not the root of all), interfaces are
    implemented, attributes belong to the signature; so do a method's return
    type (not a constructor's), parameters and type arguments, a property's and
    an event's type; a field's type is used in a member.
    """
    role, owner = F.col("role"), F.col("owner_kind")
    kind = (
        F.when((role == "base") & (F.col("target_name") != "System.Object"), "inherits").when(role == "interface", "implements").when(role == "attribute", "usesInSignature")
        .when((role == "return") & (owner == "constructor"), None).when((role == "type") & (owner == "field"), "usesInMember")
        .when(role.isin("return", "parameter", "argument", "type"), "usesInSignature")
    )
    return uses.withColumn("kind", kind).where("kind IS NOT NULL")


def local(df: DataFrame, assemblies: DataFrame, include_external: bool = False, structural: Column | None = None) -> DataFrame:
    """Rows whose ``target_assembly`` is one of the solution's, case ignored; ``structural`` rows stay anyway."""
    if include_external:
        return df
    known = assemblies.select(F.upper("assembly").alias("_own")).distinct().withColumn("_local", F.lit(True))
    joined = df.join(known, F.upper(df["target_assembly"]) == F.col("_own"), "left")
    keep = F.coalesce("_local", F.lit(False))
    return joined.where(keep if structural is None else keep | structural).drop("_own", "_local")


def kept_dependencies(uses: DataFrame, assemblies: DataFrame, include_external: bool = False) -> DataFrame:
    """Dependencies without arrays, primitives and type parameters, one for each (owner, kind, target), the first of them."""
    named = uses.withColumn("target_name", F.regexp_replace("target_name", r"(\[,*\])+$", "")).withColumn("target_id", F.regexp_replace("target_id", r"(\[,*\])+$", ""))
    named = named.where(~F.col("target_name").isin(*policies.PRIMITIVES) & ~F.coalesce("is_type_parameter", F.lit(False)))
    some = local(named, assemblies, include_external, F.col("kind").isin("inherits", "implements"))
    once = F.row_number().over(Window.partitionBy("owner_id", "kind", "target_id").orderBy("ord"))
    return some.withColumn("_k", once).where("_k = 1").drop("_k")


def capped_calls(calls: DataFrame, assemblies: DataFrame, limit: int = CALL_LIMIT, include_external: bool = False) -> DataFrame:
    """Calls (owner_id, target_id, target_name, target_assembly, is_creation, is_abstract, ord) of a method, capped before repeats go.

    Invocations come before object creations, each in order of source.
    """
    some = local(calls.where(~F.coalesce("is_abstract", F.lit(False))), assemblies, include_external)
    order = Window.partitionBy("owner_id").orderBy(F.coalesce("is_creation", F.lit(False)), "ord")
    some = some.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= max(1, limit))
    once = F.row_number().over(Window.partitionBy("owner_id", "target_id").orderBy("_rank"))
    return some.withColumn("_k", once).where("_k = 1").withColumn("kind", F.lit("calls")).drop("_k").withColumnRenamed("_rank", "call_rank")


def relations(rows: DataFrame, name: str = "dependencies", order_by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """(id, relations) of rows (owner_id, kind, target_id, target_name, file, line) in their order."""
    rel = F.struct(F.col("kind"), F.col("target_id").alias("targetId"), F.col("target_name").alias("targetName"), F.col("file"), F.col("line"), F.lit(None).cast("string").alias("siteLabel")).cast(REL)
    listed = rows.groupBy("owner_id").agg(F.sort_array(F.collect_list(F.struct(*order_by, rel.alias("r")))).alias("_l"))
    return listed.select(F.col("owner_id").alias("id"), F.col("_l.r").alias(name))


def parse_scope(text: str) -> tuple[str, str | None]:
    """``full``, ``type:Name`` or ``project:Name`` as (kind, name); anything else is an error."""
    t = (text or "").strip()
    if t.lower() in ("full", "*"):
        return "full", None
    kind, colon, name = t.partition(":")
    known = {"type": "type", "class": "type", "project": "project", "proj": "project"}.get(kind.strip().lower())
    if not colon or known is None or not name.strip():
        raise ValueError(f"not a scope: {text!r} (full, type:NAME or project:NAME)")
    return known, name.strip()


def scope_targets(types: DataFrame, projects: DataFrame, scope: str) -> DataFrame:
    """Types that a scope stands for; names are compared without case, also by their last dotted part."""
    kind, name = parse_scope(scope)
    if kind == "full":
        return types
    q = F.upper(F.lit(name))
    if kind == "type":
        full, own = F.upper("full_name"), F.upper("id")
        return types.where((full == q) | (F.upper("name") == q) | (own == q) | (own == F.concat(F.lit("TYPE:"), q)) | F.endswith(full, F.concat(F.lit("."), q)))
    own = F.upper("id")
    hit = projects.where((F.upper("name") == q) | (own == q) | (own == F.concat(F.lit("PROJECT:"), q))).select(F.col("id").alias("_project"))
    return types.join(hit, types["project_id"] == F.col("_project"), "left_semi")


def consumers(refs: DataFrame, targets: DataFrame, limit: int = CONSUMER_LIMIT) -> DataFrame:
    """(id, consumers) of each target: the types around references to it, by name, without itself, up to a cap.

    References are spread by target once, over tasks as the input asks for;
    from there each task has the whole of its targets.
    """
    said, asked = refs.where("container_type_id IS NOT NULL AND container_type_id <> target_id").select("target_id", "container_type_id"), targets.select(F.col("id").alias("_t"))
    n = tasks(said, asked)
    own = said.repartition(n, "target_id").join(asked.repartition(n, "_t"), F.col("target_id") == F.col("_t"), "left_semi")
    one = own.distinct()
    name = F.regexp_replace("container_type_id", "^[a-z]+:", "")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.upper(name), "container_type_id"))
    some = one.withColumn("ord", rank).where(F.col("ord") <= limit)
    none = F.lit(None)
    rows = some.select(F.col("target_id").alias("owner_id"), F.lit("referencedBy").alias("kind"), F.col("container_type_id").alias("target_id"), name.alias("target_name"), none.cast("string").alias("file"), none.cast("int").alias("line"), "ord")
    return relations(rows, "consumers")
