"""The registered queries of the index operators, each with the SQL that says the same.

All of them run on the index over a star schema (``sources.star``), whole
tables at a time.  A query is (function, common tables of the SQL, the SQL);
the SQL stands behind a WITH of the tables that it names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import policies, scalars
from .operators import analytics, catalog, change, extraction, graph, relations, search, snippets
from .plans.lineage import tasks
from .sources.star import Star

Query = Callable[[SparkSession, str], DataFrame]

#: Names that queries ask for.
ROOT_ORDER, ROOT_PART, ROOT_REGION = "order:7", "part:7", "region:1"
ORDER = ("leg", "x", "y", "z", "file")

_FILE = "'src/' || source || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.g.cs' ELSE '.cs' END"
_KIND = "(['method','constructor','property','field','event'])[(o_orderkey % 5 + 1)::INT]"
_MEMBER = f"(CASE {_KIND} WHEN 'constructor' THEN 'method' ELSE {_KIND} END) || ':Op' || o_orderkey"
_TOK = "CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, (length({0}) + 3) // 4) END"


def _tok(*parts: str) -> str:
    return " + ".join(f"({_TOK.format(p)})" for p in parts)


TABLES = {
    "projects": "SELECT 'project:' || n_name AS id, n_name AS name, '/' || r_name || '/' || n_name || '.csproj' AS path, CASE WHEN n_nationkey % 4 <> 0 THEN r_name END AS target_framework, n_nationkey % 5 = 0 AS is_test, sha256('/' || r_name || '/' || n_name || '.csproj') AS file_hash, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey",
    "files": f"SELECT 'file:' || doc_id AS id, 'project:' || n_name AS project_id, {_FILE} AS relative_path, '/star/' || {_FILE} AS absolute_path, sha256(text) AS content_hash, n_chars::INT AS length_chars, doc_id % 9 = 0 AS is_generated, doc_id FROM documents JOIN nation ON doc_id % 25 = n_nationkey",
    "bodies": f"SELECT 'file:' || doc_id AS file_id, {_FILE} AS relative_path, text AS content FROM documents WHERE length(text) > 0",
    "types": "SELECT 'type:' || c_name AS id, p.id AS project_id, c_name AS name, p.name || '.' || c_mktsegment || '.' || c_name AS full_name, (['class','record','struct','interface','enum','delegate'])[(c_custkey % 6 + 1)::INT] AS kind, (['public','internal','private'])[(c_custkey % 3 + 1)::INT] AS accessibility, CASE WHEN c_custkey % 4 <> 0 THEN 'Customer in ' || c_mktsegment || '.' END AS summary, CASE WHEN c_custkey % 17 <> 0 THEN 'file:' || (c_custkey % 200) END AS file_id, CASE WHEN c_custkey % 11 <> 0 THEN 1 + c_custkey % 50 END AS start_line, CASE WHEN c_custkey % 11 <> 0 THEN 1 + c_custkey % 50 + c_custkey % 97 END AS end_line, floor(abs(c_acctbal))::INT AS size_chars, c_custkey FROM customer JOIN projects p ON c_nationkey = n_nationkey",
    "members": f"SELECT {_MEMBER} AS id, 'type:Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS type_id, 'Op' || o_orderkey AS name, {_KIND} AS kind, o_orderpriority || ' Op' || o_orderkey || '(' || o_orderstatus || ')' AS signature, (['public','internal','private','protected'])[(o_orderkey % 4 + 1)::INT] AS accessibility, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderpriority END AS return_type, CASE WHEN o_orderkey % 3 <> 0 THEN 'Order with status ' || o_orderstatus || '.' END AS summary, CASE WHEN o_orderkey % 17 <> 0 THEN 'file:' || (o_orderkey % 200) END AS file_id, CASE WHEN o_orderkey % 13 <> 0 THEN 1 + o_orderkey % 400 END AS start_line, CASE WHEN o_orderkey % 13 <> 0 THEN 1 + o_orderkey % 400 + o_orderkey % 61 END AS end_line, floor(o_totalprice / 100)::INT AS size_chars, o_orderkey FROM orders",
    "calls": "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS back FROM lineitem GROUP BY l_orderkey",
    "typed": "SELECT m.*, t.full_name AS type_full_name, t.name AS type_name FROM members m JOIN types t ON m.type_id = t.id",
    "edges": """SELECT 0 AS leg, l_orderkey AS x, l_partkey AS y, l_linenumber::BIGINT AS z, 'order:' || l_orderkey AS from_id, 'part:' || l_partkey AS to_id, 'calls' AS kind, l_returnflag AS file, l_linenumber AS line FROM lineitem
 UNION ALL SELECT DISTINCT 1, l_partkey, l_suppkey, 0, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'usesInSignature', NULL, NULL::INT FROM lineitem
 UNION ALL SELECT 2, s_suppkey, s_nationkey, 0, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'implements', NULL, NULL FROM supplier
 UNION ALL SELECT 3, n_nationkey, n_regionkey, 0, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'inherits', NULL, NULL FROM nation
 UNION ALL SELECT 4, c_custkey, c_nationkey, 0, 'customer:' || c_custkey, 'nation:' || c_nationkey, 'implements', NULL, NULL FROM customer
 UNION ALL SELECT 5, l_partkey, l_orderkey, l_linenumber, 'part:' || l_partkey, 'order:' || l_orderkey, 'referencedBy', l_returnflag, l_linenumber FROM lineitem WHERE l_returnflag = 'R'""",
    "outs": "SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY leg, x, y, z, file) AS k FROM edges",
    "ins": "SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY leg, x, y, z, file) AS k FROM edges",
    "refs": "SELECT 'part:' || l_partkey AS target_id, 'order:' || l_orderkey AS container_id, 'customer:' || o_custkey AS container_type_id, 'Op' || l_orderkey AS display, l_returnflag AS file, l_linenumber AS line, CASE WHEN l_orderkey % 5 = 0 THEN 'method' WHEN l_orderkey % 5 = 1 THEN 'constructor' ELSE 'property' END AS container_kind, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "manifest": "SELECT project_id, relative_path, CASE WHEN doc_id % 7 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM files WHERE doc_id % 11 <> 0",
    "old_manifest": "SELECT project_id, relative_path, content_hash FROM files WHERE doc_id % 13 <> 0",
    "raw_projects": "SELECT 'project:' || (s_suppkey % 40) AS id, 'Unit' || (s_suppkey % 40) || CASE WHEN s_suppkey % 40 % 6 = 0 THEN '.Tests' WHEN s_suppkey % 40 % 7 = 0 THEN '.Benchmarks' ELSE '' END AS name, '/src/' || (s_suppkey % 40) || '.csproj' AS path, s_suppkey AS doc_count FROM supplier",
    "raw_types": "SELECT 'type:' || p_brand || '.' || p_type AS id, 'project:' || p_brand AS project_id, p_partkey AS ord, 'file:' || (p_partkey % 7) AS file_id, (p_size)::INT AS start_line, (p_size + 10)::INT AS end_line, (p_partkey % 500)::INT AS size_chars, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS summary, p_partkey % 50 = 0 AS is_generated FROM part",
    "raw_calls": "SELECT 'order:' || l_orderkey AS owner_id, 'part:' || l_partkey AS target_id, 'asm' || (l_suppkey % 10) AS target_assembly, l_returnflag = 'R' AS is_creation, l_linenumber::BIGINT * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM lineitem",
    "raw_members": f"SELECT 'type:' || o_custkey AS type_id, o_orderstatus || '.' || (o_orderkey % 977) AS id, {_KIND} AS kind, 'Op' || o_orderkey AS name, (['public','internal','private','protected internal'])[(o_orderkey % 4 + 1)::INT] AS accessibility, o_orderkey % 19 = 0 AS implicit, o_orderkey % 23 = 0 AS accessor, o_orderkey % 29 = 0 AS backing, CASE WHEN o_orderkey % 31 = 0 THEN ['System.CodeDom.GeneratedCodeAttribute'] ELSE [] END AS attributes, o_orderkey AS ord FROM orders",
}
_NEEDS = {"types": ("projects",), "typed": ("members", "types"), "outs": ("edges",), "ins": ("edges",), "manifest": ("files",), "old_manifest": ("files",)}


def _with(names: str, body: str, more: str = "") -> str:
    found: list[str] = []

    def need(n: str) -> None:
        for x in _NEEDS.get(n, ()):
            need(x)
        if n not in found:
            found.append(n)

    for n in names.split():
        need(n)
    ctes = [f"{n} AS ({TABLES[n]})" for n in found] + ([more] if more else [])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


_REGISTERED: dict[str, tuple[Query, str | None]] = {}


def _query(sql: str | None = None, tables: str = "", more: str = "") -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _REGISTERED[f.__name__] = (f, sql and _with(tables, sql, more))
        return f

    return register


# hotspots and quality

_KNOWN = "coalesce(end_line >= start_line, false)"


@_query(f"SELECT id, type_full_name, name, kind, score, label FROM (SELECT *, (CASE WHEN {_KNOWN} THEN end_line - start_line + 1 ELSE size_chars END)::BIGINT AS score, CASE WHEN {_KNOWN} THEN (end_line - start_line + 1) || ' lines' ELSE size_chars || ' chars' END AS label FROM typed WHERE kind IN ('method', 'constructor')) ORDER BY score DESC, size_chars DESC, id LIMIT 25", "typed")
def hotspots_size(spark, sf_dir):
    s = Star(spark, sf_dir)
    return analytics.by_size(s.orders, s.types, 25)


@_query("SELECT t.id, type_full_name, name, kind, n::BIGINT AS score FROM typed t JOIN calls ON o_orderkey = l_orderkey WHERE kind IN ('method', 'constructor') ORDER BY score DESC, id LIMIT 25", "typed calls")
def hotspots_calls(spark, sf_dir):
    s = Star(spark, sf_dir)
    return analytics.by_calls(s.members, s.types, 25)


@_query("SELECT t.id, type_full_name, name, kind, back::BIGINT AS score FROM typed t JOIN calls ON o_orderkey = l_orderkey WHERE back > 0 ORDER BY score DESC, id LIMIT 25", "typed calls")
def hotspots_fanin(spark, sf_dir):
    s = Star(spark, sf_dir)
    return analytics.by_fan_in(s.members, s.types, 25)


@_query("SELECT id, full_name, kind, coalesce(n, 0) AS score FROM types LEFT JOIN (SELECT type_id, count(*) AS n FROM members GROUP BY 1) ON id = type_id ORDER BY score DESC, size_chars DESC, id LIMIT 25", "types members")
def hotspots_types(spark, sf_dir):
    s = Star(spark, sf_dir)
    return analytics.by_members(s.types, s.orders, 25)


_QUALITY = f"""
t AS (SELECT count(*) AS type_count, count(*) FILTER (length(trim(summary)) > 0) AS types_said FROM types),
m AS (SELECT count(*) AS member_count, count(*) FILTER (kind IN ('method', 'constructor')) AS method_count, count(*) FILTER (length(trim(summary)) > 0) AS members_said,
 count(*) FILTER (kind IN ('method', 'constructor') AND l_orderkey IS NOT NULL) AS methods_calling,
 count(*) FILTER (kind IN ('method', 'constructor') AND (start_line IS NULL OR file_id IS NULL)) AS missing,
 coalesce(avg(end_line - start_line + 1) FILTER (kind IN ('method', 'constructor') AND {_KNOWN}), 0.0) AS lines FROM members LEFT JOIN calls ON o_orderkey = l_orderkey),
p AS (SELECT *, CASE WHEN type_count > 0 THEN 100.0::DOUBLE * types_said / type_count ELSE 0 END AS sp, CASE WHEN member_count > 0 THEN 100.0::DOUBLE * members_said / member_count ELSE 0 END AS mp, CASE WHEN method_count > 0 THEN 100.0::DOUBLE * methods_calling / method_count ELSE 0 END AS cp FROM t, m),
g AS (SELECT *, CASE WHEN sp >= 40 THEN 2 WHEN sp >= 15 THEN 1 ELSE 0 END + CASE WHEN cp >= 30 THEN 2 WHEN cp >= 10 THEN 1 ELSE 0 END + CASE WHEN missing = 0 THEN 2 WHEN missing < type_count THEN 1 ELSE 0 END AS points FROM p)"""


@_query("SELECT type_count, member_count, method_count, 0::BIGINT AS types_consumed, missing AS methods_missing_location, round_even(sp, 1) AS type_summary_pct, round_even(mp, 1) AS member_summary_pct, round_even(cp, 1) AS calls_pct, round_even(lines, 1) AS avg_method_lines, CASE WHEN type_count = 0 THEN 'empty' WHEN points >= 5 THEN 'A' WHEN points >= 4 THEN 'B' WHEN points >= 2 THEN 'C' ELSE 'D' END AS grade, array_to_string(list_filter([CASE WHEN type_count > 0 AND sp < 15 THEN 'few types have a summary' END, CASE WHEN method_count > 0 AND cp < 10 THEN 'few methods have calls' END, CASE WHEN missing > 0 THEN 'some methods have no location' END, 'no consumers are indexed'], lambda x: x IS NOT NULL), '; ') AS notes FROM g", "types members calls", _QUALITY)
def index_quality(spark, sf_dir):
    s = Star(spark, sf_dir)
    return analytics.quality(s.types, s.members)


# listings and names


@_query("SELECT (SELECT count(*) FROM nation) AS project_count, (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM types) AS type_count, (SELECT count(*) FROM members) AS member_count, (SELECT count(*) FROM edges) AS edge_count", "files types members edges")
def index_status(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.status(s.projects, s.source_files, s.types, s.orders, s.edges)


@_query("SELECT p.id, p.name, path, target_framework, is_test, (SELECT count(*) FROM types t WHERE t.project_id = p.id) AS type_count, (SELECT count(*) FROM files f WHERE f.project_id = p.id) AS file_count FROM projects p", "types files")
def list_projects(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.list_projects(s.projects, s.types, s.source_files)


@_query("SELECT id, full_name, name, kind, accessibility, summary, coalesce(n, 0) AS member_count FROM (SELECT * FROM types ORDER BY full_name, id LIMIT 500) LEFT JOIN (SELECT type_id, count(*) AS n FROM members GROUP BY 1) ON id = type_id", "types members")
def list_types(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.list_types(s.types, s.orders)


@_query("SELECT m.id, m.name, m.kind, type_full_name, relative_path FROM typed m LEFT JOIN files f ON m.file_id = f.id WHERE type_id = 'type:Customer#000000007' ORDER BY kind, name, m.id LIMIT 200", "typed files")
def list_members(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.list_members(s.orders, s.types, s.source_files, type_id="type:Customer#000000007").select("id", "name", "kind", "type_full_name", "relative_path")


@_query("SELECT t.id, full_name, CASE WHEN full_name = 'Customer#000000010' THEN 0 WHEN t.id IN ('Customer#000000010', 'type:Customer#000000010') THEN 1 ELSE 2 END AS match_rank, relative_path, (CASE WHEN end_line >= start_line THEN end_line - start_line + 1 ELSE 0 END)::BIGINT AS line_count FROM types t LEFT JOIN files f ON t.file_id = f.id WHERE 'Customer#000000010' IN (full_name, t.id, name) OR t.id = 'type:Customer#000000010' ORDER BY match_rank, full_name, t.id LIMIT 1", "types files")
def resolve_type(spark, sf_dir):
    s = Star(spark, sf_dir)
    found = catalog.resolve_type(s.types, s.source_files, "Customer#000000010")
    return found.select("id", "full_name", "match_rank", "relative_path", F.coalesce(scalars.line_count(F.col("start_line"), F.col("end_line")), F.lit(0)).cast("bigint").alias("line_count"))


def _resolved(spark, sf_dir, name, strict=False):
    s = Star(spark, sf_dir)
    return catalog.resolve_member(s.orders, s.types, s.source_files, name, strict).select("id", "signature", "type_full_name", "match_rank", "relative_path")


_LIKE = "SELECT m.id, signature, type_full_name, {rank} AS match_rank, relative_path FROM typed m LEFT JOIN files f ON m.file_id = f.id WHERE {hit} ORDER BY {rank}, type_full_name, name, m.id LIMIT 1"


@_query(_LIKE.format(rank="CASE WHEN m.id IN ('Op10', 'method:Op10') THEN 0 WHEN signature = 'Op10' THEN 1 WHEN name = 'Op10' THEN 3 ELSE 4 END", hit="m.id = 'method:Op10' OR name = 'Op10' OR signature ILIKE '%Op10%'"), "typed files")
def resolve_member(spark, sf_dir):
    return _resolved(spark, sf_dir, "Op10")


@_query(_LIKE.format(rank="4", hit="signature ILIKE '%urgent%'"), "typed files")
def resolve_member_like(spark, sf_dir):
    return _resolved(spark, sf_dir, "urgent")


_ROLLUP = f"y AS (SELECT type_id, sum({_tok('signature', 'summary', 'return_type')}) AS n FROM members GROUP BY 1), x AS (SELECT id, full_name, (({_tok('full_name', 'summary', 'kind')}) + coalesce(n, 0) + 3 + (length(split_part(full_name, '.', 1)) + 3) // 4)::BIGINT AS token_estimate FROM types LEFT JOIN y ON id = type_id)"


@_query("SELECT id, full_name, token_estimate FROM x", "types members", _ROLLUP)
def token_estimate_type(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.token_rollup(s.types, s.orders).join(s.types.select("id", "full_name"), "id").select("id", "full_name", "token_estimate")


@_query(f"SELECT id, ({_tok('signature', 'summary', 'return_type')})::INT AS tokens FROM members", "members")
def token_estimate_member(spark, sf_dir):
    return Star(spark, sf_dir).token_members.select("id", "tokens")


@_query(f"SELECT 'solution:/star.sln' AS id, (1 + 3 + (SELECT sum({_tok('name')}) FROM projects) + (SELECT sum(token_estimate) FROM x))::BIGINT AS token_estimate", "types members", _ROLLUP)
def token_estimate_overview(spark, sf_dir):
    s = Star(spark, sf_dir)
    return catalog.overview_tokens(s.solutions, s.projects, catalog.token_rollup(s.types, s.orders))


# scalars and policies


@_query("SELECT id, content_hash, length_chars FROM files", "files")
def content_hash(spark, sf_dir):
    return Star(spark, sf_dir).source_files.select("id", "content_hash", "length_chars")


@_query("SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag || ':L' || l_linenumber AS site, 'part:' || l_partkey AS relation, l_partkey::VARCHAR AS short, 'member' AS kind FROM lineitem")
def short_names(spark, sf_dir):
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    file = F.concat(F.lit("src/x/"), F.col("l_returnflag"))
    return i.select("l_orderkey", "l_partkey", "l_linenumber", scalars.site_label(F.lit(None).cast("string"), file, F.col("l_linenumber")).alias("site"), scalars.relation_name(part, F.lit("")).alias("relation"), scalars.short_id(part).alias("short"), scalars.kind_of_id(part).alias("kind"))


@_query("SELECT id, accessibility IN ('public', 'internal') AS visible, accessibility <> '' AS private_too FROM members", "members")
def policy_visibility(spark, sf_dir):
    m = Star(spark, sf_dir).orders
    return m.select("id", policies.visible(F.col("accessibility")).alias("visible"), policies.visible(F.col("accessibility"), True).alias("private_too"))


@_query(r"SELECT id, regexp_matches(lower(absolute_path), '/(bin|obj|migrations)/') AS skipped, is_generated AS generated FROM files", "files")
def policy_paths(spark, sf_dir):
    f = Star(spark, sf_dir).source_files
    return f.select("id", policies.skipped_path(F.col("absolute_path")).alias("skipped"), policies.generated_path(F.col("absolute_path")).alias("generated"))


@_query("SELECT id, contains(lower(name), 'ion_1') OR regexp_matches(name, '^.*7$') OR regexp_matches(name, '^N.*_2.*$') AS excluded FROM projects", "projects")
def exclude_glob(spark, sf_dir):
    return Star(spark, sf_dir).projects.select("id", policies.excluded(F.col("name"), ["ion_1", "*7", "n*_2*"]).alias("excluded"))


@_query("SELECT c_custkey, 'About ' || c_name || ' here' AS summary FROM customer")
def xml_summary(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    doc = F.concat(F.lit("<doc><summary>\n  About <see>"), "c_name", F.lit("</see>\n\there </summary><summary>no</summary></doc>"))
    return c.select("c_custkey", policies.xml_summary(doc).alias("summary"))


# relations and edges


@_query("SELECT from_id, to_id, kind, file, line, count(*) AS n FROM (SELECT m.id AS from_id, 'method:Part' || l_partkey AS to_id, 'calls' AS kind, l_returnflag AS file, l_linenumber AS line FROM lineitem l JOIN members m ON l.l_orderkey = m.o_orderkey UNION ALL SELECT 'method:Part' || l_partkey, m.id, 'referencedBy', l_returnflag, l_linenumber FROM lineitem l JOIN members m ON l.l_orderkey = m.o_orderkey WHERE l_returnflag = 'R') GROUP BY ALL", "members")
def edges_materialize(spark, sf_dir):
    made = relations.to_edges(Star(spark, sf_dir).members.select("id", "dependencies", "consumers"))
    return made.repartition(tasks(made), "from_id", "to_id").groupBy("from_id", "to_id", "kind", "file", "line").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT 'event:' || event_id AS from_id, 'user:' || user_id AS to_id, 'calls' AS kind FROM events WHERE event_id % 3 <> 0")
def edges_from_json(spark, sf_dir):
    """A third of the lists are broken or foreign and give nothing."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    good = F.concat(F.lit('[{"kind":"calls","targetId":"user:'), F.col("user_id").cast("string"), F.lit('","targetName":"u"}]'))
    json = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("[{"), "props"))).otherwise(good)
    owners = e.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("id"), relations.parse(json).alias("dependencies"), relations.parse(F.lit(None).cast("string")).alias("consumers"))
    return relations.to_edges(owners).select("from_id", "to_id", "kind")


@_query("SELECT m.id, list_transform(list_sort(d)[:5], lambda s: s[16:]) AS calls_names, len(d) AS calls_total, len(d) > 5 AS calls_truncated, len(c) AS consumers_total FROM members m JOIN l ON l_orderkey = o_orderkey", "members", "l AS (SELECT l_orderkey, array_agg(lpad(l_linenumber::VARCHAR, 4, '0') || lpad(l_partkey::VARCHAR, 10, '0') || ' Part' || l_partkey) AS d, coalesce(array_agg(l_partkey) FILTER (l_returnflag = 'R'), []) AS c FROM lineitem GROUP BY 1)")
def relation_slice(spark, sf_dir):
    m = relations.relation_slice(Star(spark, sf_dir).members, limit=5).where("calls_total > 0")
    return m.select("id", "calls_names", F.col("calls_total").cast("bigint").alias("calls_total"), "calls_truncated", F.col("consumers_total").cast("bigint").alias("consumers_total"))


@_query("SELECT kind, from_id LIKE 'user:%' AS fresh, count(*) AS n, count(DISTINCT from_id) AS owners FROM (SELECT kind, from_id FROM edges WHERE NOT (kind = 'referencedBy' AND to_id IN (SELECT 'order:' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)) UNION ALL SELECT 'referencedBy', 'user:' || o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY ALL", "edges")
def save_consumers(spark, sf_dir):
    s = Star(spark, sf_dir)
    o = s.table("orders")
    owners = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), relations.parse(F.lit(None).cast("string")).alias("consumers"))
    json = F.concat(F.lit('[{"kind":"referencedBy","targetId":"user:'), F.col("o_custkey").cast("string"), F.lit('"}]'))
    new = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), relations.parse(json).alias("consumers"))
    _, edges = relations.save_consumers(owners, s.numbered_edges().select("edge_seq", "from_id", "to_id", "kind", "file", "line"), new)
    return edges.groupBy("kind", F.col("from_id").startswith("user:").alias("fresh")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("from_id").alias("owners"))


# graphs


@_query(f"SELECT from_id, to_id, kind, file, line FROM outs WHERE from_id = '{ROOT_ORDER}' ORDER BY k LIMIT 100", "outs")
def edges_out(spark, sf_dir):
    return graph.edges_of(Star(spark, sf_dir).edges, ROOT_ORDER, True, 100, ORDER)


@_query(f"SELECT from_id, to_id, kind, file, line FROM ins WHERE to_id = '{ROOT_PART}' ORDER BY k LIMIT 20", "ins")
def edges_in(spark, sf_dir):
    return graph.edges_of(Star(spark, sf_dir).edges, ROOT_PART, False, 20, ORDER)


def _hops_sql(root: str, depth: int, outbound: bool, limit: int) -> str:
    table, own, other = ("outs", "from_id", "to_id") if outbound else ("ins", "to_id", "from_id")
    parts = [f"l0 AS (SELECT '{root}' AS node, NULL AS via, NULL AS kind, 0 AS depth, NULL AS file, NULL::INT AS line, 1::BIGINT AS r)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(d))
        parts.append(f"c{d} AS (SELECT e.{other} AS node, l.node AS via, e.kind, {d} AS depth, e.file, e.line, l.r AS pr, e.k, row_number() OVER (PARTITION BY e.{other} ORDER BY l.r, e.k) AS again FROM l{d - 1} l JOIN {table} e ON e.{own} = l.node WHERE e.k <= {limit} AND e.{other} NOT IN ({seen}))")
        parts.append(f"l{d} AS (SELECT node, via, kind, depth, file, line, row_number() OVER (ORDER BY pr, k) AS r FROM c{d} WHERE again = 1 QUALIFY r <= {limit} - (SELECT count(*) - 1 FROM ({seen})))")
    return _with(table, " UNION ALL ".join(f"SELECT node, via, kind, depth, file, line FROM l{d}" for d in range(1, depth + 1)), ",\n".join(parts))


def _impact_sql(root: str, depth: int, cap: int, what: str) -> str:
    kinds = ", ".join(f"'{k}'" for k in graph.OUTBOUND_KINDS)
    parts = [f"l0 AS (SELECT '{root}' AS node, 0 AS depth, 1::BIGINT AS r)"]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(d))
        parts.append(f"""e{d} AS (SELECT e.to_id AS other, e.from_id, e.to_id, e.kind, e.file, e.line, l.r AS pr, 0 AS dir, e.k FROM l{d - 1} l JOIN outs e ON e.from_id = l.node WHERE e.k <= {cap} AND e.kind IN ({kinds})
 UNION ALL SELECT e.from_id, e.from_id, e.to_id, e.kind, e.file, e.line, l.r, 1, e.k FROM l{d - 1} l JOIN ins e ON e.to_id = l.node WHERE e.k <= {cap})""")
        parts.append(f"c{d} AS (SELECT *, row_number() OVER (PARTITION BY other ORDER BY pr, dir, k) AS again FROM e{d} WHERE other NOT IN ({seen}))")
        parts.append(f"l{d} AS (SELECT other AS node, {d} AS depth, row_number() OVER (ORDER BY pr, dir, k) AS r FROM c{d} WHERE again = 1 QUALIFY r <= {cap} - (SELECT count(*) FROM ({seen})))")
    known = " UNION ALL ".join(f"SELECT node, depth FROM l{d}" for d in range(depth + 1))
    parts.append(f"known AS ({known})")
    body = "SELECT node AS id, split_part(node, ':', 2) AS name, 'member' AS kind, depth FROM known"
    if what == "edges":
        seen = " UNION ALL ".join(f"SELECT * FROM e{d}" for d in range(1, depth + 1))
        body = f"SELECT DISTINCT from_id, to_id, kind, file, line FROM ({seen}) WHERE other IN (SELECT node FROM known)"
    return _with("outs ins", body, ",\n".join(parts))


def _add(name: str, f: Query, sql: str | None) -> None:
    _REGISTERED[name] = (f, sql)


def _hops(root: str, depth: int, outbound: bool, limit: int) -> Query:
    return lambda spark, sf_dir: graph.hops(Star(spark, sf_dir).edges, root, depth, outbound, limit, ORDER)


def _impact(depth: int, cap: int, what: str) -> Query:
    def run(spark, sf_dir):
        g = graph.impact(Star(spark, sf_dir).edges, ROOT_PART, depth, cap, order_by=ORDER)
        return g.node_frame(spark) if what == "nodes" else g.edge_frame(spark)

    return run


_add("graph_hops_out", _hops(ROOT_ORDER, 2, True, 80), _hops_sql(ROOT_ORDER, 2, True, 80))
_add("graph_hops_out_deep", _hops(ROOT_ORDER, 4, True, 40), _hops_sql(ROOT_ORDER, 4, True, 40))
_add("graph_hops_in", _hops(ROOT_PART, 2, False, 80), _hops_sql(ROOT_PART, 2, False, 80))
_add("impact_graph_nodes", _impact(2, 40, "nodes"), _impact_sql(ROOT_PART, 2, 40, "nodes"))
_add("impact_graph_edges", _impact(2, 40, "edges"), _impact_sql(ROOT_PART, 2, 40, "edges"))


@_query("SELECT node, depth FROM r WHERE depth > 0", "edges", f"RECURSIVE_MARK r AS (SELECT '{ROOT_REGION}' AS node, 0 AS depth UNION SELECT e.from_id, depth + 1 FROM r JOIN (SELECT DISTINCT from_id, to_id FROM edges WHERE kind IN ('implements', 'inherits')) e ON e.to_id = r.node)")
def implementations_closure(spark, sf_dir):
    return graph.closure(Star(spark, sf_dir).edges, ROOT_REGION, ("implements", "inherits"))


_REGISTERED["implementations_closure"] = (implementations_closure, _REGISTERED["implementations_closure"][1].replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_MARK ", ""))


def _refs(s: Star, whole: bool = False) -> DataFrame:
    """``whole``: for queries that take more than the references to one part."""
    i, o = s.table("lineitem"), s.table("orders").select("o_orderkey", "o_custkey")
    if whole:
        n = tasks(i, o)
        i, o = i.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    j, key = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_orderkey")
    kind = F.when(key % 5 == 0, "method").when(key % 5 == 1, "constructor").otherwise("property")
    return j.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.concat(F.lit("order:"), key.cast("string")).alias("container_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("container_type_id"), F.concat(F.lit("Op"), key.cast("string")).alias("display"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"), kind.alias("container_kind"), "l_orderkey", "l_linenumber")


_SITES = "SELECT container_id, display, file, line FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY container_id, upper(file), line ORDER BY l_orderkey) AS k FROM refs WHERE target_id = '{0}' {1}) WHERE k = 1 ORDER BY l_orderkey, l_linenumber, file LIMIT 50)"
_SITE_ORDER = ("l_orderkey", "l_linenumber", "file")


@_query(_SITES.format(ROOT_PART, ""), "refs")
def reference_sites(spark, sf_dir):
    return graph.reference_sites(_refs(Star(spark, sf_dir)), ROOT_PART, 50, order_by=_SITE_ORDER)


@_query(_SITES.format(ROOT_PART, "AND container_kind IN ('method', 'constructor')"), "refs")
def method_callers(spark, sf_dir):
    return graph.callers(_refs(Star(spark, sf_dir)), ROOT_PART, 50, _SITE_ORDER)


@_query(f"SELECT count(DISTINCT container_id) AS unique_callers FROM ({_SITES.format(ROOT_PART, '')})", "refs")
def unique_callers(spark, sf_dir):
    return graph.unique_callers(graph.reference_sites(_refs(Star(spark, sf_dir)), ROOT_PART, 50, order_by=_SITE_ORDER))


@_query(f"SELECT DISTINCT container_type_id AS id FROM refs WHERE target_id = '{ROOT_PART}' ORDER BY 1 LIMIT 100", "refs")
def type_consumers(spark, sf_dir):
    return graph.consumer_types(_refs(Star(spark, sf_dir)), ROOT_PART)


@_query("SELECT o_orderkey AS node, 1 AS depth FROM orders WHERE o_custkey = 7 AND o_orderkey > (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7) ORDER BY node LIMIT 50")
def overrides(spark, sf_dir):
    """The first order of each customer is what its others override."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"))
    facts = o.join(first, "o_custkey").where("o_orderkey > first").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("method_id"), F.lpad(F.col("first").cast("string"), 12, "0").alias("overridden_id"))
    root = first.where("o_custkey = 7").first()["first"]
    return graph.overrides(facts, f"{root:012d}").select(F.col("node").cast("bigint").alias("node"), "depth")


# search

_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"


def _fts_sql(rows: str, key: str, fields: list[str], terms: list[str], name: str, category: str, limit: int) -> str:
    """Terms of one token each."""
    each = ", ".join(_TOKENS.format(f) for f in fields)
    hits = " UNION ALL ".join(f"SELECT {k} AS term, id, dl, len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS tf FROM d" for k, t in enumerate(terms))
    return f"""d AS (SELECT {key} AS id, {name} AS name, flatten([{each}]) AS w, len(w) AS dl FROM {rows}),
h AS (SELECT * FROM ({hits}) WHERE tf > 0), n AS (SELECT term, count(*) AS n FROM h GROUP BY 1), s AS (SELECT count(*) AS total, avg(dl) AS mean FROM d),
b AS (SELECT h.id, -sum(greatest(ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * h.dl / mean))) AS score FROM h JOIN n USING (term), s GROUP BY h.id HAVING count(*) = {len(terms)}),
{category} AS (SELECT '{category}' AS category, b.id, d.name, round(score, 6) AS score FROM b JOIN d USING (id) ORDER BY b.score, b.id LIMIT {limit})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@dataclass(frozen=True)
class _Parts:
    """So much of an index as a search needs."""

    types: DataFrame
    members: DataFrame
    source_files: DataFrame | None = None


def _plain(s: Star) -> search.Postings:
    return search.Postings.of(search.documents(s.types, s.orders, s.types)["member"][0], "id", "member", stemmed=False)


@_query("SELECT * FROM type", "types", _fts_sql("types", "id", ["full_name", "name", "summary"], ["machinery", "0000000"], "full_name", "type", 20))
def search_types(spark, sf_dir):
    t = Star(spark, sf_dir).types
    return _rounded(search.search_types(t, "Machinery 0000000", 20, search.Postings.of(t, "id", "type", stemmed=False)))


@_query("SELECT * FROM member", "typed", _fts_sql("typed", "id", ["type_full_name", "name", "signature", "summary"], ["op12", "urgent"], "name", "member", 20))
def search_members(spark, sf_dir):
    s = Star(spark, sf_dir)
    return _rounded(search.search_members(s.orders, s.types, "op12 URGENT", 20, _plain(s)))


@_query("SELECT 'type' AS category, id, full_name AS name, NULL::DOUBLE AS score FROM types WHERE full_name ILIKE '%omer#00000001%' OR name ILIKE '%omer#00000001%' OR summary ILIKE '%omer#00000001%' ORDER BY full_name, id LIMIT 20", "types")
def search_like_types(spark, sf_dir):
    """No token begins like this, so the search falls back to LIKE."""
    t = Star(spark, sf_dir).types
    return search.search_types(t, "omer#00000001", 20, search.Postings.of(t, "id", "type", stemmed=False))


@_query("SELECT 'member' AS category, id, name, NULL::DOUBLE AS score FROM typed WHERE name ILIKE '%p123%' OR signature ILIKE '%p123%' OR summary ILIKE '%p123%' ORDER BY type_full_name, name, id LIMIT 20", "typed")
def search_like_members(spark, sf_dir):
    s = Star(spark, sf_dir)
    return search.search_members(s.orders, s.types, "p123", 20, _plain(s))


@_query("SELECT category, body.id, split_part(relative_path, '/', -1) AS name, score, no AS line, trim(text) AS text FROM body JOIN l ON l.file_id = body.id JOIN bodies b ON b.file_id = body.id", "bodies", _fts_sql("bodies", "file_id", ["content"], ["licensed"], "relative_path", "body", 20) + r""",
l AS (SELECT file_id, no, text FROM (SELECT file_id, no, CASE WHEN length(trim(line)) > 161 THEN substr(trim(line), 1, 160) || '…' ELSE trim(line) END AS text, row_number() OVER (PARTITION BY file_id ORDER BY no) AS k FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS no FROM bodies) WHERE contains(lower(line), 'licensed')) WHERE k = 1)""")
def search_bodies(spark, sf_dir):
    b = Star(spark, sf_dir).bodies
    return _rounded(search.search_bodies(b, "licensed", 20, search.Postings.of(b, "file_id", "body", stemmed=False)))


#: Porter's stems of all words of types and members that aren't their own, by hand.
_STEMS = {
    "customer": "custom", "building": "build", "automobile": "automobil", "machinery": "machineri", "furniture": "furnitur", "status": "statu", "specified": "specifi", "ordered": "order", "urgently": "urgent", "nation": "nation", "region": "region",
}
_STEM_ROWS = ", ".join(f"('{w}', '{x}')" for w, x in _STEMS.items())


def _stemmed_sql(rows: str, fields: list[str], terms: list[str], name: str, category: str, limit: int) -> str:
    """The same search over stems; words that the list lacks are their own."""
    each = ", ".join(_TOKENS.format(f"strip_accents(coalesce({f}, ''))") for f in fields)
    hits = " UNION ALL ".join(f"SELECT {k} AS term, id, any_value(dl) AS dl, count(*) AS tf FROM {category}_w WHERE starts_with(w, '{t}') GROUP BY id" for k, t in enumerate(terms))
    c = category
    return f"""{c}_d AS (SELECT id, {name} AS name, flatten([{each}]) AS w, len(w) AS dl FROM {rows}),
{c}_w AS (SELECT id, dl, coalesce(x, w) AS w FROM (SELECT id, dl, unnest(w) AS w FROM {c}_d) LEFT JOIN (VALUES {_STEM_ROWS}) v(own, x) ON own = w),
{c}_h AS ({hits}), {c}_n AS (SELECT term, count(*) AS n FROM {c}_h GROUP BY 1), {c}_s AS (SELECT count(*) AS total, avg(dl) AS mean FROM {c}_d),
{c}_b AS (SELECT h.id, -sum(greatest(ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * h.dl / mean))) AS score FROM {c}_h h JOIN {c}_n USING (term), {c}_s GROUP BY h.id HAVING count(*) = {len(terms)}),
{c} AS (SELECT '{c}' AS category, b.id, d.name, round(score, 6) AS score FROM {c}_b b JOIN {c}_d d USING (id) ORDER BY b.score, b.id LIMIT {limit})"""


_MEMBER_FIELDS, _TYPE_FIELDS = ["type_full_name", "name", "signature", "summary"], ["full_name", "name", "summary"]


@_query("SELECT * FROM member", "typed", _stemmed_sql("typed", _MEMBER_FIELDS, ["order", "urgent"], "name", "member", 20))
def search_stemmed(spark, sf_dir):
    """Porter stems on both sides, as is the default."""
    s = Star(spark, sf_dir)
    return _rounded(search.search_members(s.orders, s.types, "ordered urgently", 20))


@_query("SELECT category, a.id, a.name, score, m.kind, type_full_name AS parent_type, signature, summary, start_line, relative_path FROM (SELECT * FROM member ORDER BY score, id LIMIT 18) a JOIN typed m ON m.id = a.id LEFT JOIN files f ON f.id = m.file_id"
        " UNION ALL SELECT category, a.id, a.name, score, t.kind, NULL, NULL, summary, start_line, relative_path FROM type a JOIN types t ON t.id = a.id LEFT JOIN files f ON f.id = t.file_id",
        "typed files", _stemmed_sql("types", _TYPE_FIELDS, ["00000001", "machineri"], "full_name", "type", 2) + ",\n" + _stemmed_sql("typed", _MEMBER_FIELDS, ["00000001", "machineri"], "name", "member", 18))
def search_all(spark, sf_dir):
    """Types, and members with what they leave of the limit; each with what is shown of it."""
    s = Star(spark, sf_dir)
    types, members = search.Postings.of(s.types, "id", "type"), search.Postings.of(search.documents(s.types, s.orders, s.types)["member"][0], "id", "member")
    two = search.search(_Parts(s.types, s.orders), "00000001 machineries", "type", 2, post={"type": types}).collect()
    hits = search.search(_Parts(s.types, s.orders), "00000001 machineries", "member", 20 - len(two), post={"member": members}).unionByName(spark.createDataFrame([tuple(r) for r in two], search.HIT))
    return _rounded(search.described(hits, _Parts(s.types, s.orders, s.source_files)))


@_query("SELECT file_id, line, lpad(line::VARCHAR, 4, ' ') || '| ' || own AS text FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS own, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line FROM bodies) WHERE line BETWEEN 1 AND 4", "bodies")
def snippet_lines(spark, sf_dir):
    b = Star(spark, sf_dir).bodies
    spans = b.select(F.col("file_id").alias("id"), "file_id", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    return snippets.snippet(b, spans, 1).select("file_id", "line", "text")


# change


def _manifests(s: Star) -> tuple[DataFrame, DataFrame]:
    f = s.source_files.withColumn("k", F.substring_index("id", ":", -1).cast("bigint"))
    now = F.when(F.col("k") % 7 == 0, F.sha2(F.encode("content_hash", "UTF-8"), 256)).otherwise(F.col("content_hash"))
    return f.where("k % 13 <> 0").select("project_id", "relative_path", "content_hash"), f.where("k % 11 <> 0").select("project_id", "relative_path", now.alias("content_hash"))


_CHANGES = "x AS (SELECT coalesce(o.project_id, n.project_id) AS id, coalesce(o.relative_path, n.relative_path) AS f, CASE WHEN n.project_id IS NULL THEN 'missing' WHEN o.project_id IS NULL THEN 'new' WHEN o.content_hash <> n.content_hash THEN 'changed' END AS reason FROM old_manifest o FULL JOIN manifest n ON o.project_id = n.project_id AND o.relative_path = n.relative_path)"


@_query("SELECT id, p.name, count(*) FILTER (reason = 'missing') AS missing_files, count(*) FILTER (reason = 'changed') AS changed_files, count(*) FILTER (reason = 'new') AS new_files, count(*) AS changes, array_to_string(list_sort(array_agg(reason || ' ' || f))[:5], '; ') AS reasons FROM x JOIN projects p USING (id) WHERE reason IS NOT NULL GROUP BY id, p.name", "manifest old_manifest projects", _CHANGES)
def staleness_report(spark, sf_dir):
    s = Star(spark, sf_dir)
    return change.stale_projects(s.projects, *_manifests(s))


_PRINT = "sha256('proj:' || file_hash || coalesce(chr(10) || (SELECT string_agg(relative_path || ':' || content_hash, chr(10) ORDER BY relative_path || ':' || content_hash) FROM {0} m WHERE m.project_id = p.id), ''))"


@_query(f"SELECT id, {_PRINT.format('files')} AS fingerprint FROM projects p", "projects files")
def project_fingerprint(spark, sf_dir):
    s = Star(spark, sf_dir)
    return change.fingerprints(s.projects, s.source_files)


@_query(f"SELECT id, CASE WHEN {_PRINT.format('old_manifest')} = {_PRINT.format('manifest')} THEN 'reuse' ELSE 'rebuild' END AS action FROM projects p", "projects manifest old_manifest")
def incremental_reuse(spark, sf_dir):
    s = Star(spark, sf_dir)
    old, new = _manifests(s)
    return change.reuse_plan(change.fingerprints(s.projects, old), change.fingerprints(s.projects, new))


# extraction from facts


def _raw_projects(s: Star) -> DataFrame:
    k = F.col("s_suppkey") % 40
    name = F.concat(F.lit("Unit"), k.cast("string"), F.when(k % 6 == 0, ".Tests").when(k % 7 == 0, ".Benchmarks").otherwise(""))
    return s.table("supplier").select(F.concat(F.lit("project:"), k.cast("string")).alias("id"), name.alias("name"), F.concat(F.lit("/src/"), k.cast("string"), F.lit(".csproj")).alias("path"), F.col("s_suppkey").alias("doc_count"))


@_query("SELECT id, name, doc_count, CASE WHEN contains(name, 'Benchmarks') THEN 'excluded' WHEN name LIKE '%.Tests' THEN 'test' ELSE 'indexed' END AS fate FROM (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY doc_count DESC, name) AS k FROM raw_projects) WHERE k = 1", "raw_projects")
def project_selection(spark, sf_dir):
    return extraction.classified_projects(_raw_projects(Star(spark, sf_dir)), ["benchmarks"]).select("id", "name", "doc_count", "fate")


@_query("SELECT a.id, project_id, a.file_id, a.start_line, a.size_chars, s.summary, generated AS is_generated, n AS locations FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM raw_types) a JOIN (SELECT id, bool_or(is_generated) AS generated, count(DISTINCT (file_id, start_line)) AS n FROM raw_types GROUP BY 1) g ON a.id = g.id LEFT JOIN (SELECT id, arg_min(summary, ord) AS summary FROM raw_types WHERE length(trim(summary)) > 0 GROUP BY 1) s ON s.id = a.id WHERE k = 1", "raw_types")
def partial_merge(spark, sf_dir):
    p, key = Star(spark, sf_dir).table("part"), F.col("p_partkey")
    raw = p.select(
        F.concat(F.lit("type:"), "p_brand", F.lit("."), "p_type").alias("id"), F.concat(F.lit("project:"), "p_brand").alias("project_id"), key.alias("ord"), F.concat(F.lit("file:"), (key % 7).cast("string")).alias("file_id"), F.lit(None).cast("string").alias("relative_path"),
        F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 10).cast("int").alias("end_line"), (key % 500).cast("int").alias("size_chars"), F.when(key % 3 == 0, F.col("p_name")).alias("summary"), (key % 50 == 0).alias("is_generated"),
    )
    return extraction.merged_types(raw).select("id", "project_id", "file_id", "start_line", "size_chars", "summary", "is_generated", F.size("locations").cast("bigint").alias("locations"))


@_query("SELECT type_id, id, kind, CASE WHEN kind = 'constructor' THEN '.ctor' ELSE name END AS name, ord FROM (SELECT *, row_number() OVER (PARTITION BY type_id, id ORDER BY ord) AS k FROM raw_members WHERE NOT implicit AND NOT accessor AND NOT backing AND accessibility <> 'private' AND len(attributes) = 0) WHERE k = 1", "raw_members")
def member_dedupe(spark, sf_dir):
    s = Star(spark, sf_dir)
    o, key = s.table("orders"), F.col("o_orderkey")
    pick = F.element_at(F.array(*map(F.lit, ("public", "internal", "private", "protected internal"))), (key % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("method", "constructor", "property", "field", "event"))), (key % 5 + 1).cast("int"))
    attributes = F.when(key % 31 == 0, F.array(F.lit("System.CodeDom.GeneratedCodeAttribute"))).otherwise(F.array().cast("array<string>"))
    raw = o.select(
        F.concat(F.lit("type:"), F.col("o_custkey").cast("string")).alias("type_id"), F.concat("o_orderstatus", F.lit("."), (key % 977).cast("string")).alias("id"), kind.alias("kind"), F.concat(F.lit("Op"), key.cast("string")).alias("name"), pick.alias("accessibility"),
        (key % 19 == 0).alias("implicit"), (key % 23 == 0).alias("accessor"), (key % 29 == 0).alias("backing"), attributes.alias("attributes"), F.array().cast("array<string>").alias("parent_attributes"), F.lit("x").alias("return_type"), key.alias("ord"),
    )
    return extraction.visible_members(raw).select("type_id", "id", "kind", "name", "ord")


@_query("SELECT owner_id, target_id, min(r) AS call_rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY is_creation, ord) AS r FROM raw_calls WHERE target_assembly <> 'asm9') WHERE r <= 3 GROUP BY ALL", "raw_calls")
def calls_capped(spark, sf_dir):
    i = Star(spark, sf_dir).table("lineitem")
    order = F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    raw = i.select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("owner_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.concat(F.lit("Asm"), (F.col("l_suppkey") % 10).cast("string")).alias("target_assembly"),
        (F.col("l_returnflag") == "R").alias("is_creation"), F.lit(False).alias("is_abstract"), order.alias("ord"),
    )
    own = spark.createDataFrame([(f"aSM{k}",) for k in range(9)], "assembly string")
    return extraction.capped_calls(raw, own, 3).select("owner_id", "target_id", F.col("call_rank").cast("bigint").alias("call_rank"))


@_query("SELECT id FROM types WHERE project_id = 'project:NATION_7'", "types")
def consumer_scope_targets(spark, sf_dir):
    s = Star(spark, sf_dir)
    return extraction.scope_targets(s.types, s.projects, "project:nation_7").select("id")


@_query("SELECT target_id AS id, list_sort(array_agg(DISTINCT upper(container_type_id)))[:100] AS consumers FROM refs GROUP BY 1", "refs")
def consumers_by_type(spark, sf_dir):
    s = Star(spark, sf_dir)
    refs = _refs(s, whole=True)
    targets = s.table("lineitem").select("l_partkey").distinct().select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id"))  # all that refs can name
    made = extraction.consumers(refs, targets)
    return made.select("id", F.transform("consumers", lambda r: F.upper(r["targetId"])).alias("consumers"))


# what the tables above can't show: values made for the case, on the same tables


@_query("SELECT p_partkey, path, regexp_matches(lower(replace(path, '\\', '/')), '/(bin|obj|migrations)/') AS skipped, regexp_matches(lower(replace(path, '\\', '/')), '(\\.g\\.cs|\\.designer\\.cs|assemblyinfo\\.cs)$|/\\.?generated/') AS generated FROM"
        " (SELECT p_partkey, '/src/' || (['bin/', 'OBJ\\', 'Migrations/', 'Generated/', 'cabin/', 'lib/'])[(p_partkey % 6 + 1)::INT] || p_partkey || (['.cs', '.g.cs', '.Designer.cs', 'AssemblyInfo.cs', '.gcs'])[(p_partkey % 5 + 1)::INT] AS path FROM part)".replace("\\\\", "\\"))
def policy_skip_paths(spark, sf_dir):
    """Build folders with either slash, and every way to be generated."""
    p, key = Star(spark, sf_dir).table("part"), F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (key % n + 1).cast("int"))
    path = F.concat(F.lit("/src/"), pick(6, "bin/", "OBJ\\", "Migrations/", "Generated/", "cabin/", "lib/"), key.cast("string"), pick(5, ".cs", ".g.cs", ".Designer.cs", "AssemblyInfo.cs", ".gcs"))
    return p.select("p_partkey", path.alias("path")).withColumns({"skipped": policies.skipped_path(F.col("path")), "generated": policies.generated_path(F.col("path"))})


@_query("""SELECT id, prefix AS kind, CASE n WHEN 0 THEN own WHEN 1 THEN own ELSE c_mktsegment || '.' || own END AS short, CASE WHEN length(named) > 80 THEN substr(named, 1, 79) || '…' ELSE named END AS relation,
 CASE WHEN length(said) > 120 THEN substr(said, 1, 119) || '…' ELSE said END AS signature FROM (SELECT *, repeat(own || '_', 2 + n * 2) AS named, own || repeat('(int)', 10 + n * 8) AS said,
 prefix || ':' || (['', 'Demo.', 'Demo.' || c_mktsegment || '.'])[n + 1] || own || CASE WHEN n = 1 THEN '' ELSE '(System.Int32,Demo.X)' END AS id
 FROM (SELECT c_custkey, c_mktsegment, (c_custkey % 3)::INT AS n, 'C' || c_custkey || 'abcdefghij' AS own, CASE WHEN c_custkey % 6 = 5 THEN 'member' ELSE (['type', 'event', 'field', 'property', 'method'])[(c_custkey % 6 + 1)::INT] END AS prefix FROM customer))""")
def short_names_dotted(spark, sf_dir):
    """Ids of every prefix, with dots and parameters; names and signatures that are cut."""
    c, key = Star(spark, sf_dir).table("customer"), F.col("c_custkey")
    n = (key % 3).cast("int")
    own = F.concat(F.lit("C"), key.cast("string"), F.lit("abcdefghij"))
    prefix = F.when(key % 6 == 5, "member").otherwise(F.get(F.array(*map(F.lit, ("type", "event", "field", "property", "method"))), (key % 6).cast("int")))
    space = F.when(n == 0, "").when(n == 1, "Demo.").otherwise(F.concat(F.lit("Demo."), "c_mktsegment", F.lit(".")))
    id_ = F.concat(prefix, F.lit(":"), space, own, F.when(n == 1, "").otherwise("(System.Int32,Demo.X)"))
    named, said = F.concat(F.repeat(F.concat(own, F.lit("_")), 2 + n * 2), F.lit("(int, Demo.X)")), F.concat(own, F.repeat(F.lit("(int)"), 10 + n * 8))
    return c.select(id_.alias("id"), scalars.kind_of_id(id_).alias("kind"), scalars.short_id(id_).alias("short"), scalars.relation_name(named, id_).alias("relation"), scalars.short_signature(said).alias("signature"))


@_query("WITH RECURSIVE r AS (SELECT 1::BIGINT AS node, 0 AS depth UNION ALL SELECT p_partkey, depth + 1 FROM r JOIN part ON p_partkey // 2 = r.node AND p_partkey > 1) SELECT node, depth FROM r WHERE depth > 0 ORDER BY depth, lpad(node::VARCHAR, 12, '0') LIMIT 50")
def overrides_deep(spark, sf_dir):
    """A part overrides the part of half its number, so there are many levels."""
    code = lambda k: F.lpad(k.cast("string"), 12, "0")
    p, key = Star(spark, sf_dir).table("part").where("p_partkey > 1"), F.col("p_partkey")
    facts = p.select(code(key).alias("method_id"), code(F.floor(key / 2)).alias("overridden_id"))
    return graph.overrides(facts, f"{1:012d}").select(F.col("node").cast("bigint").alias("node"), "depth")


@_query(f"SELECT DISTINCT id FROM (SELECT container_type_id AS id FROM refs WHERE target_id = '{ROOT_PART}' UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 7 AND p_partkey < 700) ORDER BY upper(id), id LIMIT 100", "refs")
def interface_consumers(spark, sf_dir):
    """Those that refer to a type, and those that implement it, directly or not."""
    s = Star(spark, sf_dir)
    p, key = s.table("part").where("p_partkey % 7 = 0 AND p_partkey > 7 AND p_partkey < 700"), F.col("p_partkey")
    node = lambda k: F.concat(F.lit("part:"), k.cast("string"))
    e = p.select(node(key).alias("from_id"), F.when(key % 2 == 0, node(key - 7)).otherwise(F.lit(ROOT_PART)).alias("to_id"), F.lit("implements").alias("kind"))
    return graph.consumer_types(_refs(s), ROOT_PART, 100, graph.closure(e, ROOT_PART, ("implements", "inherits")))


@_query("SELECT t.id, full_name, depth FROM (SELECT 'supplier:' || s_suppkey AS id, 'S' || (s_suppkey % 10) || '.' || s_name AS full_name, 2 AS depth FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 ORDER BY 1 LIMIT 50) t ORDER BY full_name, id")
def implementations(spark, sf_dir):
    """Suppliers as the types below a region; nations between them are no types."""
    s = Star(spark, sf_dir)
    types = s.table("supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("S"), (F.col("s_suppkey") % 10).cast("string"), F.lit("."), "s_name").alias("full_name"))
    return graph.implementations(s.edges, types, ROOT_REGION)


@_query("SELECT m.id, m.name, m.kind, relative_path FROM typed m LEFT JOIN files f ON m.file_id = f.id WHERE type_full_name = (SELECT full_name FROM types WHERE id = 'type:Customer#000000008') ORDER BY kind, name, m.id LIMIT 200", "typed files")
def list_members_by_name(spark, sf_dir):
    s = Star(spark, sf_dir)
    name = s.types.where("id = 'type:Customer#000000008'").first()["full_name"]
    return catalog.list_members(s.orders, s.types, s.source_files, full_name=name, limit=200).select("id", "name", "kind", "relative_path")


@_query("SELECT q, id, match_rank FROM (SELECT 'Op12' AS q, 'property:Op12' AS id, 5 AS match_rank UNION ALL SELECT 'Op13', 'field:Op13', 6 UNION ALL SELECT 'Op14', 'event:Op14', 7 UNION ALL SELECT 'Op15', 'method:Op15', 0) JOIN members USING (id)", "members")
def resolve_member_retry(spark, sf_dir):
    """Names that only an id with another prefix has."""
    s = Star(spark, sf_dir)
    blank = s.orders.withColumns({"name": F.lit("none"), "signature": F.lit("none()")})
    found = None
    for q in ("Op12", "Op13", "Op14", "Op15"):
        one = catalog.resolve_member(blank, s.types, s.source_files, q).select(F.lit(q).alias("q"), "id", "match_rank")
        found = one if found is None else found.unionByName(one)
    return found


_ROLES = "(['base','interface','attribute','return','parameter','type'])[(l_linenumber % 6 + 1)::INT]"
_OWNERS = "(['class','method','constructor','field'])[(l_orderkey % 4 + 1)::INT]"


@_query(f"""SELECT owner_id, kind, target_id, target_name FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, kind, target_id ORDER BY ord) AS k FROM (SELECT *,
 CASE WHEN role = 'base' THEN CASE WHEN target_name <> 'System.Object' THEN 'inherits' END WHEN role = 'interface' THEN 'implements' WHEN role = 'attribute' THEN 'usesInSignature' WHEN role = 'return' AND owner = 'constructor' THEN NULL
  WHEN role = 'type' AND owner = 'field' THEN 'usesInMember' ELSE 'usesInSignature' END AS kind FROM
 (SELECT 'o:' || l_orderkey AS owner_id, {_OWNERS} AS owner, {_ROLES} AS role, CASE WHEN l_partkey % 19 = 0 THEN 'System.Object' WHEN l_partkey % 17 = 0 THEN 'int' ELSE 'P' || l_partkey END AS target_name,
  't:P' || l_partkey AS target_id, 'asm' || (l_suppkey % 10) AS assembly, l_suppkey % 13 = 0 AS parameter, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM lineitem))
 WHERE kind IS NOT NULL AND target_name <> 'int' AND NOT parameter AND (assembly <> 'asm9' OR kind IN ('inherits', 'implements'))) WHERE k = 1""")
def light_dependencies(spark, sf_dir):
    """Dependencies of types and members by role, without primitives, type parameters, arrays' brackets, outsiders and repeats."""
    i = Star(spark, sf_dir).table("lineitem")
    pick = lambda key, *v: F.element_at(F.array(*map(F.lit, v)), (key % len(v) + 1).cast("int"))
    part, name = F.col("l_partkey"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    array = F.when(part % 5 == 0, "[]").when(part % 7 == 0, "[,][]").otherwise("")
    uses = i.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("owner_id"), pick(F.col("l_orderkey"), "class", "method", "constructor", "field").alias("owner_kind"), pick(F.col("l_linenumber"), "base", "interface", "attribute", "return", "parameter", "type").alias("role"),
        F.concat(F.lit("t:"), name, array).alias("target_id"), F.when(part % 19 == 0, "System.Object").when(part % 17 == 0, "int").otherwise(F.concat(name, array)).alias("target_name"), F.concat(F.lit("ASM"), (F.col("l_suppkey") % 10).cast("string")).alias("target_assembly"),
        (F.col("l_suppkey") % 13 == 0).alias("is_type_parameter"), (F.col("l_linenumber").cast("bigint") * 1000000000 + part * 1000 + F.col("l_suppkey") % 1000).alias("ord"),
    )
    own = spark.createDataFrame([(f"asm{k}",) for k in range(9)], "assembly string")
    return extraction.kept_dependencies(extraction.declared_dependencies(uses), own).select("owner_id", "kind", "target_id", "target_name")


_HALVES = "x AS (SELECT id, CASE WHEN nation.n_nationkey % 5 = 4 THEN 'add' WHEN nation.n_nationkey % 5 = 3 THEN 'drop' WHEN {0} = {1} THEN 'reuse' ELSE 'rebuild' END AS action FROM projects p JOIN nation ON 'project:' || n_name = p.id)"


@_query("SELECT m.project_id, relative_path, content_hash FROM old_manifest m JOIN x ON m.project_id = x.id WHERE action = 'reuse' UNION ALL SELECT m.project_id, relative_path, content_hash FROM manifest m JOIN x ON m.project_id = x.id WHERE action IN ('add', 'rebuild')", "projects manifest old_manifest", _HALVES.format(_PRINT.format("old_manifest"), _PRINT.format("manifest")))
def incremental_rebuild(spark, sf_dir):
    """Files after projects were changed, added and dropped: those of unchanged projects from the old index."""
    s = Star(spark, sf_dir)
    old, new = _manifests(s)
    before, after = s.projects.where("nationkey % 5 <> 4"), s.projects.where("nationkey % 5 <> 3")
    plan = change.reuse_plan(change.fingerprints(before, old), change.fingerprints(after, new))
    return change.merged(old, new, plan)


@_query("SELECT a.id, list_transform(list_filter(list_zip(places, range(1, len(places) + 1)), lambda z: true), lambda z: (z[1][2] || '@' || z[1][3] || CASE WHEN z[2] = 1 THEN '!' ELSE '' END)) AS places FROM (SELECT id, list_sort(array_agg((ord, file_id, start_line))) AS places FROM (SELECT *, row_number() OVER (PARTITION BY id, file_id, start_line ORDER BY ord) AS k FROM raw_types) WHERE k = 1 GROUP BY id) a", "raw_types")
def partial_locations(spark, sf_dir):
    """Where the parts of each type are: each place once, in order, the first one being primary."""
    p, key = Star(spark, sf_dir).table("part"), F.col("p_partkey")
    raw = p.select(
        F.concat(F.lit("type:"), "p_brand", F.lit("."), "p_type").alias("id"), F.concat(F.lit("project:"), "p_brand").alias("project_id"), key.alias("ord"), F.concat(F.lit("file:"), (key % 7).cast("string")).alias("file_id"), F.lit(None).cast("string").alias("relative_path"),
        F.col("p_size").cast("int").alias("start_line"), (F.col("p_size") + 10).cast("int").alias("end_line"), (key % 500).cast("int").alias("size_chars"), F.lit(None).cast("string").alias("summary"), F.lit(False).alias("is_generated"),
    )
    shown = F.transform("locations", lambda x: F.concat(x["fileId"], F.lit("@"), x["startLine"].cast("string"), F.when(x["isPrimary"], "!").otherwise("")))
    return extraction.merged_types(raw).select("id", shown.alias("places"))


@_query("SELECT c_custkey, kind <> 0 AS noisy, (['public', 'protected internal', 'private protected', '', 'internal'])[(c_custkey % 5 + 1)::INT] AS accessibility FROM (SELECT c_custkey, c_custkey % 4 AS kind FROM customer)")
def policy_texts(spark, sf_dir):
    """Diagnostics that say nothing, and accessibilities as they are written."""
    c, key = Star(spark, sf_dir).table("customer"), F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (key % n + 1).cast("int"))
    message = pick(4, "error CS0103", "warning msb3277: x", "Found conflicts between different versions of Y", "an Indirect Dependency on z: System.Runtime")
    name = pick(5, "Public", "ProtectedOrInternal", "ProtectedAndInternal", "NotApplicable", "Internal")
    return c.select("c_custkey", policies.noisy_diagnostic(message).alias("noisy"), scalars.accessibility_text(name).alias("accessibility"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in _REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTERED.items() if sql}
