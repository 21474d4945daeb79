"""An index over a star-schema data set, so that operators can run on tables of any size.

Nations are projects, customers types, orders members; line items, suppliers
and customers give edges; documents are source files with bodies.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens_of
from ..operators.relations import sequence
from ..plans.lineage import tasks
from ..schema import REL

#: Files that types and members refer to; every data set has so many documents.
FILES = 200
_NONE = f"array<{REL}>"


def _pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _rel(kind: str, target: Column, name: Column, file: Column, line: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), target.alias("targetId"), name.alias("targetName"), file.cast("string").alias("file"), line.cast("int").alias("line"), none.alias("siteLabel"))


class Star:
    """Index tables as attributes, made when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def solutions(self) -> DataFrame:
        return self.spark.createDataFrame([("solution:/star.sln", "star", "/star.sln", None)], "id string, name string, path string, file_hash string")

    @cached_property
    def projects(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        joined = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 5 rows
        path = F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit(".csproj"))
        return joined.select(
            F.concat(F.lit("project:"), "n_name").alias("id"), F.lit("solution:/star.sln").alias("solution_id"), F.col("n_name").alias("name"), path.alias("path"),
            F.when(F.col("n_nationkey") % 4 != 0, F.col("r_name")).alias("target_framework"), (F.col("n_nationkey") % 5 == 0).alias("is_test"), F.sha2(path, 256).alias("file_hash"), F.col("n_nationkey").alias("nationkey"),
        )

    @cached_property
    def source_files(self) -> DataFrame:
        d, key = self.table("documents"), F.col("doc_id")
        relative = F.concat(F.lit("src/"), "source", F.lit("/"), key.cast("string"), F.when(key % 9 == 0, ".g.cs").otherwise(".cs"))
        nations = self.table("nation").select((F.col("n_nationkey")).alias("_k"), F.concat(F.lit("project:"), "n_name").alias("project_id"))
        named = d.join(F.broadcast(nations), key % 25 == F.col("_k"))  # 25 rows
        return named.select(F.concat(F.lit("file:"), key.cast("string")).alias("id"), "project_id", relative.alias("relative_path"), F.concat(F.lit("/star/"), relative).alias("absolute_path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.col("n_chars").cast("int").alias("length_chars"), (key % 9 == 0).alias("is_generated"))

    @cached_property
    def bodies(self) -> DataFrame:
        d, key = self.table("documents"), F.col("doc_id")
        relative = F.concat(F.lit("src/"), "source", F.lit("/"), key.cast("string"), F.when(key % 9 == 0, ".g.cs").otherwise(".cs"))
        return d.select(F.concat(F.lit("file:"), key.cast("string")).alias("file_id"), relative.alias("relative_path"), F.concat(F.lit("/star/"), relative).alias("absolute_path"), F.col("text").alias("content")).where("length(content) > 0")

    @cached_property
    def namespaces(self) -> DataFrame:
        return self.types.select("project_id", F.element_at(F.split("full_name", r"\."), 2).alias("name")).distinct().select(F.concat(F.lit("ns:"), "project_id", F.lit(":"), "name").alias("id"), "project_id", "name")

    @cached_property
    def types(self) -> DataFrame:
        c, p = self.table("customer"), self.projects
        key = F.col("c_custkey")
        joined = c.join(F.broadcast(p.select("id", "name", "nationkey")), F.col("c_nationkey") == F.col("nationkey"))  # 25 rows
        lines = key % 11 != 0
        return joined.select(
            F.concat(F.lit("type:"), "c_name").alias("id"), F.col("id").alias("project_id"), F.concat(F.lit("ns:"), "id", F.lit(":"), "c_mktsegment").alias("namespace_id"), F.col("c_name").alias("name"),
            F.concat_ws(".", "name", "c_mktsegment", "c_name").alias("full_name"), _pick(key, ("class", "record", "struct", "interface", "enum", "delegate")).alias("kind"), _pick(key, ("public", "internal", "private")).alias("accessibility"),
            F.when(key % 4 != 0, F.concat(F.lit("Customer in "), "c_mktsegment", F.lit("."))).alias("summary"), F.when(key % 17 != 0, F.concat(F.lit("file:"), (key % FILES).cast("string"))).alias("file_id"),
            F.when(lines, 1 + key % 50).cast("int").alias("start_line"), F.when(lines, 1 + key % 50 + key % 97).cast("int").alias("end_line"), F.floor(F.abs("c_acctbal")).cast("int").alias("size_chars"),
            F.array(_rel("implements", F.concat(F.lit("type:"), "name"), F.col("name"), F.lit(None), F.lit(None))).cast(_NONE).alias("dependencies"), F.array().cast(_NONE).alias("consumers"), key.alias("custkey"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        """Members without their relations."""
        o, key = self.table("orders"), F.col("o_orderkey")
        lines = key % 13 != 0
        name = F.concat(F.lit("Op"), key.cast("string"))
        kind = _pick(key, ("method", "constructor", "property", "field", "event"))
        return o.select(
            F.concat(F.when(kind == "constructor", "method").otherwise(kind), F.lit(":"), name).alias("id"), F.concat(F.lit("type:Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("type_id"), name.alias("name"), kind.alias("kind"),
            F.concat("o_orderpriority", F.lit(" "), name, F.lit("("), "o_orderstatus", F.lit(")")).alias("signature"), _pick(key, ("public", "internal", "private", "protected")).alias("accessibility"), F.when(kind != "constructor", F.col("o_orderpriority")).alias("return_type"),
            F.when(key % 3 != 0, F.concat(F.lit("Order with status "), "o_orderstatus", F.lit("."))).alias("summary"), F.when(key % 17 != 0, F.concat(F.lit("file:"), (key % FILES).cast("string"))).alias("file_id"),
            F.when(lines, 1 + key % 400).cast("int").alias("start_line"), F.when(lines, 1 + key % 400 + key % 61).cast("int").alias("end_line"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("size_chars"), key.alias("orderkey"), F.col("o_custkey").alias("custkey"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Members with calls to parts, and parts that were returned as consumers, by line and part."""
        i, o = self.table("lineitem"), self.orders
        n = tasks(i, o)

        def rels(kind: str, places: Column) -> Column:
            def one(x: Column) -> Column:
                name = F.concat(F.lit("Part"), x["p"].cast("string"))
                return _rel(kind, F.concat(F.lit("method:"), name), name, x["f"], x["n"])

            return F.transform(places, one)

        place = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
        listed = i.repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(place)).alias("d"))
        joined = o.repartition(n, "orderkey").join(listed, F.col("orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
        joined = joined.withColumns({"dependencies": rels("calls", F.col("d")), "consumers": rels("referencedBy", F.filter("d", lambda x: x["f"] == "R"))}).drop("d")
        return joined.withColumns({k: F.coalesce(k, F.array()).cast(_NONE) for k in ("dependencies", "consumers")})

    @cached_property
    def token_members(self) -> DataFrame:
        return self.orders.withColumn("tokens", tokens_of(F.col("signature"), F.col("summary"), F.col("return_type")))

    @cached_property
    def edges(self) -> DataFrame:
        """Six kinds of edges, numbered by (leg, keys)."""
        i, s, n, r, c = (self.table(t) for t in ("lineitem", "supplier", "nation", "region", "customer"))

        def node(prefix: str, key: str) -> Column:
            return F.concat(F.lit(prefix), F.col(key).cast("string"))

        def leg(df: DataFrame, k: int, a: Column, b: Column, kind: str, file: Column, line: Column, x: str, y: str, z: Column) -> DataFrame:
            return df.select(F.lit(k).alias("leg"), F.col(x).cast("bigint").alias("x"), F.col(y).cast("bigint").alias("y"), z.cast("bigint").alias("z"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("kind"), file.cast("string").alias("file"), line.cast("int").alias("line"))

        none, part, order = F.lit(None), node("part:", "l_partkey"), node("order:", "l_orderkey")
        file, line = F.col("l_returnflag"), F.col("l_linenumber")
        rows = [
            leg(i, 0, order, part, "calls", file, line, "l_orderkey", "l_partkey", line),
            leg(i.select("l_partkey", "l_suppkey").distinct(), 1, part, node("supplier:", "l_suppkey"), "usesInSignature", none, none, "l_partkey", "l_suppkey", F.lit(0)),
            leg(s, 2, node("supplier:", "s_suppkey"), node("nation:", "s_nationkey"), "implements", none, none, "s_suppkey", "s_nationkey", F.lit(0)),
            leg(n, 3, node("nation:", "n_nationkey"), node("region:", "n_regionkey"), "inherits", none, none, "n_nationkey", "n_regionkey", F.lit(0)),
            leg(c, 4, node("customer:", "c_custkey"), node("nation:", "c_nationkey"), "implements", none, none, "c_custkey", "c_nationkey", F.lit(0)),
            leg(i.where("l_returnflag = 'R'"), 5, part, order, "referencedBy", file, line, "l_partkey", "l_orderkey", line),
        ]
        made = rows[0]
        for more in rows[1:]:
            made = made.unionByName(more)
        return made

    def numbered_edges(self) -> DataFrame:
        """Edges with ``edge_seq`` as operators want it: here any total order will do that all sides share."""
        return sequence(self.edges, ["x", "leg", "y", "z", "file"])
