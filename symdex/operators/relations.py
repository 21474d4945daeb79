"""Relations (a list on their owner) and edges (rows), and slices of relations for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import relation_name
from ..plans.lineage import cut
from ..schema import LOC, REL, RELATION_KINDS

#: Rows that a task ranks, about.
RANKED = 500_000


def parse(json: Column) -> Column:
    """A JSON list of relations; null, blank, broken and foreign input gives an empty list."""
    empty = F.array().cast(f"array<{REL}>")
    read = F.when(F.ltrim(json).startswith("["), F.from_json(json, f"array<{REL}>"))
    known = F.forall(read, lambda r: F.coalesce(r["kind"].isin(*RELATION_KINDS) & r["targetId"].isNotNull(), F.lit(False)))
    return F.when(F.coalesce(known, F.lit(False)), read).otherwise(empty)


def write(relations: Column) -> Column:
    return F.to_json(F.coalesce(relations, F.array().cast(f"array<{REL}>")))


def of_kind(relations: Column, *kinds: str) -> Column:
    return F.filter(relations, lambda r: r["kind"].isin(*kinds))


def to_edges(owners: DataFrame) -> DataFrame:
    """Edges of owners (id, dependencies, consumers): owner to target, and consumer to owner.

    Rows without an end or a kind are left out; repeats are kept.  The order of
    insertion is (owner, dependencies before consumers, place in the list), and
    ``edge_seq`` counts it without ranking all rows in one task.
    """
    # one list, exploded once, so that owners aren't made twice
    def side(name: str, k: int) -> Column:
        ends = (lambda r: (F.col("id"), r["targetId"])) if k == 0 else (lambda r: (r["targetId"], F.col("id")))
        made = lambda r, i: F.struct(F.lit(k).alias("side"), i.alias("place"), ends(r)[0].alias("from_id"), ends(r)[1].alias("to_id"), r["kind"].alias("kind"), r["file"].alias("file"), r["line"].alias("line"))
        return F.transform(F.coalesce(name, F.array().cast(f"array<{REL}>")), made)

    rows = owners.select(F.col("id").alias("owner"), F.inline(F.concat(side("dependencies", 0), side("consumers", 1))))
    rows = rows.where("length(from_id) > 0 AND length(to_id) > 0 AND length(kind) > 0")
    return sequence(rows, ["owner", "side", "place"]).select("edge_seq", "from_id", "to_id", "kind", "file", "line")


def sequence(rows: DataFrame, by: list[str], name: str = "edge_seq") -> DataFrame:
    """Numbers rows from 1 by columns: ranks within hash ranges of the first column, offset by the ranges' counts.

    The order is total over (range of the first column, ``by``), so the first
    column must have many values: rows that share one are ranked in one task.
    There are 64 ranges, or as many as leave 30 000 rows each where rows are
    many, and a task ranks some 16 of them.  The rows are written once and
    numbered from there; numbers are given when an index is built, and stored
    with it.
    """
    kept = cut(rows)
    n = max(4, -(-kept.count() // RANKED))  # from the files' footers
    keyed = kept.withColumn("_range", F.pmod(F.xxhash64(by[0]), F.lit(16 * n)))
    counts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each range
    ranked = keyed.repartition(n, "_range").withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*by)))
    return ranked.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_k")).drop("_range", "_before", "_k")


def migrate(edges: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Edges as they are, or made from the relations if there are none yet."""
    if edges.limit(1).count():
        return edges
    return to_edges(types.select("id", "dependencies", "consumers").unionByName(members.select("id", "dependencies", "consumers")))


def save_consumers(owners: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners and edges after the consumers of those in ``new`` (id, consumers) are replaced.

    Of the edges only ``referencedBy`` ones into these owners go; new ones are
    numbered after the last.
    """
    fresh = new.select("id", F.col("consumers").alias("_new"))
    kept = owners.join(fresh, "id", "left").withColumn("consumers", F.coalesce("_new", "consumers")).select(*owners.columns)
    back = edges.where("kind = 'referencedBy'")
    stay = edges.where("kind <> 'referencedBy'").unionByName(back.join(new.select("id"), back["to_id"] == F.col("id"), "left_anti"))
    last = edges.agg(F.coalesce(F.max("edge_seq"), F.lit(0)).alias("_last"))
    added = to_edges(new.select("id", F.array().cast(f"array<{REL}>").alias("dependencies"), "consumers"))
    added = added.crossJoin(F.broadcast(last)).withColumn("edge_seq", F.col("edge_seq") + F.col("_last")).drop("_last")
    return kept, stay.unionByName(added)


def locations(locs: Column, file_id: Column, path: Column, start: Column, end: Column, size: Column) -> Column:
    """The list as it is, or its single primary location made from the span; neither file nor line gives none."""
    one = F.struct(file_id.alias("fileId"), path.alias("relativePath"), start.alias("startLine"), end.alias("endLine"), size.alias("sizeChars"), F.lit(True).alias("isPrimary")).cast(LOC)
    empty = F.array().cast(f"array<{LOC}>")
    made = F.when(file_id.isNull() & start.isNull(), empty).otherwise(F.array(one))
    return F.when(F.coalesce(F.size(locs), F.lit(0)) > 0, locs).otherwise(made)


def relation_slice(owners: DataFrame, full: bool = False, limit: int = 20) -> DataFrame:
    """Per owner: names by group, with totals and whether some were left out.

    Compact output hides the signature names (not their total) and shows at
    most five consumers.
    """
    limit = max(1, min(limit, 100))
    d, c = F.col("dependencies"), F.col("consumers")
    groups = {
        "calls": (of_kind(d, "calls"), limit),
        "signature": (of_kind(d, "usesInSignature", "usesInMember"), limit if full else 0),
        "structural": (of_kind(d, "inherits", "implements"), limit),
        "consumers": (c, limit if full else min(5, limit)),
    }
    made = [F.col("id")]
    for name, (rel, n) in groups.items():
        names = F.transform(F.slice(rel, 1, n) if n else F.slice(rel, 1, 0), lambda r: relation_name(r["targetName"], r["targetId"]))
        made += [names.alias(f"{name}_names"), F.size(rel).alias(f"{name}_total"), (F.size(rel) > n).alias(f"{name}_truncated")]
    return owners.select(*made)
