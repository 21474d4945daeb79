"""Edges around nodes, bounded breadth-first search, impact graphs, closures and reference sites.

Depth and node caps are small constants of the operators (4 and 200), so the
search keeps its state, at most that many nodes, on the driver; what is large,
the edges, is only filtered and cut down to the cap for each node, one job for
each hop and direction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import kind_of_id, short_id
from ..plans.lineage import cut
from ..schema import OUTBOUND_KINDS
from .catalog import clamp
from .relations import of_kind

SEQ = ("edge_seq",)
HOPS = "node string, via string, kind string, depth int, file string, line int"


def edges_of(edges: DataFrame, node: str, outbound: bool = True, limit: int = 100, order_by: tuple[str, ...] = SEQ) -> DataFrame:
    """The first edges of a node in order of insertion."""
    return edges.where(F.col("from_id" if outbound else "to_id") == node).orderBy(*order_by).limit(clamp(limit, 1, 500)).select("from_id", "to_id", "kind", "file", "line")


def fetch(edges: DataFrame, nodes: list[str], outbound: bool, per_node: int, order_by: tuple[str, ...] = SEQ) -> dict[str, list[tuple]]:
    """For each of a few nodes its first ``per_node`` edges: (other end, kind, file, line)."""
    own, other = ("from_id", "to_id") if outbound else ("to_id", "from_id")
    rank = F.row_number().over(Window.partitionBy(own).orderBy(*order_by))
    some = edges.where(F.col(own).isin(nodes)).withColumn("_k", rank).where(F.col("_k") <= per_node)
    found: dict[str, list[tuple]] = {}
    for r in some.select(own, "_k", other, "kind", "file", "line").collect():  # at most nodes x per_node rows
        found.setdefault(r[0], []).append(tuple(r)[1:])
    return {n: [e[1:] for e in sorted(rows, key=lambda e: e[0])] for n, rows in found.items()}


def hops(edges: DataFrame, root: str, depth: int = 2, outbound: bool = True, limit: int = 80, order_by: tuple[str, ...] = SEQ) -> DataFrame:
    """Nodes in order of discovery from ``root``, each with the edge that found it first; the root is left out."""
    depth, limit = clamp(depth, 1, 4), clamp(limit, 1, 200)
    seen, frontier, out = {root}, [root], []
    for d in range(1, depth + 1):
        if not frontier or len(out) >= limit:
            break
        near = fetch(edges, frontier, outbound, limit, order_by)
        found = []
        for via in frontier:
            for node, kind, file, line in near.get(via, ()):
                if node not in seen and len(out) < limit:
                    seen.add(node)
                    found.append(node)
                    out.append((node, via, kind, d, file, line))
        frontier = found
    return edges.sparkSession.createDataFrame(out, HOPS)


@dataclass
class Impact:
    """An impact graph; at most 80 nodes."""

    nodes: list[tuple[str, int]] = field(default_factory=list)
    edges: list[tuple] = field(default_factory=list)
    truncated: bool = False

    def node_frame(self, spark) -> DataFrame:
        df = spark.createDataFrame(self.nodes, "id string, depth int")
        return df.select("id", short_id(F.col("id")).alias("name"), kind_of_id(F.col("id")).alias("kind"), "depth").orderBy("depth", "name", "id")

    def edge_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.edges, "from_id string, to_id string, kind string, file string, line int")


def impact(edges: DataFrame, root: str, depth: int = 2, max_nodes: int = 40, direction: str = "both", order_by: tuple[str, ...] = SEQ, owners: DataFrame | None = None, inward: DataFrame | None = None) -> Impact:
    """What a node reaches and what reaches it.

    Outwards only some kinds are followed, inwards all; a node's cap on edges
    comes before that filter.  Beyond ``max_nodes`` a new node is dropped, an
    edge between known ones still counts.  With ``owners`` (id, dependencies,
    consumers) the first hop is read from the root's relations, whose kinds
    are spelled with a capital.  ``inward`` are the same edges, stored by their
    target.
    """
    depth, cap = clamp(depth, 1, 4), clamp(max_nodes, 5, 80)
    g, known, have = Impact([(root, 0)]), {root}, set()

    def meet(node: str, edge: tuple, d: int, found: list[str]) -> None:
        if node not in known:
            if len(known) >= cap:
                g.truncated = True
                return
            known.add(node)
            g.nodes.append((node, d))
            found.append(node)
        if edge not in have:
            have.add(edge)
            g.edges.append(edge)

    frontier = [root]
    for d in range(1, depth + 1):
        if not frontier:
            break
        found: list[str] = []
        if d == 1 and owners is not None:
            out, back = _relations_of(owners, root)
        else:
            out = fetch(edges, frontier, True, cap, order_by) if direction in ("both", "out") else {}
            back = fetch(edges if inward is None else inward, frontier, False, cap, order_by) if direction in ("both", "in") else {}
        for node in frontier:
            if direction in ("both", "out"):
                for other, kind, file, line in out.get(node, ()):
                    if kind[0].lower() + kind[1:] in OUTBOUND_KINDS:
                        meet(other, (node, other, kind, file, line), d, found)
            if direction in ("both", "in"):
                for other, kind, file, line in back.get(node, ()):
                    meet(other, (other, node, kind, file, line), d, found)
        frontier = found
    g.truncated = g.truncated or len(known) >= cap
    return g


def named(nodes: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of an impact graph (at most 80) under their symbols' names; what the index hasn't keeps the name made from its id."""
    some = F.broadcast(nodes.select(F.col("id").alias("_id")))
    full = F.concat_ws(".", "full_name", "name")
    own = members.join(some, F.col("id") == F.col("_id"), "left_semi").select("id", "type_id", "name").join(types.select(F.col("id").alias("_t"), "full_name"), F.col("type_id") == F.col("_t"))
    known = types.join(some, F.col("id") == F.col("_id"), "left_semi").select(F.col("id").alias("_n"), F.col("full_name").alias("_name")).unionByName(own.select(F.col("id").alias("_n"), full.alias("_name")))
    return nodes.join(known, F.col("id") == F.col("_n"), "left").select("id", F.coalesce("_name", "name").alias("name"), "kind", "depth").orderBy("depth", "name", "id")


def _relations_of(owners: DataFrame, root: str) -> tuple[dict, dict]:
    row = owners.where(F.col("id") == root).select(of_kind(F.col("dependencies"), *OUTBOUND_KINDS), "consumers").limit(1).collect()
    if not row:
        return {}, {}
    out = [(r["targetId"], r["kind"][0].upper() + r["kind"][1:], r["file"], r["line"]) for r in row[0][0] or ()]
    back = [(r["targetId"], "referencedBy", r["file"], r["line"]) for r in row[0][1] or ()]
    return {root: out}, {root: back}


def closure(edges: DataFrame, root: str, kinds: tuple[str, ...]) -> DataFrame:
    """Every node that reaches ``root`` over edges of these kinds, with its distance; cycles end.

    The edges of these kinds are made once.  Each hop writes what it found new,
    and a frontier is sent to the edges where it is small, by Spark's own size
    limit, and shuffled where not.
    """
    own = cut(edges.where(F.col("kind").isin(*kinds)).select("from_id", "to_id").distinct())
    seen = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int")
    frontier, d = seen, 0
    while True:
        d += 1
        near = own.join(frontier, own["to_id"] == frontier["node"], "left_semi").select(F.col("from_id").alias("node")).distinct()
        frontier = cut(near.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if not frontier.limit(1).count():
            return seen.where("depth > 0")
        seen = seen.unionByName(frontier)


def implementations(edges: DataFrame, types: DataFrame, root: str, limit: int = 50) -> DataFrame:
    """Types that implement or derive from one, directly or not: the nearest ``limit``, then by name."""
    found = closure(edges, root, ("implements", "inherits"))
    return found.join(types.select("id", "full_name"), found["node"] == F.col("id")).orderBy("depth", "id").limit(limit).orderBy("full_name", "id").select("id", "full_name", "depth")


def overrides(facts: DataFrame, method: str, limit: int = 50) -> DataFrame:
    """Methods that override one (facts: method_id, overridden_id), directly or not: the nearest first."""
    e = facts.select(F.col("method_id").alias("from_id"), F.col("overridden_id").alias("to_id"), F.lit("overrides").alias("kind"))
    return closure(e, method, ("overrides",)).orderBy("depth", "node").limit(limit)


def reference_sites(refs: DataFrame, target: str, limit: int = 50, kinds: tuple[str, ...] | None = None, order_by: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The first ``limit`` sites that refer to a symbol, one for each (container, file, line), then by name, file and line."""
    own = refs.where((F.col("target_id") == target) & (F.col("container_id") != target))
    if kinds:
        own = own.where(F.col("container_kind").isin(*kinds))
    one = F.row_number().over(Window.partitionBy("container_id", F.upper(F.coalesce("file", F.lit(""))), F.coalesce("line", F.lit(-1))).orderBy(*order_by))
    first = own.withColumn("_k", one).where("_k = 1").orderBy(*order_by).limit(limit)
    return first.orderBy(F.upper("display"), F.upper("file"), "line", "container_id").select("container_id", "display", "file", "line")


def callers(refs: DataFrame, target: str, limit: int = 50, order_by: tuple[str, ...] = ("ord",)) -> DataFrame:
    return reference_sites(refs, target, limit, ("method", "constructor"), order_by)


def unique_callers(sites: DataFrame) -> DataFrame:
    return sites.agg(F.countDistinct("container_id").alias("unique_callers"))


def consumer_types(refs: DataFrame, target: str, limit: int = 100, implementors: DataFrame | None = None) -> DataFrame:
    """Types around the references to one, and for an interface all that implement it, by name."""
    own = refs.where((F.col("target_id") == target) & (F.col("container_type_id") != target)).select(F.col("container_type_id").alias("id"))
    if implementors is not None:
        own = own.unionByName(implementors.select(F.col("node").alias("id")))
    return own.distinct().orderBy(F.upper("id"), "id").limit(limit)
