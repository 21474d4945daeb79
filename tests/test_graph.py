"""Graph operators against plain Python over random graphs with cycles, loops, repeats and loose ends."""

import random
from collections import deque

import pytest

from symdex.operators import graph
from symdex.schema import DDL, OUTBOUND_KINDS, REL

KINDS = [*OUTBOUND_KINDS, "referencedBy"]


def random_edges(seed, nodes=30, n=120):
    r = random.Random(seed)
    rows = [(k, f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}", r.choice(KINDS), r.choice(["a", "b", None]), r.choice([1, 2, None])) for k in range(n)]
    return rows + [(n, "n0", "n0", "calls", None, None), (n + 1, "n0", "gone", "calls", None, None), (n + 2, "n0", "gone", "calls", None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL["edges"])


def plain_hops(rows, root, depth, outbound, limit):
    seen, queue, out = {root}, deque([(root, 0)]), []
    while queue and len(out) < limit:
        node, d = queue.popleft()
        if d == depth:
            continue
        own = [e for e in rows if (e[1] if outbound else e[2]) == node][:limit]
        for e in own:
            other = e[2] if outbound else e[1]
            if other not in seen and len(out) < limit:
                seen.add(other)
                out.append((other, node, e[3], d + 1, e[4], e[5]))
                queue.append((other, d + 1))
    return out


@pytest.mark.parametrize("seed, depth, outbound, limit", [(1, 2, True, 80), (2, 4, True, 7), (3, 3, False, 12), (4, 1, False, 1), (5, 4, True, 200)])
def test_hops(spark, seed, depth, outbound, limit):
    rows = random_edges(seed)
    got = [tuple(r) for r in graph.hops(frame(spark, rows), "n0", depth, outbound, limit).collect()]
    assert got == plain_hops(rows, "n0", depth, outbound, limit)


def plain_impact(rows, root, depth, cap, direction):
    known, nodes, edges, have = {root}, [(root, 0)], [], set()
    frontier, truncated = [root], False
    for d in range(1, depth + 1):
        found = []
        for node in frontier:
            near = []
            if direction in ("both", "out"):
                near += [(e[2], e) for e in [e for e in rows if e[1] == node][:cap] if e[3] in OUTBOUND_KINDS]
            if direction in ("both", "in"):
                near += [(e[1], e) for e in [e for e in rows if e[2] == node][:cap]]
            for other, e in near:
                if other not in known:
                    if len(known) >= cap:
                        truncated = True
                        continue
                    known.add(other)
                    nodes.append((other, d))
                    found.append(other)
                if e[1:] not in have:
                    have.add(e[1:])
                    edges.append(e[1:])
        frontier = found
    return nodes, edges, truncated or len(known) >= cap


@pytest.mark.parametrize("seed, depth, cap, direction", [(1, 2, 40, "both"), (2, 4, 10, "both"), (3, 3, 6, "out"), (4, 2, 5, "in"), (5, 4, 80, "both")])
def test_impact(spark, seed, depth, cap, direction):
    rows = random_edges(seed)
    g = graph.impact(frame(spark, rows), "n0", depth, cap, direction)
    assert (g.nodes, g.edges, g.truncated) == plain_impact(rows, "n0", depth, cap, direction)
    assert g.node_frame(spark).count() == len(g.nodes)


def test_impact_reads_relations_first(spark):
    rel = f"array<{REL}>"
    owners = spark.createDataFrame([("n0", [("calls", "n1", "n1", None, 3, None)], [("referencedBy", "n2", "n2", "f", None, None)])], f"id string, dependencies {rel}, consumers {rel}")
    edges = frame(spark, [(1, "n0", "n1", "calls", None, 3)])
    g = graph.impact(edges, "n0", 1, owners=owners)
    assert ("n0", "n1", "Calls", None, 3) in g.edges and ("n2", "n0", "referencedBy", "f", None) in g.edges


def test_closure_ends_in_cycles(spark):
    rows = [(1, "b", "a", "inherits", None, None), (2, "c", "b", "implements", None, None), (3, "a", "c", "inherits", None, None), (4, "d", "c", "calls", None, None), (5, "e", "c", "inherits", None, None)]
    got = {tuple(r) for r in graph.closure(frame(spark, rows), "a", ("inherits", "implements")).collect()}
    assert got == {("b", 1), ("c", 2), ("e", 3)}
    assert graph.closure(frame(spark, []), "a", ("inherits",)).count() == 0


def test_sites(spark):
    refs = spark.createDataFrame(
        [("t", "m1", "T1", "method", "One", "a.cs", 1, 1), ("t", "m1", "T1", "method", "One", "A.CS", 1, 2), ("t", "m2", "T2", "property", "Two", "a.cs", 2, 3), ("t", "t", "T", "method", "Self", "a.cs", 2, 4), ("u", "m3", "T3", "method", "U", "a.cs", 2, 5)],
        "target_id string, container_id string, container_type_id string, container_kind string, display string, file string, line int, ord int",
    )
    sites = graph.reference_sites(refs, "t")
    assert [r["container_id"] for r in sites.collect()] == ["m1", "m2"]
    assert [r["container_id"] for r in graph.callers(refs, "t").collect()] == ["m1"]
    assert graph.unique_callers(sites).first()[0] == 2
    assert graph.reference_sites(refs, "t", 1).count() == 1
    assert [r["id"] for r in graph.consumer_types(refs, "t").collect()] == ["T", "T1", "T2"]
