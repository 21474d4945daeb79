"""Tasks follow the input, whatever the session's shuffle partitions are."""

import pytest
from pyspark.sql import functions as F

from symdex.functions.stemming import porter
from symdex.operators import extraction, relations, search
from symdex.plans import lineage
from symdex.schema import REL


@pytest.fixture
def small_share(monkeypatch):
    monkeypatch.setattr(lineage, "SHARE", 2000)


def used(df):
    """Tasks that hold rows of ``df``."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_tasks_of_files_and_of_none(spark, tmp_path, small_share):
    spark.range(10_000).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert lineage.tasks(files) > 4
    assert lineage.tasks(files, files) >= 2 * lineage.tasks(files) - 1
    assert lineage.tasks(spark.createDataFrame([(1,)], "x int"), files) == 4  # the session's


def test_consumers_are_spread_as_the_input_is(spark, tmp_path, small_share):
    rows = [(f"type:T{i % 300}", f"type:C{i % 7}") for i in range(3000)] + [("type:hot", f"type:C{i:04d}") for i in range(250)] * 2 + [("type:hot", None), ("type:hot", "type:hot"), ("type:else", "type:C1")]
    spark.createDataFrame(rows, "target_id string, container_type_id string").write.parquet(f"{tmp_path}/refs")
    spark.createDataFrame([(t,) for t in sorted({t for t, _ in rows} - {"type:else"})] * 2, "id string").write.parquet(f"{tmp_path}/targets")
    made = extraction.consumers(spark.read.parquet(f"{tmp_path}/refs"), spark.read.parquet(f"{tmp_path}/targets"))
    assert used(made) > 4
    got = {r["id"]: [c["targetId"] for c in r["consumers"]] for r in made.collect()}
    want = {t: sorted({c for x, c in rows if x == t and c and c != t}, key=lambda c: (c[5:].upper(), c))[:100] for t in {t for t, _ in rows} - {"type:else"}}
    assert got == want


def test_a_search_stems_documents_not_tokens(spark):
    docs = spark.createDataFrame([("a", "Ordering ordered orders, ÉTÉ relational", None), ("b", "", "x1 ponies"), ("c", None, None)], "id string, name string, summary string")
    post = search.postings(docs, "id", ("name", "summary"))
    plan = post._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("ArrowEvalPython")  # split after the stemmer, which takes whole lists
    got = {(r["token"], r["doc"], r["dl"], tuple(r["positions"])) for r in post.collect()}
    assert got == {("order", "a", 5, (0, 1, 2)), (porter("ete"), "a", 5, (3,)), (porter("relational"), "a", 5, (4,)), ("x1", "b", 2, (1,)), (porter("ponies"), "b", 2, (2,))}


def test_edges_are_made_once_and_numbered_in_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(relations, "RANKED", 100)
    rel = lambda to, kind: (kind, to, None, None, None, None)
    data = [(f"o{i}", [rel(f"t{i}", "calls"), rel(f"t{i}", "calls"), rel("", "calls")], [rel(f"c{i % 5}", "referencedBy")] if i % 3 else None) for i in range(500)] + [("none", None, None)]
    owners = spark.createDataFrame(data, f"id string, dependencies array<{REL}>, consumers array<{REL}>")
    made = relations.to_edges(owners)
    assert used(made) > 4
    got = made.orderBy("edge_seq").collect()
    assert [r["edge_seq"] for r in got] == list(range(1, len(got) + 1))
    want = [("o%d" % i, "t%d" % i, "calls") for i in range(500)] * 2 + [("c%d" % (i % 5), "o%d" % i, "referencedBy") for i in range(500) if i % 3]
    assert sorted((r["from_id"], r["to_id"], r["kind"]) for r in got) == sorted(want)
    place = {}
    for r in got:  # dependencies before consumers
        owner = r["from_id"] if r["kind"] == "calls" else r["to_id"]
        place.setdefault(owner, []).append(r["kind"])
    assert all(v == sorted(v) for v in place.values())
