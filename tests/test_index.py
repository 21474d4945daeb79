"""A small solution from facts to answers."""

import json

import pytest
from pyspark.sql import functions as F

from symdex.operators import catalog, change, extraction, relations, search, snippets
from symdex.plans import service
from symdex.schema import REL, conform
from symdex.sources import config, facts
from symdex.sources.store import DuplicateTypes, Store
from symdex.streaming import ingest

ORDER = "namespace Demo;\n// An order.\nclass Order : IOrder {\n  int Total() { return Sum(); }\n  // TODO: rounding\n}\n"


def make_facts(spark, order_text=ORDER):
    def frame(name, rows):
        names = [x.split(" ")[0] for x in facts.FACTS[name].replace("array<string>", "array").split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], facts.FACTS[name])

    core = dict(id="project:Core", name="Demo.Core", path="/s/Core.csproj", assembly="Demo.Core", project_xml="<TargetFrameworks>net8.0;net10.0</TargetFrameworks>", file_hash="h1", doc_count=3)
    app = dict(id="project:App", name="Demo.App", path="/s/App.csproj", assembly="Demo.App", project_xml="<TargetFramework>net8.0</TargetFramework>", file_hash="h2", doc_count=1)
    doc = lambda i, p, path, text: dict(id=f"file:{i}", project_id=p, relative_path=path, absolute_path=f"/s/{path}", text=text)
    typ = lambda i, p, name, kind, file, a, b, k, **x: dict(id=f"type:Demo.{i}", project_id=p, namespace="Demo", name=name, full_name=f"Demo.{name}", kind=kind, accessibility="public", is_generated=False, file_id=file, relative_path=file, start_line=a, end_line=b, size_chars=50, ord=k) | x
    mem = lambda i, t, name, kind, k, **x: dict(id=f"method:Demo.{i}", type_id=f"type:Demo.{t}", name=name, kind=kind, signature=f"int {name}()", accessibility="public", file_id="file:1", start_line=4, end_line=4, size_chars=30, ord=k, attributes=[], parent_attributes=[]) | x
    return facts.Facts(spark, {
        "projects": frame("projects", [core, app, core | dict(id="project:Core2", doc_count=1), dict(id="project:T", name="Demo.Tests", path="/s/T.csproj", assembly="T", doc_count=1)]),
        "documents": frame("documents", [doc(1, "project:Core", "Order.cs", order_text), doc(2, "project:Core", "Order.Pricing.cs", "partial"), doc(3, "project:Core", "X.g.cs", "generated"), doc(4, "project:App", "App.cs", "class App {}"), doc(5, "project:Core", "obj/Y.cs", "no")]),
        "types": frame("types", [
            typ("Order", "project:Core", "Order", "class", "file:1", 3, 6, 1), typ("Order", "project:Core", "Order", "class", "file:2", 1, 9, 2, xml_doc="<summary>An order aggregate.</summary>"), typ("Order", "project:Core", "Order", "class", "FILE:2", 1, 9, 3) | dict(file_id="file:2"),
            typ("IOrder", "project:Core", "IOrder", "interface", "file:1", 1, 1, 4), typ("App", "project:App", "App", "class", "file:4", 1, 1, 5), typ("Hidden", "project:App", "Hidden", "class", "file:4", 1, 1, 6, accessibility="private"), typ("Gen", "project:Core", "Gen", "class", "file:3", 1, 1, 7),
        ]),
        "members": frame("members", [
            mem("Order.Total", "Order", "Total", "method", 1, xml_doc="<summary>Adds it up.</summary>", return_type="int"), mem("Order.Sum", "Order", "Sum", "method", 2, return_type="int"), mem("Order.Sum", "Order", "Sum", "method", 3), mem("Order.Order", "Order", "Order", "constructor", 4, return_type="void"),
            mem("Order.get", "Order", "get", "method", 5, accessor=True), mem("Order.gen", "Order", "gen", "method", 6, attributes=["System.CompilerGeneratedAttribute"]), mem("App.Main", "App", "Main", "method", 7, accessibility="internal", file_id="file:4", start_line=None, end_line=None),
        ]),
        "uses": frame("uses", [
            dict(owner_id="type:Demo.Order", owner_kind="class", role="interface", target_id="type:Demo.IOrder", target_name="Demo.IOrder", target_assembly="Demo.Core", ord=1), dict(owner_id="type:Demo.Order", owner_kind="class", role="base", target_id="type:System.Object", target_name="System.Object", target_assembly="System", ord=2),
            dict(owner_id="type:Demo.Order", owner_kind="class", role="base", target_id="type:System.Enum", target_name="System.Enum", target_assembly="System", ord=3), dict(owner_id="method:Demo.App.Main", owner_kind="method", role="parameter", target_id="type:Demo.Order[]", target_name="Demo.Order[]", target_assembly="Demo.Core", ord=4),
            dict(owner_id="method:Demo.App.Main", owner_kind="method", role="parameter", target_id="type:System.Uri", target_name="System.Uri", target_assembly="System", ord=5), dict(owner_id="method:Demo.Order.Total", owner_kind="method", role="return", target_id="type:int", target_name="int", target_assembly="System", ord=6),
        ]),
        "calls": frame("calls", [dict(owner_id="method:Demo.Order.Total", target_id="method:Demo.Order.Sum", target_name="Demo.Order.Sum()", target_assembly="demo.core", file="Order.cs", line=4, ord=k) for k in (1, 2)] + [dict(owner_id="method:Demo.Order.Total", target_id="method:Console", target_name="Console.Write", target_assembly="System.Console", ord=0)]),
        "refs": frame("refs", [dict(target_id="type:Demo.Order", container_id="method:Demo.App.Main", container_type_id="type:Demo.App", container_kind="method", display="Demo.App.Main", file="App.cs", line=2, ord=1), dict(target_id="type:Demo.Order", container_id="method:Demo.Order.Sum", container_type_id="type:Demo.Order", container_kind="method", display="x", ord=2)]),
    })


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    s = service.Service(spark, path)
    answer = s.index(make_facts(spark), "/s/Demo.sln", config.Options(index_body=True))
    return s, answer


def test_totals(built):
    s, answer = built
    assert answer.text.startswith("2 projects, 3 files, 3 types, 4 members")
    meta = s.store.meta()
    assert meta["schema_version"] == "1" and meta["index_mode"] == "structure+light-deps" and int(meta["edge_count"]) == 4
    assert s.store.has_data() and s.store.has_bodies()


def test_merge_of_parts(built):
    order = built[0].store.read().types.where("id = 'type:Demo.Order'").first()
    assert [(x["fileId"], x["isPrimary"]) for x in order["locations"]] == [("file:1", True), ("file:2", False)]
    assert order["summary"] == "An order aggregate." and order["start_line"] == 3
    assert {(r["kind"], r["targetName"]) for r in order["dependencies"]} == {("implements", "Demo.IOrder"), ("inherits", "System.Enum")}


def test_members_and_edges(built):
    index = built[0].store.read()
    assert {r["name"] for r in index.members.collect()} == {"Total", "Sum", ".ctor", "Main"}
    assert {(r["from_id"], r["to_id"], r["kind"]) for r in index.edges.collect()} == {
        ("type:Demo.Order", "type:Demo.IOrder", "implements"), ("type:Demo.Order", "type:System.Enum", "inherits"), ("method:Demo.App.Main", "type:Demo.Order", "usesInSignature"), ("method:Demo.Order.Total", "method:Demo.Order.Sum", "calls"),
    }
    assert {r["target_framework"] for r in index.projects.collect()} == {"net8.0", "net8.0 (of net8.0;net10.0)"}
    assert all(r["token_estimate"] > 0 for r in index.types.collect())


def test_names(built):
    index = built[0].store.read()
    resolve = lambda q, **k: catalog.resolve_member(index.members, index.types, index.source_files, q, **k).collect()
    for q in ("Demo.Order", "type:Demo.Order", "Order"):
        assert catalog.resolve_type(index.types, index.source_files, q).first()["id"] == "type:Demo.Order"
    assert resolve("Demo.Order.Total")[0]["match_rank"] == 0  # an id without its prefix
    assert resolve("Order.Total")[0]["match_rank"] == 4
    assert resolve("Total")[0]["match_rank"] == 3
    assert resolve("otal")[0]["name"] == "Total" and not resolve("otal", strict=True)
    assert not resolve("nobody")


def test_search(built):
    index = built[0].store.read()
    assert [r["id"] for r in search.search(index, "aggregate").collect()] == ["type:Demo.Order"]
    assert [r["category"] for r in search.search(index, "rder", "type").collect()] == ["type", "type"]  # by LIKE
    assert [r["id"] for r in search.search(index, "totals", "member").collect()] == ["method:Demo.Order.Total"]
    assert set(index.search) == {"type", "member", "body"}
    shown = search.described(search.search(index, "aggregates"), index).collect()
    assert [(r["kind"], r["summary"], r["relative_path"], r["start_line"]) for r in shown] == [("class", "An order aggregate.", "Order.cs", 3)]
    shown = search.described(search.search(index, "adding", "member"), index).collect()
    assert [(r["parent_type"], r["signature"]) for r in shown] == [("Demo.Order", "int Total()")]
    body = search.search(index, "TODO", body=True).collect()
    assert [(r["name"], r["line"], r["text"]) for r in body] == [("Order.cs", 5, "// TODO: rounding")]
    assert search.search(index, "demo.ord", "type").count() == 1  # a phrase with a prefix


def test_accents_and_stems_are_folded(spark):
    bodies = spark.createDataFrame([("a", "le café crème"), ("b", "CAFE\u0301 ouvert"), ("c", "cafeteria"), ("d", "nothing")], "file_id string, content string").withColumn("relative_path", F.col("file_id"))
    find = lambda q: sorted(r["id"] for r in search.search_bodies(bodies, q, 10).collect())
    assert find("cafe") == find("CAFÉ") == ["a", "b", "c"] and find("creme") == ["a"] and find("nothings") == ["d"]
    assert search.folded("Ångström ŒÎ") == "angstrom œi"


def test_an_update_writes_what_changed(spark, tmp_path):
    s = service.Service(spark, str(tmp_path / "u"))
    s.index(make_facts(spark), "/s/Demo.sln", config.Options(index_body=True))
    first = s.store.folders(s.store.version())
    s.save_consumers(make_facts(spark)["refs"], "type:Order")
    second = s.store.folders(s.store.version())
    assert {t for t in first if first[t] != second[t]} == {"types", "edges", "edges_in", "meta", "postings_type", "stats_type", "postings_member", "stats_member"}
    s.save_consumers(make_facts(spark)["refs"], "full")
    kept = s.store.folders(s.store.version())
    assert kept["bodies"] == first["bodies"] and s.store.read().bodies.count() == 3 and search.search(s.store.read(), "TODO", body=True).count() == 1
    import os

    assert not os.path.exists(f"{s.store.path}/{first['types']}") and os.path.exists(f"{s.store.path}/{first['bodies']}")


def test_answers(built, spark):
    s, _ = built
    assert "An order aggregate." in s.get("Order").text and "Parts:" in s.get("Order").text
    assert "# method Demo.Order.Total" in s.get("Total()").text
    assert s.get("nothing at all").code == service.NO_MATCH
    assert "   4|   int Total()" in s.snippet("Order.Total").text
    assert "Order.Total" in s.callers("Sum").text
    assert s.callers("Main").code == service.NO_MATCH
    assert "Demo.Order" in s.implementations("IOrder").text
    assert "Depth 1" in s.impact("Total").text
    assert "Total" in s.hotspots("calls").text and s.hotspots("fanin").code == service.NO_MATCH
    assert "grade" not in s.quality().text and s.quality().code == 0
    assert s.doctor().code == service.OK
    text = s.overview(members=True).text
    assert "## Demo.Core (net8.0 (of net8.0;net10.0))" in text and "- class Demo.Order : Demo.IOrder, System.Enum" in text and "~" in text
    assert s.query("aggregate").code == 0 and s.query("zzz").code == service.NO_MATCH and s.query(" ").code == service.ERROR
    assert s.consumers("Order", make_facts(spark)["refs"]).text.count("- ") == 1


def test_empty(spark, tmp_path):
    s = service.Service(spark, str(tmp_path / "none"))
    assert s.status().code == 0 and s.query("x").code == service.EMPTY and s.doctor().code == service.ERROR
    index = s.store.read()
    assert search.search(index, "x").count() == 0 and catalog.list_types(index.types, index.members).count() == 0
    from symdex.operators import analytics

    assert analytics.quality(index.types, index.members).first()["grade"] == "empty"


def test_incremental(spark, tmp_path):
    s = service.Service(spark, str(tmp_path / "i"))
    options = config.Options(changed_only=True)
    s.index(make_facts(spark), "/s/Demo.sln", options)
    assert "2 projects reused, 0 indexed again" in s.index(make_facts(spark), "/s/Demo.sln", options).text
    changed = make_facts(spark, ORDER + "// more")
    current = extraction.source_files(changed["documents"]).join(changed["projects"].where("id IN ('project:Core', 'project:App')").select(F.col("id").alias("p")), F.col("project_id") == F.col("p"), "left_semi")
    stale = s.staleness(current)
    assert stale.code == service.STALE and "changed Order.cs" in stale.text
    text = s.index(changed, "/s/Demo.sln", options).text
    assert "1 projects reused, 1 indexed again" in text and "3 types, 4 members" in text
    assert s.staleness(current).code == 0
    assert "other options" in s.index(changed, "/s/Demo.sln", config.Options(changed_only=True, max_calls=5)).text


def comparable(tables):
    """Every table as sets of rows; edges without their numbers."""
    return {name: sorted(repr(r) for r in conform(df, name).drop("edge_seq").collect()) for name, df in tables.items()}


@pytest.fixture(scope="module")
def old_tables(spark):
    return facts.build(make_facts(spark), "/s/Demo.sln", config.Options(relations=("type:App",)))


@pytest.mark.parametrize("then", [dict(index_body=True, full_relations=True), dict()])
def test_an_incremental_index_is_a_full_one(spark, old_tables, then):
    """Also where bodies and consumers are turned on or off."""
    changed, options = make_facts(spark, ORDER + "// more"), config.Options(**then)
    made, plan = facts.rebuild(changed, "/s/Demo.sln", options, old_tables)
    assert {r["action"] for r in plan.collect()} == {"reuse", "rebuild"}
    got = comparable(made)
    assert got == comparable(facts.build(changed, "/s/Demo.sln", options))
    assert len(got.get("bodies", ())) == (3 if then else 0)


def test_a_new_assembly_is_no_reuse(spark):
    """What counts as external, and so the relations of every project, depends on all assemblies."""
    one, more = make_facts(spark), make_facts(spark)
    row = spark.createDataFrame([("project:Sys", "Sys", "/s/Sys.csproj", "System", None, "h", 1)], facts.FACTS["projects"])
    more.tables["projects"] = more["projects"].unionByName(row)
    a, b = (facts.assemblies_hash(f, config.Options()).first()["hash"] for f in (one, more))
    assert a and b and a != b


def test_bodies_are_whole_unless_asked_otherwise(spark, tmp_path):
    long = ORDER + "x" * 2000
    for limit, want in ((0, len(long)), (500, None)):
        made = facts.build(make_facts(spark, long), "/s/Demo.sln", config.Options(index_body=True, max_body_chars=limit))
        got = {r["file_id"]: len(r["content"]) for r in made["bodies"].collect()}
        assert got.get("file:1") == want and got["file:4"] == len("class App {}")


def test_a_hop_skips_most_edges(spark, tmp_path):
    rows = spark.range(400_000).selectExpr("id + 1 AS edge_seq", "concat('n', lpad(id % 9973, 5, '0')) AS from_id", "concat('m', lpad(id % 7919, 5, '0')) AS to_id", "'calls' AS kind", "CAST(NULL AS string) AS file", "CAST(NULL AS int) AS line")
    s = Store(spark, str(tmp_path / "e"))
    s.write({"edges": rows.repartition(8)})
    index = s.read()
    for df, key, node in ((index.edges, "from_id", "n00500"), (index.edges_in, "to_id", "m07000")):
        some = df.where(F.col(key) == node)
        n = len(some.collect())
        plan = some._jdf.queryExecution().executedPlan()
        scan = next(x for x in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size())))
        assert n in (41, 40, 50, 51) and scan.metrics().apply("numOutputRows").value() < 200_000


def test_consumers_are_kept(spark, tmp_path):
    s = service.Service(spark, str(tmp_path / "c"))
    f = make_facts(spark)
    s.index(f, "/s/Demo.sln")
    s.save_consumers(f["refs"], "type:Order")
    index = s.store.read()
    assert [r["targetId"] for r in index.types.where("id = 'type:Demo.Order'").first()["consumers"]] == ["type:Demo.App"]
    assert index.edges.where("kind = 'referencedBy'").count() == 1
    s.save_consumers(f["refs"], "full")
    assert s.store.read().edges.where("kind = 'referencedBy'").count() == 1
    assert s.store.meta()["index_mode"] == "full-relations"
    assert "Demo.App" in s.consumers("Order").text


def test_duplicate_types_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p1"), ("t", "p2")], "id string, project_id string")
    with pytest.raises(DuplicateTypes):
        Store(spark, str(tmp_path / "d")).write({"types": conform(rows, "types")})


def test_old_index_gets_its_edges(spark, tmp_path):
    s = Store(spark, str(tmp_path / "o"))
    rows = spark.createDataFrame([("A", [("implements", "B", "B", None, None, None)])], f"id string, dependencies array<{REL}>")
    s.write({"types": conform(rows, "types")}, {"schema_version": "0"})
    assert [(r["from_id"], r["to_id"], r["kind"]) for r in s.read().edges.collect()] == [("A", "B", "implements")]


def test_relation_json(spark):
    good = [{"kind": "calls", "targetId": "x", "targetName": "X", "file": "f", "line": 3}]
    cases = [None, "", "[]", "{", '{"kind":"calls","targetId":"x"}', '[{"kind":"odd","targetId":"x"}]', json.dumps(good)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, j string").select("i", relations.parse(F.col("j")).alias("r"), relations.write(relations.parse(F.col("j"))).alias("w")).orderBy("i")
    rows = df.collect()
    assert [len(r["r"]) for r in rows] == [0] * 6 + [1]
    assert json.loads(rows[-1]["w"]) == good


def test_slices(spark):
    rel = [("calls", "a", "A(int)", None, None, None), ("usesInSignature", "b", "B", None, None, None), ("implements", "c", "C", None, None, None)]
    df = spark.createDataFrame([("o", rel, [])], f"id string, dependencies array<{REL}>, consumers array<{REL}>")
    r = relations.relation_slice(df).first()
    assert (r["calls_names"], r["signature_names"], r["signature_total"], r["structural_names"]) == (["A"], [], 1, ["C"])
    assert relations.relation_slice(df, full=True).first()["signature_names"] == ["B"]


def test_call_cap_counts_before_repeats_go(spark):
    rows = [("o", t, t, "a", False, False, k) for k, t in enumerate("xxyz")]
    calls = spark.createDataFrame(rows, "owner_id string, target_id string, target_name string, target_assembly string, is_creation boolean, is_abstract boolean, ord int")
    own = spark.createDataFrame([("A",)], "assembly string")
    got = extraction.capped_calls(calls, own, 3).orderBy("call_rank").collect()
    assert [(r["target_id"], r["call_rank"]) for r in got] == [("x", 1), ("y", 3)]


def test_snippet_lines(spark):
    bodies = spark.createDataFrame([("f", "a\r\nb\nc\nd")], "file_id string, content string")
    spans = spark.createDataFrame([("s", "f", 2, 3), ("late", "f", 9, 9), ("back", "f", 3, 1), ("none", None, 1, 1)], "id string, file_id string, start_line int, end_line int")
    got = {r["id"]: r["text"] for r in snippets.snippet_text(snippets.snippet(bodies, spans)).collect()}
    assert got == {"s": "   2| b\n   3| c", "back": "   3| c"}


def test_project_file_changes(spark):
    p = spark.createDataFrame([("p", "P", "h"), ("q", "Q", "h"), ("r", "R", None)], "id string, name string, file_hash string")
    none = spark.createDataFrame([], "project_id string, relative_path string, content_hash string")
    now = spark.createDataFrame([("p", "h2"), ("r", None)], "id string, file_hash string")
    got = {r["id"]: r["reasons"] for r in change.stale_projects(p, none, none, now).collect()}
    assert got == {"p": "changed project file", "q": "missing project file"}
    assert change.is_stale(change.stale_projects(p, none, none)).first()["is_stale"] is False


def test_stream(spark, tmp_path):
    store, src = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    rows = [("f1", "p", "a.cs", "/a.cs", "one", False, 1), ("f1", "p", "a.cs", "/a.cs", "two", False, 2), ("f2", "p", "b.cs", "/b.cs", "x", False, 1), ("f3", "p", "c.g.cs", "/c.g.cs", "x", False, 1)]
    spark.createDataFrame(rows, ingest.CHANGES).write.parquet(src)
    ingest.start(store, ingest.read_changes(spark, src), str(tmp_path / "c")).awaitTermination()
    assert {(r["file_id"], r["content"]) for r in store.read().bodies.collect()} == {("f1", "two"), ("f2", "x")}
    assert [r["id"] for r in search.search(store.read(), "two", body=True).collect()] == ["f1"]
    spark.createDataFrame([("f2", "p", "b.cs", "/b.cs", None, True, 5)], ingest.CHANGES).write.mode("append").parquet(src)
    ingest.start(store, ingest.read_changes(spark, src), str(tmp_path / "c")).awaitTermination()
    assert {r["id"] for r in store.read().source_files.collect()} == {"f1"}
    assert search.search(store.read(), "x", body=True).count() == 0 and search.search(store.read(), "two", body=True).count() == 1
    assert not ingest.apply_batch(store, spark.createDataFrame(rows, ingest.CHANGES), 1)


def test_config(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / config.FILE_NAME).write_text('{ // note\n "db": "x//y", "includePrivate": true, "max_calls": 0, "relations": ["type:A",], }')
    found = config.discover(str(tmp_path / "a" / "b"))
    assert found.db == "x//y"
    o = config.merged(found)
    assert o.include_private and o.max_calls == 1 and o.scopes() == ("type:A",) and o.mode() == "full-relations"
    assert config.merged(found, include_private=False, relations=["full"]).scopes() == ("full",)
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.json"))


def test_entry_path(tmp_path):
    with pytest.raises(FileNotFoundError):
        config.entry_path(str(tmp_path))
    (tmp_path / "a.csproj").write_text("")
    assert config.entry_path(str(tmp_path)).endswith("a.csproj")
    (tmp_path / "a.sln").write_text("")
    assert config.entry_path(str(tmp_path)).endswith("a.sln")
    (tmp_path / "b.sln").write_text("")
    with pytest.raises(ValueError):
        config.entry_path(str(tmp_path))
    with pytest.raises(ValueError):
        config.entry_path(__file__)


def test_command_line(built, spark, capsys, tmp_path):
    s, _ = built
    run = lambda *a: service.main(["--db", s.store.path, *a], spark)
    assert run("status") == 0 and "3 types" in capsys.readouterr().out
    assert run("query", "aggregate", "--format", "json") == 0
    (hit,) = json.loads(capsys.readouterr().out)["hits"]
    assert (hit["category"], hit["kind"], hit["name"], hit["summary"], hit["relativePath"], hit["startLine"]) == ("type", "class", "Demo.Order", "An order aggregate.", "Order.cs", 3)
    assert run("get", "Order", "--format", "json", "--detail", "full", "--out", str(tmp_path / "o.json")) == 0
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["lines"] == {"start": 3, "end": 6, "count": 4} and got["relations"]["structural"] == {"total": 2, "names": ["Demo.IOrder", "System.Enum"], "truncated": False} and {m["name"] for m in got["members"]} == {"Total", "Sum", ".ctor"}
    assert run("get", "nobody") == service.NO_MATCH and run("hotspots", "--by", "types", "--format", "json") == 0
    assert run("impact", "Total", "--depth", "1", "--format", "json") == 0
    g = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert {n["name"] for n in g["nodes"]} == {"Demo.Order.Total", "Demo.Order.Sum"} and g["edges"][0]["kind"] == "Calls"


def test_staleness_has_an_exit_code_and_doctor_tells(built, spark):
    s, _ = built
    same, changed = make_facts(spark), make_facts(spark, ORDER + "// more")
    assert s.status(same).code == service.OK
    stale = s.status(changed)
    assert stale.code == service.STALE and "changed Order.cs" in stale.text and stale.data["is_stale"] and stale.data["bytes"] > 0
    checks = {c["name"]: c for c in service.doctor(spark, s.store.path, changed)}
    assert not checks["staleness"]["ok"] and checks["writable"]["ok"] and not checks["entry_path"]["ok"] and service.passed(list(checks.values()))


def test_callers_are_kept_on_request(built, spark):
    s, _ = built
    rows = [("method:Demo.Order.Sum", "method:Demo.App.Main", "type:Demo.App", "method", "Demo.App.Main", "App.cs", 2, 1)]
    refs = spark.createDataFrame(rows, "target_id string, container_id string, container_type_id string, container_kind string, display string, file string, line int, ord int")
    answer = s.callers("Sum", refs, update=True)
    assert answer.data["unique"] == 1
    index = s.store.read()
    assert [r["targetId"] for r in index.members.where("id = 'method:Demo.Order.Sum'").first()["consumers"]] == ["method:Demo.App.Main"]
    assert index.edges.where("kind = 'referencedBy'").count() == 1
    assert "App.Main" in s.callers("Sum").text and "Order.Total" in s.callers("Sum").text


def test_bodies_from_disk_and_lines_of_files(spark, tmp_path):
    s = Store(spark, str(tmp_path / "f"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.cs").write_text("one\ntwo\nthree\n")
    (tmp_path / "src" / "Empty.cs").write_text("")
    rows = [(f"file:{n}", "p", f"src\\{n}.cs", f"{tmp_path}/src/{n}.cs") for n in ("A", "Empty", "Gone")]
    s.write({"source_files": spark.createDataFrame(rows, "id string, project_id string, relative_path string, absolute_path string")})
    service_ = service.Service(spark, s.path)
    assert service_.load_bodies(str(tmp_path / "src")).data == {"bodies": 1} and s.has_bodies()
    assert service_.snippet("src/A.cs:2-3").text == "   2| two\n   3| three" and service_.snippet("src/A.cs:2").data["text"] == "   2| two"
    assert service_.snippet("src/B.cs:2").code == service.NO_MATCH
