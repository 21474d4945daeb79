import pytest
from pyspark.sql import functions as F

from symdex.functions import policies, render, scalars
from symdex.functions.stemming import porter
from symdex.operators import extraction, search, snippets


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_token_estimates(spark):
    texts = [None, "", "a", "abcd", "abcde", "x" * 9]
    assert one(spark, *[scalars.tokens(F.lit(t).cast("string")) for t in texts]) == (0, 0, 1, 1, 2, 3)
    assert one(spark, scalars.tokens(F.lit("😀" * 3)), scalars.tokens(F.lit("😀" * 3), utf16=True)) == (1, 2)
    assert one(spark, scalars.tokens_of(F.lit("a"), F.lit("b"), F.lit(None).cast("string"))) == (2,)


def test_names(spark):
    ids = ["type:A.B.C", "method:A.B.Run(int)", "type:A.B", "plain"]
    assert one(spark, *[scalars.short_id(F.lit(i)) for i in ids]) == ("B.C", "B.Run", "B", "plain")
    assert one(spark, *[scalars.kind_of_id(F.lit(i)) for i in ids]) == ("type", "method", "type", "member")
    assert one(spark, scalars.relation_name(F.lit("Run(int)"), F.lit("x")), scalars.relation_name(F.lit(""), F.lit("id")), scalars.relation_name(F.lit("y" * 90), F.lit(""))) == ("Run", "id", "y" * 79 + "…")
    assert one(spark, scalars.site_label(F.lit(None).cast("string"), F.lit("a\\b.cs"), F.lit(3)), scalars.site_label(F.lit("here"), F.lit("b"), F.lit(3)), scalars.site_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(3))) == ("b.cs:L3", "here", "L3")
    assert one(spark, scalars.namespace_id(F.lit("p"), F.lit("")), scalars.namespace_id(F.lit("p"), F.lit("N"))) == ("ns:p:global", "ns:p:N")


@pytest.mark.parametrize("text, want", [("Order", "%Order%"), (" a_b% ", "%ab%"), ("", "%"), ("_%", "%")])
def test_like_pattern(spark, text, want):
    assert one(spark, scalars.like_pattern(F.lit(text))) == (want,)
    assert search.like_text(text) == want


def test_query_tokens(spark):
    assert one(spark, scalars.query_tokens(F.lit("TODO replace, persistence!"))) == (["TODO", "replace", "persistence"],)
    assert search.query_terms("Demo.Core x_y") == [["demo", "core"], ["x", "y"]]
    assert search.query_terms("!? --") == []


def test_line_counts(spark):
    rows = [(1, 3), (3, 3), (3, 1), (None, 2)]
    got = spark.createDataFrame(rows, "a int, b int").select(F.coalesce(scalars.line_count(F.col("a"), F.col("b")), F.lit(0))).collect()
    assert [r[0] for r in got] == [3, 1, 0, 0]


def test_frameworks(spark):
    xml = ["<TargetFramework>net8.0</TargetFramework>", "<TargetFrameworks>net8.0;net10.0</TargetFrameworks>", "<x/>"]
    assert one(spark, *[scalars.framework(F.lit(x)) for x in xml]) == ("net8.0", "net8.0 (of net8.0;net10.0)", None)


def test_policies(spark):
    def test(name, path="/x/y.csproj"):
        return policies.test_project(F.lit(name), F.lit(path))

    assert one(spark, test("MyApp.Tests"), test("MyApp.Test"), test("MyApp"), test("MyApp", r"C:\src\Tests\a.csproj")) == (True, True, False, True)
    paths = [r"a\obj\b.cs", "a/bin/b.cs", "a/Migrations/b.cs", None, "a/b.cs"]
    assert one(spark, *[policies.skipped_path(F.lit(p).cast("string")) for p in paths]) == (True, True, True, True, False)
    generated = ["a.g.cs", "a.Designer.cs", "x/Generated/a.cs", "OrderService.cs"]
    assert one(spark, *[policies.generated_path(F.lit(p)) for p in generated]) == (True, True, True, False)
    assert one(spark, policies.skipped_document(F.lit("a.g.cs"), True), policies.skipped_document(F.lit("a/obj/a.g.cs"), True)) == (False, True)
    assert one(spark, *[policies.external_assembly(F.lit(a)) for a in ("System.Runtime", "System", "Microsoft.Extensions.Logging", "Demo.App", "Systematic")]) == (True, True, True, False, False)
    cases = [("*.Tests", "Demo.Tests", True), ("Benchmarks", "MyBenchmarks", True), ("*.Tests", "Demo.App", False), ("*.Tests", "Foo.Bar.Tests", True)]
    for pattern, name, want in cases:
        assert one(spark, policies.excluded(F.lit(name), [pattern])) == (want,)
    assert one(spark, policies.xml_summary(F.lit("<doc><summary> An <c>order</c>\n here </summary></doc>")), policies.xml_summary(F.lit("<doc/>"))) == ("An order here", None)
    assert one(spark, *[policies.visible(F.lit(a)) for a in ("public", "private", "protected internal")]) == (True, False, True)


@pytest.mark.parametrize("text, want", [("full", ("full", None)), ("type:X", ("type", "X")), ("class:X", ("type", "X")), ("project:X", ("project", "X"))])
def test_scopes(text, want):
    assert extraction.parse_scope(text) == want


@pytest.mark.parametrize("text", ["", "type:", "unknown:x"])
def test_bad_scopes(text):
    with pytest.raises(ValueError):
        extraction.parse_scope(text)


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("electrical", "electr"), ("sky", "sky"), ("orders", "order"), ("generalizations", "gener")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_caps():
    assert render.clamp(9999, render.HITS, render.HARD_HITS) == 100
    assert render.clamp(9999, render.MEMBERS, render.HARD_MEMBERS) == 200
    assert snippets.caps(99, 99_000) == (20, 8_000)
    long = render.finish("x" * 50_000)
    assert len(long) < 12_100 and "cut at" in long
    assert "truncated" in render.capped_json(["y" * 20_000])


def test_snippets_from_disk(tmp_path):
    (tmp_path / "a.cs").write_text("one\ntwo\nthree\nfour")
    got = snippets.read(str(tmp_path), "a.cs", 2, 3)
    assert got.ok and got.text == "   2| two\n   3| three"
    assert not snippets.read(str(tmp_path), "../a.cs", 1, 1).ok
    assert not snippets.read(str(tmp_path), "%2e%2e/a.cs", 1, 1).ok
    assert not snippets.read(None, "/etc/passwd", 1, 1).ok
    assert not snippets.read(str(tmp_path), "/etc/passwd", 1, 1).ok
    (tmp_path / "link.cs").symlink_to("/etc/passwd")
    assert not snippets.read(str(tmp_path), "link.cs", 1, 1).ok


def test_first_match(spark):
    text = "line1\n// TODO: fix me\nline3\n"
    m = search.first_match(F.lit(text), ["TODO"])
    assert one(spark, m["line"], m["text"]) == (2, "// TODO: fix me")
    m = search.first_match(F.lit("\n  a\n"), [])
    assert one(spark, m["line"], m["text"]) == (1, "  a")
    m = search.first_match(F.lit("\n\n"), ["x"])
    assert one(spark, m["line"], m["text"]) == (1, None)
