"""Full-text search: postings, BM25 with prefix terms, the LIKE fallback, and line location in bodies.

Tokens are runs of letters and digits, lower-cased, without accents, and by
default stemmed.  Postings are made once, when an index is stored, in order of
the token; a search reads those of its terms, in one scan, and brings its hits,
at most 200, to the driver.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, cut
from ..functions.stemming import porter, stems
from .catalog import clamp

K1, B = 1.2, 0.75
INDEX_TOKEN = r"[\p{L}\p{N}]+"
#: What is searched of each category, in this order.
FIELDS = {"type": ("full_name", "name", "summary"), "member": ("type_full_name", "name", "signature", "summary"), "body": ("content",)}
HIT = "category string, id string, name string, score double"


@cache
def _accents() -> tuple[str, str]:
    """Lower-case letters with accents and the letters that they stand for; accents by themselves stand for nothing."""
    with_, without = [], []
    for code in range(0xC0, 0x2100):
        c = chr(code)
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and unicodedata.category(base)[0] == "L" and all(unicodedata.category(m) == "Mn" for m in marks):
            with_.append(c)
            without.append(base)
    return "".join(with_) + "".join(map(chr, range(0x300, 0x370))), "".join(without)


def fold(text: Column) -> Column:
    """ASCII, of as many bytes as letters, has no accents, and the translation takes a map lookup for each letter."""
    plain = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(F.translate(plain, *_accents()))


def folded(text: str) -> str:
    with_, without = _accents()
    return text.lower().translate({ord(c): (without[i] if i < len(without) else None) for i, c in enumerate(with_)})


def query_terms(text: str, stemmed: bool = False) -> list[list[str]]:
    """The first 12 query tokens, each as the index tokens that it is a phrase of."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}_.]+", text)[:12]
    terms = [t for t in (regex.findall(INDEX_TOKEN, folded(f)) for f in found) if t]
    return [[porter(x) for x in t] for t in terms] if stemmed else terms


def like_text(text: str) -> str:
    bare = re.sub("[%_]", "", text.strip())
    return f"%{bare}%" if bare else "%"


def _tokens(field: str) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(field, F.lit(""))), F.lit(INDEX_TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str, fields: tuple[str, ...] | list[str], stemmed: bool = True) -> DataFrame:
    """(token, doc, dl, positions): positions count over all fields, with a gap between two; dl is the document's tokens.

    A document is split once, and stemmed as one list, so that a search drops
    the tokens that it doesn't want where they are made.
    """
    gap = F.array(F.lit(""))
    whole = F.concat(*[x for f in fields for x in (_tokens(f), gap)][:-1])
    split = docs.select(F.col(id_col).alias("doc"), whole.alias("tokens"))
    if stemmed:
        split = split.withColumn("tokens", stems("tokens"))
    dl = F.size("tokens") - (len(fields) - 1)
    rows = split.select("doc", dl.alias("dl"), F.posexplode("tokens").alias("pos", "token")).where("token <> ''")
    return rows.groupBy("token", "doc", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def stats(docs: DataFrame, fields: tuple[str, ...] | list[str]) -> DataFrame:
    """One row: number of documents and their average length."""
    dl = reduce(lambda a, b: a + b, [F.size(_tokens(f)) for f in fields])
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg(dl), F.lit(0.0)).alias("avg_dl"))


def documents(types: DataFrame, members: DataFrame, bodies: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """What is searched in each category, and the column that names it."""
    named = types.select(F.col("id").alias("_t"), F.col("full_name").alias("type_full_name"))
    return {"type": (types, "id"), "member": (members.join(named, F.col("type_id") == F.col("_t")), "id"), "body": (bodies, "file_id")}


@dataclass(frozen=True)
class Postings:
    """Postings of one category and their statistics."""

    rows: DataFrame
    stats: DataFrame
    stemmed: bool = True

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, category: str, stemmed: bool = True) -> Postings:
        return cls(postings(docs, id_col, FIELDS[category], stemmed), stats(docs, FIELDS[category]), stemmed)


def bm25(post: DataFrame, stat: DataFrame, terms: list[list[str]]) -> DataFrame:
    """(doc, score) of documents that match every term; a better score is lower.

    A term is a phrase whose last token is a prefix.  Postings are scanned
    once: each that a term has a part of gives its positions, moved back by the
    part's place, and a phrase is where all its parts agree.
    """
    if not terms:
        return post.select("doc", F.lit(0.0).alias("score")).limit(0)
    token = F.col("token")
    parts = [(k, j, token.startswith(t) if j == len(term) - 1 else token == t) for k, term in enumerate(terms) for j, t in enumerate(term)]
    place = F.array(*[F.when(hit, F.struct(F.lit(k).alias("term"), F.lit(j).alias("part"))) for k, j, hit in parts])
    some = post.where(reduce(lambda a, b: a | b, [hit for *_, hit in parts])).select("doc", "dl", "positions", F.explode(F.array_compact(place)).alias("at"))
    moved = F.transform("positions", lambda p: p - F.col("at.part"))
    own = [F.flatten(F.collect_list(F.when(F.col("at.part") == j, moved))).alias(f"p{j}") for j in range(max(map(len, terms)))]
    met = some.groupBy(F.col("at.term").alias("term"), "doc", "dl").agg(*own)
    length = F.element_at(F.array(*[F.lit(len(t)) for t in terms]), F.col("term") + 1)
    both = F.col("p0")
    for j in range(1, len(own)):
        both = F.when(length > j, F.array_intersect(both, f"p{j}")).otherwise(both)
    hits = met.select("term", "doc", "dl", F.size(both).alias("tf")).where("tf > 0")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    joined = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stat))  # 12 rows at most, and one
    idf = F.greatest(F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return joined.groupBy("doc").agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("_terms")).where(F.col("_terms") == len(terms)).drop("_terms")


def _top(post: Postings, text: str, limit: int) -> DataFrame | None:
    """(doc, score) of the best, at most 200, or None if there are none."""
    scored = bm25(post.rows, post.stats, query_terms(text, post.stemmed))
    rows = scored.orderBy("score", "doc").limit(min(limit, 200)).collect()
    return post.rows.sparkSession.createDataFrame([tuple(r) for r in rows], "doc string, score double") if rows else None


def like_types(types: DataFrame, text: str, limit: int) -> DataFrame:
    p = like_text(text)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(p), F.lit(False)) for c in ("full_name", "name", "summary")])
    return types.where(hit).orderBy("full_name", "id").limit(limit).select(F.lit("type").alias("category"), "id", F.col("full_name").alias("name"), F.lit(None).cast("double").alias("score"))


def like_members(members: DataFrame, types: DataFrame, text: str, limit: int) -> DataFrame:
    """The type's name isn't searched, but the order is by it."""
    p = like_text(text)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(p), F.lit(False)) for c in ("name", "signature", "summary")])
    named = types.select(F.col("id").alias("_t"), "full_name")
    rows = members.where(hit).select("id", "type_id", "name").join(named, F.col("type_id") == F.col("_t"))
    return rows.orderBy("full_name", "name", "id").limit(limit).select(F.lit("member").alias("category"), "id", "name", F.lit(None).cast("double").alias("score"))


def search_types(types: DataFrame, text: str, limit: int, post: Postings | None = None) -> DataFrame:
    """Types by BM25, or by LIKE if no token matches."""
    top = _top(post or Postings.of(types, "id", "type"), text, limit)
    if top is None:
        return like_types(types, text, limit)
    found = types.select("id", F.col("full_name").alias("name")).join(F.broadcast(top), F.col("id") == F.col("doc"))  # at most 200
    return found.select(F.lit("type").alias("category"), "id", "name", "score")


def search_members(members: DataFrame, types: DataFrame, text: str, limit: int, post: Postings | None = None) -> DataFrame:
    """Members by BM25, or by LIKE if no token matches."""
    top = _top(post or Postings.of(documents(types, members, types)["member"][0], "id", "member"), text, limit)
    if top is None:
        return like_members(members, types, text, limit)
    found = members.select("id", "name").join(F.broadcast(top), F.col("id") == F.col("doc"))  # at most 200
    return found.select(F.lit("member").alias("category"), "id", "name", "score")


def first_match(content: Column, tokens: list[str]) -> Column:
    """struct(line, text): the first line with any token; without tokens line 1 and the first line that isn't blank."""
    lines = F.split(F.regexp_replace(content, r"\r\n?", "\n"), "\n", -1)
    said = F.filter(lines, lambda x: F.length(F.trim(x)) > 0)
    first = F.get(said, F.lit(0))
    if not tokens:
        return F.struct(F.lit(1).alias("line"), cut(first, 161).alias("text"))
    hits = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: reduce(lambda a, b: a | b, [F.contains(F.lower(s["x"]), F.lit(t.lower())) for t in tokens]))
    hit = F.get(hits, F.lit(0))
    at_first = F.array_position(lines, first)
    line = F.when(hit.isNotNull(), hit["i"] + 1).when(first.isNotNull(), at_first).otherwise(1).cast("int")
    return F.struct(line.alias("line"), cut(F.trim(F.when(hit.isNotNull(), hit["x"]).otherwise(first)), 161).alias("text"))


def search_bodies(bodies: DataFrame, text: str, limit: int, post: Postings | None = None) -> DataFrame:
    """Files by BM25 of their bodies, with the first matching line; no fallback."""
    import regex

    top = _top(post or Postings.of(bodies, "file_id", "body"), text, limit)
    if top is None:
        top = bodies.sparkSession.createDataFrame([], "doc string, score double")
    rows = bodies.join(F.broadcast(top), bodies["file_id"] == F.col("doc"))  # at most 200
    tokens = regex.findall(r"[\p{L}\p{N}_.]+", text)[:12]
    m = first_match(F.col("content"), tokens)
    return rows.select(F.lit("body").alias("category"), F.col("file_id").alias("id"), basename(F.col("relative_path")).alias("name"), "score", m["line"].alias("line"), m["text"].alias("text"))


def search(index, text: str, kind: str = "all", limit: int = 20, body: bool = False, post: dict[str, Postings] | None = None) -> DataFrame:
    """Types and members; members get what types leave of the limit, at least one."""
    limit, post = clamp(limit, 1, 200), post if post is not None else getattr(index, "search", None) or {}
    if body:
        return search_bodies(index.bodies, text, limit, post.get("body")).orderBy("score", "id")
    spark, rows = index.types.sparkSession, []
    if kind in ("all", "type"):
        rows += search_types(index.types, text, limit, post.get("type")).collect()  # at most the limit
    if kind in ("all", "member"):
        rows += search_members(index.members, index.types, text, limit if kind == "member" else max(1, limit - len(rows)), post.get("member")).collect()
    found = spark.createDataFrame([tuple(r) for r in rows], HIT)
    return found.orderBy(F.coalesce("score", F.lit(0.0)), F.upper("name"), "id").limit(limit)


def described(hits: DataFrame, index) -> DataFrame:
    """Hits with what a reader wants to see: kind, parent type, signature, summary, path and line."""
    files = index.source_files.select(F.col("id").alias("_f"), "relative_path")
    names = index.types.select(F.col("id").alias("_t"), F.col("full_name").alias("parent_type"))
    none = F.lit(None).cast("string")
    types = index.types.select(F.col("id").alias("_id"), "kind", none.alias("parent_type"), none.alias("signature"), "summary", "file_id", "start_line")
    some = hits.select(F.col("id").alias("_hit"))
    members = index.members.join(F.broadcast(some), F.col("id") == F.col("_hit"), "left_semi").join(names, F.col("type_id") == F.col("_t"))
    members = members.select(F.col("id").alias("_id"), "kind", "parent_type", "signature", "summary", "file_id", "start_line")
    each = types.join(F.broadcast(some), F.col("_id") == F.col("_hit"), "left_semi").unionByName(members)
    known = each.join(files, F.col("file_id") == F.col("_f"), "left").drop("file_id", "_f")
    return F.broadcast(hits).join(known, F.col("id") == F.col("_id")).drop("_id").orderBy(F.coalesce("score", F.lit(0.0)), F.upper("name"), "id")  # at most 200 hits
