"""The questions that a user asks of a stored index, as methods that return text, and a command line for them.

Exit codes: 0 answered, 1 error, 2 empty index, 3 nothing matches, 4 stale.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render, scalars
from ..operators import analytics, catalog, change, extraction, graph, relations, search, snippets
from ..schema import REL, conform
from ..sources import config, facts
from ..sources.store import Store, load_bodies, resolve_file
from .lineage import cut, held

OK, ERROR, EMPTY, NO_MATCH, STALE = range(5)


@dataclass(frozen=True)
class Answer:
    """Markdown, the exit code, and the same as data for JSON."""

    text: str
    code: int = OK
    data: dict | None = None

    def formatted(self, form: str = "md", limit: int | None = None) -> str:
        return self.text if form == "md" else render.capped_json(render.plain(self.data if self.data is not None else {"message": self.text, "code": self.code}), limit)


def _rows(df: DataFrame, limit: int = 1000) -> list[dict]:
    """Results are capped by their operators; the limit here is a guard."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def doctor(spark: SparkSession, path: str, current: facts.Facts | None = None) -> list[dict]:
    """Checks of the surroundings and of a stored index; only errors make it fail."""
    service = Service(spark, path)
    store, out = service.store, [dict(name="runtime", severity="error", ok=spark.version >= "4", message=f"Spark {spark.version}")]

    def add(name: str, severity: str, ok: bool, message: str) -> bool:
        out.append(dict(name=name, severity=severity, ok=bool(ok), message=message))
        return bool(ok)

    add("checkpoint_dir", "warn", bool(spark.conf.get("spark.checkpoint.dir", "")) or spark.sparkContext.master.startswith("local"), "loops cut lineage in spark.checkpoint.dir")
    version = store.version()
    if not add("database", "error", version is not None, version or "there is no index in this folder"):
        for name in ("schema", "index_data", "staleness", "quality"):
            add(name, "info", True, "skipped, as there is no index")
        return out
    meta = store.meta()
    add("schema", "warn", meta.get("schema_version") == "1", f"schema version {meta.get('schema_version', '0')}")
    index = store.read()
    if add("index_data", "error", bool(index.solutions.limit(1).count()), "the index has a solution"):
        if entry := meta.get("entry"):
            add("entry_path", "warn", store.exists(entry), entry)
        if current is None:
            add("staleness", "info", True, "skipped, as no facts are given")
        else:
            stale = service.stale(current)
            add("staleness", "warn", not stale, "stale: " + ", ".join(r["name"] for r in stale[:5]) if stale else "the index is as the facts are")
        row = analytics.quality(index.types, index.members).first()
        add("quality", "info", row["grade"] in ("A", "B", "C"), f"grade {row['grade']}")
        add("edges", "warn", bool(index.edges.limit(1).count()), f"{meta.get('edge_count', '0')} edges")
    why = store.unwritable()
    add("writable", "warn", not why, why or path)
    return out


def passed(checks: list[dict]) -> bool:
    return all(c["ok"] for c in checks if c["severity"] == "error")


class Service:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    # building

    def index(self, source: facts.Facts, entry: str, options: config.Options = config.Options()) -> Answer:
        """Builds the index from facts; with ``changed_only`` rows of unchanged projects are taken over."""
        shaping = repr(sorted(options.shaping().items()))
        own = facts.assemblies_hash(source, options).first()["hash"]
        meta = self.store.meta() if self.store.version() else {}
        note = ""
        with held():
            if change.can_reuse(meta.get("options"), shaping, meta.get("entry") == entry and meta.get("assemblies") == own, options.changed_only):
                tables, plan = facts.rebuild(source, entry, options, self.store.read().tables())
                acts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
                note = f", {acts.get('reuse', 0)} projects reused, {acts.get('rebuild', 0) + acts.get('add', 0)} indexed again"
            else:
                tables = facts.build(source, entry, options)
                if options.changed_only:
                    note = ", all projects indexed as other options, another entry or other assemblies had been used"
            self.store.write(tables, {"options": shaping, "entry": entry, "assemblies": own, "index_mode": options.mode(), "index_body": "1" if options.index_body else "0"})
        return Answer(self.status().text.rstrip() + note)

    def save_consumers(self, refs: DataFrame, scope: str) -> Answer:
        """Finds the consumers of the types in scope and keeps them."""
        index = self.store.read()
        targets = extraction.scope_targets(index.types, index.projects, scope).select("id")
        found = extraction.consumers(refs, targets)
        none = F.array().cast(f"array<{REL}>")
        with held():
            new = cut(targets.join(found, "id", "left").select("id", F.coalesce("consumers", none).alias("consumers")))
            types, edges = relations.save_consumers(index.types, index.edges, new)
            n = new.count()
            self.store.update({"index_mode": "full-relations"}, types=conform(types, "types"), edges=edges)
        return Answer(f"{n} types updated", data={"updated": n})

    def _keep(self, table: str, id_: str, sites: list[dict]) -> None:
        """Replaces what the index has as the consumers of one symbol."""
        index = self.store.read()
        listed = [("referencedBy", r["container_id"], r["display"], r["file"], r["line"], None) for r in sites]
        new = self.spark.createDataFrame([(id_, listed)], f"id string, consumers array<{REL}>")
        with held():
            owners, edges = relations.save_consumers(getattr(index, table), index.edges, new)
            self.store.update(None, **{table: conform(owners, table), "edges": edges})

    # asking

    def _empty(self) -> Answer | None:
        return None if self.store.version() else Answer("the index is empty", EMPTY)

    def status(self, current: facts.Facts | None = None, options: config.Options = config.Options()) -> Answer:
        """What the index holds; with facts as they are now also whether it is stale."""
        if not self.store.version():
            return Answer("the index is empty", data={"empty": True})
        index, meta = self.store.read(), self.store.meta()
        n = catalog.status(index.projects, index.source_files, index.types, index.members, index.edges).first().asDict()
        names = {"project_count": "projects", "file_count": "files", "type_count": "types", "member_count": "members", "edge_count": "edges"}
        size = self.store.bytes()
        text = f"{', '.join(f'{v} {names[k]}' for k, v in n.items())}; {size} bytes, mode {meta.get('index_mode', 'structure')}, built {meta.get('indexed_at_utc', '?')}"
        data = n | {"bytes": size, "index_mode": meta.get("index_mode"), "indexed_at_utc": meta.get("indexed_at_utc"), "schema_version": meta.get("schema_version"), "entry": meta.get("entry")}
        if current is None:
            return Answer(text, data=data)
        stale = self.stale(current, options)
        return Answer("\n".join([text, *(f"{r['name']}: {r['reasons']}" for r in stale)] if stale else [text, "up to date"]), STALE if stale else OK, data | {"is_stale": bool(stale), "stale_projects": stale})

    def stale(self, current: facts.Facts, options: config.Options = config.Options()) -> list[dict]:
        """Projects whose files, or project file, aren't those of the index."""
        index, own = self.store.read(), facts.indexed_projects(current, options)
        some = current["documents"].join(own.select(F.col("id").alias("_p")), F.col("project_id") == F.col("_p"), "left_semi")
        manifest = extraction.source_files(some, options.include_generated)
        return _rows(change.stale_projects(index.projects, index.source_files, manifest, own.select("id", "file_hash")).orderBy("name", "id"))

    def staleness(self, manifest: DataFrame, project_hashes: DataFrame | None = None) -> Answer:
        index = self.store.read()
        stale = _rows(change.stale_projects(index.projects, index.source_files, manifest, project_hashes).orderBy("name", "id"))
        return Answer("\n".join(f"{r['name']}: {r['reasons']}" for r in stale), STALE, {"stale_projects": stale}) if stale else Answer("up to date", data={"stale_projects": []})

    def doctor(self, current: facts.Facts | None = None) -> Answer:
        found = doctor(self.spark, self.store.path, current)
        good = sum(c["ok"] for c in found)
        return Answer(render.checks(found), OK if passed(found) else ERROR, {"ok": passed(found), "pass_count": good, "fail_count": len(found) - good, "checks": found})

    def overview(self, members: bool = False, limit: int | None = None) -> Answer:
        if none := self._empty():
            return none
        index = self.store.read()
        n = catalog.status(index.projects, index.source_files, index.types, index.members, index.edges).first().asDict()
        name = index.solutions.orderBy("id").select("name").limit(1).collect()
        files = index.source_files.select(F.col("id").alias("_f"), "relative_path")
        types = index.types.orderBy("full_name", "id").limit(render.OVERVIEW_TYPES)
        some = types.join(files, F.col("file_id") == F.col("_f"), "left").orderBy("full_name", "id")
        by: dict[str, list[dict]] = {}
        if members:
            own = index.members.join(types.select(F.col("id").alias("_t")), F.col("type_id") == F.col("_t"), "left_semi")
            for r in _rows(own.select("type_id", "kind", "name", "signature", "dependencies", "id").orderBy("type_id", "kind", "name", "id"), render.OVERVIEW_TYPES * render.OVERVIEW_MEMBERS):
                by.setdefault(r["type_id"], []).append(r)
        n["name"] = name[0]["name"] if name else "index"
        projects, shown = _rows(index.projects.orderBy("name", "id")), _rows(some)
        own = [render.detail_data(t) | {"project_id": t["project_id"], "members": [{"kind": m["kind"], "name": m["name"], "signature": m["signature"]} for m in by.get(t["id"], ())] or None} for t in shown]
        return Answer(render.overview(n, projects, shown, by, limit), data={"solution": n["name"], "status": n, "projects": projects, "types": own})

    def query(self, text: str, kind: str = "all", limit: int = 15, body: bool = False, full: bool = False) -> Answer:
        if none := self._empty():
            return none
        if not text.strip():
            return Answer("nothing to search for", ERROR)
        if body and not self.store.has_bodies():
            return Answer("bodies aren't indexed", ERROR)
        index = self.store.read()
        found = search.search(index, text, kind, render.clamp(limit, render.HITS, render.HARD_HITS), body)
        rows = _rows(found if body else search.described(found, index))
        return Answer(render.hits(rows, text, full), OK if rows else NO_MATCH, {"query": text, "count": len(rows), "detail": "full" if full else "compact", "hits": rows})

    def _type(self, name: str) -> dict | None:
        index = self.store.read()
        return next(iter(_rows(catalog.resolve_type(index.types, index.source_files, name))), None)

    def _member(self, name: str, strict: bool = False) -> dict | None:
        index = self.store.read()
        return next(iter(_rows(catalog.resolve_member(index.members, index.types, index.source_files, name, strict))), None)

    def get(self, name: str, kind: str = "auto", full: bool = False, limit: int | None = None) -> Answer:
        """A type or member; a type goes first unless the name looks like a method's."""
        if none := self._empty():
            return none
        as_member = kind == "member" or (kind == "auto" and (name.startswith("method:") or "(" in name))
        order = [self._member, self._type] if as_member else [self._type, self._member]
        for find in order if kind == "auto" else order[:1]:
            if row := find(name):
                if find == self._member:
                    return Answer(render.member_detail(row, full, limit), data=render.detail_data(row, full))
                index = self.store.read()
                own = _rows(catalog.list_members(index.members, index.types, index.source_files, row["id"], limit=render.MEMBERS))
                return Answer(render.type_detail(row, own, full, limit), data=render.detail_data(row, full) | {"members": [render.detail_data(m, full) for m in own]})
        return Answer(f"nothing is called {name}", NO_MATCH)

    def _symbol(self, name: str) -> dict | None:
        """A member if any matches, else a type."""
        return self._member(name) or self._type(name)

    def _lines_of_file(self, name: str) -> dict | None:
        """PATH:LINE or PATH:FIRST-LAST of an indexed file, as a span."""
        m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", name)
        found = _rows(resolve_file(self.store.read().source_files, m[1])) if m else []
        return found[0] | {"file_id": found[0]["id"], "start_line": int(m[2]), "end_line": int(m[3] or m[2])} if found else None

    def load_bodies(self, root: str, pattern: str = "*.cs", max_chars: int = 0) -> Answer:
        """Takes the bodies of indexed files from disk."""
        if none := self._empty():
            return none
        with held():
            bodies = cut(conform(load_bodies(self.spark, self.store.read().source_files, root, pattern, max_chars), "bodies"))
            n = bodies.count()
            self.store.update({"index_body": "1"}, bodies=bodies)
        return Answer(f"{n} bodies loaded", data={"bodies": n})

    def snippet(self, name: str, context: int = 0, max_chars: int = snippets.CHARS, root: str | None = None) -> Answer:
        """The source of a symbol, from indexed bodies or else from disk below ``root``."""
        if none := self._empty():
            return none
        row = self._lines_of_file(name) or self._symbol(name)
        if not row or row["start_line"] is None or not row["relative_path"]:
            return Answer(f"no source is known for {name}", NO_MATCH)
        index = self.store.read()
        span = self.spark.createDataFrame([(row["id"], row["file_id"], row["start_line"], row["end_line"])], "id string, file_id string, start_line int, end_line int")
        found = _rows(snippets.snippet_text(snippets.snippet(index.bodies, span, context)))
        _, max_chars = snippets.caps(context, max_chars)
        if found:
            text = found[0]["text"]
            text = text if len(text) <= max_chars else text[: max_chars - 1] + "…"
            return Answer(text, data={"id": row["id"], "relative_path": row["relative_path"], "start_line": row["start_line"], "end_line": row["end_line"], "text": text})
        read = snippets.read(root, row["relative_path"], row["start_line"], row["end_line"] or row["start_line"], context, max_chars)
        return Answer(read.text, OK if read.ok else ERROR, {"id": row["id"], "relative_path": row["relative_path"], "ok": read.ok, "text": read.text})

    def callers(self, name: str, refs: DataFrame | None = None, limit: int = 50, update: bool = False) -> Answer:
        """Reference sites of a member, from reference facts where they are given, else from its calls in the index; ``update`` keeps them."""
        if none := self._empty():
            return none
        row = self._member(name)
        if not row:
            return Answer(f"no member is called {name}", NO_MATCH)
        limit = max(1, min(limit, 100))
        if refs is not None:
            rows = _rows(graph.reference_sites(refs, row["id"], limit))
            if update:
                self._keep("members", row["id"], rows)
        else:
            e = graph.edges_of(self._inward().where("kind IN ('calls', 'referencedBy')"), row["id"], False, limit)
            rows = _rows(e.select(F.col("from_id").alias("container_id"), scalars.short_id(F.col("from_id")).alias("display"), "file", "line").distinct().orderBy(F.upper("display"), "file", "line"))
        return self._sites(f"Callers of {row['type_full_name']}.{row['name']}", row["id"], rows)

    def _sites(self, title: str, id_: str, rows: list[dict]) -> Answer:
        unique = len({r.get("container_id") or r.get("id") or r["display"] for r in rows})
        return Answer(render.sites(title, rows), OK if rows else NO_MATCH, {"target": id_, "count": len(rows), "unique": unique, "sites": rows})

    def _inward(self) -> DataFrame:
        index = self.store.read()
        return index.edges if index.edges_in is None else index.edges_in

    def consumers(self, name: str, refs: DataFrame | None = None, limit: int = 100, update: bool = False) -> Answer:
        """Types that refer to one; ``update`` keeps them."""
        if none := self._empty():
            return none
        row = self._type(name)
        if not row:
            return Answer(f"no type is called {name}", NO_MATCH)
        if refs is not None:
            index, implementors = self.store.read(), None
            if row["kind"] == "interface":
                implementors = graph.closure(index.edges, row["id"], ("implements", "inherits"))
            with held():
                rows = [{"container_id": r["id"], "display": r["id"], "file": None, "line": None} for r in _rows(graph.consumer_types(refs, row["id"], max(1, min(limit, 100)), implementors))]
            if update:
                self._keep("types", row["id"], rows)
        else:
            rows = [{"container_id": r["targetId"], "display": r["targetName"] or r["targetId"], "file": r["file"], "line": r["line"]} for r in row["consumers"][:limit]]
        return self._sites(f"Consumers of {row['full_name']}", row["id"], rows)

    def implementations(self, name: str, limit: int = 50) -> Answer:
        if none := self._empty():
            return none
        row = self._type(name)
        if not row:
            return Answer(f"no type is called {name}", NO_MATCH)
        index = self.store.read()
        with held():
            rows = _rows(graph.implementations(index.edges, index.types, row["id"], limit))
        return self._sites(f"Implementations of {row['full_name']}", row["id"], [r | {"display": r["full_name"]} for r in rows])

    def overrides(self, name: str, override_facts: DataFrame, limit: int = 50) -> Answer:
        if none := self._empty():
            return none
        row = self._member(name)
        if not row:
            return Answer(f"no member is called {name}", NO_MATCH)
        index = self.store.read()
        with held():
            found = graph.overrides(override_facts, row["id"], limit)
            members = catalog.with_types(index.members, index.types)
            named = found.join(members, found["node"] == members["id"]).orderBy(F.upper("type_full_name"), F.upper("name"), "id")
            rows = _rows(named.select("id", F.concat_ws(".", "type_full_name", "name").alias("display"), "depth"))
        return self._sites(f"Overrides of {row['type_full_name']}.{row['name']}", row["id"], rows)

    def impact(self, name: str, depth: int = 2, max_nodes: int = 40, direction: str = "both") -> Answer:
        if none := self._empty():
            return none
        row = self._symbol(name)
        if not row:
            return Answer(f"nothing is called {name}", NO_MATCH)
        index = self.store.read()
        owners = index.types.select("id", "dependencies", "consumers").unionByName(index.members.select("id", "dependencies", "consumers"))
        g = graph.impact(index.edges, row["id"], depth, max_nodes, direction, owners=owners, inward=index.edges_in)
        nodes, edges = _rows(graph.named(g.node_frame(self.spark), index.types, index.members)), _rows(g.edge_frame(self.spark))
        return Answer(render.impact(row["id"], nodes, edges, g.truncated), data={"root": row["id"], "nodes": nodes, "edges": edges, "truncated": g.truncated, "by_depth": {str(d): sum(n["depth"] == d for n in nodes) for d in sorted({n["depth"] for n in nodes})}})

    def hotspots(self, metric: str | None = None, limit: int = 10) -> Answer:
        if none := self._empty():
            return none
        rows = _rows(analytics.hotspots(self.store.read(), metric, limit))
        return Answer(render.hotspots(analytics.metric(metric), rows), OK if rows else NO_MATCH, {"metric": analytics.metric(metric), "items": rows})

    def quality(self) -> Answer:
        if none := self._empty():
            return none
        index = self.store.read()
        row = analytics.quality(index.types, index.members).first().asDict()
        return Answer(render.quality(row), data=row)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m symdex.plans.service VERB ...``"""
    p = argparse.ArgumentParser(prog="symdex")
    p.add_argument("--db")
    p.add_argument("--config")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names in (("status", ()), ("doctor", ()), ("relations", ("scope", "facts")), ("bodies", ("root",)), ("export", ()), ("quality", ()), ("index", ("facts", "entry")), ("consumers", ("name",)), ("query", ("text",)), ("get", ("name",)), ("snippet", ("name",)), ("callers", ("name",)), ("implementations", ("name",)), ("overrides", ("name", "facts")), ("impact", ("name",)), ("hotspots", ())):
        v = verbs.add_parser(verb)
        for n in names:
            v.add_argument(n)
        v.add_argument("--limit", "--max", "--top", type=int)
        v.add_argument("--format", default="md", choices=["md", "json"])
        v.add_argument("--detail", default="compact", choices=["compact", "full"])
        v.add_argument("--out")
        if verb in ("query", "get"):
            v.add_argument("--kind", default="all" if verb == "query" else "auto")
            v.add_argument("--full", action="store_true")
        if verb == "query":
            v.add_argument("--body", action="store_true")
        if verb == "export":
            v.add_argument("--members", action="store_true")
        if verb == "impact":
            v.add_argument("--depth", type=int, default=2)
            v.add_argument("--direction", default="both", choices=["both", "in", "out"])
        if verb == "hotspots":
            v.add_argument("--metric", "--by")
        if verb == "snippet":
            v.add_argument("--context", type=int, default=0)
            v.add_argument("--root")
        if verb in ("callers", "consumers", "status", "doctor"):
            v.add_argument("--facts")
        if verb in ("callers", "consumers"):
            v.add_argument("--update", action="store_true")
        if verb == "index":
            for flag in ("private", "tests", "generated", "external"):
                v.add_argument(f"--include-{flag}", action="store_true", default=None)
            for flag in ("index-body", "full-relations", "changed-only"):
                v.add_argument(f"--{flag}", action="store_true", default=None)
            v.add_argument("--relations", nargs="*")
            v.add_argument("--exclude-projects", nargs="*")
            v.add_argument("--max-calls", type=int)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        known = config.load(a.config) if a.config else config.discover(".")
        s = Service(spark, a.db or known.db or "symdex-index")
        cap = {} if a.limit is None else {"limit": a.limit}
        refs = facts.read(spark, a.facts) if getattr(a, "facts", None) else None
        if a.verb == "index":
            said = {k: getattr(a, k) for k in ("include_private", "include_tests", "include_generated", "include_external", "index_body", "full_relations", "changed_only", "max_calls", "relations", "exclude_projects")}
            # a path on this machine must be something that can be indexed; others are names
            entry = config.entry_path(a.entry) if os.path.exists(a.entry) else a.entry
            answer = s.index(refs, entry, config.merged(known, **said))
        elif a.verb == "query":
            answer = s.query(a.text, a.kind, body=a.body, full=a.full or a.detail == "full", **cap)
        elif a.verb == "get":
            answer = s.get(a.name, a.kind, a.full or a.detail == "full", a.limit)
        elif a.verb == "export":
            answer = s.overview(a.members, a.limit)
        elif a.verb == "relations":
            answer = s.save_consumers(refs["refs"], a.scope)
        elif a.verb == "bodies":
            answer = s.load_bodies(a.root)
        elif a.verb == "status":
            answer = s.status(refs, config.merged(known))
        elif a.verb == "doctor":
            answer = s.doctor(refs)
        elif a.verb == "snippet":
            answer = s.snippet(a.name, a.context, root=a.root)
        elif a.verb in ("callers", "consumers"):
            answer = getattr(s, a.verb)(a.name, refs and refs["refs"], update=a.update, **cap)
        elif a.verb == "implementations":
            answer = s.implementations(a.name, **cap)
        elif a.verb == "overrides":
            answer = s.overrides(a.name, refs["overrides"], **cap)
        elif a.verb == "impact":
            answer = s.impact(a.name, a.depth, a.limit or 40, a.direction)
        elif a.verb == "hotspots":
            answer = s.hotspots(a.metric, **cap)
        else:
            answer = getattr(s, a.verb)()
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return ERROR
    text = answer.formatted(a.format)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return answer.code


if __name__ == "__main__":
    sys.exit(main())
