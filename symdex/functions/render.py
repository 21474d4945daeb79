"""Markdown and JSON of bounded results.  Rows come in already cut to their caps."""

from __future__ import annotations

import json
from math import ceil

CHARS, HARD_CHARS = 12_000, 24_000
RELATIONS, HARD_RELATIONS = 20, 100
MEMBERS, HARD_MEMBERS = 80, 200
HITS, HARD_HITS = 50, 100
OVERVIEW_TYPES, OVERVIEW_MEMBERS = 200, 50
EDGES_SHOWN = 40

#: A prefix of the answer's token estimate.
FOOTER = "\n\n~{} tokens\n"
CUT = "\n\n(cut at {} characters)\n"


def clamp(value: int | None, default: int, hard: int) -> int:
    return max(1, min(hard, default if value is None else value))


def tokens(text: str | None) -> int:
    return max(1, ceil(len(text) / 4)) if text else 0


def finish(text: str, limit: int | None = None) -> str:
    """The text with its estimate; beyond the cap it is cut and says so."""
    limit = clamp(limit, CHARS, HARD_CHARS)
    whole = text.rstrip() + FOOTER.format(tokens(text))
    if len(whole) <= limit:
        return whole
    room = limit - 80 if limit - 80 >= 100 else limit // 2
    return whole[:room] + CUT.format(limit)


def capped_json(value, limit: int | None = None) -> str:
    """JSON; beyond the cap an object that says so, with the first 500 characters."""
    limit = clamp(limit, CHARS, HARD_CHARS)
    text = json.dumps(value, ensure_ascii=False, default=str)
    return text if len(text) <= limit else json.dumps({"truncated": True, "maxChars": limit, "preview": text[:500]}, ensure_ascii=False)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def plain(value):
    """A value for JSON: keys in camel case, nothing that is null."""
    if isinstance(value, dict):
        return {_camel(k): plain(v) for k, v in value.items() if v is not None}
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def relation_groups(row: dict, full: bool = False, limit: int = RELATIONS) -> dict:
    """Names of an owner's relations by group, with totals; compact output hides those of signatures and shows five consumers."""
    out = {}
    deps, consumers = row.get("dependencies") or [], row.get("consumers") or []
    for name, rel, n in (
        ("calls", [r for r in deps if r["kind"] == "calls"], limit), ("structural", [r for r in deps if r["kind"] in ("inherits", "implements")], limit),
        ("signature", [r for r in deps if r["kind"] in ("usesInSignature", "usesInMember")], limit if full else 0), ("consumers", consumers, limit if full else min(5, limit)),
    ):
        names = [_short((r["targetName"] or r["targetId"]).split("(")[0], 80) for r in rel[:n]]
        out[name] = {"total": len(rel), "names": names, "truncated": len(rel) > n}
    return out


def detail_data(row: dict, full: bool = False) -> dict:
    """A type or member for JSON."""
    start, end = row.get("start_line"), row.get("end_line")
    kept = {k: row.get(k) for k in ("id", "name", "full_name", "type_full_name", "kind", "signature", "return_type", "accessibility", "summary", "relative_path", "is_generated", "token_estimate")}
    lines = {"start": start, "end": end, "count": end - start + 1 if start and end and end >= start else 0} if start else None
    places = [{"path": x["relativePath"] or x["fileId"], "start": x["startLine"], "end": x["endLine"], "primary": x["isPrimary"]} for x in row.get("locations") or ()]
    return kept | {"lines": lines, "locations": places or None, "relations": relation_groups(row, full)}


def _short(text: str, limit: int) -> str:
    return text if len(text) <= limit else text[: limit - 1] + "…"


def _where(row: dict) -> str:
    path, start, end = row.get("relative_path"), row.get("start_line"), row.get("end_line")
    if not path:
        return ""
    return f" — {path}" + (f":{start}" + (f"-{end}" if end and end != start else "") if start else "")


def _dependencies(row: dict, kinds: tuple[str, ...]) -> list[str]:
    return [r["targetName"] or r["targetId"] for r in row.get("dependencies") or () if r["kind"] in kinds]


def overview(status: dict, projects: list[dict], types: list[dict], members: dict[str, list[dict]] | None = None, limit: int | None = None) -> str:
    """A solution's projects and types, with members where they are given."""
    out = [f"# {status.get('name', 'index')}", "", f"{status['project_count']} projects, {status['type_count']} types, {status['member_count']} members, {status['file_count']} files"]
    own: dict[str, list[dict]] = {}
    for t in types[:OVERVIEW_TYPES]:
        own.setdefault(t["project_id"], []).append(t)
    for p in projects:
        framework = f" ({p['target_framework']})" if p.get("target_framework") else ""
        out += ["", f"## {p['name']}{framework}" + (" [test]" if p.get("is_test") else "")]
        for t in own.get(p["id"], ()):
            bases = _dependencies(t, ("inherits", "implements"))
            out.append(f"- {t['kind']} {t['full_name']}" + (f" : {', '.join(bases)}" if bases else "") + _where(t))
            for m in (members or {}).get(t["id"], ())[:OVERVIEW_MEMBERS]:
                calls = _dependencies(m, ("calls",))
                out.append(f"  - {_short(m['signature'], 120)}" + (f" -> {', '.join(calls)}" if calls else ""))
    if len(types) > OVERVIEW_TYPES:
        out += ["", f"+{len(types) - OVERVIEW_TYPES} more types"]
    return finish("\n".join(out), limit)


def hits(rows: list[dict], text: str, full: bool = False, limit: int | None = None) -> str:
    out = [f"# Search: {text}", "", f"{len(rows)} hits", ""]
    for r in rows[:HARD_HITS]:
        if r["category"] == "body":
            out.append(f"- {r['name']}:{r['line']} {r['text'] or ''} ({r['id']})")
            continue
        name = f"{r['parent_type']}.{r['name']}" if r.get("parent_type") else r["name"]
        said = f" {_short(r['signature'], 120)}" if r.get("signature") else ""
        out.append(f"- {r['category']} {name}{said} ({r['id']}){_where(r)}" + (f" — {r['summary']}" if full and r.get("summary") else ""))
    return finish("\n".join(out if rows else [*out, "nothing found"]), limit)


_TITLES = {"calls": "Calls", "structural": "Structure", "signature": "Signature", "consumers": "Consumers"}


def _slices(row: dict, full: bool, limit: int) -> list[str]:
    out = []
    for name, g in relation_groups(row, full, limit).items():
        if g["names"]:
            more = g["total"] - len(g["names"])
            out += ["", f"{_TITLES[name]} ({g['total']}): {', '.join(g['names'])}" + (f", +{more} more" if more else "")]
        elif g["total"]:
            out += ["", f"{_TITLES[name]}: {g['total']}"]
    return out


def type_detail(row: dict, members: list[dict], full: bool = False, limit: int | None = None) -> str:
    out = [f"# {row['kind']} {row['full_name']}", f"{row['accessibility']}{_where(row)}"]
    if row.get("summary"):
        out += ["", row["summary"]]
    if len(row.get("locations") or ()) > 1:
        out += ["", "Parts:"] + [f"- {x['relativePath'] or x['fileId']}:{x['startLine']}" + (" (primary)" if x["isPrimary"] else "") for x in row["locations"]]
    out += _slices(row, full, RELATIONS)
    if members:
        out += ["", "## Members"] + [f"- {m['kind']} {_short(m['signature'], 120)}" for m in members[:HARD_MEMBERS]]
    return finish("\n".join(out), limit)


def member_detail(row: dict, full: bool = False, limit: int | None = None) -> str:
    out = [f"# {row['kind']} {row['type_full_name']}.{row['name']}", row["signature"], f"{row['accessibility']}{_where(row)}"]
    if row.get("summary"):
        out += ["", row["summary"]]
    return finish("\n".join(out + _slices(row, full, RELATIONS)), limit)


def sites(title: str, rows: list[dict], limit: int | None = None) -> str:
    """Callers or consumers; none found is no proof that there are none."""
    out = [f"# {title}", ""]
    for r in rows:
        at = f" — {r['file']}:L{r['line']}" if r.get("file") and r.get("line") is not None else f" — {r['file']}" if r.get("file") else ""
        out.append(f"- {r['display']}{at}")
    if not rows:
        out.append("none are indexed; calls through reflection or from elsewhere aren't seen")
    return finish("\n".join(out), limit)


def impact(root: str, nodes: list[dict], edges: list[dict], truncated: bool, limit: int | None = None) -> str:
    out = [f"# Impact of {root}"]
    for depth in sorted({n["depth"] for n in nodes}):
        out += ["", f"## Depth {depth}"] + [f"- {n['kind']} {n['name']} ({n['id']})" for n in nodes if n["depth"] == depth]
    out += ["", "## Edges"] + [f"- {e['from_id']} -{e['kind']}-> {e['to_id']}" for e in edges[:EDGES_SHOWN]]
    if len(edges) > EDGES_SHOWN:
        out.append(f"+{len(edges) - EDGES_SHOWN} more")
    if truncated:
        out += ["", "the graph reached its cap on nodes"]
    return finish("\n".join(out), limit)


def hotspots(metric: str, rows: list[dict], limit: int | None = None) -> str:
    out = [f"# Hotspots by {metric}", ""]
    for k, r in enumerate(rows, 1):
        name = r["full_name"] if "full_name" in r else f"{r['type_full_name']}.{r['name']}"
        out.append(f"{k}. {name}: {r.get('label') or r['score']}")
    return finish("\n".join(out), limit)


def quality(row: dict, limit: int | None = None) -> str:
    out = [f"# Index quality: {row['grade']}", "", f"summaries: types {row['type_summary_pct']} %, members {row['member_summary_pct']} %", f"methods with calls: {row['calls_pct']} %", f"average method: {row['avg_method_lines']} lines"]
    return finish("\n".join(out + ([f"notes: {row['notes']}"] if row["notes"] else [])), limit)


def checks(rows: list[dict], limit: int | None = None) -> str:
    good = sum(r["ok"] for r in rows)
    return finish("\n".join(["# Doctor", "", f"{good} pass, {len(rows) - good} fail", ""] + [f"- {'ok' if r['ok'] else r['severity']} {r['name']}: {r['message']}" for r in rows]), limit)
