"""Options of an index build: a JSON file, found near the input, under what a caller says."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields

FILE_NAME = "symdex.json"
#: Entry files by precedence.
ENTRIES = (".slnx", ".sln", ".csproj")


@dataclass(frozen=True)
class Options:
    include_private: bool = False
    include_tests: bool = False
    include_generated: bool = False
    include_external: bool = False
    index_body: bool = False
    full_relations: bool = False
    changed_only: bool = False
    max_calls: int = 30
    #: Characters of a body that are kept, and half the bytes beyond which a file has none; 0 keeps all.
    max_body_chars: int = 0
    relations: tuple[str, ...] = ()
    exclude_projects: tuple[str, ...] = ()

    def scopes(self) -> tuple[str, ...]:
        """Scopes that are named go before the flag for all."""
        return self.relations or (("full",) if self.full_relations else ())

    def mode(self) -> str:
        return "full-relations" if self.scopes() else "structure+light-deps"

    def shaping(self) -> dict:
        """What decides about the rows of an index."""
        return {k: v for k, v in asdict(self).items() if k not in ("changed_only", "full_relations", "relations", "index_body", "max_body_chars")}


@dataclass(frozen=True)
class Config:
    """What the file says; None where it says nothing."""

    db: str | None = None
    root: str | None = None
    values: dict = field(default_factory=dict)


def _plain(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    kept = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S).sub(lambda m: m[1] or " ", text)
    return re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S).sub(lambda m: m[1] or "", kept)


def load(path: str) -> Config:
    """A broken file is an error."""
    with open(path, encoding="utf-8-sig") as f:
        try:
            data = json.loads(_plain(f.read()))
        except ValueError as e:
            raise ValueError(f"{path}: {e}") from e
    if not isinstance(data, dict):
        raise ValueError(f"{path}: not an object")
    names = {f.name.replace("_", ""): f.name for f in fields(Options)}
    values = {}
    for key, value in data.items():
        name = names.get(key.replace("_", "").lower())
        if name and value is not None:
            values[name] = tuple(value) if isinstance(value, list) else value
    return Config(data.get("db"), os.path.dirname(os.path.abspath(path)), values)


def discover(start: str) -> Config:
    """The file in the folder of ``start`` or the nearest one above; an empty configuration without one."""
    at = os.path.abspath(start)
    at = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        path = os.path.join(at, FILE_NAME)
        if os.path.isfile(path):
            return load(path)
        up = os.path.dirname(at)
        if up == at:
            return Config()
        at = up


def merged(config: Config, **said) -> Options:
    """What a caller says (None: nothing) goes before the file, and that before the defaults; lists replace lists."""
    known = {f.name for f in fields(Options)}
    if odd := set(said) - known:
        raise TypeError(f"no such options: {sorted(odd)}")
    values = config.values | {k: v for k, v in said.items() if v is not None and v != () and v != []}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    values["max_calls"] = max(1, int(values.get("max_calls", 30)))
    return Options(**values)


def entry_path(path: str) -> str:
    """The file to index: itself, or the only one of the best kind in a folder."""
    full = os.path.abspath(path)
    if os.path.isfile(full):
        if full.lower().endswith(ENTRIES):
            return full
        raise ValueError(f"{path}: neither a solution nor a project")
    if not os.path.isdir(full):
        raise FileNotFoundError(path)
    names = sorted(os.listdir(full))
    for kind in ENTRIES:
        found = [n for n in names if n.lower().endswith(kind)]
        if len(found) > 1:
            raise ValueError(f"{path}: several {kind} files: {', '.join(found)}")
        if found:
            return os.path.join(full, found[0])
    raise FileNotFoundError(f"{path}: no solution or project")
