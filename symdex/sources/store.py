"""Stored indexes: Parquet tables in version folders, and a pointer that names the current one.

A write makes a new version and moves the pointer last, so a reader sees one
version or the other, and a failed write is never seen.  A version has a list
of its tables' folders: an update writes the tables that changed, with what is
made from them, and lists the others where they are.  All files go
through Hadoop's file system, so the folder may be on any storage that the
executors share.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extraction import duplicate_types
from ..operators.relations import migrate
from ..operators.search import FIELDS, Postings, documents, stats
from ..plans.index import TABLES, Index
from ..plans.lineage import cut
from ..schema import DDL, conform, schema

SCHEMA_VERSION = "1"
POINTER = "CURRENT"
#: The list of a version's tables, and the edges in order of their target.
LIST, INWARD = "TABLES.json", "edges_in"
SEARCH_DDL = {"postings": "token string, doc string, dl int, positions array<int>", "stats": "n_docs bigint, avg_dl double"}
#: Tables on which the postings of a category depend.
SEARCHED = {"type": {"types"}, "member": {"members", "types"}, "body": {"bodies"}}


class DuplicateTypes(ValueError):
    """Several projects claim one type id."""


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that the file is whole or old."""
    p, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(beside, p):
        fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"cannot move the pointer {path}")


class Store:
    """The index in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> str | None:
        text = _read_text(self.spark, f"{self.path}/{POINTER}")
        return text.strip() if text else None

    def folders(self, version: str | None) -> dict[str, str]:
        """The folder of each stored table, below this one."""
        text = _read_text(self.spark, f"{self.path}/{version}/{LIST}") if version else None
        return json.loads(text) if text else {t: f"{version}/{t}" for t in (*TABLES, INWARD)} if version else {}

    def read(self, version: str | None = None) -> Index:
        """The current version, or an index of empty tables where there is none; columns of other days are filled in."""
        version = version or self.version()
        at, made = self.folders(version), {}

        def stored(name: str) -> DataFrame | None:
            return self._table(at, name)

        for t in TABLES:
            df = stored(t)
            made[t] = self.spark.createDataFrame([], schema(t)) if df is None else conform(df, t)
        if version is not None and self._meta(made["meta"]).get("schema_version", "0") == "0":
            made["edges"] = conform(migrate(made["edges"], made["types"], made["members"]), "edges")
            return Index(**made)
        if (df := stored(INWARD)) is not None:
            made[INWARD] = conform(df, "edges")
        made["search"] = {c: Postings(rows, sums) for c in FIELDS if (rows := stored(f"postings_{c}")) is not None and (sums := stored(f"stats_{c}")) is not None}
        return Index(**made)

    @staticmethod
    def _meta(df: DataFrame) -> dict[str, str]:
        return {r["key"]: r["value"] for r in df.collect()}  # some twenty keys

    def _table(self, at: dict[str, str], name: str) -> DataFrame | None:
        """A stored table under its known schema, for which no file is opened; lists that an old file lacks are empty."""
        if name not in at:
            return None
        p, fs = _path(self.spark, f"{self.path}/{at[name]}")
        if not fs.exists(p):
            return None
        kind, _, category = name.partition("_")
        own = SEARCH_DDL[kind] if category in SEARCHED else schema("edges" if name == INWARD else name)
        df = self.spark.read.schema(own).parquet(str(p.toString()))
        return df.withColumns({f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in df.schema if f.dataType.typeName() == "array"})

    def meta(self) -> dict[str, str]:
        df = self._table(self.folders(self.version()), "meta")
        return {} if df is None else self._meta(df)

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str] | None = None, keep: int = 2) -> str:
        """Replaces the index; tables that aren't given are empty, keys of ``meta`` that aren't given stay."""
        types = tables.get("types")
        if types is not None and (twice := duplicate_types(types).orderBy("id").limit(5).collect()):
            raise DuplicateTypes("type ids in several projects: " + ", ".join(r["id"] for r in twice))
        return self._write({t: tables[t] if t in tables else self.spark.createDataFrame([], schema(t)) for t in TABLES if t != "meta"}, meta, keep, {})

    def _write(self, tables: dict[str, DataFrame], meta: dict[str, str] | None, keep: int, same: dict[str, str], postings: dict[str, DataFrame] | None = None) -> str:
        """A new version of some tables, the ``same`` ones staying where they are."""
        old = self.version()
        known = self.meta() if old else {}
        version = f"v-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        at = dict(same)

        def put(df: DataFrame, name: str) -> DataFrame:
            at[name] = f"{version}/{name}"
            df.write.parquet(f"{self.path}/{at[name]}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/{at[name]}")

        stored = {t: self._table(same, t) for t in ("types", "members", "bodies", "edges") if t in same}

        def table(t: str) -> None:
            df = conform(tables[t], t)
            if t != "edges":
                stored[t] = put(df, t)
                return
            made = cut(df)
            for key, name in (("from_id", "edges"), ("to_id", INWARD)):
                stored[name] = put(self._by_node(made, key), name)

        def searched(category: str) -> None:
            docs, id_col = documents(stored["types"], stored["members"], stored["bodies"])[category]
            rows = (postings or {}).get(category)
            rows = Postings.of(docs, id_col, category).rows if rows is None else rows
            put(rows.repartitionByRange("token", "doc").sortWithinPartitions("token", "doc"), f"postings_{category}")
            put(stats(docs, FIELDS[category]), f"stats_{category}")

        with ThreadPoolExecutor(4) as pool:  # small tables don't fill a cluster one by one
            list(pool.map(table, tables))
            list(pool.map(searched, [c for c in FIELDS if SEARCHED[c] & set(tables)]))
        known |= {"schema_version": SCHEMA_VERSION, "indexed_at_utc": datetime.now(timezone.utc).isoformat()} | (meta or {})
        if "edges" in tables:
            known["edge_count"] = str(stored["edges"].count())
        put(self.spark.createDataFrame(sorted(known.items()), DDL["meta"]).coalesce(1), "meta")
        _write_text(self.spark, f"{self.path}/{version}/{LIST}", json.dumps(at, sort_keys=True))
        _write_text(self.spark, f"{self.path}/{POINTER}", version)
        self._prune(keep)
        return version

    def _by_node(self, edges: DataFrame, key: str) -> DataFrame:
        """Edges in order of a node: a hop skips all row groups but those of its nodes."""
        return edges.repartitionByRange(F.col(key), F.col("edge_seq")).sortWithinPartitions(key, "edge_seq")

    def _prune(self, keep: int) -> None:
        """Deletes what none of the newest versions lists; a reader may still be in the one before."""
        p, fs = _path(self.spark, self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-"))
        kept = names[-max(1, keep) :]
        needed = {folder for v in kept for folder in self.folders(v).values()}
        for name in names[: -max(1, keep)]:
            if not any(folder.startswith(f"{name}/") for folder in needed):
                fs.delete(_path(self.spark, f"{self.path}/{name}")[0], True)
                continue
            own, _ = _path(self.spark, f"{self.path}/{name}")
            for s in fs.listStatus(own):
                if f"{name}/{s.getPath().getName()}" not in needed:
                    fs.delete(s.getPath(), True)

    def update(self, meta: dict[str, str] | None = None, keep: int = 2, postings: dict[str, DataFrame] | None = None, **changed: DataFrame) -> str:
        """A new version with some tables replaced; ``postings`` are those of a category, where they are known."""
        version = self.version()
        if not version or "types" not in self.folders(version):
            return self.write(self.read().tables() | changed, meta, keep)
        gone = {"meta", *changed, *([INWARD] if "edges" in changed else []), *(f"{x}_{c}" for c, on in SEARCHED.items() if on & set(changed) for x in ("postings", "stats"))}
        same = {t: folder for t, folder in self.folders(version).items() if t not in gone}
        return self._write(changed, meta, keep, same, postings)

    def exists(self, path: str) -> bool:
        p, fs = _path(self.spark, path)
        return fs.exists(p)

    def bytes(self) -> int:
        """Size of the current version's tables, wherever they lie."""
        size = 0
        for folder in set(self.folders(self.version()).values()):
            p, fs = _path(self.spark, f"{self.path}/{folder}")
            size += fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return size

    def unwritable(self) -> str:
        """Why nothing can be written to the folder, or nothing."""
        probe = f"{self.path}/probe-{uuid.uuid4().hex}"
        try:
            _write_text(self.spark, probe, "ok")
            p, fs = _path(self.spark, probe)
            fs.delete(p, False)
            return ""
        except Exception as e:  # of whatever kind the file system has
            return str(e).splitlines()[0][:200]

    def has_data(self) -> bool:
        df = self._table(self.folders(self.version()), "solutions")
        return df is not None and bool(df.limit(1).count())

    def has_bodies(self) -> bool:
        df = self._table(self.folders(self.version()), "bodies")
        return self.meta().get("index_body") == "1" or (df is not None and bool(df.limit(1).count()))


def load_bodies(spark: SparkSession, files: DataFrame, root: str, pattern: str = "*.cs", max_chars: int = 0) -> DataFrame:
    """Bodies of indexed files read below ``root``, whole, or of files of at most twice ``max_chars`` bytes the first so many characters; empty files have none."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where("length > 0")
    content = F.decode("content", "UTF-8")
    if max_chars:
        raw, content = raw.where(f"length <= {2 * max_chars}"), F.substring(content, 1, max_chars)
    some = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), content.alias("content"))
    joined = files.join(some, F.translate(files["absolute_path"], "\\", "/") == F.col("_path"))
    return joined.select(F.col("id").alias("file_id"), "relative_path", "absolute_path", "content").where("length(content) > 0")


def resolve_file(files: DataFrame, relative: str) -> DataFrame:
    """The file with a relative path, written with either slash."""
    return files.where(F.translate("relative_path", "\\", "/") == relative.replace("\\", "/")).orderBy("id").limit(1)
