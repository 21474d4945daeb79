"""The index: named tables that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

TABLES = ("meta", "solutions", "projects", "source_files", "namespaces", "types", "members", "edges", "bodies")


@dataclass(frozen=True)
class Index:
    """One frame for each index table; frames are lazy, so unused ones cost nothing."""

    meta: DataFrame
    solutions: DataFrame
    projects: DataFrame
    source_files: DataFrame
    namespaces: DataFrame
    types: DataFrame
    members: DataFrame
    edges: DataFrame
    bodies: DataFrame
    #: The edges again, stored by their target.
    edges_in: DataFrame | None = None
    #: Stored postings by category, as ``operators.search`` takes them.
    search: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}
