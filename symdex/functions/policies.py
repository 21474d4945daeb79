"""Inclusion policies of the index build, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import slashes

VISIBLE = ("public", "internal", "protected internal")
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".designer.cs", "assemblyinfo.cs", "globalusings.g.cs", ".assemblyattributes.cs", ".generated.cs")
GENERATED_ATTRIBUTES = ("GeneratedCodeAttribute", "CompilerGeneratedAttribute")
#: Types that never count as a dependency.
PRIMITIVES = ("void", "object", "string", "bool", "byte", "short", "int", "long", "float", "double", "decimal", "char", "System.DateTime")
NOISE = ("%MSB3277%", "%conflicts between different versions%", "%indirect dependency on%System.Runtime%")


def visible(accessibility: Column, include_private: bool = False) -> Column:
    return (accessibility != "") if include_private else accessibility.isin(*VISIBLE)


def test_project(name: Column, path: Column) -> Column:
    p = slashes(path)
    return F.coalesce(name.rlike(r"(?i)(\.tests|\.test|test)$|tests"), F.lit(False)) | F.coalesce(p.rlike(r"(?i)/tests/|\.tests/"), F.lit(False))


def skipped_path(path: Column) -> Column:
    p = slashes(path)
    return p.isNull() | (p == "") | p.rlike(r"(?i)/(bin|obj|migrations)/")


def generated_path(path: Column) -> Column:
    p = F.lower(slashes(path))
    suffix = "|".join(re.escape(s) for s in GENERATED_SUFFIXES)
    return F.coalesce(p.rlike(f"({suffix})$|/\\.?generated/"), F.lit(False))


def skipped_document(path: Column, include_generated: bool = False) -> Column:
    skipped = skipped_path(path)
    return skipped if include_generated else skipped | generated_path(path)


def generated_symbol(attributes: Column, implicit: Column, parent: Column | None = None) -> Column:
    """Implicit, or marked by an attribute on itself or on its containing type (``parent``: its attributes)."""
    def marked(attrs: Column) -> Column:
        return F.coalesce(F.exists(attrs, lambda a: F.substring_index(a, ".", -1).isin(*GENERATED_ATTRIBUTES)), F.lit(False))

    own = F.coalesce(implicit, F.lit(False)) | marked(attributes)
    return own if parent is None else own | marked(parent)


def noisy_diagnostic(message: Column) -> Column:
    found = F.lit(False)
    for pattern in NOISE:
        found = found | message.ilike(pattern)
    return F.coalesce(found, F.lit(False))


def external_assembly(assembly: Column) -> Column:
    return F.coalesce(assembly.rlike(r"(?i)^(System|Microsoft|mscorlib|netstandard|WindowsBase|PresentationCore|PresentationFramework)(\.|$)"), F.lit(False))


def exclude_regex(pattern: str) -> str:
    """A pattern with stars matches in order from end to end; one without matches anywhere."""
    p = pattern.strip()
    if "*" not in p:
        return "(?i)" + re.escape(p)
    return "(?is)^" + ".*".join(re.escape(x) for x in p.split("*")) + "$"


def excluded(name: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        if p.strip():
            found = found | name.rlike(exclude_regex(p))
    return found


def xml_summary(doc: Column) -> Column:
    """The text of the first summary element, without tags and with single spaces."""
    inner = F.regexp_extract(doc, r"(?is)<summary>(.*?)</summary>", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(inner, r"<[^>]+>", ""), r"\s+", " ")), F.lit(""))
