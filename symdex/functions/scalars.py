"""Scalar functions of the index, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pascal(kind: Column) -> Column:
    """``usesInSignature`` as ``UsesInSignature``."""
    return F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1 << 20))


def tokens(text: Column, utf16: bool = False) -> Column:
    """Estimated tokens of a text: a quarter of its length rounded up; none for null or empty.

    ``utf16`` counts UTF-16 code units, as hosts with such strings do.
    """
    n = (F.length(F.encode(text, "UTF-16BE")) / 2) if utf16 else F.length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil(n / 4))).otherwise(0).cast("int")


def tokens_of(*parts: Column) -> Column:
    """Each part is rounded by itself."""
    total = tokens(parts[0])
    for p in parts[1:]:
        total = total + tokens(p)
    return total


def line_count(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start + 1).otherwise(0)


def has_lines(start: Column, end: Column) -> Column:
    return F.coalesce(end >= start, F.lit(False))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def normal_path(path: Column) -> Column:
    return F.trim(slashes(path))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def make_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), *[x for p in parts for x in (p, F.lit(":"))][:-1])


def namespace_id(project_id: Column, name: Column) -> Column:
    """The global namespace is named '' but its id says so."""
    return make_id("ns", project_id, F.when(name == "", "global").otherwise(name))


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one being an ellipsis where some are missing."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def site_label(label: Column, file: Column, line: Column) -> Column:
    named = F.when(F.length(file) > 0, basename(file))
    at = F.concat(F.lit("L"), line.cast("string"))
    where = F.when(named.isNotNull() & line.isNotNull(), F.concat(named, F.lit(":"), at)).otherwise(F.coalesce(named, at))
    return F.when(F.length(F.trim(label)) > 0, label).otherwise(where)


def relation_name(target_name: Column, target_id: Column) -> Column:
    """A relation's target without parameters, at most 80 characters."""
    full = F.when(F.length(target_name) > 0, target_name).otherwise(target_id)
    paren = F.locate("(", full)
    return cut(F.when(paren > 1, F.substring(full, F.lit(1), paren - 1)).otherwise(full), 80)


def short_id(id_: Column) -> Column:
    """An id without its prefix and parameters, down to two dotted segments, or the last one if there are just two."""
    colon = F.locate(":", id_)
    bare = F.when(colon > 0, F.substring(id_, colon + 1, F.length(id_))).otherwise(id_)
    paren = F.locate("(", bare)
    bare = F.when(paren > 1, F.substring(bare, F.lit(1), paren - 1)).otherwise(bare)
    n = F.size(F.split(bare, r"\."))
    return F.when(n >= 3, F.substring_index(bare, ".", -2)).when(n == 2, F.substring_index(bare, ".", -1)).otherwise(bare)


def kind_of_id(id_: Column) -> Column:
    found = F.lit("member")
    for prefix in ("type", "event", "field", "property", "method"):
        found = F.when(id_.startswith(prefix + ":"), prefix).otherwise(found)
    return found


def short_signature(signature: Column) -> Column:
    return cut(signature, 120)


def accessibility_text(name: Column) -> Column:
    """``ProtectedOrInternal`` and its like as they are written in source."""
    return F.when(name == "ProtectedOrInternal", "protected internal").when(name == "ProtectedAndInternal", "private protected").when(name == "NotApplicable", "").otherwise(F.lower(name))


def capped_json(json: Column, limit: int) -> Column:
    """JSON that is too long gives way to a note with its first 500 characters."""
    note = F.to_json(F.struct(F.lit(True).alias("truncated"), F.lit(limit).alias("maxChars"), F.substring(json, 1, 500).alias("preview")))
    return F.when(F.length(json) > limit, note).otherwise(json)


def query_tokens(text: Column) -> Column:
    """The first 12 search tokens: runs of letters, digits, underscores and dots."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_.]+"), F.lit(0)), 1, 12)


def like_pattern(text: Column) -> Column:
    """Wildcards are taken out of the text; nothing left matches everything."""
    bare = F.regexp_replace(F.trim(text), "[%_]", "")
    return F.when(F.length(bare) > 0, F.concat(F.lit("%"), bare, F.lit("%"))).otherwise("%")


def framework(project_xml: Column) -> Column:
    """The target framework, or the first of several with the whole list."""
    one = F.nullif(F.trim(F.regexp_extract(project_xml, r"(?i)<TargetFramework>\s*([^<]+?)\s*</TargetFramework>", 1)), F.lit(""))
    several = F.nullif(F.trim(F.regexp_extract(project_xml, r"(?i)<TargetFrameworks>\s*([^<]+?)\s*</TargetFrameworks>", 1)), F.lit(""))
    first = F.trim(F.element_at(F.split(several, ";"), 1))
    return F.coalesce(one, F.when(F.locate(";", several) > 0, F.concat(first, F.lit(" (of "), several, F.lit(")"))).otherwise(several))
