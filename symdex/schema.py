"""Schemas of the index tables, and the closed domains of their enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REL = "struct<kind:string,targetId:string,targetName:string,file:string,line:int,siteLabel:string>"
LOC = "struct<fileId:string,relativePath:string,startLine:int,endLine:int,sizeChars:int,isPrimary:boolean>"

_SPAN = "file_id string, start_line int, end_line int, start_offset int, end_offset int, size_chars int"
_RELATIONS = f"dependencies array<{REL}>, consumers array<{REL}>, token_estimate int"

DDL = {
    "meta": "key string, value string",
    "solutions": "id string, name string, path string, file_hash string",
    "projects": "id string, solution_id string, name string, path string, target_framework string, is_test boolean, file_hash string",
    "source_files": "id string, project_id string, relative_path string, absolute_path string, content_hash string, length_chars int, is_generated boolean",
    "namespaces": "id string, project_id string, name string",
    "types": f"id string, project_id string, namespace_id string, name string, full_name string, kind string, accessibility string, is_static boolean, is_abstract boolean, is_sealed boolean, is_generated boolean, summary string, {_SPAN}, {_RELATIONS}, locations array<{LOC}>",
    "members": f"id string, type_id string, name string, kind string, signature string, accessibility string, is_static boolean, is_abstract boolean, is_async boolean, is_generated boolean, return_type string, summary string, {_SPAN}, {_RELATIONS}",
    "edges": "edge_seq bigint, from_id string, to_id string, kind string, file string, line int",
    "bodies": "file_id string, relative_path string, absolute_path string, content string",
}

TYPE_KINDS = ("class", "record", "struct", "interface", "enum", "delegate")
MEMBER_KINDS = ("method", "property", "field", "event", "constructor")
RELATION_KINDS = ("inherits", "implements", "usesInSignature", "usesInMember", "calls", "referencedBy")
#: Kinds that an impact graph follows outwards.
OUTBOUND_KINDS = ("calls", "usesInSignature", "usesInMember", "inherits", "implements")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns; those that it lacks are null, or an empty list."""
    made = []
    for f in schema(table):
        if f.name in df.columns:
            made.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            empty = F.array() if isinstance(f.dataType, T.ArrayType) else F.lit(None)
            made.append(empty.cast(f.dataType).alias(f.name))
    return df.select(*made)
