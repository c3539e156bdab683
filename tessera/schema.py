"""Schemas and alphabets of the property graph and of the event log."""

from __future__ import annotations

from pyspark.sql import types as T

#: The edge kinds, in the order that defines the dimensions of a profile; the store knows one more.
EDGE_KINDS = (
    "CALLS", "REFERENCES", "EXTENDS", "IMPLEMENTS", "OVERRIDES", "INJECTS", "CONTAINS", "IMPORTS",
    "ANNOTATES", "TYPE_OF", "READS_FIELD", "WRITES_FIELD", "RETURNS_TYPE", "CONSTRUCTS", "RAISES",
)
STORE_EDGE_KINDS = (*EDGE_KINDS, "USES_TRAIT")
NODE_KINDS = ("file", "module", "class", "interface", "enum", "function", "method", "field", "parameter", "annotation", "type_alias", "namespace")

#: (kind, direction) pairs: the dimensions of a depth-1 profile.
DIMS = tuple((k, d) for k in EDGE_KINDS for d in ("out", "in"))

SYMBOL = T.StructType(
    [T.StructField(n, T.StringType(), n not in ("id",)) for n in ("id", "kind", "language", "repo", "qualified_name", "short_name", "file")]
    + [T.StructField(n, T.LongType()) for n in ("line", "col", "end_line", "end_col")]
    + [T.StructField(n, T.StringType()) for n in ("signature", "visibility", "ast_hash")]
    + [T.StructField(n, T.BooleanType()) for n in ("is_abstract", "is_static")]
    + [T.StructField(n, T.StringType()) for n in ("branch", "source", "repo_commit_sha", "partition")]
    + [T.StructField(n, T.TimestampType()) for n in ("indexed_at", "repo_commit_date")]
)
EDGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("src_id", "dst_id", "kind")] + [T.StructField("count", T.LongType()), T.StructField("provenance", T.StringType())]
)
TOKEN = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("text", "kind", "repo", "file")] + [T.StructField(n, T.LongType()) for n in ("line", "col")] + [T.StructField(n, T.StringType()) for n in ("symbol_id", "repo_commit_sha")]
)
HLC = T.StructType([T.StructField("physical", T.LongType()), T.StructField("logical", T.LongType()), T.StructField("replica", T.StringType())])
EVENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("hlc", HLC), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType())])
