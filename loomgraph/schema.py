"""Schemas, kinds in their order, and the three classes of edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds, in the order in which they sort.
NODE_KINDS = ("Module", "Function", "Type", "Field", "Concept", "Dependency", "Extension", "ExtensionContribution")
EDGE_KINDS = ("Calls", "Inherits", "DataFlow", "Contains", "SemanticSimilar", "Impacts", "Contributes")
CLASSES = ("must", "may", "unknown")
# Attribute keys that every parse replaces; the last three are prefixes.
PARSER_KEYS = ("is_test", "return_type", "source_projection", "call_evidence_v1")
PARSER_PREFIXES = ("route_guard::", "entry_route::", "entry_route_params::")
# Kinds of nodes that belong to the graph, not to source files.
GRAPH_OWNED_KINDS = ("Concept", "Dependency", "Extension", "ExtensionContribution")

SPAN = T.StructType([T.StructField("start_byte", T.LongType()), T.StructField("end_byte", T.LongType()), T.StructField("start_row", T.IntegerType()), T.StructField("start_col", T.IntegerType())])
NODES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("span", SPAN),
        T.StructField("source", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ]
)
EDGES = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.FloatType())])
CLAIMS = T.StructType(
    [
        T.StructField("caller", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("source_fingerprint", T.LongType()),
        T.StructField("assumptions", T.ArrayType(T.StringType())),
        T.StructField("site", SPAN),
        T.StructField("class", T.StringType()),
        T.StructField("targets", T.ArrayType(T.LongType())),
        T.StructField("reason", T.StringType()),
        T.StructField("coverage_gap", T.BooleanType()),
    ]
)


def propagates(kind: Column) -> Column:
    """Edges that carry impact."""
    return kind.isin("Calls", "DataFlow", "Impacts")


def projected(kind: Column) -> Column:
    """Edges that a parse derives from source."""
    return kind.isin("Calls", "Inherits", "DataFlow", "Contains")


def reviewed(kind: Column) -> Column:
    """Edges that a diff reports."""
    return kind.isin("Calls", "Inherits", "DataFlow")


def parser_owned(key: Column) -> Column:
    out = key.isin(*PARSER_KEYS)
    for p in PARSER_PREFIXES:
        out = out | F.startswith(key, F.lit(p))
    return out


def kind_order(kind: Column, kinds=EDGE_KINDS) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind)
