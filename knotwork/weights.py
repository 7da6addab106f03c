"""Weights, costs and priors by edge kind and node kind, and column helpers over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_KINDS = ("file", "module", "class", "function", "method", "trait", "impl", "variable", "type", "document", "section", "concept", "diagram", "image", "commit", "author", "hyperedge", "flow")
STRUCTURAL = ("defines", "calls", "imports", "inherits", "implements", "reads_writes", "tested_by", "member_of", "entry_of")
SEMANTIC = ("mentions", "describes", "similar_to", "rationale_for")
CROSS_MODAL = ("illustrates", "documented_by")
EDGE_KINDS = STRUCTURAL + SEMANTIC + CROSS_MODAL

#: kind: (path cost, impact cost, rank weight, community weight)
EDGE_WEIGHTS = {
    "defines": (0.35, 1.25, 0.70, 0.70),
    "calls": (1.00, 1.00, 1.00, 0.55),
    "imports": (1.35, 1.60, 0.55, 0.45),
    "inherits": (0.80, 0.75, 1.15, 1.25),
    "implements": (0.80, 0.75, 1.15, 1.25),
    "reads_writes": (1.15, 0.90, 0.90, 0.85),
    "documented_by": (1.10, 1.20, 0.75, 0.75),
    "describes": (1.10, 1.20, 0.75, 0.75),
    "mentions": (1.70, 1.80, 0.75, 0.75),
    "illustrates": (1.70, 1.80, 0.60, 0.55),
    "similar_to": (2.00, 2.00, 0.60, 0.55),
    "rationale_for": (2.00, 2.00, 0.60, 0.55),
    "tested_by": (1.80, 1.10, 0.30, 0.60),
    "member_of": (3.00, 5.00, 0.05, 0.10),
    "entry_of": (3.00, 5.00, 0.05, 0.10),
}
#: kind: (search prior, impact boost, specificity for line ranges)
NODE_WEIGHTS = {
    "function": (4.0, 1.30, 5),
    "method": (4.0, 1.30, 5),
    "class": (4.0, 1.30, 4),
    "type": (4.0, 1.30, 3),
    "trait": (3.0, 1.20, 4),
    "impl": (3.0, 1.20, 4),
    "module": (1.0, 0.95, 3),
    "file": (1.0, 0.95, 1),
    "document": (2.0, 0.85, 1),
    "section": (2.0, 0.85, 2),
    "concept": (2.0, 0.85, 2),
    "diagram": (1.5, 0.75, 2),
    "image": (1.5, 0.75, 2),
    "variable": (0.5, 0.70, 2),
    "hyperedge": (0.5, 0.70, 2),
    "commit": (0.5, 0.70, 2),
    "author": (0.5, 0.70, 2),
    "flow": (1.5, 0.40, 2),
}
AMBIGUOUS_COMMUNITY_WEIGHT = 0.15
PATH, IMPACT, RANK, COMMUNITY = range(4)
PRIOR, BOOST, SPECIFICITY = range(3)


def _lookup(column: Column, table: dict, index: int, default: float) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, float(v[index]))]
    return F.coalesce(F.create_map(*pairs)[column], F.lit(float(default)))


def edge_weight(column: Column, index: int) -> Column:
    return _lookup(column, EDGE_WEIGHTS, index, 1.0)


def node_weight(column: Column, index: int) -> Column:
    return _lookup(column, NODE_WEIGHTS, index, (0.5, 0.7, 2)[index])


def sql_case(column: str, table: dict, index: int, default: float) -> str:
    """The same lookup as SQL text."""
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v[index])}" for k, v in table.items()) + f" ELSE {float(default)} END"
