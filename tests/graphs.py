"""Small graphs as literals."""

import random

from knotwork.graph import PropertyGraph

NODES = "id bigint, kind string, name string, qualified_name string, source_uri string, line_start int, line_end int, is_test boolean, properties string, source_text string, valid_from string, valid_to string"
EDGES = "edge_id bigint, src bigint, dst bigint, kind string, confidence double, conf_class string, call_scope string, call_receiver string, resolved_from string, valid_from string, valid_to string"


def make(spark, nodes, edges):
    """nodes: (id, kind, name, extra dict); edges: (src, dst, kind, extra dict); both extras optional."""
    rows, links = [], []
    for n in nodes:
        i, kind, name, *x = n
        x = x[0] if x else {}
        rows.append((i, kind, name, x.get("qualified_name", f"m::{name}"), x.get("source_uri", f"src/{name}.rs"), x.get("line_start", 1), x.get("line_end", 10), x.get("is_test", False), x.get("properties"), x.get("source_text"), x.get("valid_from"), x.get("valid_to")))
    for k, e in enumerate(edges):
        s, d, kind, *x = e
        x = x[0] if x else {}
        conf = x.get("conf_class", "extracted")
        links.append((k, s, d, kind, x.get("confidence", {"extracted": 1.0, "inferred": 0.7, "ambiguous": 0.0}[conf]), conf, x.get("call_scope"), x.get("call_receiver"), None, x.get("valid_from"), x.get("valid_to")))
    return PropertyGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES))


def random_graph(spark, seed, n=40, m=90):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    g = make(spark, [(i, rnd.choice(["function", "method", "class", "file"]), f"x{i}") for i in range(n)], [(s, d, rnd.choice(["calls", "imports", "defines"])) for s, d in pairs])
    return g, pairs
