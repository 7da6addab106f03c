"""python -m knotwork OPERATION --folder DIR [--params JSON]: one page of an operation as JSON."""

from __future__ import annotations

import argparse
import json
import sys

from knotwork import ops
from knotwork.graph import EDGE_COLUMNS, NODE_COLUMNS, PropertyGraph
from knotwork.session import get_spark, read_table


def context_of(spark, folder: str) -> ops.Context:
    """The graph of a folder with its commits and vectors, where these tables exist."""
    graph = PropertyGraph.load(spark, folder, (*NODE_COLUMNS, "properties", "valid_from", "valid_to"), (*EDGE_COLUMNS, "valid_from", "valid_to"))
    tables = {}
    for key, table in (("commits", "commits"), ("vectors", "node_vectors"), ("hunks", "hunks"), ("files", "files")):
        try:
            tables[key] = read_table(spark, folder, table)
        except Exception as e:  # an absent table only takes the operations that need it
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return ops.Context(graph, **tables)


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="knotwork", description=__doc__)
    parser.add_argument("operation", choices=sorted({*ops.OPERATIONS, *ops.ALIASES}))
    parser.add_argument("--folder", required=True)
    parser.add_argument("--params", default="{}", type=json.loads)
    options = parser.parse_args(argv)
    spark = get_spark("knotwork")
    spark.sparkContext.setLogLevel("ERROR")
    answer = ops.respond(context_of(spark, options.folder), options.operation, **options.params)
    print(json.dumps(answer, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
