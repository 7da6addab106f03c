"""Feature-hash embeddings of code and text: 384 signed, weighted hash buckets, normalised to length 1."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.graph import is_placeholder

DIMENSIONS = 384

#: Seeds and factor of the bucket and the sign hash.
BUCKET_SEED, SIGN_SEED, FACTOR = 0xCBF29CE484222325, 0x9E3779B97F4A7C15, 0x100000001B3
#: Weights of the features.
TOKEN, STEM, CANONICAL, GRAM, PIECE, PAIR, CANONICAL_PAIR, TRIPLE, SKIP, ACRONYM, CONCEPT = 1.25, 0.70, 1.05, 0.24, 0.42, 0.82, 0.58, 0.36, 0.28, 0.85, 3.0
#: Words that mean the same, by the word that stands for them.
SAME = {
    "remove": ("delete", "deleted", "remove", "removed", "drop", "purge", "cleanup"),
    "add": ("add", "added", "create", "created", "insert", "new"),
    "change": ("change", "changed", "changes", "diff", "delta", "modify", "modified", "update", "updated"),
    "search": ("find", "search", "lookup", "query", "discover"),
    "auth": ("auth", "authenticate", "authentication", "login", "signin", "signon"),
    "test": ("test", "tests", "spec", "specs", "coverage"),
    "bug": ("bug", "defect", "error", "failure", "panic", "regression"),
    "cache": ("cache", "cached", "memo", "memoize", "memoized"),
    "config": ("config", "configuration", "setting", "settings"),
    "storage": ("db", "database", "sqlite", "store", "storage", "persist", "persistence"),
    "doc": ("doc", "docs", "document", "documentation", "readme"),
    "embedding": ("embed", "embedding", "embeddings", "semantic", "vector", "vectors"),
    "source": ("file", "files", "path", "paths", "source", "sources"),
    "graph": ("graph", "node", "nodes", "edge", "edges", "flow", "flows"),
    "server": ("http", "server", "serve", "route", "routes"),
    "ignore": ("ignore", "gitignore", "exclude", "skip"),
    "index": ("index", "indexed", "indexing", "fts", "fts5"),
    "install": ("install", "installer", "setup", "hook", "hooks"),
    "agent": ("json", "mcp", "tool", "tools", "agent", "agents"),
    "rank": ("rank", "ranking", "score", "scored", "scoring", "boost", "boosted"),
    "extract": ("read", "reader", "parse", "parser", "extract", "extraction"),
    "review": ("review", "risk", "impact", "blast", "radius"),
    "symbol": ("symbol", "symbols", "function", "functions", "method", "methods"),
    "ui": ("terminal", "tui", "ui", "viewer", "view"),
    "watch": ("watch", "daemon", "poll", "polling"),
}
#: Endings a stem loses, the first that fits.
STEM_ENDINGS = ("ing", "ed", "er", "or", "able", "ible", "tion", "ions")
#: Concepts, each with word groups of which every one must occur; alternatives in a list.
CONCEPTS = (
    ("embedding", [[("embed", "embedding", "semantic", "vector")]]),
    ("delete-source", [[("delete", "remove", "drop", "purge"), ("file", "source", "node", "edge")]]),
    ("review-coverage", [[("test", "spec", "coverage"), ("risk", "review", "change", "diff")]]),
    ("semantic-search", [[("embed", "embedding", "semantic", "vector"), ("search", "rank", "score")]]),
    ("agent-interface", [[("mcp", "tool", "agent", "json")]]),
    ("automation", [[("config", "mcp", "setup")], [("watch", "daemon", "hook", "install")]]),
    ("graph-reasoning", [[("graph", "node", "edge", "flow"), ("rank", "impact", "path", "community")]]),
)
#: Words, operators and marks of code.
CODE_WORDS = frozenset(("fn", "def", "func", "class", "struct", "impl", "trait", "interface", "let", "const", "var", "public", "private", "static", "async", "await", "return", "yield", "for", "while", "if", "else", "match", "switch", "try", "catch", "throw", "new", "type", "enum", "union", "import", "export", "from", "package", "module", "pub", "self", "this"))
CODE_MARKS = re.compile(r"->|=>|\|\||&&|!=|<=|>=|\+\+|--|\+=|-=|\*=|/=|[{}\[\]();:,]")
#: Features of code by prefix, weight and words; a word of the group gives prefix:word.
CODE_GROUPS = (
    ("access", 1.2, ("public", "private", "protected", "static", "pub", "const")),
    ("type", 1.1, ("string", "int", "float", "bool", "boolean", "number", "vec", "vector", "list", "array", "map", "dict", "option", "optional", "nullable", "any", "void", "null")),
    ("async", 1.5, ("async", "await", "coroutine", "promise", "future", "defer")),
    ("coll", 1.0, ("append", "insert", "push", "pop", "remove", "filter", "map", "reduce", "sort", "reverse", "flatten", "merge", "join", "collect", "iter", "iterate", "find", "contains", "get", "set", "delete", "clear", "size", "length")),
    ("io", 1.0, ("read", "write", "open", "close", "stream", "buffer", "file", "path", "url", "http", "tcp", "socket", "connect", "disconnect")),
)
#: Features of code that any word of a group gives.
CODE_SIGNS = (("error-handling", 1.3, ("error", "exception", "panic")), ("try-catch", 1.3, ("try", "catch")), ("result-type", 1.3, ("result", "ok", "err")))
TEST_SIGN = (1.2, ("test", "spec", "mock", "stub", "fixture", "setup", "teardown", "assert", "expect", "should", "given", "when", "then"))

_CANONICAL = {w: k for k, words in SAME.items() for w in words}
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def singular(token: str) -> str:
    return token[:-1] if len(token) > 4 and token.endswith("s") else token


def tokens_of(text: str) -> list[str]:
    """Lower-case singular words, split at marks, camel humps, acronyms and digits; ASCII only."""
    return [singular(t.lower()) for word in re.findall("[A-Za-z0-9]+", text) for t in _HUMP.split(word) if t]


def stem(token: str) -> str:
    s = singular(token)
    return next((s[: -len(e)] for e in STEM_ENDINGS if len(s) > len(e) + 3 and s.endswith(e)), s)


@functools.lru_cache(maxsize=200_000)
def place(feature: str) -> tuple[int, float]:
    """Bucket and sign of a feature."""
    bucket, sign = BUCKET_SEED, SIGN_SEED
    for b in feature.encode():
        bucket = ((bucket ^ b) * FACTOR) & 0xFFFFFFFFFFFFFFFF
        sign = ((sign ^ b) * FACTOR) & 0xFFFFFFFFFFFFFFFF
    return bucket % DIMENSIONS, 1.0 if sign & 1 == 0 else -1.0


@functools.lru_cache(maxsize=50_000)
def _token_features(token: str) -> tuple[tuple[str, float], ...]:
    out = [(f"tok:{token}", TOKEN), (f"stem:{stem(token)}", STEM)]
    if _CANONICAL.get(token, token) != token:
        out.append((f"canon:{_CANONICAL[token]}", CANONICAL))
    out += [(f"char:{token[i:i + n]}", GRAM) for n in (3, 4, 5) for i in range(len(token) - n + 1)]
    if len(token) > 3:
        out += [(f"piece:{p}", PIECE) for p in sorted({x for n in (3, 4, 5) if len(token) >= n for x in (token[:n], token[-n:])})]
    return tuple(out)


def features_of(text: str) -> Counter:
    """Weights of the features of a text."""
    tokens = tokens_of(text)
    out: Counter = Counter()
    if not tokens:
        return out
    for t in tokens:
        for f, w in _token_features(t):
            out[f] += w
    canonical = [_CANONICAL.get(t, t) for t in tokens]
    for i in range(len(tokens) - 1):
        out[f"bi:{tokens[i]}:{tokens[i + 1]}"] += PAIR
        if canonical[i : i + 2] != tokens[i : i + 2]:
            out[f"cbi:{canonical[i]}:{canonical[i + 1]}"] += CANONICAL_PAIR
        if i + 2 < len(tokens):
            out[f"tri:{tokens[i]}:{tokens[i + 1]}:{tokens[i + 2]}"] += TRIPLE
            out[f"skip:{tokens[i]}:{tokens[i + 2]}"] += SKIP
    unique = list(dict.fromkeys(tokens))
    initials = "".join(t[0] for t in unique)
    if len(initials) >= 2:
        out[f"acro:{initials}"] += ACRONYM
    have = set(unique)
    if CODE_MARKS.search(text) or CODE_WORDS & set(text.split()):
        for prefix, w, words in CODE_GROUPS:
            for word in words:
                if word in have:
                    out[f"{prefix}:{word}"] += w
        for sign, w, words in CODE_SIGNS:
            if have & set(words):
                out[sign] += w
        first = next((x for x in TEST_SIGN[1] if x in have), None)
        if first:
            out[f"test-pat:{first}"] += TEST_SIGN[0]
    for name, ways in CONCEPTS:
        if any(all(have & set(group) for group in way) for way in ways):
            out[f"concept:{name}"] += CONCEPT
    return out


def embed(text: str) -> np.ndarray:
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    for f, w in features_of(text).items():
        i, sign = place(f)
        v[i] += sign * w
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm > 0 else v


def embedding_text(nodes: DataFrame) -> Column:
    """kind, name, qualified name with spaces, path, and the source text on a new line."""
    have = nodes.columns
    head = F.concat_ws(" ", "kind", "name", F.replace("qualified_name", F.lit("::"), F.lit(" ")), "source_uri")
    return F.when(F.col("source_text").isNull(), head).otherwise(F.concat(head, F.lit("\n"), "source_text")) if "source_text" in have else head


def embed_nodes(nodes: DataFrame, model: str = "hash-384") -> DataFrame:
    """(node_id, model, vector) of every node but call placeholders."""
    if model != "hash-384":
        raise ValueError(f"no such model: {model}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node_id": pdf["node_id"], "model": model, "vector": [embed(t or "") for t in pdf["text"]]})

    rows = nodes.where(~is_placeholder(F.col("qualified_name"))).select(F.col("id").alias("node_id"), embedding_text(nodes).alias("text"))
    return rows.mapInPandas(run, "node_id bigint, model string, vector array<float>")
