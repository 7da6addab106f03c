"""p1 to p4 against plain Python on small tables with every kind of irregular row."""

import json
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotwork.functions.canonical import canonical_json, canonical_text
from knotwork.operators.history import attribute_history
from knotwork.operators.hot_keys import dominant_keys, salted_counts
from knotwork.operators.references import classify_references, orphan_references, orphan_report
from knotwork.operators.snapshot_diff import snapshot_changes

T0 = datetime(2024, 1, 1)
EDGES = "edge_id bigint, src_id bigint, dst_id bigint, kind string, valid_from string, ingested_at timestamp_ntz, side string, salt int, n_rows int"
NODES = "id bigint, valid_from string, valid_to string, key string, born int"
VERSIONS = "id bigint, qualified_name string, properties string, valid_from string, valid_to string, recorded_at timestamp_ntz, island int"
SNAPS = "snap_no int, qualified_name string, line_start int, properties string, delivered_at timestamp_ntz, change string"


@pytest.fixture(scope="module")
def commits(spark):
    return spark.createDataFrame([(f"c{i}", i) for i in range(12)], "sha string, ord int")


def edges_of(spark, seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rnd.random() < 0.4
        rows.append((rnd.choice([None, *range(n)]), rnd.choice([None, 1, 2, 3]), 7 if hot else rnd.choice([None, *range(40)]), rnd.choice(["calls", "defines", None]),
                     rnd.choice([None, "gone", *(f"c{i}" for i in range(12))]), rnd.choice([None, T0, T0 + timedelta(days=40)]), "x", 0, 0))
    rows += rows[:50]
    return rows, spark.createDataFrame(rows, EDGES)


@pytest.mark.parametrize("options", [{}, {"salts": 3, "heavy_fraction": 0.05}])
def test_key_counts(spark, options):
    rows, df = edges_of(spark, 1)
    want = defaultdict(lambda: [0, set()])
    for e, s, d, k, *_ in rows:
        for side, key in (("src", s), ("dst", d)):
            if key is not None:
                want[side, key, k][0] += 1
                want[side, key, k][1] |= {e} - {None}
    got = {(r.side, r.node_id, r.kind): (r.n_rows, r.n_edges) for r in salted_counts(df, **options).collect()}
    assert got == {k: (n, len(ids)) for k, (n, ids) in want.items()}


def test_dominant_keys(spark):
    rows, df = edges_of(spark, 2)
    want = {(side, k) for i, side in ((1, "src"), (2, "dst")) for k in {r[i] for r in rows} - {None} if sum(r[i] == k for r in rows) >= 0.2 * len(rows)}
    assert {tuple(r) for r in dominant_keys(df, 0.2).collect()} == want and want
    assert salted_counts(df.limit(0)).count() == 0 and dominant_keys(df.limit(0)).count() == 0


@pytest.mark.parametrize("options", [{}, {"salts": 3, "heavy_fraction": 0.05}])
def test_orphans(spark, commits, options):
    rows, edges = edges_of(spark, 3)
    nodes = [(i, random.Random(i).choice([None, "c3", "c8", "nowhere"]), random.Random(i + 99).choice([None, "c5"]), "x", 0) for i in range(2, 30)] + [(None, "c1", None, "x", 0)]
    nodes += nodes[:5]
    ordinal = {f"c{i}": i for i in range(12)}
    born = {i: ordinal.get(f, -1) for i, f, *_ in nodes if i is not None}
    want, counts = set(), defaultdict(int)
    for e, s, d, _, at, when, *_ in rows:
        for side, k in (("src", s), ("dst", d)):
            if k is None:
                continue
            status = "missing" if k not in born else "late" if at in ordinal and born[k] > ordinal[at] else None
            if status:
                want.add((e, side))
                counts[side, when and when.date().replace(day=1), status] += 1
    nodes = spark.createDataFrame(nodes, NODES)
    assert {tuple(r) for r in orphan_references(edges, nodes, commits, **options).collect()} == want
    assert {(r.side, r.month, r.status): r.n_rows for r in orphan_report(edges, nodes, commits, **options).collect()} == counts
    assert any(r.status == "deleted" for r in classify_references(edges, nodes, commits).collect())
    assert orphan_references(edges, nodes.limit(0), commits).count() == len({(r[0], s) for r in rows for s, k in (("src", r[1]), ("dst", r[2])) if k is not None})
    assert orphan_references(edges.limit(0), nodes, commits).count() == 0


SPELLINGS = [None, "", " \t", "{}", "{ }", '{"a":1,"b":[1,2]}', '{"b": [1, 2], "a": 1.0}', '{"a":1,"b":[2,1]}', '{"a":1e0,"b":[1,2]}', '{"a":"1","b":[1,2]}', '{"a":null}', '{"a":"é"}', '{"a":"\\u00e9"}', "{", '{"a":1', '{"a":1} x']


def test_canonical_text(spark):
    odd = ['{"a":1}{"b":2}', "{} ] [ {}", '{} ], "x" }', "1,2", "[1,2]", "null", '"x"', "NaN", '{"a":NaN}', '{"a":-0.0}', '{"a":0}', '{"a":1E2}', '{"a":100}', '{"a":1,"a":2}', '{"a":2}', '{"a":"\\ud83d\\ude00"}', '{"a":"😀"}', '{"a":"\\ud800"}',
           '{"a":123456789012345678901234567890123456789012345}', '{"z":{"y":1,"x":[{"q":1,"p":2}]}}', "{'a':1}", '{"a":"tab\\tkept"}', '{"a":"\\u0001"}', '{"\\u0001":0,"v":1}', '1,"v":2', '{"a":0.10}', '{"a":0.1}', "[" * 50 + "]" * 50]
    texts = SPELLINGS + odd
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, properties string")
    got = {r.i: r.c for r in df.select("i", canonical_json(F.col("properties")).alias("c")).collect()}
    same = {i: canonical_text(t) for i, t in enumerate(texts)}
    assert {(i, j) for i in got for j in got if got[i] == got[j]} == {(i, j) for i in same for j in same if same[i] == same[j]}
    assert same[odd.index('{"a":1,"a":2}') + len(SPELLINGS)] == same[odd.index('{"a":2}') + len(SPELLINGS)]


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=6))
def test_canonical_ignores_spelling(value):
    assert canonical_text(json.dumps(value)) == canonical_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True))


def history_of(rows, last=11):
    ordinal = {f"c{i}": i for i in range(12)}
    best = {}
    for r in rows:
        start = ordinal.get(r[3] if r[3] is not None else r[4])
        if start is None or r[1] is None:
            continue
        end = ordinal.get(r[4])
        end = end if end is not None and end >= start else None
        key = (r[5] is not None, r[5], r[0], end is not None, end, canonical_text(r[2]))
        if (r[1], start) not in best or key > best[r[1], start]:
            best[r[1], start] = key
    out = []
    for name in sorted({q for q, _ in best}):
        starts = sorted(s for q, s in best if q == name)
        versions = []
        for i, s in enumerate(starts):
            *_, end, text = best[name, s]
            if i + 1 < len(starts):
                end = min(starts[i + 1] - 1, end if end is not None else 99)
            if versions and versions[-1][2] == text and versions[-1][1] is not None and versions[-1][1] + 1 == s:
                versions[-1][1] = end
            else:
                versions.append([s, end, text])
        out += [(name, f"c{s}", "" if e is None else f"c{e}") for s, e, _ in versions]
    return set(out)


@pytest.mark.parametrize("seed", range(3))
def test_history(spark, commits, seed):
    rnd = random.Random(seed)
    shas = [None, "zz", *(f"c{i}" for i in range(12))]
    rows = []
    for i in range(400):
        name = "hot" if rnd.random() < 0.4 else rnd.choice([None, *"abcdefghijklmno"])
        rows.append((i, name, rnd.choice(SPELLINGS[:10]), rnd.choice(shas), rnd.choice(shas), rnd.choice([None, T0 + timedelta(hours=i)]), 0))
    rows += rows[:40]
    rnd.shuffle(rows)
    got = attribute_history(spark.createDataFrame(rows, VERSIONS), commits)
    assert {(r.qualified_name, r.valid_from, r.valid_to) for r in got.collect()} == history_of(rows)
    assert attribute_history(spark.createDataFrame([], VERSIONS), commits).count() == 0
    assert attribute_history(spark.createDataFrame(rows, VERSIONS), commits.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_changes(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(500):
        name = rnd.choice([None, "", " a", "a", "a ", *(f"n{k}" for k in range(60))])
        rows.append((rnd.choice([None, 1, 2, 3, 4]), name, rnd.choice([None, 1, 2]), rnd.choice(SPELLINGS), rnd.choice([None, T0 + timedelta(hours=i)]), "x"))
    seen = set()  # ties would need the hash's order
    rows = [r for r in rows if (k := (r[0], (r[1] or "").strip(" "), r[4])) not in seen and not seen.add(k)]
    rows += rows[:50]
    best = {}
    for no, name, line, text, at, _ in rows:
        if no and name is not None:
            k, v = (no, name.strip(" ")), (at is not None, at, line, canonical_text(text))
            if k not in best or v[:2] > best[k][:2]:
                best[k] = v
    want = set()
    for no in (2, 3, 4):
        for name in {q for _, q in best}:
            new, old = best.get((no, name)), best.get((no - 1, name))
            if new and not old:
                want.add((no, name, "added"))
            elif old and not new:
                want.add((no, name, "removed"))
            elif new and old and new[2:] != old[2:]:
                want.add((no, name, "changed"))
    df = spark.createDataFrame(rows, SNAPS)
    assert {tuple(r) for r in snapshot_changes(df, 1, 4).collect()} == want and want
    assert snapshot_changes(df.limit(0), 1, 4).count() == 0
