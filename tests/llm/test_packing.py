from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.packing import _slots, pack_documents, pack_items, plan_containers
from knotwork.session import read_table


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=25))
def test_plan_uses_every_item_once_and_never_overfills(counts):
    used = Counter()
    for lengths, times in plan_containers(counts, 40):
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] += times
    assert used == Counter({k: v for k, v in counts.items() if v})


def test_exact_complements_are_found():
    plan = plan_containers({60: 5, 40: 5, 70: 3, 20: 3, 10: 3, 50: 2, 25: 4}, 100)
    assert all(sum(x) == 100 for x, _ in plan)


def first_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, room in enumerate(bins):
            if room >= x:
                bins[i] -= x
                break
        else:
            bins.append(capacity - x)
    return len(bins)


def test_no_worse_than_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for draw in (rng.integers(1, 257, 600), np.clip(rng.lognormal(3, 1, 600), 1, 256).astype(int)):
        n = sum(k for _, k in plan_containers(Counter(draw.tolist()), 256))
        assert n <= first_fit_decreasing(draw.tolist(), 256) * 1.01 + 1


def test_few_slots_are_compared_per_item():
    draw = np.clip(np.random.default_rng(7).lognormal(5, 1.2, 1_000_000), 1, 2048).astype(int)
    counts = Counter(draw.tolist())
    width, slots = _slots(counts, 2048)
    held = Counter()
    for length, chunk, *_ in slots:
        held[length, chunk] += 1
    compared = sum(k * max(0, min(width[length], counts[length] - chunk * width[length])) for (length, chunk), k in held.items())
    assert compared <= 3 * len(draw)


@pytest.mark.parametrize("run", [1_000_000, 2])
def test_items_are_placed_whole(spark, run):
    rows = [(i, n) for i, n in enumerate([5, 5, 5, 3, 2, 9, 23, 10, 0, None, -1, 1])] + [(0, 5)]
    got = pack_items(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), capacity=10, run=run).collect()
    fill, parts = Counter(), Counter()
    for r in got:
        fill[r.container] += r.n_tokens
        parts[r.doc_id] += r.n_tokens
    assert max(fill.values()) <= 10 and set(fill) == set(range(len(fill)))
    assert parts == Counter({0: 10, 1: 5, 2: 5, 3: 3, 4: 2, 5: 9, 6: 23, 7: 10, 11: 1})
    assert [(r.part_no, r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.part_no) if r.doc_id == 6] == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert pack_items(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


def test_documents(spark, folder):
    rows = pack_documents(read_table(spark, folder, "documents")).collect()
    fill = Counter()
    for r in rows:
        fill[r.container] += r.n_tokens
    total = sum(fill.values())
    assert max(fill.values()) <= 2048
    assert len(fill) == -(-total // 2048)
