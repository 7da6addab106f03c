import random
import time

import pytest

from knotwork.llm import neardup
from knotwork.llm.neardup import near_duplicate_groups, near_duplicate_pairs


def grams(s):
    return {s[i : i + 5] for i in range(max(1, len(s) - 4))}


def brute(rows, threshold=0.6):
    content = {}
    for i, name, text in rows:
        c = " ".join(f"{name or ''} {text or ''}".lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "))
        c = " ".join(x for x in c.split(" ") if x)
        if i is not None and len(c) >= 24:
            content[i] = grams(c)
    ids = sorted(content)
    return {(a, b) for a in ids for b in ids if a < b and len(content[a] & content[b]) / len(content[a] | content[b]) >= threshold}


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        words[rnd.randrange(len(words))] = "".join(rnd.choice("abcdefgh") for _ in range(6))
    return " ".join(words)


@pytest.mark.parametrize("hot", [neardup.HOT, 1])
def test_pairs_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BLOCK", min(neardup.BLOCK, 16 * hot))
    rnd = random.Random(2)
    rows = []
    for g in range(40):
        words = ["".join(rnd.choice("klmnopqrstuv") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.choice([8, 40, 200]))]
        for _ in range(rnd.randint(1, 5)):
            rows.append((len(rows), "Name", edited(rnd, words, rnd.randint(0, len(words) // 8))))
    rows += [(900, None, None), (901, "short", "x"), (902, "A" * 40, None), (903, "a" * 40, "\t\n "), (904, "a" * 40, ""), (None, "a" * 40, None)]
    rows += [(905, "文" * 30 + "字" * 30, None), (906, "文" * 30 + "字" * 31, None), (907, "long", "xyz " * 20_000), (908, "long", "xyz " * 20_001)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id bigint, name string, source_text string, content string, class_id string")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df).collect()}
    want = brute(rows)
    assert got == want and len(want) > 20


def test_a_group_of_copies_is_one_class(spark):
    rows = [(i, "copied", "the same function body again and again") for i in range(300)] + [(1000, "other", "something else entirely, all of it")]
    rows.append((1001, "copied", "the same function body again and again!"))
    groups = {r.id: (r.class_id, r.n_links) for r in near_duplicate_groups(spark.createDataFrame(rows, "id bigint, name string, source_text string")).collect()}
    assert {groups[i] for i in range(300)} == {(0, 1)} and groups[1000] == (1000, 0) and groups[1001] == (1001, 1)


def test_many_texts_of_one_template(spark, tmp_path):
    """20,000 short texts behind a common header: no pair is alike but the planted ones, and none is emitted."""
    rnd = random.Random(4)
    head = "licensed under the terms of the public licence, see the file for details: "
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, "t", head + word(70)) for i in range(20_000)]
    rows += [(100_000 + i, "t", rows[i * 50][2][:-2] + "zz") for i in range(100)]
    began = time.time()
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(spark.createDataFrame(rows, "id bigint, name string, source_text string")).collect()}
    assert got == {(i * 50, 100_000 + i) for i in range(100)} and time.time() - began < 240


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, name string, source_text string")
    assert near_duplicate_pairs(df).count() == 0 and near_duplicate_groups(df).count() == 0
