import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm.encoding import LEAF_CHARS, Encoder, encode_corpus, halves, rank_file
from knotwork.session import read_table


@pytest.fixture(scope="module")
def enc():
    return Encoder(rank_file())


PIECES = ["'", "l", "l", "'re", " ", "\n", "x'", "the ", "'s", "don't", "中文字，", "。", "    ", "\n\n", "  x", "123", "!!!", "é", "×,", "a" * 50, "0" * 70, " " * 60, "-" * 40, "😀", "\t", "Привет ", "　", "\x1c", "'ll"]


def joined(enc, text, size):
    leaves = halves(text, size)
    assert "".join(leaves) == text
    return enc.tree([enc.leaf(x) for x in leaves]).tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([1, 1, 1, 2, 60])), min_size=1, max_size=40), st.sampled_from([1, 2, 3, 7, 50]))
def test_halves_join_exactly(enc, pieces, size):
    text = "".join(p * k for p, k in pieces)
    assert joined(enc, text, size) == enc.bpe.encode_ordinary(text)


def test_unsplit_run_is_joined_as_a_tree(enc):
    rnd = random.Random(5)
    for alphabet in ("ab", "abcdefghij", "0123456789", "-=_", " ", "中文字", " \n"):
        text = "".join(rnd.choice(alphabet) for _ in range(30_000))
        for whole in (text, f"start {text} end"):
            assert joined(enc, whole, 1000) == enc.bpe.encode_ordinary(whole)


def test_long_texts_of_the_corpus_are_joined(enc, spark, folder):
    """Every text above a leaf goes through joins, as in p7_ids."""
    texts = [r.text for r in read_table(spark, folder, "documents").where("length(text) > 2048").collect()]
    before = enc.joins
    for text in texts:
        assert enc.encode(text).tolist() == enc.bpe.encode_ordinary(text)
    assert texts and enc.joins - before >= sum(len(t) // LEAF_CHARS for t in texts) - len(texts)


def test_corpus_against_other_library(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = read_table(spark, folder, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for limit in (32_768, 300):  # the second sends most texts along the distributed way
        got = {r.doc_id: r.ids for r in encode_corpus(docs, long_chars=limit).collect()}
        assert got.keys() == texts.keys()
        for k, text in texts.items():
            assert got[k] == t.encode(text or "", add_special_tokens=False).ids


def test_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "same", "z"), (3, "same", "z"), (None, "<|endoftext|>", "w"), (5, "b" * 200, "v"), (5, "b" * 200, "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df, long_chars=100).collect()), key=repr)
    assert [x for x in got if x[0] in (1, 2)] == [(1, []), (2, [])]
    assert len([x for x in got if x[0] == 3]) == 2 and len([x for x in got if x[0] == 5]) == 2
    assert 50256 not in [x for x in got if x[0] is None][0][1]
    counts = encode_corpus(df, long_chars=100, counts_only=True)
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(x[1]) for x in got)
    assert encode_corpus(df.limit(0)).count() == 0


def test_encode_none(enc):
    assert enc.encode(None).dtype == np.uint32 and len(enc.encode("")) == 0
