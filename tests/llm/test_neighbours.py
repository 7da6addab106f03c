import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from knotwork.llm import neighbours as nb

SCHEMA = "node_id bigint, model string, vector array<float>, embedded_at timestamp, bucket string"


def unit(vectors):
    ids = np.array(sorted(vectors))
    x = np.stack([np.asarray(vectors[i], dtype=np.float32).astype(np.float64) for i in ids])
    return ids, x / np.linalg.norm(x, axis=1)[:, None]


def brute(vectors, k=5):
    ids, x = unit(vectors)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    return {(int(i), int(ids[j])) for i, row in zip(ids, np.argsort(-s, axis=1, kind="stable")[:, :k]) for j in row}


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 8), 384))
    return {i * 3: (centres[i % len(centres)] + 0.35 * rng.standard_normal(384)).astype(np.float32) for i in range(n)}


def apart(n, seed=3):
    rng = np.random.default_rng(seed)
    return {i: rng.standard_normal(384).astype(np.float32) for i in range(n)}


def frame(spark, vectors, extra=()):
    return spark.createDataFrame([(i, "m", [float(y) for y in x], None, "clash") for i, x in vectors.items()] + list(extra), SCHEMA)


def stored(spark, folder, vectors):
    ids = list(vectors)
    numbers = pa.array(np.concatenate([np.asarray(vectors[i], dtype=np.float32) for i in ids]))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) * 384 + 1, 384, dtype=np.int32)), numbers)
    pq.write_table(pa.table({"node_id": pa.array(ids, pa.int64()), "vector": lists, "embedded_at": pa.nulls(len(ids), pa.timestamp("us"))}), f"{folder}/v.parquet")
    return spark.read.parquet(f"{folder}/v.parquet")


def recall(df, vectors, **options):
    """Share of the true pairs found; every list has to be whole."""
    rows = nb.nearest_nodes(df, **options).collect()
    assert len(rows) == 5 * len(vectors)
    want = brute(vectors)
    return len({(r.node_id, r.neighbour) for r in rows} & want) / len(want)


@pytest.mark.parametrize("bits", [None, 15])
def test_recall_of_clustered_vectors(spark, tmp_path, bits):
    vectors = clustered(3000)
    assert recall(stored(spark, tmp_path, vectors), vectors, bits=bits) >= 0.95


@pytest.mark.parametrize("bits", [None, 14])
def test_recall_without_clusters(spark, tmp_path, bits):
    vectors = apart(2000)
    assert recall(stored(spark, tmp_path, vectors), vectors, bits=bits) >= 0.9


def test_differing_bits_by_substring():
    index = nb.Index(8)
    assert len(index.cuts) == 16 and index.grown(1).radius == 64 * nb.WORDS
    a = np.array([[0, 0]], dtype=np.uint64)
    assert index.apart(a, a ^ np.uint64(1)).tolist() == [[1] + [0] * 7 + [1] + [0] * 7]


def test_exact(spark, tmp_path):
    vectors = apart(700, 5)
    assert recall(stored(spark, tmp_path, vectors), vectors, exact=True) == 1


@pytest.mark.parametrize("values", [{"BLOCK": 40, "WHOLE_HOME": 50}, {"DENSE": 0, "MANY": 1}])
def test_large_buckets_dense_buckets_and_split_homes(spark, tmp_path, monkeypatch, values):
    for name, value in values.items():
        monkeypatch.setattr(nb, name, value)
    vectors = clustered(900, 2)
    vectors |= {5000 + i: v for i, v in enumerate(apart(6, 9).values())}  # these have no cluster
    assert recall(stored(spark, tmp_path, vectors), vectors) >= 0.95


def test_probes_with_flipped_bits(spark, tmp_path):
    """Substrings of 21 bits: few neighbours share one exactly."""
    vectors = clustered(900, 4)
    df = stored(spark, tmp_path, vectors)
    assert recall(df, vectors, bits=21, recall=0.8) >= 0.8


@pytest.mark.parametrize("few", [nb.FEW, 0])
def test_few_vectors_far_apart(spark, monkeypatch, few):
    monkeypatch.setattr(nb, "FEW", few)
    vectors = apart(63)
    assert recall(frame(spark, vectors), vectors) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    vectors = clustered(60, 1)
    one = [float(y) for y in vectors[0]]
    copies = {1000 + i: np.array(one, dtype=np.float32) for i in range(40)}
    bad = [(5000, "m", None, None, ""), (5001, "m", [], None, ""), (5002, "m", [0.0] * 384, None, ""), (5003, "m", [float("nan")] + one[1:], None, ""),
           (5004, "m", [None] + one[1:], None, ""), (5005, "m", one[:256], None, ""), (None, "m", one, None, ""), (0, "m", one, None, "")]
    df = frame(spark, vectors | copies, bad)
    got = {}
    for r in nb.nearest_nodes(df).collect():
        got.setdefault(r.node_id, set()).add(r.neighbour)
    assert not set(got) & set(range(5000, 5010))
    assert got[0] == {1000, 1001, 1002, 1003, 1004}
    assert got[1000] == {0, 1001, 1002, 1003, 1004} and got[1039] == {0, 1000, 1001, 1002, 1003}
    assert all(len(x) <= 5 for x in got.values())


def test_empty_and_single(spark):
    assert nb.nearest_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nb.nearest_pairs(frame(spark, {7: np.ones(384)})).count() == 0
