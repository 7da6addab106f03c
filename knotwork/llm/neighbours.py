"""Most similar vectors by multi-index hashing with learned rotated binary codes.

A rotation of the leading principal axes, learned on a bounded sample so that signs lose least (iterative
quantisation), gives each vector a binary code. The code is cut into substrings, each an index of its own. By
the pigeonhole principle every code within a Hamming radius of ``tables x (flips + 1) - 1`` shares a substring
with the query up to ``flips`` bits, so probing the buckets of those substrings retrieves all of them. Buckets
hold codes and ids only: pairs whose codes differ in too many bits are dropped by XOR and population count. The
floats then travel once to a home, a group of vectors that lie together, where the surviving pairs get their
exact cosines. A vector that still lacks k others is probed with more flips, and at last held against all.

How many flips and differing bits are needed is measured, not assumed: a sample of queries is held against all
vectors, and the index is used as deep as their true neighbours need. Where no depth reaches the recall asked
for (vectors without any clusters), all vectors are compared in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.batches import sorted_groups
from knotwork.session import stage

SAMPLE = 8_192  # vectors that the rotation and the homes are learned on
QUERIES = 256  # of them, held against all vectors to measure the index
RECALL = 0.98  # share of the sampled queries' true neighbours that the index has to meet
WORDS = 2  # 64-bit words of a code
FEW = 512  # vectors that are simply all compared
BLOCK = 8_192  # codes of a bucket that one task compares
DENSE = 48  # similar pairs a row of a bucket above which its floats are compared in blocks instead of emitting pairs
HOME, HOMES = 2_048, 1_024  # vectors meant for a home, and the most centres
WHOLE_HOME = 8_192  # vectors of a home above which it is split
MANY = 4_096  # candidates of a lone vector above which it is rather held against all


def usable_rows(vectors: DataFrame, size: int = 384) -> DataFrame:
    """(node_id, vector, embedded_at, h1, h2) of the right length; what the numbers are is looked at in ``_unit``."""
    rows = vectors.where(F.col("node_id").isNotNull() & (F.size("vector") == size)).select(
        F.col("node_id").cast("bigint").alias("node_id"), F.col("vector").cast("array<float>").alias("vector"), "embedded_at")
    return rows.withColumn("h1", F.xxhash64(F.lit(1), "vector")).withColumn("h2", F.xxhash64(F.lit(2), "vector"))


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable ones: finite, without nulls, not all zero."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    at = np.flatnonzero(np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1))
    flat = flat[at]
    return at, flat / np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None]


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the code; deterministic."""
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    reduced = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(reduced @ rotation).T @ reduced)
        rotation = (u @ vt).T
    return mean, axes @ rotation


def _centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of the homes: spherical k-means from evenly spread rows."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)].astype(np.float32)
    x = sample.astype(np.float32)
    for _ in range(rounds):
        best = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def substring_bits(n: int) -> int:
    """Bits of a substring: 8 up to half a million vectors, then one more per doubling, so that buckets keep their size."""
    return min(32, max(8, math.ceil(math.log2(max(2, n))) - 11))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    projection: np.ndarray
    centres: np.ndarray

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The code of each row as WORDS unsigned words."""
        sign = (unit - self.mean) @ self.projection > 0
        full = np.zeros((len(unit), 64 * WORDS), dtype=np.uint8)
        full[:, : sign.shape[1]] = sign
        return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


@dataclass(frozen=True)
class Index:
    """Substrings of ``bits`` bits, none across two words; probes flip up to ``flips`` bits, pairs differ in up to ``radius``."""

    bits: int
    flips: int = 0
    radius: int = 64 * WORDS

    @property
    def cuts(self) -> list[tuple[int, int]]:
        return [(w, i * self.bits) for w in range(WORDS) for i in range(64 // self.bits)]

    def grown(self, flips: int) -> Index:
        return Index(self.bits, flips, max(self.radius, len(self.cuts) * (flips + 1) - 1))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits by substring of paired codes."""
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([np.bitwise_count((a[:, w] ^ b[:, w]) >> np.uint64(s) & mask) for w, s in self.cuts], axis=1)

    def posted(self, codes: DataFrame, flips: int = 0) -> DataFrame:
        """codes with the key of each index, and of the buckets up to ``flips`` bits away."""
        mask = (1 << self.bits) - 1
        masks = [sum(1 << i for i in f) for j in range(flips + 1) for f in itertools.combinations(range(self.bits), j)]
        own = [F.shiftrightunsigned(f"w{w}", s).bitwiseAND(F.lit(mask)) for w, s in self.cuts]
        keys = F.array(*[x.bitwiseOR(F.lit(t << 48)) for t, x in enumerate(own)])
        if flips:
            keys = F.flatten(F.transform(keys, lambda k: F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: k.bitwiseXOR(m))))
        return codes.select("class_id", "home", *[f"w{i}" for i in range(WORDS)], F.explode(keys).alias("key"))


def calibrate(rows: DataFrame, model: Model, queries: np.ndarray, k: int, bits: int, target: float) -> Index | None:
    """The least deep index that meets ``target`` of the queries' true neighbours, or None.

    Each query is held against every row; k neighbours a query come to the driver.
    """
    asked = queries.astype(np.float32)
    shared = rows.sparkSession.sparkContext.broadcast((model, asked))  # at most QUERIES vectors

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, asked = shared.value
        score, query, words = np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros((0, WORDS), np.int64)
        for b in batches:
            _, unit = _unit(b.column("vector"))
            if not len(unit):
                continue
            s = asked @ unit.astype(np.float32).T
            s[s > 1 - 1e-6] = -3  # itself and its copies
            near = min(k, s.shape[1])
            cols = np.argpartition(-s, near - 1, axis=1)[:, :near]
            q = np.repeat(np.arange(len(asked), dtype=np.int32), near)
            score = np.concatenate((score, s[q, cols.ravel()]))
            query = np.concatenate((query, q))
            words = np.concatenate((words, model.codes(unit[cols.ravel()]).view(np.int64)))
            order = np.lexsort((-score, query))
            score, query, words = score[order], query[order], words[order]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            score, query, words = score[first], query[first], words[first]
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score.astype(np.float64)), *(pa.array(words[:, i]) for i in range(WORDS))], ["q", "cosine", *(f"w{i}" for i in range(WORDS))])

    names = [f"w{i}" for i in range(WORDS)]
    found = rows.select("vector").mapInArrow(search, "q int, cosine double, " + ", ".join(f"{w} bigint" for w in names)).where("cosine > -2").distinct()
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), *names))).where(F.col("r") <= k)
    got = top.select("q", *names).toPandas()  # at most QUERIES x k rows
    if not len(got):
        return None
    a, b = model.codes(queries)[got["q"].to_numpy()], got[names].to_numpy(dtype=np.int64).view(np.uint64)
    parts = Index(bits).apart(a, b).min(axis=1)
    whole = np.bitwise_count(a ^ b).sum(axis=1)
    for flips in (0, 1):
        met = parts <= flips
        if met.mean() >= target:
            radius = int(np.quantile(whole[met], 0.995, method="higher"))
            return Index(bits, flips, max(radius, len(Index(bits).cuts) * (flips + 1) - 1))
    return None


def _chunks(rows: int, cols: int, size: int = 1 << 22) -> Iterator[slice]:
    step = max(1, size // max(1, cols))
    return (slice(i, i + step) for i in range(0, rows, step))


def _near_codes(index: Index, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of code pairs within the radius that no earlier index has met."""
    close = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(WORDS):
        close += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    mask = close <= index.radius
    r, c = np.nonzero(mask)
    if table and len(r):
        earlier = (index.apart(a[r], b[c])[:, :table] <= index.flips).any(axis=1)
        mask[r[earlier], c[earlier]] = False
    return mask


def _codes_of(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(f"w{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)


def _pairs(index: Index):
    """(a, b, home_a, home_b) of similar codes in a bucket; for a bucket dense with them one row (null, key) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, starts in sorted_groups(batches, "key"):
            codes = _codes_of(group)
            ids, home, role, keys = (group.column(c).to_numpy() for c in ("class_id", "home", "role", "key"))
            out, dense = [], []
            for lo, hi in zip(starts[:-1], starts[1:]):
                if hi - lo < 2:
                    continue
                left, right = lo + np.flatnonzero(role[lo:hi] != 2), lo + np.flatnonzero(role[lo:hi] != 1)
                met, found = [], 0
                for rows in _chunks(len(left), len(right)):
                    mask = _near_codes(index, int(keys[lo] >> 48), codes[left[rows]], codes[right])
                    mask &= ids[left[rows]][:, None] < ids[right][None, :]
                    r, c = np.nonzero(mask)
                    met.append((left[rows][r], right[c]))
                    found += len(r)
                    if found > DENSE * (hi - lo):
                        break
                if found > DENSE * (hi - lo):
                    dense.append(keys[lo])
                else:
                    out += met
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(home[a]), pa.array(home[b])], ["a", "b", "home_a", "home_b"])
            if dense:
                none = pa.nulls(len(dense), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(dense), pa.int64()), pa.array(dense, pa.int64()), none, none], ["a", "b", "home_a", "home_b"])

    return run


def _firsts(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of each a by (cosine, smaller b)."""
    order = np.lexsort((b, -cosine, a))
    a, b, cosine = a[order], b[order], cosine[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(cosine[keep])], ["a", "b", "cosine"])


def _at_home(k: int, both: bool):
    """Exact cosines of the pairs of a home; the k best of each end, or of a alone."""

    def run(vectors: pa.Table, pairs: pa.Table) -> pa.Table:
        ids = vectors.column("class_id").to_numpy()
        ids, first = np.unique(ids, return_index=True)
        a, b = (pairs.column(c).to_numpy() for c in "ab")
        if len(a):
            _, x = _unit(vectors.column("vector").take(pa.array(first)))
            i, j = np.searchsorted(ids, a), np.searchsorted(ids, b)
            cosine = np.concatenate([np.einsum("ij,ij->i", x[i[s]], x[j[s]]) for s in _chunks(len(a), x.shape[1])]).round(9)
            if both:
                a, b, cosine = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((cosine, cosine))
        else:
            cosine = np.zeros(0)
        return pa.Table.from_batches([_firsts(a, b, cosine, k)])

    return run


def _in_blocks(k: int, index: Index | None):
    """The k best of each row of a bucket, by exact cosines of whatever the single-precision products can't tell apart.

    With an index only pairs of similar codes that no earlier index has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, "bucket"):
            for lo, hi in zip(starts[:-1], starts[1:]):
                group = table.slice(int(lo), int(hi - lo))
                _, x = _unit(group.column("vector"))
                y, ids, role = x.astype(np.float32), group.column("class_id").to_numpy(), group.column("role").to_numpy()
                codes = _codes_of(group) if index else None
                left, right = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
                for rows in _chunks(len(left), len(right)):
                    rows = left[rows]
                    mask = _near_codes(index, int(group.column("tab")[0].as_py()), codes[rows], codes[right]) if index else np.ones((len(rows), len(right)), dtype=bool)
                    mask &= ids[rows][:, None] != ids[right][None, :]
                    if not mask.any():
                        continue
                    scores = y[rows] @ y[right].T
                    scores[~mask] = -3
                    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(rows), -2.0)
                    r, c = np.nonzero((scores >= least[:, None] - 4e-6) & mask)
                    r, c = rows[r], right[c]
                    cosine = np.concatenate([np.einsum("ij,ij->i", x[r[s]], x[c[s]]) for s in _chunks(len(r), x.shape[1])]).round(9)
                    yield _firsts(ids[r], ids[c], cosine, k)

    return run


_NEAR = "a bigint, b bigint, cosine double"


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _against_all(short: DataFrame, m: int, classes: DataFrame, n: int, k: int) -> DataFrame:
    """(a, b, cosine): the k best of all ``n`` classes for each of the ``m`` short ones; each pair of blocks is a task's work."""
    rows, cols = math.ceil(m / BLOCK), math.ceil(n / BLOCK)
    at = lambda blocks: F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("bigint")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    ask = short.select(at(rows).alias("i"), each(cols), "class_id", F.lit(1).alias("role"), "vector").withColumn("bucket", F.col("i") * cols + F.col("o"))
    answer = classes.select(at(cols).alias("i"), each(rows), "class_id", F.lit(2).alias("role"), "vector").withColumn("bucket", F.col("o") * cols + F.col("i"))
    met = ask.unionByName(answer).select("bucket", "class_id", "role", "vector")
    return _best(met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_blocks(k, None), _NEAR), k)


class Vectors:
    """Classes of equal vectors with their codes and homes, and the scan that holds their numbers."""

    def __init__(self, rows: DataFrame, classes: DataFrame, k: int):
        self.rows, self.classes, self.k = rows, classes, k

    def of(self, classes: DataFrame, *extra: str) -> DataFrame:
        """(class_id, vector, extra columns) of classes (class_id, h1, h2); a repeated row gives repeated ones."""
        keys = classes.select(F.col("class_id").alias("node_id"), "h1", "h2", *extra)
        return self.rows.join(keys, ["node_id", "h1", "h2"]).select(F.col("node_id").alias("class_id"), "vector", *extra)

    def once(self, classes: DataFrame) -> DataFrame:
        return self.of(classes).dropDuplicates(["class_id"])

    def rerank(self, pairs: DataFrame, both: bool) -> DataFrame:
        """(a, b, cosine) of stored pairs (a, b, home_a, home_b): the floats go to the homes of the pairs' first ends."""
        needed = pairs.select(F.col("a").alias("class_id"), F.col("home_a").alias("home")).unionByName(
            pairs.select(F.col("b").alias("class_id"), F.col("home_a").alias("home"))).distinct()
        homes = needed.groupBy("class_id").agg(F.collect_set("home").alias("homes"))  # at most as many as there are homes
        to = stage(homes.join(self.classes.select("class_id", "h1", "h2"), "class_id"), "homes")
        sent = self.of(to, "homes").select(F.explode("homes").alias("home"), "class_id", "vector")
        asked = pairs.select(F.col("home_a").alias("home"), "a", "b")
        return sent.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(_at_home(self.k, both), _NEAR)

    def in_buckets(self, posted: DataFrame, keys: DataFrame, index: Index) -> DataFrame:
        """(a, b, cosine) inside the buckets of ``keys`` (key, blocks), as products of blocks, each pair of blocks apart."""
        live = posted.join(keys, "key")
        block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
        role = F.col("role")
        # a block meets itself and each other block: role 0 is both sides, 1 the queries, 2 the candidates
        visits = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.when(
            o == block, F.array(F.struct(block.alias("i"), block.alias("j"), role.alias("role")))).otherwise(F.array(
                F.struct(block.alias("i"), o.alias("j"), F.lit(1).alias("role")), F.struct(o.alias("i"), block.alias("j"), F.lit(2).alias("role"))))))
        words = [f"w{i}" for i in range(WORDS)]
        visited = live.select("class_id", "key", *words, "role", F.explode(visits).alias("v")).where("role = 0 or v.role = role").select(
            "class_id", *words, F.xxhash64("key", "v.i", "v.j").alias("bucket"), "v.role", F.shiftright("key", 48).alias("tab"))
        vectors = self.once(self.classes.join(live.select("class_id").distinct(), "class_id", "left_semi"))
        met = visited.join(vectors, "class_id").select("bucket", "class_id", "role", "tab", *words, "vector")
        return met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_blocks(self.k, index), _NEAR)

    def indexed(self, index: Index) -> DataFrame:
        """(a, b, cosine): for each class the k best others that the index meets."""
        posted = index.posted(self.classes).withColumn("role", F.lit(2 if index.flips else 0))
        if index.flips:
            # the candidates lie in their own buckets only, the queries look into all within the flips
            posted = posted.unionByName(index.posted(self.classes, index.flips).withColumn("role", F.lit(1)))
        counts = posted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        large = stage(counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("key", "blocks"), "large-buckets")
        small = posted.join(large, "key", "left_anti")
        codes = [f"w{i}" for i in range(WORDS)]
        sorted_ = small.select("key", "class_id", "home", "role", *codes).repartition("key").sortWithinPartitions("key")
        pairs = stage(sorted_.mapInArrow(_pairs(index), "a bigint, b bigint, home_a int, home_b int"), "pairs")
        found = self.rerank(pairs.where("a is not null"), True)
        dense = pairs.where("a is null").select(F.col("b").alias("key"), F.lit(1).alias("blocks")).unionByName(large)
        return found if dense.isEmpty() else found.unionByName(self.in_buckets(posted, dense, index))

    def probed(self, short: DataFrame, index: Index) -> DataFrame:
        """(a, b, cosine): what the few ``short`` classes meet in the buckets up to index.flips away.

        Classes that meet more than MANY there are left to the comparison with all.
        """
        there = index.posted(self.classes).select("key", F.col("class_id").alias("b"), F.col("home").alias("home_b"), *[F.col(f"w{i}").alias(f"v{i}") for i in range(WORDS)])
        here = index.posted(short, index.flips).withColumnRenamed("class_id", "a").withColumnRenamed("home", "home_a")
        apart = sum((F.bit_count(F.col(f"w{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("w0").bitwiseXOR(F.col("v0"))))
        pairs = stage(here.join(there, "key").where(F.col("a") != F.col("b")).where(apart <= index.radius).select("a", "b", "home_a", "home_b").distinct(), "probed")
        many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("a")
        return self.rerank(pairs.join(many, "a", "left_anti").select("a", "b", "home_a", "home_b"), False)


def nearest_nodes(vectors: DataFrame, k: int = 5, size: int = 384, sample: int = SAMPLE, recall: float = RECALL, bits: int | None = None, exact: bool = False) -> DataFrame:
    """(node_id, neighbour, cosine): the k nodes with the highest cosine of every usable vector.

    Usable are vectors of ``size`` finite numbers, not all zero, with a node id; of several of one node the one
    embedded last counts (of equal times the one of the greater hash). Cosines are rounded to nine decimals; of
    equal ones the smaller node id comes first. Nodes with equal vectors are one class in the index, so a group
    of copies, however large, is one entry; the first k + 1 ids of a class are all that anyone's list can hold
    of it. Every node gets min(k, others) neighbours. An empty table, or one vector, gives no rows.

    The index meets at least ``recall`` of what a sample of queries has as true neighbours; ``exact`` compares
    all with all in blocks instead. ``bits`` overrides the substrings' length.
    """
    rows = usable_rows(vectors, size)
    spark = rows.sparkSession
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "node_id bigint, neighbour bigint, cosine double")
    # a bounded sample: rows whose hash lies below the share that ``sample`` is of all
    share = min(1 << 30, int(0.9 * sample / n * (1 << 30)) + 1)
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(3), "node_id", "h1"), F.lit(1 << 30)) < share) if n > sample else rows
    _, unit = _unit(drawn.select("vector").limit(sample).toArrow().column("vector"))
    if not len(unit):
        unit = np.zeros((1, size))
    unit = np.unique(unit, axis=0)
    picked = np.random.default_rng(5).permutation(len(unit))[:QUERIES]
    model = Model(*learn_rotation(unit, min(64 * WORDS, size)), _centres(unit, max(1, min(HOMES, n // HOME, len(unit)))))
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers a bit and centre

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            at, x = _unit(b.column("vector"))
            if not len(at):
                continue
            code = model.codes(x).view(np.int64)
            home = (x.astype(np.float32) @ model.centres.T).argmax(axis=1).astype(np.int32)
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("node_id", "embedded_at", "h1", "h2")), *(pa.array(code[:, i]) for i in range(WORDS)), pa.array(home)],
                                             ["node_id", "embedded_at", "h1", "h2", *words, "home"])

    words = [f"w{i}" for i in range(WORDS)]
    kind = dict(rows.dtypes)["embedded_at"]
    coded = rows.mapInArrow(encode, f"node_id bigint, embedded_at {kind}, h1 bigint, h2 bigint, " + ", ".join(f"{w} bigint" for w in words) + ", home int")
    last = coded.groupBy("node_id").agg(F.max(F.struct("embedded_at", "h1", "h2", *words, "home")).alias("r"))
    ids = stage(last.select("node_id", "r.h1", "r.h2", *[f"r.{w}" for w in words], "r.home"), "vector-codes")
    named = ids.groupBy("h1", "h2").agg(F.min("node_id").alias("class_id"), *[F.first(c).alias(c) for c in (*words, "home")])
    classes = stage(named, "vector-classes")
    sizes = {r.home: r.n for r in classes.groupBy("home").agg(F.count("*").alias("n")).collect()}  # at most HOMES rows
    m = sum(sizes.values())
    split = {h: math.ceil(x / WHOLE_HOME) for h, x in sizes.items() if x > WHOLE_HOME}
    if split:
        pieces = F.coalesce(F.create_map(*[F.lit(x) for p in split.items() for x in p])[F.col("home")], F.lit(1))
        classes = classes.withColumn("home", F.col("home") + F.lit(HOMES) * F.pmod(F.xxhash64("class_id"), pieces).cast("int"))
    v = Vectors(rows, classes, k)
    index = None if exact or m <= FEW else calibrate(rows, model, unit[picked], k, bits or substring_bits(m), recall)
    if index is None:
        whole = v.once(classes)
        near = stage(_against_all(whole, m, whole, m, k), "near") if m > 1 else spark.createDataFrame([], _NEAR)
    else:
        near = stage(_best(v.indexed(index), k), "near")
        for flips in (index.flips + 1, index.flips + 2, None):
            full = near.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("n")).where(F.col("n") >= min(k, m - 1))
            lacking = m - full.count()
            if not lacking:
                break
            short = stage(classes.join(full, "class_id", "left_anti"), "near-short")
            more = v.probed(short, index.grown(flips)) if flips else _against_all(v.once(short), lacking, v.once(classes), m, k)
            near = stage(_best(near.unionByName(more), k), "near")
    return _expanded(near, ids.join(classes.select("class_id", "h1", "h2"), ["h1", "h2"]).select("class_id", "node_id"), k)


def _expanded(near: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(node_id, neighbour, cosine) of the nodes from the k best (a, b, cosine) of their classes."""
    first = Window.partitionBy("class_id").orderBy("node_id")
    heads = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("class_id").agg(F.sort_array(F.collect_list("node_id")).alias("ids"))
    heads = stage(heads, "class-heads")
    own = heads.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("cosine"))
    reach = near.unionByName(own).join(heads.withColumnRenamed("class_id", "b"), "b").select("a", "cosine", F.explode("ids").alias("id"))
    # k + 1 bounded entries per class: each member drops itself and keeps k
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "id")
    lists = reach.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("a").agg(
        F.sort_array(F.collect_list(F.struct("r", "id", "cosine"))).alias("entries"))
    mine = members.join(lists.withColumnRenamed("a", "class_id"), "class_id")
    others = F.slice(F.filter("entries", lambda e: e["id"] != F.col("node_id")), 1, k)
    return mine.select("node_id", F.explode(others).alias("e")).select("node_id", F.col("e.id").alias("neighbour"), "e.cosine")


def nearest_pairs(vectors: DataFrame, k: int = 5, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs where one is among the k most similar of the other."""
    near = nearest_nodes(vectors, k, **options)
    return near.select(F.least("node_id", "neighbour").alias("id_a"), F.greatest("node_id", "neighbour").alias("id_b")).distinct()
