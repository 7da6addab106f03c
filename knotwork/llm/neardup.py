"""Near-duplicate texts: banded MinHash candidates, verified by odd sketches and then exactly.

A text is its set of distinct character n-grams. Equal texts become one class first, so copies cost
nothing further. Each class gets ``BANDS * ROWS`` MinHash samples; classes that agree in all rows of a band
are candidates. The samples, folded into a bitmap of parities (an odd sketch), estimate the similarity of a
candidate pair from the population count of the XOR of two bitmaps, in the JVM. Pairs whose estimate isn't
clearly too low are checked exactly.

A band that many classes share (a licence header, a template) is hot: its classes aren't paired. They go to
blocks, pairs of blocks with a hot band in common meet in a task of their own, and there the same sketches and
the same exact check let only similar pairs out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.batches import list_array, sorted_groups, text_batches
from knotwork.session import stage

GRAM = 5
BANDS, ROWS = 80, 5  # a pair of similarity 0.6 shares a band with probability 0.9985, one of 0.2 with 0.025, of 0.1 with 0.0008
WORDS = 8  # 64-bit words of an odd sketch
SLACK = 0.2  # more than three standard deviations of the estimate at a similarity of 0.6
HOT = 512  # classes of a band above which they are compared in blocks
BLOCK = 2_048  # classes of a block


def normalised(text: Column) -> Column:
    """Lower case, each run of spaces, tabs, CR and LF as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def gram_hashes(text: str, n: int = GRAM) -> np.ndarray:
    """Distinct 64-bit hashes of the character n-grams of a text, sorted; a shorter text is one gram."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = min(n, len(c)) or 1
    h = np.full(max(0, len(c) - n + 1), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for i in range(n):
        h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return np.unique(h)


@functools.lru_cache(maxsize=4)
def _family(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a[:, None], rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)[:, None]


def sketch(grams: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, odd sketch words) of a set of grams."""
    k = bands * rows
    a, b = _family(k)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(k, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 4096):  # long texts in blocks; every gram takes part
        m = x[None, i : i + 4096] ^ b
        m *= a
        np.minimum(best, m.min(axis=1), out=best)
    sample = best.astype(np.uint64) << np.uint64(16) | np.arange(k, dtype=np.uint64)
    sample = (sample ^ (sample >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    sample ^= sample >> np.uint64(32)
    key = np.zeros(bands, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ sample[r::rows]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    bit = sample >> np.uint64(40)
    parity = np.bincount((bit % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    words = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
    # the band's number takes the upper bits, so keys of different bands never meet
    return (key >> np.uint64(8)).view(np.int64) | (np.arange(bands, dtype=np.int64) << 56), words


def text_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of items (id, content): (id, h1, h2) and (class_id, h1, h2, content).

    A class is one distinct content, named by its least id. Partial aggregation shrinks a group of copies,
    however large, to one row per task before the shuffle.
    """
    keyed = items.select("id", "content", F.xxhash64(F.lit(1), "content").alias("h1"), F.xxhash64(F.lit(2), "content").alias("h2"))
    members = keyed.select("id", "h1", "h2").distinct()
    classes = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.first("content").alias("content"))
    return members, classes


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_batches(batches, "content"):
        both = [sketch(gram_hashes(t)) for t in b.column("content").to_pylist()]
        words = np.stack([w for _, w in both]) if both else np.zeros((0, WORDS), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("class_id", "h1", "h2", "content")), list_array([k for k, _ in both], pa.int64()), *(pa.array(words[:, i]) for i in range(WORDS))],
            ["class_id", "h1", "h2", "content", "bands", *(f"w{i}" for i in range(WORDS))])


def sketch_table(classes: DataFrame) -> DataFrame:
    words = ", ".join(f"w{i} bigint" for i in range(WORDS))
    return classes.mapInArrow(_sketched, f"class_id bigint, h1 bigint, h2 bigint, content string, bands array<bigint>, {words}")


def _estimate(prefix_a: str, prefix_b: str) -> Column:
    """Similarity estimated from the odd sketches: 1 + n/(4k) ln(1 - 2z/n)."""
    n, k = 64 * WORDS, BANDS * ROWS
    z = sum((F.bit_count(F.col(f"{prefix_a}{i}").bitwiseXOR(F.col(f"{prefix_b}{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{prefix_a}0").bitwiseXOR(F.col(f"{prefix_b}0"))))
    return F.when(z * 2 >= n, F.lit(0.0)).otherwise(1 + F.lit(n / (4 * k)) * F.log(1 - z * F.lit(2.0 / n)))


def _jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
    out, last, grams = [], None, None
    for a, b in zip(left, right):
        if a != last:
            last, grams = a, gram_hashes(a)
        other = gram_hashes(b)
        common = len(np.intersect1d(grams, other, assume_unique=True))
        union = len(grams) + len(other) - common
        out.append(common / union if union else 1.0)
    return pd.Series(out, dtype="float64")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the classes that share a band; for a hot band one row (null, band) instead."""
    for group, starts in sorted_groups(batches, "band", HOT):
        ids, sizes = group.column("class_id").to_numpy(), np.diff(starts)
        hot = np.flatnonzero(sizes > HOT)
        ends = np.repeat(np.where(sizes > HOT, 0, starts[1:]), sizes)
        at, far = np.arange(len(ids)), 1
        while True:
            at = at[at + far < ends[at]]
            if not len(at):
                break
            x, y = ids[at], ids[at + far]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            far += 1
        if len(hot):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), pa.int64()), group.column("band").take(pa.array(starts[hot])).combine_chunks()], ["a", "b"])


class _Grams:
    """Inverted lists of the grams of some texts, for the exact overlap of one text with all of them."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in texts])
        self.grams, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        self.holders = np.repeat(np.arange(len(texts)), self.sizes)[np.argsort(inverse, kind="stable")]
        self.ends = np.cumsum(np.bincount(inverse, minlength=len(self.grams)))

    def similarity(self, grams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == grams)]
        lists = [self.holders[self.ends[i - 1] if i else 0 : self.ends[i]] for i in at]
        common = np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), dtype=np.int64)
        return common / (len(grams) + self.sizes - common)


def _in_blocks(threshold: float):
    n, k = 64 * WORDS, BANDS * ROWS
    most = n / 2 * (1 - np.exp(-4 * k * (1 - threshold + SLACK) / n))  # differing bits at the least estimate that is looked at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, "bucket"):
            for lo, hi in zip(starts[:-1], starts[1:]):
                group = table.slice(int(lo), int(hi - lo))
                ids, role = group.column("class_id").to_numpy(), group.column("role").to_numpy()
                words = np.stack([group.column(f"w{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
                left, right = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
                if not len(left) or not len(right):
                    continue
                texts = [gram_hashes(t) for t in group.column("content").to_pylist()]
                lists, out = _Grams([texts[i] for i in right]), []
                for i in left:
                    apart = np.bitwise_count(words[right] ^ words[i]).sum(axis=1)
                    ask = (apart <= most) & (ids[right] > ids[i] if role[i] == 0 else ids[right] != ids[i])
                    if ask.any():
                        s = lists.similarity(texts[i])
                        hit = np.flatnonzero(ask & (s >= threshold))
                        other = ids[right[hit]]
                        out.append((np.minimum(other, ids[i]), np.maximum(other, ids[i]), s[hit]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "similarity"])

    return run


def _hot_links(sketches: DataFrame, posted: DataFrame, hot: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the classes with a hot band (band): all that share one meet, block by block."""
    held = stage(posted.join(hot, "band"), "hot-bands")
    first = held.groupBy("class_id").agg(F.min("band").alias("first"))
    pieces = first.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    placed = first.join(pieces, "first").select("class_id", F.xxhash64("first", F.pmod(F.xxhash64("class_id"), "pieces")).alias("block"))
    placed = stage(placed, "hot-blocks")
    present = held.join(placed, "class_id").select("band", "block").distinct()
    meet = present.select("band", F.col("block").alias("i")).join(present.select("band", F.col("block").alias("j")), "band").where("i <= j").select("i", "j").distinct()
    same = F.col("i") == F.col("j")
    visits = stage(meet.select(F.xxhash64("i", "j").alias("bucket"), F.explode(F.when(same, F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("role")))).otherwise(
        F.array(F.struct(F.col("i").alias("block"), F.lit(1).alias("role")), F.struct(F.col("j").alias("block"), F.lit(2).alias("role"))))).alias("v")).select("bucket", "v.*"), "hot-visits")
    texts = placed.join(sketches.select("class_id", "content", *[f"w{i}" for i in range(WORDS)]), "class_id").join(visits, "block").drop("block")
    return texts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_blocks(threshold), "a bigint, b bigint, similarity double")


def similar_classes(sketches: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of classes at or above the threshold, from a stored sketch table."""
    posted = sketches.select(F.explode("bands").alias("band"), "class_id")
    met = stage(posted.repartition("band").sortWithinPartitions("band").mapInArrow(_met, "a bigint, b bigint"), "candidates")
    pairs = met.where("a is not null").distinct()
    words = [f"w{i}" for i in range(WORDS)]
    side = lambda k, p, cols: sketches.select(F.col("class_id").alias(k), *[F.col(c).alias(p + c) for c in cols])
    likely = pairs.join(side("a", "a", words), "a").join(side("b", "b", words), "b").where(_estimate("aw", "bw") >= threshold - SLACK).select("a", "b")
    texts = likely.join(side("b", "b", ["content"]), "b").join(side("a", "a", ["content"]), "a")
    jaccard = F.pandas_udf(_jaccard, "double")
    found = texts.select("a", "b", jaccard("acontent", "bcontent").alias("similarity")).where(F.col("similarity") >= threshold)
    hot = met.where("a is null").select(F.col("b").alias("band")).distinct()
    return found if hot.isEmpty() else found.unionByName(_hot_links(sketches, posted, hot, threshold)).dropDuplicates(["a", "b"])


def _contents(nodes: DataFrame, least: int = 24) -> DataFrame:
    content = normalised(F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("source_text", F.lit(""))))
    return nodes.select(F.col("id").cast("bigint").alias("id"), content.alias("content")).where(
        F.col("id").isNotNull() & (F.length("content") >= least))


def near_duplicate_classes(nodes: DataFrame, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(members, links) of nodes (id, name, source_text): (id, class_id) and (a, b, similarity) of class ids.

    Content is name, a space and source_text, null as empty, normalised; nodes with a null id or a content
    of less than 24 characters take no part. Rows of one id and content count once. An id with several
    contents belongs to several classes. An empty table gives empty results. Other columns are ignored.
    """
    members, classes = text_classes(_contents(nodes))
    sketches = stage(sketch_table(classes), "sketches")
    belongs = members.join(sketches.select("h1", "h2", "class_id"), ["h1", "h2"]).select("id", "class_id")
    return belongs, similar_classes(sketches, threshold)


def near_duplicate_pairs(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of nodes whose contents are similar, copies included.

    The form for small groups: its size is quadratic in a group of copies by definition. The classes and
    links of ``near_duplicate_classes`` say the same in linear size.
    """
    members, links = near_duplicate_classes(nodes, threshold)
    # classes of one member have no inner pairs; a pair of classes expands to the pairs of their members
    several = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    both = links.select("a", "b").unionByName(several)
    expanded = both.join(members.select(F.col("id").alias("x"), F.col("class_id").alias("a")), "a").join(
        members.select(F.col("id").alias("y"), F.col("class_id").alias("b")), "b")
    return expanded.where("x <> y and (a <> b or x < y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_duplicate_groups(nodes: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, class_id, n_links): each node's class of equal content and the number of other similar classes."""
    members, links = near_duplicate_classes(nodes, threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
