"""Filling containers of fixed capacity with items of varying length.

Items count only by their length, so the plan is made on the histogram of lengths: at most ``capacity``
numbers, however large the corpus. Exact-complement hashing builds one container pattern at a time: put in
the longest length left, look up in the index of single, pair and triple sums whether available lengths
fill the gap exactly, and else add the longest that fits and look again. A pattern is used as many times
as its scarcest length allows, so each one exhausts a length and their number is bounded by the capacity,
not by the corpus. Where no exact filling is left, the longest fitting items fill up as best they can.
The items are then matched to the patterns' slots by their rank within their length.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.encoding import DEFAULT_TOKENIZER, encode_corpus
from knotwork.session import stage

CAPACITY = 2_048
RUN = 1_000_000  # items of a length that one task ranks


class _Stock:
    """Available items by length, the number of available pairs by their sum, and the sums that triples can have."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.count[length] += n
        have = self.count > 0
        self.pairs = np.zeros(capacity + 1, dtype=np.int64)  # unordered pairs of different lengths, both in stock
        lengths = np.flatnonzero(have)
        for a in lengths:
            b = lengths[lengths > a]
            np.add.at(self.pairs, (a + b)[a + b <= capacity], 1)
        self._triples: np.ndarray | None = None

    def triples(self) -> np.ndarray:
        """Whether three items in stock may have this sum; built anew after a length is used up."""
        if self._triples is None:
            lengths = np.flatnonzero(self.count[: self.capacity + 1])
            two = self.pairs > 0
            twice = 2 * lengths[(self.count[lengths] > 1) & (2 * lengths <= self.capacity)]
            two[twice] = True
            sums = np.zeros(self.capacity + 1, dtype=bool)
            for a in lengths:
                sums[a:] |= two[: self.capacity + 1 - a]
            self._triples = sums
        return self._triples

    def take(self, pattern: Counter, times: int) -> None:
        for length, k in pattern.items():
            self.count[length] -= k * times
            if not self.count[length]:
                other = np.flatnonzero(self.count[: self.capacity - length + 1])
                other = other[other != length]
                self.pairs[other + length] -= 1
                self._triples = None

    def free(self, used: Counter) -> np.ndarray:
        left = self.count
        if used:
            left = left.copy()
            for length, k in used.items():
                left[length] -= k
        return left

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """Up to three lengths in stock, beside those used, whose sum is the gap; longest first."""
        left = self.free(used)
        if left[gap] > 0:
            return (gap,)
        pair = self._pair(gap, left)
        if pair:
            return pair
        if not self.triples()[gap]:
            return None
        firsts = np.flatnonzero(left[: gap - 1] > 0)
        # the index counts pairs of different lengths; a pair of one length twice is looked up apart
        rest = gap - firsts
        double = (rest % 2 == 0) & (left[rest // 2] > 1)
        for a in firsts[(self.pairs[rest] > 0) | double][::-1]:
            left[a] -= 1
            pair = self._pair(gap - a, left)
            left[a] += 1
            if pair:
                return (int(a), *pair)
            if 3 * a < gap:
                return None  # the longest of three is at least a third
        return None

    @staticmethod
    def _pair(gap: int, left: np.ndarray) -> tuple[int, int] | None:
        if gap < 2:
            return None
        a = np.arange((gap + 1) // 2, gap)
        ok = (left[a] > 0) & (left[gap - a] > np.where(a * 2 == gap, 1, 0))
        hit = np.flatnonzero(ok)
        return (int(a[hit[-1]]), int(gap - a[hit[-1]])) if len(hit) else None


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) patterns that use up every item of the histogram ``counts``.

    Lengths are 1 to ``capacity``. Deterministic; the work depends on the number of different lengths.
    """
    stock = _Stock(counts, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    while stock.count.any():
        used: Counter = Counter()
        gap = capacity
        while gap:
            combination = stock.exact(gap, used) if gap < capacity else None
            if combination:
                used.update(combination)
                break
            fits = np.flatnonzero(stock.free(used)[1 : gap + 1] > 0)
            if not len(fits):
                break
            longest = int(fits[-1]) + 1
            # of many short items, as many at once as leave a gap that a single, pair or triple could still fill
            k = max(1, min(int(stock.free(used)[longest]), gap // longest - 3))
            used[longest] += k
            gap -= k * longest
        times = min(int(stock.count[length]) // k for length, k in used.items())
        stock.take(used, times)
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
    return out


def _slots(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple[int, int, int, int, int, int]]]:
    """Chunk widths by length, and (length, chunk, low, high, times, base) slots.

    The ranks low..high - 1 of a length go to the ``times`` containers from ``base`` on, in turn. A length's ranks are cut into as many equal chunks as it has slots, and a slot is listed in each chunk it
    touches, so the slots listed are at most twice as many, and so are the comparisons of all its items.
    """
    runs, base, done = defaultdict(list), 0, Counter()
    for lengths, times in plan_containers(counts, capacity):
        for length, k in Counter(lengths).items():
            runs[length].append((done[length], done[length] + k * times, times, base))
            done[length] += k * times
        base += times
    width = {length: -(-counts[length] // len(rows)) for length, rows in runs.items()}
    return width, [(length, c, *r) for length, rows in runs.items() for r in rows for c in range(r[0] // width[length], (r[1] - 1) // width[length] + 1)]


def pack_items(sizes: DataFrame, capacity: int = CAPACITY, item: str = "doc_id", size: str = "n_tokens", run: int = RUN) -> DataFrame:
    """(doc_id, part_no, start, n_tokens, container): every part of every item with its container.

    An item of more than ``capacity`` is split into parts of ``capacity`` and a last one with the rest;
    all others stay whole. Null, zero and negative sizes are left out. Containers are numbered from 0.
    Repeated rows are items of their own. ``sizes`` should be cheap to read twice (a stored table).

    Items get ranks within their length. A length of more than ``run`` items, which may hold most of the corpus, is
    ranked in buckets by hash of about that many, which start where the ones before end.
    """
    n = F.col(size).cast("bigint")
    parts = sizes.select(F.col(item).alias("doc_id"), n.alias("n")).where("n > 0").withColumn(
        "part_no", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))))
    parts = parts.select(
        "doc_id", "part_no", (F.col("part_no").cast("bigint") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("n") - F.col("part_no") * F.lit(capacity)).cast("int").alias("length"))
    counts = {r.length: r.k for r in parts.groupBy("length").agg(F.count("*").alias("k")).collect()}  # at most ``capacity`` rows
    width, slots = _slots(counts, capacity)
    spark = sizes.sparkSession
    # both tables are bounded by the capacity, not by the corpus
    length = spark.createDataFrame([(k, w, -(-counts[k] // run)) for k, w in width.items()], "length int, width bigint, pieces int")
    slot = spark.createDataFrame(slots, "length int, chunk bigint, low bigint, high bigint, times bigint, base bigint")
    parts = parts.join(F.broadcast(length), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part_no"), "pieces").cast("int"))
    ranked = parts.withColumn("rank", (F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "part_no")) - 1).cast("bigint"))
    if max(counts.values(), default=0) > run:
        tally = parts.groupBy("length", "bucket").agg(F.count("*").alias("k"))  # a row for every ``run`` items
        before = F.sum("k").over(Window.partitionBy("length").orderBy("bucket")) - F.col("k")
        ranked = ranked.join(tally.select("length", "bucket", before.alias("before")), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.withColumn("chunk", F.expr("rank div width")).join(F.broadcast(slot), ["length", "chunk"]).where("rank >= low and rank < high")
    return placed.select("doc_id", "part_no", "start", F.col("length").alias("n_tokens"), (F.col("base") + (F.col("rank") - F.col("low")) % F.col("times")).alias("container"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """``pack_items`` for whole texts, measured in tokens; null and empty texts are left out.

    The counts are stored once, so that the histogram and the placing don't encode the corpus twice.
    """
    sizes = encode_corpus(documents, tokenizer, folder, counts_only=True)
    return pack_items(stage(sizes, "token-counts"), capacity)
