"""Encoding of a corpus with a byte-level BPE of public rank files.

Short texts are encoded whole. A long text is halved, wherever the middle falls, until its leaves are small;
leaves are encoded apart, those of very long texts in different tasks, and joined as a tree. Each join encodes a
growing window of text around the cut again until both sides agree: the window starts at the last piece of
the left side (and the one before it, as a contraction may reach back that far), which the split pattern finds whatever follows, and ends where the pattern
has a boundary both in the window and in the right side alone. From there on the pattern, which never looks back,
goes on alike. A piece longer than a leaf is joined from the tokens of its two halves, by windows of tokens that
grow until they begin and end with what the sides have there: a byte pair encoding is valid if each pair of
neighbouring tokens is.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.batches import list_array, text_batches

DEFAULT_TOKENIZER = "byte_bpe_50k"
LONG_CHARS = 32_768  # texts above this are spread over tasks
LEAF_CHARS = 2_048

# A letter or digit before a blank always ends a piece of the split pattern: where to start looking for the last one.
_ANCHOR = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n\t])")


def rank_file(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> str:
    """Place of a rank file; ``folder`` defaults to the installed public vocabularies."""
    if folder:
        return f"{folder}/{name}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Part(NamedTuple):
    """An encoded part of a text; the last two pieces of its split take ``tail`` characters."""

    ids: np.ndarray
    text: str
    tail: int


class Encoder:
    """One tokenizer, with exact encoding of texts of any length."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.joins = 0

    def short(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=())

    def piece(self, data: bytes) -> np.ndarray:
        return np.array(self.bpe._core_bpe.encode_single_piece(data), dtype=np.uint32)

    def ends(self, text: str) -> list[int]:
        """Where the pieces of a text end."""
        return [m.end() for m in self.pattern.finditer(text)]

    def leaf(self, text: str) -> Part:
        """An encoded part of a text."""
        w = 64
        while True:
            start = 0
            if w < len(text):
                anchor = _ANCHOR.search(text, len(text) - w)
                start = anchor.start() if anchor else -1
            cuts = [0, *self.ends(text[start:])] if start >= 0 else []
            if start == 0 or len(cuts) > 2:
                return Part(self.short(text), text, len(text) - start - cuts[max(0, len(cuts) - 3)])
            w *= 4

    def tokens(self, ids: np.ndarray, size: int, last: bool = False) -> int:
        """Number of the first (or last) tokens that make up ``size`` bytes."""
        some = ids[-size:][::-1] if last else ids[:size]
        return int(np.searchsorted(np.cumsum(self.lengths[some]), size)) + 1 if size else 0

    def join_tokens(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a single piece from those of its two halves."""
        w = 8
        while True:
            a, b = left[-w:], right[:w]
            mid = self.piece(self.bpe.decode_bytes(a.tolist() + b.tolist()))
            if (len(a) == len(left) or mid[0] == a[0]) and (len(b) == len(right) or mid[-1] == b[-1]):
                return np.concatenate((left[: len(left) - len(a)], mid, right[len(b) :]))
            w *= 2

    def join(self, left: Part, right: Part) -> Part:
        self.joins += 1
        before = left.text[len(left.text) - left.tail :]
        n, w = len(before), 16
        while True:
            head = right.text[:w]
            window, there = self.ends(before + head), self.ends(head)
            whole = w >= len(right.text)
            if not whole:  # what touches the window's end isn't settled
                window, there = window[:-2], there[:-2]
            agreed = next((e for e in window if e == n or e > n and e - n in set(there)), None)
            if agreed is not None:
                break
            w *= 4
        window = [e for e in window if e <= agreed]
        text, out, start = before + head, [], 0
        own = {0, *self.ends(before)}
        for e in window:
            if start < n < e and e - start > LEAF_CHARS and start in own and e - n in there:
                a = self.tokens(left.ids, len(text[start:n].encode()), True)
                b = self.tokens(right.ids, len(text[n:e].encode()))
                out.append(self.join_tokens(left.ids[len(left.ids) - a :], right.ids[:b]))
            else:
                out.append(self.piece(text[start:e].encode()))
            start = e
        kept = left.ids[: len(left.ids) - self.tokens(left.ids, len(before.encode()), True)]
        rest = right.ids[self.tokens(right.ids, len(text[n:agreed].encode())) :]
        starts, behind = [0, *window[:-1]], len(right.text) - (agreed - n)
        if right.tail <= behind and right.tail < len(right.text):
            tail = right.tail
        else:  # at most one piece of the right side lies behind the window
            tail = behind + agreed - starts[-1 if behind else max(-2, -len(starts))]
        return Part(np.concatenate((kept, *out, rest)), left.text + right.text, tail)

    def tree(self, parts: list[Part]) -> np.ndarray:
        """Ids of the whole text from its encoded leaves in order."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0].ids if parts else np.zeros(0, dtype=np.uint32)

    def encode(self, text: str | None, size: int = LEAF_CHARS) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        return self.short(text) if len(text) <= size else self.tree([self.leaf(x) for x in halves(text, size)])


def halves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Leaves of at most ``size`` characters by halving, in order."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], size) + halves(text[mid:], size)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(documents: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, folder: str | None = None, long_chars: int = LONG_CHARS, counts_only: bool = False) -> DataFrame:
    """(doc_id, ids): the token ids of each document's whole text, without special tokens.

    One output row per input row. A null and an empty text both give an empty list. Strings that look like
    special tokens are ordinary text. Texts up to ``long_chars`` characters are encoded in the scan's own
    tasks without a shuffle; only the parts of longer ones are spread over tasks and assembled per row.
    With ``counts_only`` the result is (doc_id, n_tokens), and short texts send back a number each.
    Other columns are ignored; a null doc_id is kept.
    """
    path = rank_file(tokenizer, folder)
    rows = documents.select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > long_chars
    out_type = "doc_id bigint, n_tokens int" if counts_only else "doc_id bigint, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in text_batches(batches, "text"):
            ids = [e.encode(t) for t in b.column("text").to_pylist()]
            last = pa.array([len(x) for x in ids], type=pa.int32()) if counts_only else list_array(ids, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), last], ["doc_id", "n_tokens" if counts_only else "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                leaves = halves(text)
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(leaves, pa.string())],
                    ["doc_id", "row", "part", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            leaves = [e.leaf(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "part", "text")), pa.array([x.tail for x in leaves], pa.int32()), list_array([x.ids for x in leaves], pa.int32())],
                                             ["doc_id", "row", "part", "text", "tail", "ids"])

    def assemble(table: pa.Table) -> pa.Table:
        t = table.sort_by("part")
        ids = encoder(path).tree([Part(np.asarray(x.values.to_numpy(), dtype=np.uint32), text, tail) for x, text, tail in zip(t.column("ids"), t.column("text").to_pylist(), t.column("tail").to_pylist())])
        last = pa.array([len(ids)], type=pa.int32()) if counts_only else list_array([ids], pa.int32())
        return pa.table([t.column("doc_id").slice(0, 1), last], names=["doc_id", "n_tokens" if counts_only else "ids"])

    short_rows = rows.where(~long).mapInArrow(whole, out_type)
    # equal rows would share their parts, so each row gets an id; uuid() keeps its seed when a task is run again
    parts = rows.where(long).withColumn("row", F.uuid()).mapInArrow(cut, "doc_id bigint, row string, part int, text string")
    encoded = parts.repartition("row", "part").mapInArrow(encode_leaves, "doc_id bigint, row string, part int, text string, tail int, ids array<int>")
    return short_rows.unionByName(encoded.groupBy("row").applyInArrow(assemble, out_type))
