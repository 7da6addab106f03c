"""Text similarities Spark has no builtin for, as plain functions and pandas functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 1.0 - levenshtein(a, b) / max(len(a), len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text to a window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    common = " ".join(sorted(set(a.split()) & set(b.split())))
    return max(ratio(common, a), ratio(common, b)) if common else 0.0


def subsequence_ratio(query: str, candidate: str) -> float:
    """Share of the candidate that the query covers as a subsequence, 0 if it isn't one."""
    rest = iter(candidate)
    return len(query) / max(1, len(candidate)) if all(c in rest for c in query) else 0.0


def fuzzy_score(query: str, candidate: str) -> float:
    """The best of seven similarities of two normalised names."""
    if not query or not candidate:
        return 0.0
    q, c = query.replace(" ", ""), candidate.replace(" ", "")
    initials = "".join(w[0] for w in candidate.split())
    return max(ratio(query, candidate), ratio(q, c), partial_ratio(q, c), token_sort_ratio(query, candidate), token_set_ratio(query, candidate), ratio(q, initials), subsequence_ratio(q, c))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(mine, theirs)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised for a common start of up to four characters where it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j)


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def jaro_winkler_column(a: Column, b: Column) -> Column:
    return _jaro_winkler(a, b)


def nfc(text: Column) -> Column:
    """NFC form; ASCII text, which is its own, doesn't leave the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(F.coalesce(_nfc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text))


def fuzzy_column(query: str):
    """A pandas function of two columns of names: the better fuzzy score against a fixed query."""

    @F.pandas_udf(DoubleType())
    def score(names: pd.Series, qualified: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        out = []
        for pair in zip(names, qualified):
            for x in pair:
                if x not in known:
                    known[x] = fuzzy_score(query, x or "")
            out.append(max(known[x] for x in pair))
        return pd.Series(out, dtype="float64")

    return score
