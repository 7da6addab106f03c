"""A canonical text for JSON values, so that equal values have equal text.

Key order, spacing and escapes don't count; the order in arrays does; a key holding null differs
from a missing key and a string from a number. Numbers compare by value. Null, blank and ``{}`` give
the empty string. Text that isn't valid JSON stands for itself.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_END = "\x01"
_VALUE, _RAW = "v:", "t:"


def _number(x: Decimal) -> str:
    if x == 0:
        return "0"
    text = format(x, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _dump(x) -> str:
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_dump(k)}:{_dump(x[k])}" for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_dump, x)) + "]"
    if isinstance(x, Decimal):
        return _number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False).encode("utf-8", "backslashreplace").decode()
    return json.dumps(x)


def _refuse(name: str):
    raise ValueError(name)


def canonical_text(text: str | None) -> str:
    """The same function for one Python string; the slow path and the test oracle."""
    if text is None or not text.strip(" \t\r\n"):
        return ""
    try:
        value = json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=_refuse)
        out = _dump(value)
    except (ValueError, RecursionError, ArithmeticError):
        return _RAW + text
    return "" if out == "{}" else _VALUE + out


@F.pandas_udf(StringType())
def _canonical_slow(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def canonical_json(col: Column) -> Column:
    """Column form. Almost every row stays in the JVM, where VARIANT sorts keys and drops spacing.

    The text is parsed between a first key and a closing sentinel key, so that trailing garbage, which
    the parser would ignore, either breaks the object or shows as a third key. Only rows that fail
    this test, or hold exponents, control characters or very long digits (where VARIANT keeps another
    spelling), reach Python; for the others the pandas function gets nulls.
    """
    text = col.cast("string")
    blank = text.isNull() | ~text.rlike(r"[^ \t\r\n]")
    parsed = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"\\u0001":0}')))
    whole = F.coalesce(F.size(parsed.cast("map<string,variant>")) == 2, F.lit(False)) & F.coalesce(
        F.element_at(parsed.cast("map<string,variant>"), F.lit(_END)).isNotNull(), F.lit(False)
    )
    odd = text.rlike(r"[0-9][eE]|[0-9.]{30}|\\u00[01]|\\u[dD]|\\[bf]")
    plain = ~blank & whole & ~odd
    value = F.coalesce(F.to_json(F.try_variant_get(parsed, "$.v", "variant")), F.lit("null"))
    quick = F.when(plain, F.when(value == "{}", F.lit("")).otherwise(F.concat(F.lit(_VALUE), value)))
    slow = _canonical_slow(F.when(~blank & ~plain, text))
    return F.when(blank, F.lit("")).otherwise(F.coalesce(quick, slow))
