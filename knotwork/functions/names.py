"""Columns over names and paths: test conventions, languages, identifier forms, path parts.

The patterns are plain enough to mean the same in Java's and RE2's syntax, so SQL checks can share them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path conventions of tests, by folder, file name and framework suffix.
TEST_PATH = "|".join((
    r"(^|/)(tests?|__tests__|spec)/",
    r"(^|/)test_[^/]*$",
    r"(_test|_spec)(\.[^./]*)?$",
    r"\.(test|spec)\.[^./]*$",
    r"(^|/)(?i:test_helper)[^/]*$",
    r"Tests?\.(java|cs|php|kt|swift)$",
    r"Spec\.(kt|swift)$",
    r"(Spec|Suite|Test)\.scala$",
    r"(?i:_test|_spec)\.(dart|lua)$",
))
#: Name conventions of tests.
TEST_NAME = r"^[Tt]est_|_test$|_spec$|^.+Test$|^(should|it|given)[A-Z]|^Test[A-Z]"
#: File endings by language.
LANGUAGE_ENDINGS = {
    "rust": ("rs",),
    "python": ("py",),
    "js": ("ts", "tsx", "js", "jsx", "mjs", "cjs"),
    "cpp": ("c", "cc", "cpp", "cxx", "h", "hh", "hpp", "hxx"),
    "markdown": ("md", "markdown"),
    "diagram": ("svg",),
}
DOC_LANGUAGES = ("markdown", "diagram")


def is_test_path(path: Column) -> Column:
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike(TEST_PATH), F.lit(False))


def is_test_name(name: Column) -> Column:
    return F.coalesce(name.rlike(TEST_NAME), F.lit(False))


def looks_like_test(path: Column, name: Column) -> Column:
    return is_test_path(path) | is_test_name(name)


def language_of(path: Column) -> Column:
    """Language by file ending, null if none is known."""
    ending = F.regexp_extract(path, r"\.([^.]*)$", 1)
    out = F.lit(None).cast("string")
    for language, endings in LANGUAGE_ENDINGS.items():
        out = F.when(ending.isin(*endings), language).otherwise(out)
    return out


def language_sql(path: str) -> str:
    cases = " ".join(f"WHEN regexp_extract({path}, '\\.([^.]*)$', 1) IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in LANGUAGE_ENDINGS.items())
    return f"(CASE {cases} END)"


_SPLITS = (
    (r"[^\p{L}\p{N}]+", " "),
    (r"(\p{Ll})(\p{Lu})", "$1 $2"),
    (r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2"),
    (r"(\p{L})(\p{N})", "$1 $2"),
    (r"(\p{N})(\p{L})", "$1 $2"),
)


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier, split at marks, camel humps, acronyms and digits."""
    out = name
    for pattern, to in _SPLITS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.regexp_replace(F.lower(out), " +", " "))


def identifier_words_text(name: str) -> str:
    import regex

    out = name
    for pattern, to in _SPLITS:
        out = regex.sub(pattern, to.replace("$", "\\"), out)
    return " ".join(out.lower().split())


def identifier_words_sql(name: str) -> str:
    out = name
    for pattern, to in _SPLITS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace(lower({out}), ' +', ' ', 'g'))"


def compact(words: Column) -> Column:
    return F.replace(words, F.lit(" "), F.lit(""))


def snake(name: Column) -> Column:
    return F.replace(identifier_words(name), F.lit(" "), F.lit("_"))


def slug(title: Column) -> Column:
    """Lower case, each run of other characters than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def same_source(left: Column, right: Column) -> Column:
    """Equal, or one is the end of the other."""
    return (left == right) | left.endswith(right) | right.endswith(left)


def glob_regex(glob: str) -> str:
    """Whole-text pattern of a glob: * is anything but a colon, ? one such character."""
    return "^" + "".join("[^:]*" if c == "*" else "[^:]" if c == "?" else re.escape(c) for c in glob) + "$"
