"""Truthiness, white space and keyword tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as \\s of Python.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def truthy(c: Column, kind: str = "string") -> Column:
    """False for NULL, empty text, zero, false and the empty array; never NULL. ``kind``: string, number, boolean, array or struct."""
    test = {"string": c != "", "number": c != 0, "boolean": c, "array": F.size(c) > 0, "struct": c.isNotNull()}[kind]
    return F.coalesce(test, F.lit(False))


def first_truthy(*cs: Column) -> Column:
    """The first text that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def norm_space(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def contains_any(c: Column, words) -> Column:
    """Whether a text holds one of the literal words; NULL is false."""
    test = F.lit(False)
    for w in dict.fromkeys(words):
        test = test | F.coalesce(c.contains(w), F.lit(False))
    return test


def word_list(c: Column) -> Column:
    """The words between white space; the empty text has none."""
    t = norm_space(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(c: Column) -> Column:
    """Number of words; 0 for NULL and empty."""
    return F.size(word_list(c))


def safe_dirname(c: Column) -> Column:
    """Letters, digits and ``-_.`` kept, everything else ``_``, 200 characters at most."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), 1, 200)
