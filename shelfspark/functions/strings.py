"""String predicates with the catalogue's rules for blanks, LIKE and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters up to U+0020.
BLANKS = "".join(map(chr, range(33)))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(s: Column) -> Column:
    """s without characters up to U+0020 at both ends."""
    return F.btrim(s, F.lit(BLANKS))


def present(s: Column) -> Column:
    """Not null and not blank; never null itself."""
    return F.coalesce(F.length(trimmed(s)) > 0, F.lit(False))


def blank_to_null(s: Column) -> Column:
    return F.when(present(s), trimmed(s))


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def contains_like(s: Column, needle: str, ascii_only: bool = False) -> Column:
    """s LIKE '%needle%' without an escape character: % and _ in the needle are wildcards, a backslash is itself.

    By default case does not matter for any letter; with ascii_only for A-Z only.
    """
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    if ascii_only:
        return ascii_lower(s).like(pattern.translate(str.maketrans(_UPPER, _LOWER)))
    return s.ilike(pattern)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often they are used: nothing is pushed below or merged into a generator."""
    made = df.select("*", F.inline(F.array(F.struct(*[c.alias(f"_{n}") for n, c in columns.items()]))))
    kept = [F.col(f"_{n}").alias(n) if n in columns else F.col(n) for n in df.columns]
    return made.select(*kept, *[F.col(f"_{n}").alias(n) for n in columns if n not in df.columns])
