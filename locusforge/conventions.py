"""Naming conventions of the domain tables, as Column expressions.

Scaffold names are compared after trimming blanks and lower-casing; sample names of the comparison
table after trimming blanks, dropping an ending ``.parquet`` and upper-casing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BASES = ("A", "C", "G", "T")


def scaffold_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def sample_name(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(F.regexp_replace(F.trim(c), r"(?i)\.parquet$", "")))


def period(c: Column | str) -> Column:
    """Month of a timestamp as ``yyyy-MM``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM")


def coverage() -> Column:
    """A+C+G+T as a long; null if one of them is null."""
    return sum((F.col(b).cast("long") for b in BASES[1:]), F.col(BASES[0]).cast("long"))


def quoted(name: str) -> str:
    """A column name taken from the data, as an expression can name it."""
    return "`" + name.replace("`", "``") + "`"
