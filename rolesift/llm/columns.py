"""Column functions that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else: other letters keep their form and length."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def place_of(df: DataFrame, name: str) -> int:
    """The place of the column of that exact name, else of the only one that differs in case."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    found = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns named {name!r} among {df.columns}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """`df` with its columns named `_0`, `_1`, …: no name clashes with a working column."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def take(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns of `df` under new names (new name: column), whatever else `df` holds."""
    return numbered(df).select(*(F.col(f"_{place_of(df, old)}").alias(new) for new, old in wanted.items()))
