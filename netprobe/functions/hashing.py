"""Repeatable randomness: md5 of seed and key, the same in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by colons; plain strings and numbers are literals."""
    return F.md5(F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """In [0, 1), from the first 52 bits."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("double") / float(16**13)


def hash_int(*parts: Column | str | int) -> Column:
    """A non-negative long of 52 bits."""
    return F.conv(F.substring(hash_key(*parts), 1, 13), 16, 10).cast("long")
