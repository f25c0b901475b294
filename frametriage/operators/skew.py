"""Joins of a table to values that were aggregated from it, on the same keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def join_back(rows: DataFrame, values: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows.join(values, keys), where values has one row for each key and comes from an aggregation by the keys.

    An aggregate that keeps its shuffle for the join ties the rows of a key to one task. Joining on a hash of the keys
    too makes both sides shuffle for the join alone, and then a frequent key's rows are split by the adaptive skew join.
    """
    hashed, name = F.xxhash64(*keys), unused(rows, "keys")
    return rows.withColumn(name, hashed).join(values.withColumn(name, hashed).hint("merge"), [*keys, name], how).drop(name)
