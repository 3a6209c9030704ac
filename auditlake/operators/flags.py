"""Flags and scores per record: named conditions as 0/1 columns, ordered labels as numbers, blind spots of assets.

Conditions and tables of labels are parameters; a condition that is unknown (NULL) does
not hold, a label outside its table scores 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flags(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Adds one 0/1 column per condition."""
    return df.withColumns({k: F.coalesce(c, F.lit(False)).cast("int") for k, c in conditions.items()})


def score(c: Column, points: dict[str, int]) -> Column:
    """Points of a label in any letter case; 0 outside the table."""
    out = F.lit(0)
    for k, n in points.items():
        out = F.when(F.upper(c) == k.upper(), n).otherwise(out)
    return out


def feature_table(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Key and numeric features, nulls as 0."""
    return df.select(*key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])


def silent(items: DataFrame, events: DataFrame, key: str, condition: Column) -> DataFrame:
    """Items under a condition that no event names: keys are reduced before they meet."""
    return items.where(condition).join(events.select(key).distinct(), key, "left_anti")


def findings(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, finding) of several checks united."""
    return reduce(DataFrame.unionByName, [df.select(key, F.lit(name).alias("finding")) for name, df in parts.items()])


def drivers(limits: list[tuple[Column, str]]) -> Column:
    """Names of the conditions that hold, in order, as one text; empty where none does."""
    return F.concat_ws("; ", *[F.when(c, F.lit(name)) for c, name in limits])
