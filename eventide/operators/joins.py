"""Join shapes of the reference (JN-1, JN-4, JN-13, FLT-12) as reusable steps.

Physical strategy is left to Spark: dimension sides are broadcast when their
measured size is under the broadcast threshold (AQE re-plans at runtime),
and skewed fact keys are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_presence(df: DataFrame, keys: DataFrame, on: str | list[str]):
    """JN-13: rows whose key exists in ``keys`` (left semi) and rows whose
    key does not (left anti): the bulk form of "check existence before write"."""
    return df.join(keys, on, "left_semi"), df.join(keys, on, "left_anti")


def members_of(df: DataFrame, list_col, key: str, dim: DataFrame, dim_key: str,
               out_key: str = "member_id") -> DataFrame:
    """FLT-12: rows of ``dim`` whose key is in each row's list (one explode and
    one equi join, never a per-row FIND_IN_SET)."""
    ids = df.select(key, F.explode(list_col).alias(out_key))
    return ids.join(dim.withColumnRenamed(dim_key, out_key), out_key)
