"""Named table scans (SRC-1) and append-table streams (SRC-3).

Raw inputs are parquet with explicit schemas: no inference, so a scan plans
from the schema alone and Catalyst can prune columns and push filters into
the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SRC-1: scan one named table with its declared schema."""
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(table_path(sf_dir, name))


def stream(spark: SparkSession, path: str, schema: str, time_col: str | None = None,
           max_files_per_trigger: int = 1) -> DataFrame:
    """SRC-3: an append-only folder of parquet files read as a stream.

    Event time is cast to ``timestamp`` because watermarks refuse
    ``timestamp_ntz``; the session time zone is UTC, so the wall clock is kept.
    """
    df = (spark.readStream.schema(schema)
          .option("maxFilesPerTrigger", max_files_per_trigger)
          .parquet(path))
    if time_col:
        df = df.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return df
