"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import ensure_checkpoint_dir, ship_package

# Rows of one Arrow batch handed to Python: texts are a few KB, some far longer.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings every operator needs: checkpoint folder, code, batch size."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def fold_of(doc_id: Column) -> Column:
    """crc32(id as text) mod 5; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    """Fold 0 is held out; a NULL id is not held out (and is never learned from)."""
    return F.coalesce(fold_of(doc_id) == 0, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def row_udf(spark: SparkSession, schema: str, model, score: Callable):
    """Pandas UDF ``text -> struct``: ``score(model, list of texts) -> columns``.

    The model is broadcast once; a NULL text reaches ``score`` as ''. Batches
    are cut into blocks of bounded size, so memory follows the longest text.
    """
    import pandas as pd

    from eventide.llm.nptext import text_blocks

    shared = spark.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        for s in it:
            texts = [t if isinstance(t, str) else "" for t in s]
            parts = [pd.DataFrame(score(m, texts[a:b])) for a, b in text_blocks(texts)]
            yield (pd.concat(parts, ignore_index=True) if parts
                   else pd.DataFrame(score(m, [])).astype(object))

    from collections.abc import Iterator
    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)
