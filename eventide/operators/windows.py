"""First / latest / top-n per key (WIN-1..6).

"Latest row per key" is written as ``max_by`` over a struct ordering key,
which Spark aggregates partially on the map side: a key with a third of all
rows still sends one partial row per input partition through the shuffle.
Top-n per key uses ``row_number`` with a ``<= n`` filter, which Spark plans
as a WindowGroupLimit so each partition keeps at most n rows per key before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_per(df: DataFrame, key: str | list[str], order: list[str],
               keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row per key with the greatest ``order`` tuple (ties end on ``id``)."""
    keys = _keys(key)
    keep = keep or [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in keep]).alias("v"))
    best = df.groupBy(*keys).agg(F.max(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.v.{c}").alias(prefix + c) for c in keep])


def first_per(df: DataFrame, key: str | list[str], order: list[str],
              keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """WIN-5: one row per key with the smallest ``order`` tuple."""
    keys = _keys(key)
    keep = keep or [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in keep]).alias("v"))
    best = df.groupBy(*keys).agg(F.min(packed).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.v.{c}").alias(prefix + c) for c in keep])


def latest_message(messages: DataFrame) -> DataFrame:
    """WIN-1: newest message per conversation (created_at, then id)."""
    return latest_per(messages, "conversation_id", ["created_at", "id"],
                      ["id", "text", "created_at", "sender_id"], prefix="last_")


def top_n_per(df: DataFrame, key: str | list[str], order: list[Column], n: int,
              rank_col: str = "rank") -> DataFrame:
    """WIN-3: the first ``n`` rows per key in ``order``, with the rank kept."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w).cast("long"))
            .filter(F.col(rank_col) <= n))


def latest_code(otps: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-4: newest code per key by expires_at (ties: higher id), as a
    partial aggregation (a phone with a huge number of codes stays spread)."""
    return latest_per(otps, keys, ["expires_at", "id"])


def first_image(media_lists: DataFrame, medias: DataFrame, list_col: str = "media_ids",
                key: str = "row_id") -> DataFrame:
    """WIN-6: first id of type image in each list, in list order."""
    pos = media_lists.select(key, F.posexplode(list_col).alias("pos", "media_id"))
    images = medias.filter(F.col("type") == "image").select(F.col("id").alias("media_id"))
    return (pos.join(images, "media_id", "left_semi")
            .groupBy(key).agg(F.min_by("media_id", "pos").alias("thumbnail_id")))


def top_by(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """ORD-2 / ORD-3: the first ``n`` rows of the whole table in ``order``
    (planned as TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(*order).limit(n)
