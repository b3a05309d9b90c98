"""Per-key aggregates (AGG-1..10).

Every aggregate here runs *before* it is joined to its dimension rows, so the
shuffle carries one partial row per key and map-side partial aggregation
absorbs hot keys (a key holding a third of the rows costs one partial row per
input partition, not one task holding all of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.exprs import not_canceled, ts_lit


def seats_filled(reservations: DataFrame) -> DataFrame:
    """AGG-1: seats taken per event by bookings that are not canceled."""
    return (not_canceled(reservations)
            .groupBy("event_id")
            .agg(F.sum("group_members").alias("filled")))


def capacity_struct(capacity_col: str = "capacity", filled_col: str = "filled"):
    """AGG-1 output: total, filled (0 when no booking) and left (may be < 0)."""
    filled = F.coalesce(F.col(filled_col), F.lit(0)).cast("bigint")
    return F.struct(F.col(capacity_col).cast("bigint").alias("total"), filled.alias("filled"),
                    (F.col(capacity_col) - filled).alias("left"))


def rating_stats(ratings: DataFrame) -> DataFrame:
    """AGG-2: average score (decimal with 4 places, as AVG of INT) and count
    per rated user."""
    return (ratings.groupBy("to_user_id")
            .agg(F.avg(F.col("score").cast("decimal(10,0)")).alias("rating_avg"),
                 F.count(F.lit(1)).alias("rating_count")))


def rating_columns(avg_col: str = "rating_avg", cnt_col: str = "rating_count"):
    """AGG-2 defaults: 0 for users without ratings."""
    return (F.coalesce(F.col(avg_col), F.lit(0).cast("decimal(14,4)")).alias(avg_col),
            F.coalesce(F.col(cnt_col), F.lit(0).cast("bigint")).alias(cnt_col))


def count_per(df: DataFrame, key: str, name: str, out_key: str | None = None) -> DataFrame:
    """AGG-3: rows per key."""
    return df.groupBy(F.col(key).alias(out_key or key)).agg(F.count(F.lit(1)).alias(name))


def earnings_by_creator(transactions: DataFrame, reservations: DataFrame,
                        events: DataFrame) -> DataFrame:
    """AGG-4 / JN-6: paid amount per event creator (not leader), through
    inner joins transaction -> reservation -> event.

    Transactions are summed per reservation first so the join carries one row
    per reservation; the event join is then an equi join on event id.
    """
    paid = (transactions.filter(F.col("status") == "paid")
            .groupBy("reservation_id").agg(F.sum("amount").alias("amount")))
    per_event = (paid.join(reservations.select(F.col("id").alias("reservation_id"), "event_id"),
                           "reservation_id")
                 .groupBy("event_id").agg(F.sum("amount").alias("amount")))
    return (per_event.join(events.select(F.col("id").alias("event_id"), "creator_id"), "event_id")
            .groupBy("creator_id").agg(F.sum("amount").alias("total_earnings")))


def hashtags_per_memory(tags: DataFrame) -> DataFrame:
    """AGG-6: distinct hashtags per memory, sorted."""
    return (tags.groupBy("memory_id")
            .agg(F.array_sort(F.collect_set("hashtag")).alias("hashtags")))


def code_usage(reservations: DataFrame) -> DataFrame:
    """AGG-8: seats sold under each discount code by bookings not canceled.
    Id 0 means "no code" (the reference stores 0 for a booking without one)."""
    return (not_canceled(reservations)
            .filter(F.col("discount_code_id").isNotNull() & (F.col("discount_code_id") != 0))
            .groupBy("discount_code_id")
            .agg(F.sum("group_members").alias("filled")))


def chat_members(participants: DataFrame, reservations: DataFrame) -> DataFrame:
    """AGG-9 / AGG-10: members per chat = sum of the participants' booking sizes."""
    sizes = reservations.select(F.col("id").alias("reservation_id"), "group_members")
    return (participants.join(sizes, "reservation_id", "left")
            .groupBy("conversation_id")
            .agg(F.coalesce(F.sum("group_members"), F.lit(0)).alias("members")))


def past_events_per_user(reservations: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """AGG-3: reservations (any status) for events that started before as-of."""
    past_ids = events.filter(F.col("start_time") < ts_lit(as_of)).select(
        F.col("id").alias("event_id"))
    return (reservations.join(past_ids, "event_id", "left_semi")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("events_joined")))
