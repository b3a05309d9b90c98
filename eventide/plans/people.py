"""Leader and user queries (Q06-Q12).

Counts, ratings and earnings are aggregated per key before they meet the
leader / user rows (JN-4), and the per-leader category lookup of the reference
(one query per leader, JN-14) is a single explode + join + collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.calendar import to_jalali
from eventide.functions.exprs import full_name, full_url, json_ids, minute_text, nested, ts_lit
from eventide.operators.joins import members_of
from eventide.operators.ranks import group_rank
from eventide.operators.stats import (count_per, earnings_by_creator, past_events_per_user,
                                      rating_columns, rating_stats)


def number_format2(c: Column) -> Column:
    """PHP number_format(x, 2): round half up to 2 places, thousands commas."""
    return F.format_number(F.round(c.cast("decimal(20,4)"), 2), 2)


def leader_categories(t) -> DataFrame:
    """Q06 / JN-14 / AGG-7: each leader's distinct categories ordered by name.

    The id list is JSON text; ids are matched as numbers (quoted ids too), ids
    with no category are dropped, and a leader without any keeps an empty list.
    """
    # FLT-12: the id list is exploded once and joined to the categories;
    # leaders without a valid id keep an empty list through the outer join.
    pairs = members_of(t.leaders.withColumnRenamed("id", "leader_id"), json_ids("categories_id"),
                       "leader_id", t.event_categories, "id", "category_id")
    pairs = t.leaders.select(F.col("id").alias("leader_id")).join(
        pairs.select("leader_id", "category_id", "name"), "leader_id", "left")
    return (pairs.groupBy("leader_id")
            .agg(F.sort_array(F.collect_set(
                F.when(F.col("name").isNotNull(),
                       F.struct("name", F.col("category_id").alias("id"))))).alias("categories")))


def _leader_core(t) -> DataFrame:
    users = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name", "avatar")
    ratings = rating_stats(t.ratings).withColumnRenamed("to_user_id", "user_id")
    followers = count_per(t.leader_followers, "leader_id", "followers_count", "id")
    return (t.leaders.join(users, "user_id", "left")
            .join(ratings, "user_id", "left")
            .join(followers, "id", "left"))


def leader_board(t) -> DataFrame:
    """Q07: every leader with name, avatar, events hosted (all events),
    followers, rating (numeric and as number_format text) and categories."""
    hosted = count_per(t.events, "leader_id", "events_hosted", "id")
    avg, cnt = rating_columns()
    cats = leader_categories(t).withColumnRenamed("leader_id", "id")
    return (_leader_core(t).join(hosted, "id", "left").join(cats, "id", "left")
            .select("id", "user_id", "bio", "categories_id", "registered_at",
                    full_name("first_name", "last_name").alias("name"), "avatar",
                    F.coalesce("events_hosted", F.lit(0)).alias("events_hosted"),
                    F.coalesce("followers_count", F.lit(0)).alias("followers_count"),
                    avg, number_format2(avg).alias("rating_avg_text"), cnt, "categories"))


def leader_profile(t, as_of: str) -> DataFrame:
    """Q08: per leader (inner join to users): bio, rating, events hosted in
    the past only, followers, total paid earnings of events the leader's user
    *created*, categories."""
    hosted = count_per(t.events.filter(F.col("start_time") < ts_lit(as_of)), "leader_id",
                       "events_hosted", "id")
    earn = earnings_by_creator(t.transactions, t.reservations, t.events).withColumnRenamed(
        "creator_id", "user_id")
    cats = leader_categories(t).withColumnRenamed("leader_id", "id")
    users = t.users.select(F.col("id").alias("user_id"))
    avg, cnt = rating_columns()
    return (_leader_core(t).join(users, "user_id", "inner")
            .join(hosted, "id", "left").join(earn, "user_id", "left").join(cats, "id", "left")
            .select(F.col("id").alias("leader_id"), "user_id", "bio", avg,
                    number_format2(avg).alias("rating_avg_text"), cnt,
                    F.coalesce("events_hosted", F.lit(0)).alias("events_hosted"),
                    F.coalesce("followers_count", F.lit(0)).alias("followers_count"),
                    F.coalesce("total_earnings", F.lit(0)).alias("total_earnings"),
                    "categories_id", "categories"))


def user_profile(t, as_of: str) -> DataFrame:
    """Q09: user columns (not the national id), rating, events joined (reservations of any status
    for events that already started) and the Jalali birth date."""
    ratings = rating_stats(t.ratings).withColumnRenamed("to_user_id", "id")
    joined = past_events_per_user(t.reservations, t.events, as_of).withColumnRenamed(
        "user_id", "id")
    avg, cnt = rating_columns()
    base = (t.users.join(ratings, "id", "left").join(joined, "id", "left"))
    base = to_jalali(base, "birth_date", "birth_date_jalali")
    return base.select("id", "username", "first_name", "last_name", "gender", "phone",
                       "birth_date", "birth_date_jalali", "role", "avatar",
                       "is_active", "registered_at", avg,
                       number_format2(avg).alias("rating_avg_text"), cnt,
                       F.coalesce("events_joined", F.lit(0)).alias("events_joined"))


def user_reservations(t, users=None, sort: bool = True, rank: bool = False) -> DataFrame:
    """Q10: every reservation with its event and user objects, newest first
    per user (JN-2 inner joins: rows whose event or user is missing drop).
    ``rank`` adds the place in the user's list as ``order_rank`` (ORD-5)."""
    res = t.reservations
    if users is not None:
        res = res.filter(F.col("user_id").isin(list(users)))
    ev = t.events.select(F.col("id").alias("event_id"), F.col("title").alias("e_title"),
                         F.col("slug").alias("e_slug"), F.col("start_time").alias("e_start"),
                         F.col("price").alias("e_price"))
    us = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name")
    out = (res.join(ev, "event_id").join(us, "user_id")
           .select("id", "user_id",
                   nested(title=F.col("e_title"), slug=F.col("e_slug"),
                          start_time=minute_text("e_start"), price=F.col("e_price")).alias("event"),
                   nested(name=full_name("first_name", "last_name")).alias("user"),
                   "code", "price", "status", minute_text("created_at").alias("created_at"),
                   F.col("created_at").alias("_created")))
    newest = [F.col("_created").desc(), F.col("id").desc()]
    if rank:
        out = group_rank(out, ["user_id"], newest, "order_rank")
    elif sort:
        out = out.orderBy("user_id", *newest)
    return out.drop("_created")


def user_transactions(t, users=None) -> DataFrame:
    """Q11: transactions with their event object, owner through the
    reservation (JN-5 chain transaction -> reservation -> event);
    transactions without a reservation drop (the reference's WHERE on the
    outer-joined user id)."""
    res = t.reservations.select(F.col("id").alias("reservation_id"), "user_id", "event_id")
    if users is not None:
        res = res.filter(F.col("user_id").isin(list(users)))
    ev = t.events.select(F.col("id").alias("event_id"), "title", "slug", "start_time")
    return (t.transactions.join(res, "reservation_id")
            .join(ev, "event_id", "left")
            .select("user_id",
                    nested(title=F.col("title"), slug=F.col("slug"),
                           start_time=F.col("start_time")).alias("event"),
                    "type", "amount", "status", "authority", "card_hash", "card_pan", "ref_id",
                    "paid_at", "created_at", "updated_at"))


def payment_detail(t, authorities=None) -> DataFrame:
    """Q12: payment rows by authority with event title, start, location and
    image url (JN-5 left-join chain: a transaction without reservation keeps
    NULLs)."""
    tx = t.transactions
    if authorities is not None:
        tx = tx.filter(F.col("authority").isin(list(authorities)))
    res = t.reservations.select(F.col("id").alias("reservation_id"), "event_id")
    ev = t.events.select(F.col("id").alias("event_id"), "title", "start_time", "location",
                         "thumbnail_id")
    med = t.event_medias.select(F.col("id").alias("thumbnail_id"), F.col("url").alias("image"))
    return (tx.join(res, "reservation_id", "left").join(ev, "event_id", "left")
            .join(med, "thumbnail_id", "left")
            .select("id", "authority", "amount", "reservation_id", "status",
                    nested(title=F.col("title"), start_time=minute_text("start_time"),
                           location=F.col("location"),
                           image=full_url("image")).alias("event")))
