"""Event catalog queries (Q01-Q05): catalog, detail, similar, featured, categories.

Shape of every plan: aggregate the large facts (reservations, ratings, medias)
by their join key first, then left-join the results to events. The reference
instead groups by every dimension column after a fan-out join; pre-aggregating
keeps the shuffle at one row per key and lets map-side partial aggregation
absorb hot events or hot leaders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.exprs import (full_name, full_url, grouping_filter, hour_ranges,
                                      in_categories, location_like, of_leader, on_day, ts_lit,
                                      visible)
from eventide.operators.ranks import global_rank
from eventide.operators.stats import capacity_struct, rating_columns, rating_stats, seats_filled
from eventide.operators.windows import top_by, top_n_per


def leader_dim(t) -> DataFrame:
    """JN-1 + JN-4: leader -> user -> rating stats, one row per leader id."""
    users = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name", "avatar",
                           F.col("registered_at").alias("user_registered_at"))
    ratings = rating_stats(t.ratings).withColumnRenamed("to_user_id", "user_id")
    return (t.leaders.select(F.col("id").alias("leader_id"), "user_id", "bio")
            .join(users, "user_id", "left")
            .join(ratings, "user_id", "left"))


def leader_struct():
    avg, cnt = rating_columns()
    return F.struct(full_name("first_name", "last_name").alias("name"),
                    F.col("avatar").alias("avatar"), F.col("bio").alias("bio"),
                    avg.alias("rating_avg"), cnt.alias("rating_count"),
                    F.col("user_registered_at").alias("registered_at"))


def decorated_events(t, events: DataFrame, with_thumbnail_url: bool = True) -> DataFrame:
    """Events with category name, thumbnail url, capacity and leader objects."""
    cats = t.event_categories.select(F.col("id").alias("category_id"),
                                     F.col("name").alias("category"))
    thumbs = t.event_medias.select(F.col("id").alias("thumbnail_id"),
                                   F.col("url").alias("thumbnail_path"))
    # JN-3: the reference's "r.status != 'canceled'" inside the ON clause is
    # applied before the (pre-aggregated) left join, so events without
    # bookings keep a row.
    filled = seats_filled(t.reservations).withColumnRenamed("event_id", "id")
    out = (events
           .join(cats, "category_id", "left")
           .join(leader_dim(t), "leader_id", "left")
           .join(filled, "id", "left"))
    if with_thumbnail_url:
        out = out.join(thumbs, "thumbnail_id", "left")
    return (out.withColumn("capacity_obj", capacity_struct())
            .withColumn("leader", leader_struct()))


def catalog_order_columns(as_of: str):
    """ORD-1: bucket 1 = future, 2 = ongoing (started; end NULL or >= now),
    3 = past. Future ascending by start, the rest descending."""
    now = ts_lit(as_of)
    st, en = F.col("start_time"), F.col("end_time")
    bucket = (F.when(st > now, 1)
              .when((st <= now) & (en.isNull() | (en >= now)), 2)
              .otherwise(3))
    return bucket.alias("order_bucket")


def _catalog_order() -> list:
    b = F.col("order_bucket")
    return [b.asc(), F.when(b == 1, F.col("start_time")).asc(),
            F.when(b != 1, F.col("start_time")).desc(), F.col("id").asc()]


def catalog_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(*_catalog_order())


def catalog_rank(df: DataFrame) -> DataFrame:
    """ORD-1 as a column ``order_rank``: the event's place in the whole list."""
    return global_rank(df, _catalog_order(), "order_rank")


def event_catalog(t, as_of: str, location: str | None = None, day: str | None = None,
                  categories=None, leader_id: int | None = None, grouping: int | None = None,
                  hours: str | None = None, sort: bool = True) -> DataFrame:
    """Q01: the event list with every optional filter of the reference.

    Leader mode (``leader_id`` given) drops the status test and keeps the
    not-private test, as in the reference.
    """
    ev = t.events
    ev = visible(ev, "leader" if leader_id is not None else "public")
    if location:
        ev = ev.filter(location_like(location))
    if day:
        from eventide.functions.calendar import jalali_text_to_gregorian
        greg = jalali_text_to_gregorian(ev.sparkSession, day)
        ev = ev.filter(on_day(greg) if greg else F.lit(False))
    if categories:
        ev = ev.filter(in_categories(categories))
    if leader_id is not None:
        ev = ev.filter(of_leader(leader_id))
    if grouping:
        ev = ev.filter(grouping_filter(grouping))
    if hours:
        cond = hour_ranges(hours)
        if cond is not None:
            ev = ev.filter(cond)
    out = decorated_events(t, ev).select(
        "id", "title", "description", "slug", "start_time", "end_time", "location", "category",
        full_url("thumbnail_path").alias("thumbnail"), "price", "grouping", "views", "status",
        F.col("capacity_obj").alias("capacity"), "leader", catalog_order_columns(as_of))
    return catalog_sort(out) if sort else out


def event_detail(t, slugs=None) -> DataFrame:
    """Q02: events by slug (every slug when ``slugs`` is None): verified
    only, private allowed; plus address, coordinates and the number of
    attached media. The media themselves are ``event_detail_medias`` rows
    (one per media, in id order), so an event with a huge media list never
    becomes one oversized row."""
    ev = visible(t.events, "slug")
    if slugs is not None:
        ev = ev.filter(F.col("slug").isin(list(slugs)))
    counts = (t.event_medias.filter(F.col("event_id").isNotNull())
              .groupBy(F.col("event_id").alias("id")).agg(F.count(F.lit(1)).alias("media_count")))
    return (decorated_events(t, ev, with_thumbnail_url=False)
            .join(counts, "id", "left")
            .select("id", "title", "description", "slug", "start_time", "end_time", "location",
                    "address",
                    F.struct("lat", "lng", F.col("address").alias("address")).alias("coordinates"),
                    "category", "thumbnail_id", "price", "grouping",
                    F.col("capacity_obj").alias("capacity"), "leader",
                    F.coalesce("media_count", F.lit(0)).alias("media_count")))


def event_detail_medias(t, slugs=None, sort: bool = True) -> DataFrame:
    """Q02 media list: (event id, media id, type, full url) of verified
    events, ordered by event then media id."""
    ev = visible(t.events, "slug")
    if slugs is not None:
        ev = ev.filter(F.col("slug").isin(list(slugs)))
    out = (t.event_medias.filter(F.col("event_id").isNotNull())
           .join(ev.select(F.col("id").alias("event_id")), "event_id", "left_semi")
           .select("event_id", F.col("id").alias("media_id"), "type", full_url("url").alias("url")))
    return out.orderBy("event_id", "media_id") if sort else out


def medias_array(detail_medias: DataFrame) -> DataFrame:
    """The nested form of Q02's media list, for callers that want it (one
    array per event; use only where the per-event list is known small)."""
    return (detail_medias.groupBy("event_id")
            .agg(F.array_sort(F.collect_list(F.struct("media_id", "type", "url"))).alias("medias")))


def similar_events(t, as_of: str, only_visible: bool = False, n: int = 3) -> DataFrame:
    """Q03: for every event, up to ``n`` other future events of its category,
    newest created first; when there is none, ``n`` future events overall
    (with price and category).

    Scale: the same-category self join would square each category, so each
    category's candidates are cut to its newest n+1 future events first (exact,
    since dropping self removes at most one). The fallback pool is the global
    newest n+1 future events. Both are bounded (n+1 rows for a category, n+1 in
    all) and broadcast; thumbnails are looked up for them alone, and the ranks
    of a source are taken on keys, so that no task sorts texts of many events.
    The reference applies no status or privacy test; ``only_visible`` adds it.
    """
    now = ts_lit(as_of)
    ev = t.events
    cand = ev.filter(F.col("start_time") > now)
    if only_visible:
        cand = visible(cand, "public")
    cand = cand.select(F.col("id").alias("sim_id"), "category_id", "slug", "title", "start_time",
                       "created_at", "price", "thumbnail_id")
    order = [F.col("created_at").desc(), F.col("sim_id").desc()]
    thumbs = t.event_medias.select(F.col("id").alias("thumbnail_id"),
                                   F.col("url").alias("thumbnail_path"))

    def with_thumbnail(few):
        """A candidate has a row for each media of its thumbnail's id, so the
        newest n+1 rows with it are among those of the newest n+1 without."""
        mine = thumbs.join(F.broadcast(few.select("thumbnail_id").distinct()), "thumbnail_id", "left_semi")
        return few.join(F.broadcast(mine), "thumbnail_id", "left").withColumn(
            "thumbnail", full_url("thumbnail_path")).drop("thumbnail_id", "thumbnail_path")

    def newest(pairs):
        return top_n_per(pairs.filter(F.col("source_id") != F.col("sim_id")), "source_id", order, n)

    # Dealt by id first: a scan task's rows are cut to n+1 a category by a sort of them all.
    cut = top_n_per(cand.repartition("sim_id"), "category_id", order, n + 1, "_r").drop("_r")
    per_cat = F.broadcast(top_n_per(with_thumbnail(cut), "category_id", order, n + 1, "_r"))
    src = ev.select(F.col("id").alias("source_id"), "category_id").repartition("source_id")
    # JN-7: same-category self join with inequality, on the cut candidate set
    ranked = newest(src.join(per_cat.select("category_id", "_r", "created_at", "sim_id"), "category_id"))
    primary = (ranked.select("source_id", "category_id", "_r", "rank").join(per_cat, ["category_id", "_r"])
               .select("source_id", "slug", "title", "start_time", "thumbnail", "rank",
                       F.lit(False).alias("is_fallback")))
    # SET-1: sources without any primary row get the global list.
    cats = t.event_categories.select(F.col("id").alias("category_id"),
                                     F.col("name").alias("category"))
    # The window runs over the rows left after the limit.
    pool = F.broadcast(top_by(with_thumbnail(top_by(cand, order, n + 1)), order, n + 1)
                       .join(cats, "category_id", "left")
                       .withColumn("_r", F.row_number().over(Window.orderBy(*order))))
    lonely = src.select("source_id").join(ranked.select("source_id").distinct(), "source_id",
                                          "left_anti")
    fallback = (newest(lonely.crossJoin(pool.select("_r", "created_at", "sim_id")))
                .select("source_id", "_r", "rank").join(pool, "_r").select(
                    "source_id", "slug", "title", "start_time", "price", "category", "thumbnail", "rank",
                    F.lit(True).alias("is_fallback")))
    return primary.unionByName(fallback, allowMissingColumns=True)


def featured_events(t, as_of: str, n: int = 3) -> DataFrame:
    """Q04: the n future visible events with most views (then earliest start,
    then lowest id)."""
    ev = visible(t.events, "public").filter(F.col("start_time") > ts_lit(as_of))
    top = top_by(ev, [F.col("views").desc(), F.col("start_time").asc(), F.col("id").asc()], n)
    # The window runs over the n rows left after the limit.
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(
        F.col("views").desc(), F.col("start_time").asc(), F.col("id").asc())).cast("long"))
    return decorated_events(t, ranked).select(
        "rank", "id", "title", "description", "slug", "start_time", "end_time", "location",
        "category", full_url("thumbnail_path").alias("thumbnail"), "price", "grouping",
        F.col("capacity_obj").alias("capacity"), "leader")


def event_categories(t) -> DataFrame:
    """Q05: all categories (SRC-2: every column, named)."""
    return t.event_categories.select("id", "name")
