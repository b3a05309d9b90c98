"""Registered queries: flat outputs of the library's jobs, plus DuckDB oracles.

Each registered callable takes ``(spark, sf_dir)`` and returns a DataFrame
whose nested objects are flattened to ``parent_child`` columns, decimals
turned to doubles and arrays joined to text in a stated order, so that an
order-insensitive comparison with the DuckDB text is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from eventide.functions.exprs import flatten
from eventide.functions.patterns import (ADDRESS, HOUR_MINUTE, LATITUDE, LONGITUDE, PERSIAN_NAME, PLACE_NAME,
                                         YEAR_MONTH_DAY)
from eventide.sources.views import AS_OF, domain, duckdb_ctes

QUERIES: dict = {}
ORACLES: dict = {}

NOW = f"TIMESTAMP '{AS_OF}'"
MEDIA = "'https://media.example/'"


def flat(df: DataFrame) -> DataFrame:
    """Flatten structs; decimals become doubles (exact 4-place values)."""
    df = flatten(df)
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def register(name: str, views: list[str] | None = None, sql: str | None = None,
             recursive: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = (duckdb_ctes(views, recursive) if views else "") + sql
        return fn
    return deco


def avg4(col: str) -> str:
    """DuckDB: AVG of an INT column rounded half-up to 4 places, in exact
    integer arithmetic (the Spark side averages as decimal(14,4))."""
    return f"((20000 * sum({col}) + count(*)) // (2 * count(*))) / 10000"


# ---------------------------------------------------------------- catalog

_LEADER_SQL = f"""
rs AS (SELECT to_user_id, {avg4('score')} AS rating_avg, count(*) AS rating_count
       FROM d_ratings GROUP BY to_user_id),
ld AS (SELECT l.id AS leader_id, l.bio, u.first_name, u.last_name, u.avatar,
              u.registered_at AS user_registered_at, rs.rating_avg, rs.rating_count
       FROM d_leaders l LEFT JOIN d_users u ON l.user_id = u.id
       LEFT JOIN rs ON u.id = rs.to_user_id),
filled AS (SELECT event_id, sum(group_members) AS filled FROM d_reservations
           WHERE status <> 'canceled' GROUP BY event_id)"""

_LEADER_COLS = """
       ld.first_name || ' ' || ld.last_name AS leader_name,
       ld.avatar AS leader_avatar, ld.bio AS leader_bio,
       coalesce(ld.rating_avg, 0) AS leader_rating_avg,
       coalesce(ld.rating_count, 0) AS leader_rating_count,
       ld.user_registered_at AS leader_registered_at"""

_CAP_COLS = """
       cast(e.capacity AS bigint) AS capacity_total,
       cast(coalesce(f.filled, 0) AS bigint) AS capacity_filled,
       cast(e.capacity - coalesce(f.filled, 0) AS bigint) AS capacity_left"""

_DECOR_JOINS = """
LEFT JOIN d_event_categories ec ON e.category_id = ec.id
LEFT JOIN ld ON e.leader_id = ld.leader_id
LEFT JOIN filled f ON e.id = f.event_id"""

_CATALOG_VIEWS = ["d_events", "d_event_categories", "d_leaders", "d_users", "d_event_medias",
                  "d_reservations", "d_ratings"]


@register("event_catalog", _CATALOG_VIEWS, f"""
, {_LEADER_SQL.strip()}
SELECT e.id, e.title, e.description, e.slug, e.start_time, e.end_time, e.location,
       ec.name AS category, {MEDIA} || coalesce(em.url, '') AS thumbnail, e.price, e.grouping,
       e.views, e.status, {_CAP_COLS}, {_LEADER_COLS},
       CASE WHEN e.start_time > {NOW} THEN 1
            WHEN e.start_time <= {NOW} AND (e.end_time IS NULL OR e.end_time >= {NOW}) THEN 2
            ELSE 3 END AS order_bucket,
       row_number() OVER (ORDER BY order_bucket, CASE WHEN order_bucket = 1 THEN e.start_time END,
                          CASE WHEN order_bucket <> 1 THEN e.start_time END DESC, e.id) AS order_rank
FROM d_events e {_DECOR_JOINS}
LEFT JOIN d_event_medias em ON e.thumbnail_id = em.id
WHERE e.status = 'verified' AND NOT e.is_private""")
def q_event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventide.plans.catalog import catalog_rank, event_catalog
    return flat(catalog_rank(event_catalog(domain(spark, sf_dir), AS_OF, sort=False)))


@register("event_detail", _CATALOG_VIEWS, f"""
, {_LEADER_SQL.strip()},
m AS (SELECT event_id, count(*) AS n FROM d_event_medias WHERE event_id IS NOT NULL GROUP BY event_id)
SELECT e.id, e.title, e.description, e.slug, e.start_time, e.end_time, e.location, e.address,
       e.lat AS coordinates_lat, e.lng AS coordinates_lng, e.address AS coordinates_address,
       ec.name AS category, e.thumbnail_id, e.price, e.grouping, {_CAP_COLS}, {_LEADER_COLS},
       coalesce(m.n, 0) AS media_count
FROM d_events e {_DECOR_JOINS}
LEFT JOIN m ON e.id = m.event_id
WHERE e.status = 'verified'""")
def q_event_detail(spark, sf_dir):
    from eventide.plans.catalog import event_detail
    return flat(event_detail(domain(spark, sf_dir)))


@register("event_detail_medias", ["d_events", "d_event_medias"], f"""
SELECT m.event_id, m.id AS media_id, m.type, {MEDIA} || m.url AS url
FROM d_event_medias m JOIN d_events e ON m.event_id = e.id WHERE e.status = 'verified'""")
def q_event_detail_medias(spark, sf_dir):
    from eventide.plans.catalog import event_detail_medias
    return event_detail_medias(domain(spark, sf_dir))


@register("similar_events", ["d_events", "d_event_medias", "d_event_categories"], f"""
, cand AS (SELECT e.id AS sim_id, e.category_id, e.slug, e.title, e.start_time, e.created_at,
                  e.price, {MEDIA} || coalesce(em.url, '') AS thumbnail
           FROM d_events e LEFT JOIN d_event_medias em ON em.id = e.thumbnail_id
           WHERE e.start_time > {NOW}),
prim AS (SELECT s.id AS source_id, c.slug, c.title, c.start_time, c.thumbnail,
                row_number() OVER (PARTITION BY s.id ORDER BY c.created_at DESC, c.sim_id DESC) AS rank
         FROM d_events s JOIN cand c ON s.category_id = c.category_id AND s.id <> c.sim_id),
p3 AS (SELECT * FROM prim WHERE rank <= 3),
fb AS (SELECT s.id AS source_id, c.slug, c.title, c.start_time, c.price, ec.name AS category,
              c.thumbnail,
              row_number() OVER (PARTITION BY s.id ORDER BY c.created_at DESC, c.sim_id DESC) AS rank
       FROM d_events s JOIN cand c ON s.id <> c.sim_id
       LEFT JOIN d_event_categories ec ON ec.id = c.category_id
       WHERE s.id NOT IN (SELECT source_id FROM p3))
SELECT source_id, slug, title, start_time, thumbnail, rank, false AS is_fallback,
       cast(NULL AS bigint) AS price, cast(NULL AS varchar) AS category FROM p3
UNION ALL
SELECT source_id, slug, title, start_time, thumbnail, rank, true AS is_fallback, price, category
FROM fb WHERE rank <= 3""")
def q_similar_events(spark, sf_dir):
    from eventide.plans.catalog import similar_events
    return flat(similar_events(domain(spark, sf_dir), AS_OF))


@register("featured_events", _CATALOG_VIEWS, f"""
, {_LEADER_SQL.strip()},
top AS (SELECT *, row_number() OVER (ORDER BY views DESC, start_time ASC, id ASC) AS rank
        FROM d_events WHERE status = 'verified' AND NOT is_private AND start_time > {NOW})
SELECT e.rank, e.id, e.title, e.description, e.slug, e.start_time, e.end_time, e.location,
       ec.name AS category, {MEDIA} || coalesce(em.url, '') AS thumbnail, e.price, e.grouping,
       {_CAP_COLS}, {_LEADER_COLS}
FROM top e {_DECOR_JOINS}
LEFT JOIN d_event_medias em ON e.thumbnail_id = em.id
WHERE e.rank <= 3""")
def q_featured_events(spark, sf_dir):
    from eventide.plans.catalog import featured_events
    return flat(featured_events(domain(spark, sf_dir), AS_OF))


@register("event_categories", ["d_event_categories"], "SELECT id, name FROM d_event_categories")
def q_event_categories(spark, sf_dir):
    from eventide.plans.catalog import event_categories
    return event_categories(domain(spark, sf_dir))


# ---------------------------------------------------------------- leaders / users

def cats_text(col: str = "categories") -> F.Column:
    """Sorted category objects as ``name:id`` text, comma separated."""
    return F.array_join(F.transform(col, lambda c: F.concat(c["name"], F.lit(":"),
                                                             c["id"].cast("string"))), ",")


def fmt2_duck(a4: str) -> str:
    """DuckDB: number_format(x, 2) of a 4-place average held as integer
    ten-thousandths ``a4`` (half up)."""
    h = f"(({a4}) + 50) // 100"
    return f"cast(({h}) // 100 AS varchar) || '.' || lpad(cast(({h}) % 100 AS varchar), 2, '0')"


_A4 = "((20000 * sum(score) + count(*)) // (2 * count(*)))"

_LEADER_CATS_SQL = """
lc_ids AS (SELECT l.id AS leader_id, try_cast(x AS bigint) AS category_id
           FROM d_leaders l, unnest(from_json(l.categories_id, '["VARCHAR"]')) t(x)),
lc_pairs AS (SELECT DISTINCT i.leader_id, c.name, c.id FROM lc_ids i
             JOIN d_event_categories c ON i.category_id = c.id),
lc AS (SELECT l.id AS leader_id,
              coalesce(string_agg(p.name || ':' || cast(p.id AS varchar), ',' ORDER BY p.name, p.id), '')
                AS categories
       FROM d_leaders l LEFT JOIN lc_pairs p ON l.id = p.leader_id GROUP BY l.id)"""

_RS4 = f"""
rs AS (SELECT to_user_id, {_A4} AS a4, count(*) AS rating_count FROM d_ratings GROUP BY to_user_id)"""


@register("leader_categories", ["d_leaders", "d_event_categories"], f"""
, {_LEADER_CATS_SQL.strip()}
SELECT leader_id, categories FROM lc""")
def q_leader_categories(spark, sf_dir):
    from eventide.plans.people import leader_categories
    df = leader_categories(domain(spark, sf_dir))
    return df.select("leader_id", cats_text().alias("categories"))


@register("leader_board", ["d_leaders", "d_users", "d_events", "d_leader_followers", "d_ratings",
                           "d_event_categories"], f"""
, {_LEADER_CATS_SQL.strip()}, {_RS4.strip()},
ev AS (SELECT leader_id, count(*) AS n FROM d_events GROUP BY leader_id),
fo AS (SELECT leader_id, count(*) AS n FROM d_leader_followers GROUP BY leader_id)
SELECT l.id, l.user_id, l.bio, l.categories_id, l.registered_at,
       u.first_name || ' ' || u.last_name AS name, u.avatar,
       coalesce(ev.n, 0) AS events_hosted, coalesce(fo.n, 0) AS followers_count,
       coalesce(rs.a4, 0) / 10000 AS rating_avg,
       {fmt2_duck('coalesce(rs.a4, 0)')} AS rating_avg_text,
       coalesce(rs.rating_count, 0) AS rating_count, lc.categories
FROM d_leaders l LEFT JOIN d_users u ON l.user_id = u.id
LEFT JOIN rs ON u.id = rs.to_user_id
LEFT JOIN ev ON l.id = ev.leader_id LEFT JOIN fo ON l.id = fo.leader_id
LEFT JOIN lc ON l.id = lc.leader_id""")
def q_leader_board(spark, sf_dir):
    from eventide.plans.people import leader_board
    df = leader_board(domain(spark, sf_dir))
    return flat(df.withColumn("categories", F.coalesce(cats_text(), F.lit(""))))


@register("leader_profile", ["d_leaders", "d_users", "d_events", "d_leader_followers", "d_ratings",
                             "d_event_categories", "d_transactions", "d_reservations"], f"""
, {_LEADER_CATS_SQL.strip()}, {_RS4.strip()},
ev AS (SELECT leader_id, count(*) AS n FROM d_events WHERE start_time < {NOW} GROUP BY leader_id),
fo AS (SELECT leader_id, count(*) AS n FROM d_leader_followers GROUP BY leader_id),
earn AS (SELECT e.creator_id, sum(t.amount) AS total FROM d_transactions t
         JOIN d_reservations r ON t.reservation_id = r.id JOIN d_events e ON r.event_id = e.id
         WHERE t.status = 'paid' GROUP BY e.creator_id)
SELECT l.id AS leader_id, l.user_id, l.bio,
       coalesce(rs.a4, 0) / 10000 AS rating_avg,
       {fmt2_duck('coalesce(rs.a4, 0)')} AS rating_avg_text,
       coalesce(rs.rating_count, 0) AS rating_count,
       coalesce(ev.n, 0) AS events_hosted, coalesce(fo.n, 0) AS followers_count,
       cast(coalesce(earn.total, 0) AS bigint) AS total_earnings, l.categories_id, lc.categories
FROM d_leaders l JOIN d_users u ON l.user_id = u.id
LEFT JOIN rs ON u.id = rs.to_user_id
LEFT JOIN ev ON l.id = ev.leader_id LEFT JOIN fo ON l.id = fo.leader_id
LEFT JOIN earn ON u.id = earn.creator_id
LEFT JOIN lc ON l.id = lc.leader_id""")
def q_leader_profile(spark, sf_dir):
    from eventide.plans.people import leader_profile
    df = leader_profile(domain(spark, sf_dir), AS_OF)
    return flat(df.withColumn("categories", F.coalesce(cats_text(), F.lit(""))))


JCAL_DUCK = """
jyears AS (SELECT range AS jy, CASE WHEN ((range + 12) % 33) % 4 = 1 THEN 366 ELSE 365 END AS ylen
           FROM range(1270, 1490)),
jys AS (SELECT jy, ylen, coalesce(sum(ylen) OVER (ORDER BY jy ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0) AS so FROM jyears),
janc AS (SELECT so AS aso FROM jys WHERE jy = 1403),
jcal AS (SELECT cast(DATE '2024-03-20' + cast(so + d - aso AS integer) AS date) AS date,
                cast(jy AS integer) AS jy,
                cast(CASE WHEN d < 186 THEN d // 31 + 1 ELSE (d - 186) // 30 + 7 END AS integer) AS jm,
                cast(CASE WHEN d < 186 THEN d % 31 + 1 ELSE (d - 186) % 30 + 1 END AS integer) AS jd,
                cast(d AS integer) AS doy, ylen = 366 AS leap
         FROM jys, janc, range(0, 366) r(d) WHERE d < ylen)"""


def _year_start_duck(y: str) -> str:
    """DuckDB: days from the start of a cycle far back to a Jalali year's first day."""
    return f"(({y} + 12) // 33 * 12053 + ({y} + 12) % 33 * 365 + (({y} + 12) % 33 + 2) // 4)"


def jalali_duck(source: str, date: str) -> str:
    """DuckDB: ``source`` with jy, jm, jd, doy (0-based) and leap of its date column, by arithmetic
    (516818: the first day of year 1403 by the count of ``_year_start_duck``)."""
    start = "c * 365 + (c + 2) // 4"
    return (f"(SELECT * EXCLUDE (n, c, doy_), cast(n // 12053 * 33 + c - 12 AS int) AS jy, cast(doy_ AS int) AS doy, "
            "cast(CASE WHEN doy_ < 186 THEN doy_ // 31 + 1 ELSE (doy_ - 186) // 30 + 7 END AS int) AS jm, "
            "cast(CASE WHEN doy_ < 186 THEN doy_ % 31 + 1 ELSE (doy_ - 186) % 30 + 1 END AS int) AS jd, "
            "c % 4 = 1 AS leap "
            f"FROM (SELECT *, n % 12053 - ({start}) AS doy_ "
            f"FROM (SELECT * EXCLUDE (c), c - CASE WHEN {start} > n % 12053 THEN 1 ELSE 0 END AS c "
            f"FROM (SELECT *, least(n % 12053 // 365, 32) AS c "
            f"FROM (SELECT *, {date} - DATE '2024-03-20' + 516818 AS n FROM {source})))))")


def gregorian_duck(y: str, m: str, d: str) -> str:
    """DuckDB: the date of a Jalali year, month and day; NULL for an impossible one."""
    return (f"CASE WHEN {y} >= 1 AND {m} BETWEEN 1 AND 12 AND {d} >= 1 AND {d} <= CASE WHEN {m} <= 6 THEN 31 "
            f"WHEN {m} <= 11 OR ({y} + 12) % 33 % 4 = 1 THEN 30 ELSE 29 END "
            f"THEN DATE '2024-03-20' + cast({_year_start_duck(y)} + CASE WHEN {m} <= 7 THEN ({m} - 1) * 31 "
            f"ELSE 186 + ({m} - 7) * 30 END + {d} - 1 - 516818 AS int) END")


@register("user_profile", ["d_users", "d_ratings", "d_reservations", "d_events"], f"""
, {_RS4.strip()}, {JCAL_DUCK.strip()},
pj AS (SELECT r.user_id, count(*) AS n FROM d_reservations r JOIN d_events e ON r.event_id = e.id
       WHERE e.start_time < {NOW} GROUP BY r.user_id)
SELECT u.id, u.username, u.first_name, u.last_name, u.gender, u.phone,
       cast(u.birth_date AS varchar) AS birth_date,
       cast(j.jy AS varchar) || '/' || cast(j.jm AS varchar) || '/' || cast(j.jd AS varchar)
         AS birth_date_jalali,
       u.role, u.avatar, u.is_active, u.registered_at,
       coalesce(rs.a4, 0) / 10000 AS rating_avg,
       {fmt2_duck('coalesce(rs.a4, 0)')} AS rating_avg_text,
       coalesce(rs.rating_count, 0) AS rating_count, coalesce(pj.n, 0) AS events_joined
FROM d_users u LEFT JOIN rs ON u.id = rs.to_user_id LEFT JOIN pj ON u.id = pj.user_id
LEFT JOIN jcal j ON u.birth_date = j.date""")
def q_user_profile(spark, sf_dir):
    from eventide.plans.people import user_profile
    df = flat(user_profile(domain(spark, sf_dir), AS_OF))
    return df.withColumn("birth_date", F.col("birth_date").cast("string"))


@register("user_reservations", ["d_reservations", "d_events", "d_users"], """
SELECT r.id, r.user_id, e.title AS event_title, e.slug AS event_slug,
       strftime(e.start_time, '%Y/%m/%d %H:%M') AS event_start_time, e.price AS event_price,
       u.first_name || ' ' || u.last_name AS user_name, r.code, r.price, r.status,
       strftime(r.created_at, '%Y/%m/%d %H:%M') AS created_at,
       row_number() OVER (PARTITION BY r.user_id ORDER BY r.created_at DESC, r.id DESC) AS order_rank
FROM d_reservations r JOIN d_events e ON r.event_id = e.id JOIN d_users u ON r.user_id = u.id""")
def q_user_reservations(spark, sf_dir):
    from eventide.plans.people import user_reservations
    return flat(user_reservations(domain(spark, sf_dir), rank=True))


@register("user_transactions", ["d_transactions", "d_reservations", "d_events"], """
SELECT r.user_id, e.title AS event_title, e.slug AS event_slug, e.start_time AS event_start_time,
       t.type, t.amount, t.status, t.authority, t.card_hash, t.card_pan, t.ref_id, t.paid_at,
       t.created_at, t.updated_at
FROM d_transactions t LEFT JOIN d_reservations r ON t.reservation_id = r.id
LEFT JOIN d_events e ON r.event_id = e.id
WHERE r.user_id IS NOT NULL""")
def q_user_transactions(spark, sf_dir):
    from eventide.plans.people import user_transactions
    return flat(user_transactions(domain(spark, sf_dir)))


@register("payment_detail", ["d_transactions", "d_reservations", "d_events", "d_event_medias"], f"""
SELECT t.id, t.authority, t.amount, t.reservation_id, t.status, e.title AS event_title,
       strftime(e.start_time, '%Y/%m/%d %H:%M') AS event_start_time, e.location AS event_location,
       {MEDIA} || coalesce(em.url, '') AS event_image
FROM d_transactions t LEFT JOIN d_reservations r ON t.reservation_id = r.id
LEFT JOIN d_events e ON r.event_id = e.id LEFT JOIN d_event_medias em ON e.thumbnail_id = em.id""")
def q_payment_detail(spark, sf_dir):
    from eventide.plans.people import payment_detail
    return flat(payment_detail(domain(spark, sf_dir)))


# ---------------------------------------------------------------- chat / social

VIEWER = 1


@register("inbox", ["d_conversations", "d_participants", "d_users", "d_events", "d_messages"], f"""
SELECT cp.user_id, c.id,
       CASE WHEN c.is_group THEN c.name ELSE (
         SELECT u2.first_name || ' ' || u2.last_name FROM d_participants cp2
         JOIN d_users u2 ON cp2.user_id = u2.id
         WHERE cp2.conversation_id = c.id AND cp2.user_id <> cp.user_id ORDER BY cp2.id LIMIT 1)
       END AS name,
       CASE WHEN c.is_group THEN (SELECT cast(e.thumbnail_id AS varchar) FROM d_events e
                                  WHERE e.id = c.event_id) ELSE (
         SELECT u2.avatar FROM d_participants cp2 JOIN d_users u2 ON cp2.user_id = u2.id
         WHERE cp2.conversation_id = c.id AND cp2.user_id <> cp.user_id ORDER BY cp2.id LIMIT 1)
       END AS avatar,
       c.is_group, c.expires_on, m.text AS last_message_text, m.created_at AS last_message_time,
       u.first_name || ' ' || u.last_name AS last_sender_name,
       CASE WHEN c.expires_on >= {NOW} THEN 0 ELSE 1 END AS live_rank,
       row_number() OVER (PARTITION BY cp.user_id ORDER BY c.expires_on < {NOW},
                          m.created_at DESC NULLS LAST, c.id) AS order_rank
FROM d_participants cp JOIN d_conversations c ON cp.conversation_id = c.id
LEFT JOIN d_messages m ON m.id = (SELECT m2.id FROM d_messages m2 WHERE m2.conversation_id = c.id
                                  ORDER BY m2.created_at DESC, m2.id DESC LIMIT 1)
LEFT JOIN d_users u ON m.sender_id = u.id
WHERE c.status = 'completed'""")
def q_inbox(spark, sf_dir):
    from eventide.plans.social import inbox
    return flat(inbox(domain(spark, sf_dir), AS_OF, rank=True))


@register("thread", ["d_messages", "d_conversations", "d_users"], f"""
SELECT m.id, m.conversation_id, c.expires_on, m.text,
       strftime(m.created_at, '%Y/%m/%d %H:%M') AS time, m.sender_id = {VIEWER} AS is_self,
       us.first_name || ' ' || us.last_name AS sender_name,
       CASE WHEN c.is_group THEN us.avatar END AS sender_avatar,
       CASE WHEN m.reply_to IS NOT NULL THEN r.id END AS reply_to_id,
       CASE WHEN m.reply_to IS NOT NULL THEN ur.first_name || ' ' || ur.last_name END AS reply_to_sender,
       CASE WHEN m.reply_to IS NOT NULL THEN r.text END AS reply_to_text,
       row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.id) AS order_rank
FROM d_messages m LEFT JOIN d_messages r ON m.reply_to = r.id
LEFT JOIN d_conversations c ON m.conversation_id = c.id
LEFT JOIN d_users ur ON r.sender_id = ur.id
LEFT JOIN d_users us ON m.sender_id = us.id""")
def q_thread(spark, sf_dir):
    from eventide.plans.social import thread
    return flat(thread(domain(spark, sf_dir), VIEWER, rank=True))


@register("memories_feed", ["d_memories", "d_users", "d_events", "d_memory_medias",
                            "d_memory_hashtags", "d_memory_likes", "d_memory_comments",
                            "d_memories_saved", "d_leader_followers"], f"""
SELECT m.id, m.uuid,
       coalesce(e.title, '') AS event_name, coalesce(e.slug, '') AS event_slug,
       coalesce(e.location, '') AS event_location,
       coalesce(strftime(e.start_time, '%Y/%m/%d %H:%M'), '') AS event_start_time,
       u.id AS user_id, u.first_name || ' ' || u.last_name AS user_name,
       coalesce(u.avatar, '') AS user_avatar, m.caption,
       {MEDIA} || coalesce(mm.url, '') AS thumbnail,
       strftime(m.created_at, '%Y/%m/%d %H:%M') AS created_at,
       (SELECT count(*) FROM d_memory_likes ml WHERE ml.memory_id = m.id) AS like_count,
       (SELECT count(*) FROM d_memory_comments mc WHERE mc.memory_id = m.id) AS comment_count,
       coalesce((SELECT string_agg(DISTINCT hashtag, ',' ORDER BY hashtag) FROM d_memory_hashtags mh
                 WHERE mh.memory_id = m.id), '') AS hashtags,
       (SELECT count(*) FROM d_memory_likes ml WHERE ml.memory_id = m.id AND ml.user_id = {VIEWER}) > 0
         AS is_liked,
       (SELECT count(*) FROM d_memories_saved ms WHERE ms.memory_id = m.id AND ms.user_id = {VIEWER}) > 0
         AS is_saved,
       (SELECT count(*) FROM d_leader_followers lf WHERE lf.leader_id = u.id
          AND lf.follower_id = {VIEWER}) > 0 AS is_following,
       m.created_at AS created_ts
FROM d_memories m JOIN d_users u ON m.user_id = u.id
LEFT JOIN d_events e ON m.event_id = e.id
LEFT JOIN d_memory_medias mm ON mm.id = m.thumbnail_id
WHERE m.status = 'published'""")
def q_memories_feed(spark, sf_dir):
    from eventide.plans.social import memories_feed
    df = memories_feed(domain(spark, sf_dir), VIEWER, sort=True)
    return flat(df.withColumn("hashtags", F.array_join("hashtags", ",")))


@register("memory_medias", ["d_memories", "d_memory_medias"], f"""
SELECT m.id AS memory_id, m.uuid, mm.id AS media_id, mm.type, {MEDIA} || mm.url AS url
FROM d_memories m JOIN d_memory_medias mm ON m.id = mm.memory_id WHERE m.status = 'published'""")
def q_memory_medias(spark, sf_dir):
    from eventide.plans.social import memory_medias
    return memory_medias(domain(spark, sf_dir), sort=True)


@register("stories", ["d_memories", "d_events", "d_event_categories", "d_users"], """
SELECT m.id, m.caption, m.created_at, e.category_id, ec.name AS category, u.id AS user_id,
       u.first_name || ' ' || u.last_name AS user_name, u.avatar AS user_avatar
FROM d_memories m LEFT JOIN d_events e ON m.event_id = e.id
LEFT JOIN d_event_categories ec ON e.category_id = ec.id LEFT JOIN d_users u ON m.user_id = u.id
WHERE m.status = 'published'""")
def q_stories(spark, sf_dir):
    from eventide.plans.social import stories
    return flat(stories(domain(spark, sf_dir), sort=True))


@register("temp_medias", ["d_event_medias"], """
SELECT uploader_id, uuid AS id, url, type FROM d_event_medias WHERE event_id IS NULL""")
def q_temp_medias(spark, sf_dir):
    from eventide.plans.social import temp_medias
    return temp_medias(domain(spark, sf_dir))


@register("user_notifications", ["d_notifications"], "SELECT * FROM d_notifications")
def q_user_notifications(spark, sf_dir):
    from eventide.plans.social import user_notifications
    return user_notifications(domain(spark, sf_dir))


@register("user_tickets", ["d_support_tickets"], "SELECT * FROM d_support_tickets")
def q_user_tickets(spark, sf_dir):
    from eventide.plans.social import user_tickets
    return user_tickets(domain(spark, sf_dir))


@register("report_targets", ["d_reports"], "\n UNION ALL ".join(
    f"SELECT id, reporter_id, reason, created_at, '{k}' AS target_kind, reported_{k}_id AS target_id "
    f"FROM d_reports WHERE reported_{k}_id IS NOT NULL"
    for k in ["user", "conversation", "message", "event", "leader", "memory"]))
def q_report_targets(spark, sf_dir):
    from eventide.plans.social import report_targets
    return report_targets(domain(spark, sf_dir))[0]


# ---------------------------------------------------------------- pricing / settlement / codes

@register("discount_quotes", ["d_code_requests", "d_discount_codes", "d_reservations", "d_events"], f"""
, c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id) AS rn
                        FROM d_discount_codes) WHERE rn = 1),
used AS (SELECT discount_code_id, sum(group_members) AS filled FROM d_reservations
         WHERE status <> 'canceled' AND discount_code_id IS NOT NULL AND discount_code_id <> 0
         GROUP BY discount_code_id),
q AS (SELECT r.request_id, r.code, r.event_id, c.id AS code_id, e.price,
             CASE WHEN c.id IS NULL THEN 'not-found'
                  WHEN c.expires_on < {NOW} THEN 'expired'
                  WHEN (c.event_id IS NOT NULL AND c.event_id <> r.event_id)
                    OR (c.category_id IS NOT NULL AND c.category_id IS DISTINCT FROM e.category_id)
                    OR (c.leader_id IS NOT NULL AND c.leader_id IS DISTINCT FROM e.leader_id) THEN 'out-of-scope'
                  WHEN c.capacity > 0 AND coalesce(u.filled, 0) >= c.capacity THEN 'used-up'
                  ELSE 'ok' END AS verdict,
             CASE WHEN coalesce(c.discount_percent, 0) <> 0 THEN
                    CASE WHEN c.discount_max IS NOT NULL AND c.discount_max <> 0
                         THEN least(round(cast(e.price AS decimal(18,2)) * c.discount_percent / 100, 2),
                                    cast(c.discount_max AS decimal(18,2)))
                         ELSE round(cast(e.price AS decimal(18,2)) * c.discount_percent / 100, 2) END
                  ELSE cast(coalesce(c.discount_constant, 0) AS decimal(18,2)) END AS amt
      FROM d_code_requests r LEFT JOIN c1 c ON r.code = c.code
      LEFT JOIN used u ON c.id = u.discount_code_id LEFT JOIN d_events e ON r.event_id = e.id)
SELECT request_id, code, event_id, code_id, verdict,
       CASE WHEN verdict = 'ok' THEN cast(amt AS double) END AS amount,
       CASE WHEN verdict = 'ok' THEN cast(greatest(0, cast(price AS decimal(18,2)) - amt) AS double) END
         AS final_price
FROM q""")
def q_discount_quotes(spark, sf_dir):
    from eventide.plans.commerce import discount_quotes
    t = domain(spark, sf_dir)
    return flat(discount_quotes(t, t.code_requests, AS_OF))


@register("settle_batch", ["d_confirmations", "d_transactions", "d_reservations", "d_events"], """
, tx1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY id) AS rn
                         FROM d_transactions) WHERE rn = 1),
c1 AS (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY confirmed_at, conf_id) AS rn
       FROM d_confirmations),
v AS (SELECT c.conf_id, c.authority, c.confirmed_at,
             CASE WHEN c.rn > 1 THEN 'duplicate' WHEN t.id IS NULL THEN 'not-found'
                  WHEN t.status = 'paid' THEN 'already-paid' ELSE 'settled' END AS verdict,
             t.id AS transaction_id, t.reservation_id, e.is_approval
      FROM c1 c LEFT JOIN tx1 t ON c.authority = t.authority
      LEFT JOIN d_reservations r ON t.reservation_id = r.id LEFT JOIN d_events e ON r.event_id = e.id)
SELECT conf_id, authority, confirmed_at, verdict, transaction_id, reservation_id,
       CASE WHEN verdict = 'settled' THEN CASE WHEN is_approval THEN 'need-approval' ELSE 'paid' END END
         AS reservation_status,
       CASE WHEN verdict = 'settled' THEN 100000000000 + transaction_id END AS ref_id
FROM v""")
def q_settle_batch(spark, sf_dir):
    from eventide.plans.commerce import settle_batch
    t = domain(spark, sf_dir)
    return settle_batch(t, t.confirmations)[0]


@register("otp_audit", ["d_otp_issued", "d_otp_attempt"], """
, cand AS (SELECT a.id AS attempt_id, a.phone, a.attempted_at, i.id AS otp_id, i.expires_at
           FROM d_otp_attempt a LEFT JOIN d_otp_issued i
             ON a.phone = i.phone AND a.code = i.code AND a.user_ip = i.user_ip
            AND i.created_at <= a.attempted_at),
best AS (SELECT attempt_id, phone, attempted_at, arg_max(otp_id, (expires_at, otp_id)) AS otp_id,
                max(expires_at) AS expires_at
         FROM cand GROUP BY attempt_id, phone, attempted_at),
st AS (SELECT *, CASE WHEN otp_id IS NULL THEN 'wrong'
                      WHEN floor(epoch(attempted_at)) < expires_at THEN 'ok' ELSE 'expired' END AS s
       FROM best),
st2 AS (SELECT *, CASE WHEN s = 'ok' AND row_number() OVER (PARTITION BY otp_id, s
                         ORDER BY attempted_at, attempt_id) > 1 THEN 'reused' ELSE s END AS status
        FROM st),
line AS (SELECT phone, page, created_at AS moment, true AS asks, id FROM d_otp_issued
         UNION ALL SELECT u.phone, i.page, u.attempted_at, false, NULL
         FROM st2 u JOIN d_otp_issued i ON u.otp_id = i.id WHERE u.status = 'ok'),
l2 AS (SELECT *, floor(epoch(moment)) AS s,
              row_number() OVER (PARTITION BY phone, page ORDER BY moment, asks DESC, id) AS rn FROM line),
rec(phone, page, rn, live_until, refused) AS (
  SELECT phone, page, rn, CASE WHEN asks THEN s + 120 ELSE 0 END, 0 FROM l2 WHERE rn = 1
  UNION ALL
  SELECT r.phone, r.page, r.rn,
         CASE WHEN NOT r.asks THEN 0 WHEN r.s < rec.live_until THEN rec.live_until ELSE r.s + 120 END,
         CASE WHEN r.asks AND r.s < rec.live_until THEN 1 ELSE 0 END
  FROM rec JOIN l2 r ON r.phone = rec.phone AND r.page = rec.page AND r.rn = rec.rn + 1),
thr AS (SELECT phone, sum(refused) AS throttled FROM rec GROUP BY phone),
req AS (SELECT phone, count(*) AS requests FROM d_otp_issued GROUP BY phone),
att AS (SELECT phone, count(*) AS attempts, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS matched,
               sum(CASE WHEN status = 'expired' THEN 1 ELSE 0 END) AS expired,
               sum(CASE WHEN status = 'wrong' THEN 1 ELSE 0 END) AS wrong,
               sum(CASE WHEN status = 'reused' THEN 1 ELSE 0 END) AS reused
        FROM st2 GROUP BY phone)
SELECT coalesce(req.phone, att.phone) AS phone,
       cast(coalesce(requests, 0) AS bigint) AS requests, cast(coalesce(throttled, 0) AS bigint) AS throttled,
       cast(coalesce(attempts, 0) AS bigint) AS attempts,
       cast(coalesce(matched, 0) AS bigint) AS matched, cast(coalesce(expired, 0) AS bigint) AS expired,
       cast(coalesce(wrong, 0) AS bigint) AS wrong, cast(coalesce(reused, 0) AS bigint) AS reused
FROM req FULL JOIN att ON req.phone = att.phone LEFT JOIN thr ON thr.phone = req.phone""", recursive=True)
def q_otp_audit(spark, sf_dir):
    from eventide.plans.commerce import otp_audit
    t = domain(spark, sf_dir)
    return otp_audit(t.otp_issued, t.otp_attempt)


# ---------------------------------------------------------------- admission / matching

@register("admit_bookings", ["d_booking_requests", "d_events", "d_reservations"], """
, base AS (SELECT event_id, sum(group_members) AS filled FROM d_reservations
           WHERE status <> 'canceled' GROUP BY event_id),
r AS (SELECT q.*, e.id IS NOT NULL AS ex, e.capacity, e.grouping,
             e.capacity - coalesce(b.filled, 0) AS left0,
             coalesce(e.grouping > 2 AND q.size > e.grouping, false) AS gviol,
             coalesce(q.requested_at > e.start_time, false) AS closed,
             row_number() OVER (PARTITION BY q.event_id ORDER BY q.requested_at, q.request_id) AS rn
      FROM d_booking_requests q LEFT JOIN d_events e ON q.event_id = e.id
      LEFT JOIN base b ON q.event_id = b.event_id),
rec(event_id, rn, lft) AS (
  SELECT DISTINCT event_id, 0 AS rn, left0 AS lft FROM r WHERE ex
  UNION ALL
  SELECT r.event_id, r.rn,
         CASE WHEN NOT r.gviol AND NOT r.closed AND r.size <= rec.lft THEN rec.lft - r.size ELSE rec.lft END
  FROM rec JOIN r ON r.event_id = rec.event_id AND r.rn = rec.rn + 1),
d AS (SELECT r.*, p.lft AS left_before, c.lft AS left_after FROM r
      LEFT JOIN rec p ON p.event_id = r.event_id AND p.rn = r.rn - 1
      LEFT JOIN rec c ON c.event_id = r.event_id AND c.rn = r.rn)
SELECT request_id, event_id, user_id, requested_at, size,
       find_buddy AND coalesce(grouping, 0) < 2 AS find_buddy,
       cast(capacity AS bigint) AS capacity, cast(grouping AS bigint) AS grouping,
       cast(left0 AS bigint) AS left0, cast(left_before AS bigint) AS left_before,
       ex AND left_after < left_before AS admitted,
       CASE WHEN NOT ex THEN 'no-event' WHEN left_before <= 0 THEN 'full'
            WHEN size > left_before OR gviol THEN 'too-many' WHEN closed THEN 'closed'
            ELSE 'admitted' END AS reason,
       cast(left_after AS bigint) AS left_after
FROM d""", recursive=True)
def q_admit_bookings(spark, sf_dir):
    from eventide.operators.folds import admit_bookings
    t = domain(spark, sf_dir)
    return admit_bookings(t, t.booking_requests)


@register("match_groups", ["d_reservations", "d_events"], """
, b AS (SELECT r.id AS reservation_id, r.event_id, r.user_id, r.group_members, r.find_buddy,
               e.grouping, r.updated_at AS paid_at
        FROM d_reservations r JOIN d_events e ON r.event_id = e.id
        WHERE r.status IN ('paid', 'need-approval') AND (r.find_buddy OR e.grouping >= 2)),
k AS (SELECT reservation_id, event_id, user_id, 'buddy' AS kind, 1 AS w, 2 AS cap, paid_at
      FROM b WHERE find_buddy
      UNION ALL
      SELECT reservation_id, event_id, user_id, 'group' AS kind, group_members AS w, grouping AS cap,
             paid_at FROM b WHERE grouping >= 2),
k2 AS (SELECT *, row_number() OVER (PARTITION BY event_id, kind ORDER BY paid_at, reservation_id) AS seq
       FROM k),
rec(event_id, kind, seq, fills, members, chat) AS (
  SELECT DISTINCT event_id, kind, 0, cast([] AS INTEGER[]), cast([] AS BIGINT[][]), cast(NULL AS INTEGER)
  FROM k2
  UNION ALL
  SELECT event_id, kind, seq,
         CASE WHEN pos IS NOT NULL
              THEN list_transform(fills, lambda f, i: CASE WHEN i = pos THEN f + w ELSE f END)
              WHEN w > cap THEN fills ELSE list_append(fills, w) END,
         CASE WHEN pos IS NOT NULL
              THEN list_transform(members, lambda m, i: CASE WHEN i = pos THEN list_append(m, u) ELSE m END)
              WHEN w > cap THEN members ELSE list_append(members, [u]) END,
         CASE WHEN pos IS NOT NULL THEN pos WHEN w > cap THEN NULL ELSE len(fills) + 1 END
  FROM (SELECT r.event_id, r.kind, k2.seq, r.fills, r.members, k2.w, k2.cap, k2.user_id AS u,
               list_position(list_transform(r.fills, lambda f, i: f + k2.w <= k2.cap
                                            AND NOT list_contains(r.members[i], k2.user_id)), true) AS pos
        FROM rec r JOIN k2 ON k2.event_id = r.event_id AND k2.kind = r.kind AND k2.seq = r.seq + 1) x),
fin AS (SELECT event_id, kind, arg_max(fills, seq) AS fills FROM rec GROUP BY event_id, kind)
SELECT k2.reservation_id, k2.event_id, k2.user_id, k2.kind, rec.chat AS chat_no,
       rec.chat IS NOT NULL AS placed, fin.fills[rec.chat] AS chat_fill, cast(k2.cap AS integer) AS chat_size,
       CASE WHEN rec.chat IS NULL THEN NULL
            WHEN fin.fills[rec.chat] = k2.cap THEN 'completed' ELSE 'pending' END AS chat_status,
       coalesce(e.end_time, e.start_time) + INTERVAL 7 DAY AS chat_expires_on
FROM k2 JOIN rec ON rec.event_id = k2.event_id AND rec.kind = k2.kind AND rec.seq = k2.seq
JOIN fin ON fin.event_id = k2.event_id AND fin.kind = k2.kind
JOIN d_events e ON e.id = k2.event_id""", recursive=True)
def q_match_groups(spark, sf_dir):
    from eventide.operators.folds import match_groups
    return match_groups(domain(spark, sf_dir))


# ---------------------------------------------------------------- quality / text / calendar

# Declared table -> the view that stands for it.
_AUDIT_VIEWS = {
    "otps": "d_otp_issued", "conversation_participants": "d_participants",
    **{t: "d_" + t for t in (
        "users event_categories events event_medias leaders reservations transactions discount_codes "
        "support_tickets notifications conversations messages leader_followers ratings reports memories "
        "memory_medias memory_hashtags memory_likes memory_comments memories_saved").split()},
}
# Declared columns that the views lack: their rules come out as not audited (NULL).
_AUDIT_ABSENT = {
    "users": "password", "otps": "is_used", "events": "coordinates", "leader_followers": "created_at",
    "memory_medias": "created_at", "memory_hashtags": "id created_at", "memory_likes": "id created_at",
    "memories_saved": "id created_at",
}


def _audit_sql() -> str:
    from eventide.operators.constraints import marketplace_rules
    absent = {(t, c) for t, cols in _AUDIT_ABSENT.items() for c in cols.split()}
    sel, by_table, skipped = [], {}, []
    for r in marketplace_rules():
        if r.table not in _AUDIT_VIEWS or any((r.table, c) in absent for c in r.cols) or (
                r.ref and r.ref[0] not in _AUDIT_VIEWS):
            skipped.append(f"('{r.table}', '{r.kind}', '{','.join(r.cols)}', NULL, NULL)")
            continue
        view, c = _AUDIT_VIEWS[r.table], r.cols[0]
        head = f"SELECT '{r.table}', '{r.kind}', '{','.join(r.cols)}', count(*), min"
        if r.kind in ("pk", "unique"):
            key = " || '|' || ".join(r.cols)
            sel.append(f"{head}(k) FROM (SELECT {key} || '' AS k FROM {view} WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1)")
        elif r.kind == "fk":
            sel.append(f"{head}(t.{c} || '') FROM {view} t ANTI JOIN {_AUDIT_VIEWS[r.ref[0]]} p ON t.{c} = p.id "
                       f"WHERE t.{c} IS NOT NULL")
        else:
            cond = (f"{c} IS NULL" if r.kind == "not_null"
                    else f"{c} NOT IN {r.values}" if r.kind == "enum"
                    else f"{c} NOT BETWEEN {r.values[0]} AND {r.values[1]}")
            by_table.setdefault(r.table, []).append((r.kind, c, cond))
    for t, rules in by_table.items():
        pk = "memory_id" if (t, "id") in absent else "id"
        sel.append(f"SELECT '{t}', unnest([{', '.join(repr(k) for k, _, _ in rules)}]), "
                   f"unnest([{', '.join(repr(c) for _, c, _ in rules)}]), "
                   f"unnest([{', '.join(f'count(*) FILTER ({w})' for _, _, w in rules)}]), "
                   f"unnest([{', '.join(f"min({pk} || '') FILTER ({w})" for _, _, w in rules)}]) FROM {_AUDIT_VIEWS[t]}")
    sel.append(f"SELECT * FROM (VALUES {', '.join(skipped)}) v")
    body = "\nUNION ALL ".join(sel)
    return (", a(table_name, rule, columns, violations, sample_key) AS (" + body + ")\n"
            "SELECT table_name, rule, columns, cast(violations AS bigint) AS violations, "
            "cast(sample_key AS varchar) AS sample_key FROM a")


@register("constraint_audit", list(_AUDIT_VIEWS.values()), _audit_sql())
def q_constraint_audit(spark, sf_dir):
    from eventide.operators.constraints import audit, marketplace_rules
    t = domain(spark, sf_dir)
    return audit({n: t.view(v) for n, v in _AUDIT_VIEWS.items()}, marketplace_rules())


_NID_OK = """(regexp_full_match(regexp_replace({c}, '[\\s\\-]', '', 'g'), '\\d{{10}}')
  AND regexp_replace({c}, '[\\s\\-]', '', 'g') <> repeat(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), 1, 1), 10)
  AND (CASE WHEN list_sum([cast(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), i, 1) AS int) * (11 - i)
                           for i in range(1, 10)]) % 11 < 2
            THEN cast(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), 10, 1) AS int)
                 = list_sum([cast(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), i, 1) AS int) * (11 - i)
                             for i in range(1, 10)]) % 11
            ELSE cast(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), 10, 1) AS int)
                 = 11 - list_sum([cast(substr(regexp_replace({c}, '[\\s\\-]', '', 'g'), i, 1) AS int) * (11 - i)
                                  for i in range(1, 10)]) % 11 END))"""

_FA = f"'{PERSIAN_NAME}'"


HASH_SECRET = "registered-query"  # a deployment passes its own


@register("validate_users", ["d_registrations", "d_users"], f"""
, x AS (SELECT r.*, r.phone IN (SELECT phone FROM d_users) AS ptaken,
             r.national_id IN (SELECT national_id FROM d_users) AS ntaken
      FROM d_registrations r),
y AS (SELECT *, concat_ws(',',
        CASE WHEN NOT coalesce(regexp_full_match(first_name, {_FA}), false) THEN 'first_name' END,
        CASE WHEN NOT coalesce(regexp_full_match(last_name, {_FA}), false) THEN 'last_name' END,
        CASE WHEN NOT coalesce(regexp_full_match(phone, '09\\d{{9}}'), false) THEN 'phone' END,
        CASE WHEN NOT coalesce({_NID_OK.format(c='national_id')}, false) THEN 'national_id' END,
        CASE WHEN ptaken THEN 'phone_taken' END,
        CASE WHEN ntaken THEN 'national_id_taken' END) AS own FROM x),
fp AS (SELECT phone, min(row_id) AS f FROM y WHERE own = '' GROUP BY phone),
fn AS (SELECT national_id, min(row_id) AS f FROM y WHERE own = '' GROUP BY national_id),
z AS (SELECT y.*, concat_ws(',', CASE WHEN own <> '' THEN own END,
        CASE WHEN row_id > fp.f THEN 'phone_repeated' END,
        CASE WHEN row_id > fn.f THEN 'national_id_repeated' END) AS reasons
      FROM y LEFT JOIN fp ON y.phone = fp.phone LEFT JOIN fn ON y.national_id = fn.national_id)
SELECT row_id, first_name, last_name, phone,
       sha256('{HASH_SECRET}:' || sha256('{HASH_SECRET}:' || national_id)) AS national_id, reasons,
       reasons = '' AS accepted
FROM z""")
def q_validate_users(spark, sf_dir):
    from eventide.operators.quality import check_users
    t = domain(spark, sf_dir)
    return check_users(t.registrations, t.users, secret=HASH_SECRET).select(
        "row_id", "first_name", "last_name", "phone", "national_id",
        F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"))


def _norm_phone_sql(c: str) -> str:
    d = f"regexp_replace(translate({c}, '۰۱۲۳۴۵۶۷۸۹٫', '0123456789.'), '[^0-9]', '', 'g')"
    return (f"CASE WHEN regexp_full_match({d}, '09\\d{{9}}') THEN {d} "
            f"WHEN regexp_full_match({d}, '9\\d{{9}}') THEN '0' || {d} "
            f"WHEN regexp_full_match({d}, '98\\d{{9,10}}') THEN '0' || substr({d}, 3) ELSE {d} END")


@register("contact_duplicates", ["d_users", "d_registrations"], f"""
, c AS (SELECT 'u' || cast(id AS varchar) AS id, phone FROM d_users
        UNION ALL SELECT 'r' || cast(row_id AS varchar) AS id, phone FROM d_registrations)
SELECT phone_norm, id, n FROM (
  SELECT {_norm_phone_sql('phone')} AS phone_norm, id,
         count(*) OVER (PARTITION BY {_norm_phone_sql('phone')}) AS n FROM c)
WHERE n > 1""")
def q_contact_duplicates(spark, sf_dir):
    from eventide.functions.text import standardise_contacts
    t = domain(spark, sf_dir)
    c = (t.users.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"), "phone")
         .unionByName(t.registrations.select(
             F.concat(F.lit("r"), F.col("row_id").cast("string")).alias("id"), "phone")))
    return standardise_contacts(c)


_ESC = "replace(replace(replace(replace(replace({c}, '&', '&amp;'), '\"', '&quot;'), '''', '&#039;'), '<', '&lt;'), '>', '&gt;')"


@register("clean_captions", ["d_memories"], f"""
SELECT id, {_ESC.format(c="trim(uuid, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))")} AS uuid,
       {_ESC.format(c="trim(caption, ' ' || chr(9) || chr(10) || chr(13) || chr(0) || chr(11))")} AS caption
FROM d_memories""")
def q_clean_captions(spark, sf_dir):
    from eventide.functions.text import clean_text
    return clean_text(domain(spark, sf_dir).memories.select("id", "uuid", "caption"))


def _duck_list(name: str) -> str:
    import eventide.functions.calendar as cal
    return "[" + ", ".join("'" + m + "'" for m in getattr(cal, name)) + "]"


_MONTHS_DUCK = _duck_list("MONTH_NAMES")


@register("event_slugs", ["d_events"], f"""
, {JCAL_DUCK.strip()}
SELECT e.id, trim(lower(regexp_replace(
         regexp_replace(e.title, '[^a-zA-Z0-9\\s\\-_\\x{{0600}}-\\x{{06FF}}]', '', 'g')
         || coalesce(' ' || lpad(cast(j.jd AS varchar), 2, '0') || ' ' || {_MONTHS_DUCK}[j.jm]
                     || ' ' || cast(j.jy AS varchar), ''),
         '\\s+', '-', 'g')), '-') AS slug
FROM d_events e LEFT JOIN jcal j ON cast(e.start_time AS date) = j.date""")
def q_event_slugs(spark, sf_dir):
    from eventide.functions.text import slug
    t = domain(spark, sf_dir)
    return slug(t.events.select("id", "title", "start_time"), "title", "start_time").select("id", "slug")


@register("calendar_rollup", ["d_reservations"], f"""
, {JCAL_DUCK.strip()}
SELECT j.jy, j.jm, {_MONTHS_DUCK}[j.jm] AS month_name, count(*) AS bookings,
       cast(sum(r.group_members) AS bigint) AS seats
FROM d_reservations r JOIN jcal j ON cast(r.created_at AS date) = j.date
GROUP BY j.jy, j.jm""")
def q_calendar_rollup(spark, sf_dir):
    from eventide.functions.calendar import rollup_calendar
    t = domain(spark, sf_dir)
    return rollup_calendar(t.reservations, "created_at", "month",
                           [F.count(F.lit(1)).alias("bookings"),
                            F.sum("group_members").alias("seats")])


@register("validate_members", ["d_group_members"], f"""
, {JCAL_DUCK.strip()},
m AS (SELECT *, translate(trim(birth_date), '۰۱۲۳۴۵۶۷۸۹٫', '0123456789.') AS bt FROM d_group_members),
p AS (SELECT *, CASE WHEN len(string_split(bt, '/')) = 3 THEN string_split(bt, '/')
                     WHEN len(string_split(bt, '-')) = 3 THEN string_split(bt, '-') END AS parts FROM m),
q AS (SELECT *, try_cast(parts[1] AS int) AS y, try_cast(parts[2] AS int) AS mo,
             try_cast(parts[3] AS int) AS d FROM p),
g AS (SELECT q.*, CASE WHEN y < 1600 THEN j.date
                        ELSE try_strptime(lpad(cast(y AS varchar), 4, '0') || '-' || lpad(cast(mo AS varchar), 2, '0')
                                          || '-' || lpad(cast(d AS varchar), 2, '0'), '%Y-%m-%d')::date END AS bd
      FROM q LEFT JOIN jcal j ON q.y = j.jy AND q.mo = j.jm AND q.d = j.jd)
SELECT member_id, reservation_id, cast(bd AS varchar) AS birth_date_g,
       concat_ws(',',
         CASE WHEN first_name IS NULL OR (trim(first_name) = '' AND first_name <> '0') THEN 'first_name' END,
         CASE WHEN last_name IS NULL OR (trim(last_name) = '' AND last_name <> '0') THEN 'last_name' END,
         CASE WHEN birth_date IS NULL OR (trim(birth_date) = '' AND birth_date <> '0') THEN 'birth_date' END,
         CASE WHEN national_id IS NULL OR (trim(national_id) = '' AND national_id <> '0') THEN 'national_id' END,
         CASE WHEN bd IS NULL AND NOT (birth_date IS NULL OR trim(birth_date) = '') THEN 'birth_date_format' END)
         AS missing
FROM g""")
def q_validate_members(spark, sf_dir):
    from eventide.operators.quality import check_members
    t = domain(spark, sf_dir)
    return check_members(t.group_members).select("member_id", "reservation_id",
                                      F.col("birth_date_g").cast("string").alias("birth_date_g"),
                                      F.array_join("missing", ",").alias("missing"))


# ---------------------------------------------------------------- streaming (run with availableNow)

@register("stream_live_fill", ["d_reservations"], """
SELECT event_id, cast(sum(CASE WHEN status = 'canceled' THEN 0 ELSE group_members END) AS bigint) AS filled
FROM d_reservations GROUP BY event_id""")
def q_stream_live_fill(spark, sf_dir):
    from eventide.streaming.jobs import file_stream, live_fill, run_update_snapshot
    r = domain(spark, sf_dir).reservations
    # change feed: creation (+members), later cancellation (-members)
    changes = (r.select(F.col("id").alias("reservation_id"), "event_id",
                        F.col("group_members").cast("long").alias("seats_delta"),
                        F.col("created_at").alias("change_ts"))
               .unionByName(r.filter(F.col("status") == "canceled").select(
                   F.col("id").alias("reservation_id"), "event_id",
                   (-F.col("group_members")).cast("long").alias("seats_delta"),
                   F.col("updated_at").alias("change_ts"))))
    s = file_stream(changes, "seat_changes", "change_ts")
    return run_update_snapshot(live_fill(s), "live_fill", "event_id")


@register("stream_accept_messages", ["d_messages", "d_conversations"], """
SELECT m.id, m.conversation_id, m.sender_id, m.created_at, m.created_at <= c.expires_on AS accepted
FROM d_messages m JOIN d_conversations c ON m.conversation_id = c.id""")
def q_stream_accept_messages(spark, sf_dir):
    from eventide.streaming.jobs import accept_messages, file_stream, run_to_table
    t = domain(spark, sf_dir)
    s = file_stream(t.messages.select("id", "conversation_id", "sender_id", "created_at"),
                    "messages", "created_at")
    out = run_to_table(accept_messages(s, t.conversations), "accept_messages")
    return out.select("id", "conversation_id", "sender_id",
                      F.col("created_at").cast("timestamp_ntz").alias("created_at"), "accepted")


@register("stream_settle", ["d_confirmations", "d_transactions", "d_reservations", "d_events"], """
, tx1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY id) AS rn
                         FROM d_transactions) WHERE rn = 1),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY confirmed_at, conf_id)
                      AS rn FROM d_confirmations) WHERE rn = 1)
SELECT c.conf_id, c.authority, c.confirmed_at, t.id AS transaction_id, t.reservation_id,
       CASE WHEN e.is_approval THEN 'need-approval' ELSE 'paid' END AS reservation_status,
       100000000000 + t.id AS ref_id
FROM c1 c JOIN tx1 t ON c.authority = t.authority
LEFT JOIN d_reservations r ON t.reservation_id = r.id LEFT JOIN d_events e ON r.event_id = e.id
WHERE t.status <> 'paid'""")
def q_stream_settle(spark, sf_dir):
    from eventide.streaming.jobs import disorder_seconds, file_stream, scratch_dir, settle_stream
    t = domain(spark, sf_dir)
    s = file_stream(t.confirmations, "confirmations", "confirmed_at")
    job = settle_stream(s, t.transactions, t.reservations, t.events, scratch_dir(spark, "settled"),
                        disorder_seconds(t.confirmations, "confirmed_at"), buckets=8)
    return job.table("out").select(
        "conf_id", "authority", F.col("confirmed_at").cast("timestamp_ntz").alias("confirmed_at"),
        "transaction_id", "reservation_id", "reservation_status", "ref_id")


@register("stream_otp_match", ["d_otp_issued", "d_otp_attempt"], """
, m AS (SELECT a.id AS attempt_id, i.id AS otp_id, a.attempted_at
        FROM d_otp_attempt a JOIN d_otp_issued i
          ON a.phone = i.phone AND a.code = i.code AND a.user_ip = i.user_ip
         AND a.attempted_at >= i.created_at AND a.attempted_at < i.created_at + INTERVAL 120 SECOND)
SELECT attempt_id, otp_id,
       row_number() OVER (PARTITION BY otp_id ORDER BY attempted_at, attempt_id) = 1 AS first_use
FROM m""")
def q_stream_otp_match(spark, sf_dir):
    from eventide.streaming.jobs import disorder_seconds, file_stream, otp_match, scratch_dir
    t = domain(spark, sf_dir)
    late = max(disorder_seconds(t.otp_issued, "created_at", 3), disorder_seconds(t.otp_attempt, "attempted_at", 3))
    i = file_stream(t.otp_issued, "otp_issued", "created_at", n_files=3)
    a = file_stream(t.otp_attempt, "otp_attempt", "attempted_at", n_files=3)
    return otp_match(i, a, scratch_dir(spark, "otp_match"), late).table("out").select("attempt_id", "otp_id", "first_use")


@register("stream_otp_throttle", ["d_otp_issued"], """
, r AS (SELECT id, phone, page, created_at, floor(epoch(created_at)) AS s,
               row_number() OVER (PARTITION BY phone, page ORDER BY created_at, id) AS rn
        FROM d_otp_issued),
rec(phone, page, rn, live_until, accepted) AS (
  SELECT phone, page, rn, s + 120, true FROM r WHERE rn = 1
  UNION ALL
  SELECT r.phone, r.page, r.rn,
         CASE WHEN r.s < rec.live_until THEN rec.live_until ELSE r.s + 120 END,
         NOT (r.s < rec.live_until)
  FROM rec JOIN r ON r.phone = rec.phone AND r.page = rec.page AND r.rn = rec.rn + 1)
SELECT r.id, r.phone, r.page, rec.accepted,
       CASE WHEN rec.accepted THEN cast(rec.live_until AS bigint) END AS expires_at
FROM r JOIN rec ON r.phone = rec.phone AND r.page = rec.page AND r.rn = rec.rn""", recursive=True)
def q_stream_otp_throttle(spark, sf_dir):
    from eventide.streaming.jobs import disorder_seconds, file_stream, otp_throttle, scratch_dir
    t = domain(spark, sf_dir)
    s = file_stream(t.otp_issued.select("id", "phone", "page", "created_at"), "otp_req",
                    "created_at")
    return otp_throttle(s, scratch_dir(spark, "otp_throttle"),
                        disorder_seconds(t.otp_issued, "created_at")).table("out").select(
        "id", "phone", "page", "accepted", "expires_at")


@register("stream_admit", ["d_booking_requests", "d_events", "d_reservations"], """
, base AS (SELECT event_id, sum(group_members) AS filled FROM d_reservations
           WHERE status <> 'canceled' GROUP BY event_id),
r AS (SELECT q.*, e.id IS NOT NULL AS ex, e.grouping,
             e.capacity - coalesce(b.filled, 0) AS left0,
             coalesce(e.grouping > 2 AND q.size > e.grouping, false) AS gviol,
             coalesce(q.requested_at > e.start_time, false) AS closed,
             row_number() OVER (PARTITION BY q.event_id ORDER BY q.requested_at, q.request_id) AS rn
      FROM d_booking_requests q LEFT JOIN d_events e ON q.event_id = e.id
      LEFT JOIN base b ON q.event_id = b.event_id),
rec(event_id, rn, lft) AS (
  SELECT DISTINCT event_id, 0 AS rn, left0 AS lft FROM r WHERE ex
  UNION ALL
  SELECT r.event_id, r.rn,
         CASE WHEN NOT r.gviol AND NOT r.closed AND r.size <= rec.lft THEN rec.lft - r.size ELSE rec.lft END
  FROM rec JOIN r ON r.event_id = rec.event_id AND r.rn = rec.rn + 1),
d AS (SELECT r.*, p.lft AS left_before, c.lft AS left_after FROM r
      LEFT JOIN rec p ON p.event_id = r.event_id AND p.rn = r.rn - 1
      LEFT JOIN rec c ON c.event_id = r.event_id AND c.rn = r.rn)
SELECT request_id, event_id, size, cast(left_before AS bigint) AS left_before,
       ex AND left_after < left_before AS admitted,
       CASE WHEN NOT ex THEN 'no-event' WHEN left_before <= 0 THEN 'full'
            WHEN size > left_before OR gviol THEN 'too-many' WHEN closed THEN 'closed'
            ELSE 'admitted' END AS reason
FROM d""", recursive=True)
def q_stream_admit(spark, sf_dir):
    from eventide.streaming.jobs import admit_stream, disorder_seconds, file_stream, scratch_dir
    t = domain(spark, sf_dir)
    s = file_stream(t.booking_requests.select("request_id", "event_id", "user_id", "requested_at", "size",
                                              "find_buddy"), "booking_requests", "requested_at", n_files=4)
    job = admit_stream(s, t.events, t.reservations, scratch_dir(spark, "admit_stream"),
                       disorder_seconds(t.booking_requests, "requested_at"))
    return job.table("out").select("request_id", "event_id", "size", "left_before", "admitted", "reason")


# ---------------------------------------------------------------- event intake and sinks

def _date_sql(col: str) -> str:
    """DuckDB: the CAL-3 reading of a date text column as ``(y, m, d, date)``
    pieces; a year below 1600 is Jalali."""
    t = f"translate(trim({col}), '۰۱۲۳۴۵۶۷۸۹٫', '0123456789.')"
    norm = (f"CASE WHEN length({t}) - length(replace({t}, '/', '')) = 2 THEN {t} "
            f"WHEN length({t}) - length(replace({t}, '-', '')) = 2 THEN replace({t}, '-', '/') END")
    return f"string_split({norm}, '/')"


_HHMM, _YMD = f"'{HOUR_MINUTE}'", f"'{YEAR_MONTH_DAY}'"
_LAT, _LNG = f"'{LATITUDE}'", f"'{LONGITUDE}'"

# The rules of DQ-3 in the order of their reasons: reason, condition of a row that breaks it.
_EV_RULES = {
    "title_length": f"""NOT coalesce(length(title) BETWEEN 5 AND 150, false)""",
    "category": f"""cat_id IS NULL""",
    "start_date": f"""NOT coalesce(regexp_full_match(start_date, {_YMD}), false) OR sdate IS NULL""",
    "start_time": f"""NOT coalesce(regexp_full_match(start_time, {_HHMM}), false)""",
    "end_date": f"""NOT coalesce(regexp_full_match(end_date, {_YMD}), false) OR edate IS NULL""",
    "end_time": f"""NOT coalesce(regexp_full_match(end_time, {_HHMM}), false)""",
    "start_in_past": f"""coalesce(st_ < {NOW}, false)""",
    "end_before_start": f"""coalesce(et_ <= st_, false)""",
    "location_name": f"""NOT coalesce(regexp_full_match(location_name, '{PLACE_NAME}'), false)""",
    "address": f"""NOT coalesce(regexp_full_match(address, '{ADDRESS}'), false)""",
    "lat": f"""NOT coalesce(regexp_full_match(coordinate_lat, {_LAT}), false)""",
    "lng": f"""NOT coalesce(regexp_full_match(coordinate_lng, {_LNG}), false)""",
    "coordinate_address": f"""NOT coalesce(regexp_full_match(coordinate_address, '{ADDRESS}'), false)""",
    "description_length": f"""NOT coalesce(length(description) BETWEEN 20 AND 2000, false)""",
    "no_image": f"""thumbnail_id IS NULL""",
    "capacity": f"""NOT coalesce(cap_i BETWEEN 1 AND 65535, false)""",
    "grouping": f"""grp > 0 AND grp <> cap_i AND (grp > cap_i OR cap_i % greatest(grp, 1) <> 0)""",
    "price": f"""price IS NOT NULL AND price <> '' AND price <> '0' AND NOT coalesce(try_cast(price_digits AS bigint) > 0, false)""",
    "leader": f"""(CASE WHEN is_admin AND named_leader IS NOT NULL THEN named_leader ELSE own_leader END) IS NULL""",
}


def _ev_reasons(names) -> str:
    return "concat_ws(',', " + ",\n  ".join(f"CASE WHEN {_EV_RULES[n]} THEN '{n}' END" for n in names) + ")"


_EV_TIMES_SQL = f"""sp AS (SELECT s.*, {_date_sql('start_date')} AS sp_, {_date_sql('end_date')} AS ep_
       FROM d_event_submissions s),
sy AS (SELECT *, try_cast(sp_[1] AS int) AS sy_, try_cast(sp_[2] AS int) AS sm_,
              try_cast(sp_[3] AS int) AS sd_, try_cast(ep_[1] AS int) AS ey_,
              try_cast(ep_[2] AS int) AS em_, try_cast(ep_[3] AS int) AS ed_ FROM sp),
sdt AS (SELECT y.*,
          CASE WHEN sy_ < 1600 THEN {gregorian_duck('sy_', 'sm_', 'sd_')}
               ELSE cast(try_strptime(printf('%04d-%02d-%02d', y.sy_, y.sm_, y.sd_), '%Y-%m-%d') AS date) END AS sdate,
          CASE WHEN ey_ < 1600 THEN {gregorian_duck('ey_', 'em_', 'ed_')}
               ELSE cast(try_strptime(printf('%04d-%02d-%02d', y.ey_, y.em_, y.ed_), '%Y-%m-%d') AS date) END AS edate
        FROM sy y),
st AS (SELECT *,
          CASE WHEN regexp_full_match(start_time, {_HHMM})
               THEN try_strptime(cast(sdate AS varchar) || ' ' || start_time, '%Y-%m-%d %H:%M') END AS st_,
          CASE WHEN regexp_full_match(end_time, {_HHMM})
               THEN try_strptime(cast(edate AS varchar) || ' ' || end_time, '%Y-%m-%d %H:%M') END AS et_
        FROM sdt)"""

_EV_LINKS_SQL = """mu AS (SELECT sub_id, trim(unnest(string_split(media_ids, ','))) AS uuid,
              unnest(generate_series(1, len(string_split(media_ids, ',')))) AS pos
       FROM d_event_submissions),
th AS (SELECT mu.sub_id, arg_min(em.id, mu.pos) AS thumbnail_id FROM mu
       JOIN d_event_medias em ON em.uuid = mu.uuid WHERE em.type = 'image' GROUP BY mu.sub_id),
x AS (SELECT st.*, th.thumbnail_id, ec.id AS cat_id, u.role,
             ol.id AS own_leader, nl.id AS named_leader,
             CASE WHEN regexp_full_match(capacity, '\\s*(0|[1-9][0-9]*)\\s*') THEN try_cast(trim(capacity) AS bigint) END AS cap_i,
             coalesce(CASE WHEN regexp_full_match(grouping, '\\s*(0|[1-9][0-9]*)\\s*') THEN try_cast(trim(grouping) AS bigint) END, 0) AS grp,
             regexp_replace(coalesce(price, ''), '\\D', '', 'g') AS price_digits,
             coalesce(u.role = 'admin', false) AS is_admin
      FROM st LEFT JOIN th ON th.sub_id = st.sub_id
      LEFT JOIN d_event_categories ec ON ec.id = try_cast(st.category AS bigint)
      LEFT JOIN d_users u ON u.id = st.creator_id
      LEFT JOIN d_leaders ol ON ol.user_id = st.creator_id
      LEFT JOIN d_leaders nl ON nl.id = try_cast(st.leader AS bigint)),"""

_EV_CHECK_SQL = f"""
, {_EV_TIMES_SQL},
{_EV_LINKS_SQL}
v AS (SELECT *, CASE WHEN is_admin AND named_leader IS NOT NULL THEN named_leader ELSE own_leader END AS leader_id,
        {_ev_reasons(_EV_RULES)} AS reasons
      FROM x)"""

_EV_VIEWS = ["d_event_submissions", "d_event_categories", "d_event_medias", "d_leaders", "d_users"]


def _register_event_checks(name: str, views: list[str], rules: tuple, ctes: str, source: str) -> None:
    """DQ-3 by groups of rules: each submission with the reasons of one group."""
    def query(spark, sf_dir):
        from eventide.operators.quality import validate_events
        t = domain(spark, sf_dir)
        r = validate_events(t.event_submissions, t.event_categories, t.event_medias, t.leaders,
                            t.users, AS_OF, checked=True)
        mine = F.array(*[F.lit(x) for x in rules])
        return r.select("sub_id", F.array_join(F.array_intersect("reasons", mine), ",").alias("reasons"))

    register(name, views, f"{ctes}\nSELECT sub_id, {_ev_reasons(rules)} AS reasons FROM {source}")(query)


_register_event_checks("event_text_checks", ["d_event_submissions"], (
    "title_length", "location_name", "address", "lat", "lng", "coordinate_address", "description_length"),
    "", "d_event_submissions")
_register_event_checks("event_time_checks", ["d_event_submissions"], (
    "start_date", "start_time", "end_date", "end_time", "start_in_past", "end_before_start"),
    ", " + _EV_TIMES_SQL, "st")
_register_event_checks("event_link_checks", _EV_VIEWS, (
    "category", "no_image", "capacity", "grouping", "price", "leader"),
    ", st AS (SELECT * FROM d_event_submissions),\n" + _EV_LINKS_SQL.rstrip(","), "x")


@register("validate_events", _EV_VIEWS, _EV_CHECK_SQL + """
SELECT sub_id, reasons,
       CASE WHEN reasons = '' THEN thumbnail_id END AS thumbnail_id,
       CASE WHEN reasons = '' THEN CASE WHEN is_admin THEN 'verified' ELSE 'pending' END END AS status,
       CASE WHEN reasons = '' THEN leader_id END AS leader_id,
       CASE WHEN reasons = '' THEN cast(CASE WHEN grp = cap_i THEN 0 ELSE grp END AS integer) END AS grouping,
       CASE WHEN reasons = '' THEN st_ END AS start_time
FROM v""")
def q_validate_events(spark, sf_dir):
    from eventide.operators.quality import validate_events
    t = domain(spark, sf_dir)
    r = validate_events(t.event_submissions, t.event_categories, t.event_medias, t.leaders,
                        t.users, AS_OF, checked=True)
    ok = F.size("reasons") == 0
    return r.select("sub_id", F.array_join("reasons", ",").alias("reasons"),
                    *[F.when(ok, F.col(c)).alias(c) for c in
                      ("thumbnail_id", "status", "leader_id", "grouping", "start_time")])


@register("ingest_events", _EV_VIEWS + ["d_events"], _EV_CHECK_SQL + f"""
SELECT sub_id, title, description, cat_id AS category_id, st_ AS start_time, et_ AS end_time,
       location_name AS location, address, cast(coordinate_lat AS double) AS coordinates_lat,
       cast(coordinate_lng AS double) AS coordinates_lng, coordinate_address AS coordinates_address,
       coalesce(try_cast(price_digits AS bigint), 0) AS price, cast(cap_i AS integer) AS capacity,
       cast(CASE WHEN grp = cap_i THEN 0 ELSE grp END AS integer) AS grouping, creator_id, leader_id,
       thumbnail_id, CASE WHEN is_admin THEN 'verified' ELSE 'pending' END AS status,
       coalesce(private, false) AS is_private, coalesce(approval, false) AS is_approval,
       (SELECT max(id) FROM d_events) + sub_id AS id, {NOW} AS created_at, cast(0 AS bigint) AS views,
       trim(lower(regexp_replace(
         regexp_replace(title, '[^a-zA-Z0-9\\s\\-_\\x{{0600}}-\\x{{06FF}}]', '', 'g')
         || coalesce(' ' || lpad(cast(jd AS varchar), 2, '0') || ' ' || {_MONTHS_DUCK}[jm]
                     || ' ' || cast(jy AS varchar), ''), '\\s+', '-', 'g')), '-') AS slug
FROM {jalali_duck('v', 'cast(st_ AS date)')} WHERE reasons = ''""")
@register("ingest_events")
def q_ingest_events(spark, sf_dir):
    from eventide.operators.quality import ingest_events, validate_events
    t = domain(spark, sf_dir)
    ok, _ = validate_events(t.event_submissions, t.event_categories, t.event_medias, t.leaders,
                            t.users, AS_OF)
    new_events, _ = ingest_events(ok, t.events, t.event_medias, AS_OF)
    return flat(new_events)


@register("delete_medias", ["d_event_medias", "d_part_keys"], """
SELECT m.* FROM d_event_medias m
WHERE NOT EXISTS (SELECT 1 FROM d_part_keys k WHERE k.uuid = m.uuid AND k.uploader_id = m.uploader_id)""")
def q_delete_medias(spark, sf_dir):
    from eventide.sources.sinks import delete_keys
    t = domain(spark, sf_dir)
    return delete_keys(t.event_medias, t.part_keys)


@register("cascade_messages", ["d_messages"], """
, gone0 AS (SELECT id FROM d_messages WHERE conversation_id % 7 = 0 OR sender_id % 11 = 0),
gone(id) AS (SELECT id FROM gone0
             UNION SELECT m.id FROM d_messages m JOIN gone g ON m.reply_to = g.id)
SELECT * FROM d_messages WHERE id NOT IN (SELECT id FROM gone)""", recursive=True)
def q_cascade_messages(spark, sf_dir):
    from eventide.sources.sinks import cascade_delete
    t = domain(spark, sf_dir)
    convs = t.conversations.filter(F.col("id") % 7 == 0).select("id")
    users = t.users.filter(F.col("id") % 11 == 0).select("id")
    return cascade_delete(t.messages, removed_conversations=convs, removed_users=users)


@register("reservation_codes", ["d_reservations"], """
SELECT id, price, 'RES_' || lpad(cast((id * 7368787 + 104729) % 1000000000000 AS varchar), 12, '0') AS code,
       CASE WHEN price > 0 THEN 'A' ELSE 'F' END || lpad(md5(cast(id AS varchar)), 35, '0') AS authority
FROM d_reservations""")
def q_reservation_codes(spark, sf_dir):
    from eventide.sources.sinks import assign_codes, authority_code
    r = domain(spark, sf_dir).reservations.select("id", "price")
    return (assign_codes(r, "id")
            .withColumn("authority", authority_code(F.col("price"), F.col("id"))))


@register("calendar_days", ["d_reservations"], f"""
, days AS (SELECT DISTINCT cast(created_at AS date) AS date FROM d_reservations),
w AS (SELECT *, cast((dayofweek(date) + 1) % 7 AS integer) AS weekday FROM days),
c AS (SELECT * FROM {jalali_duck('w', 'date')}),
t AS (SELECT date, doy, jy FROM {jalali_duck('w', '(date + cast(3 - weekday AS integer))')})
SELECT cast(c.date AS varchar) AS date, c.jy, c.jm, c.jd, {_MONTHS_DUCK}[c.jm] AS month_name,
       {_duck_list("MONTH_SHORT")}[c.jm] AS month_short,
       cast(floor(c.jm / 3.1) + 1 AS int) AS season,
       {_duck_list("SEASON_NAMES")}[cast(floor(c.jm / 3.1) AS int) + 1] AS season_name,
       c.weekday, {_duck_list("WEEKDAY_NAMES")}[c.weekday + 1] AS weekday_name, c.leap,
       CASE WHEN c.jm = 12 THEN 29 + cast(c.leap AS int) ELSE 31 - cast(floor(c.jm / 6.5) AS int) END
         AS month_len,
       c.doy AS day_of_year, cast(cast(c.leap AS int) + 364 - c.doy AS integer) AS days_left,
       cast(t.doy // 7 + 1 AS integer) AS week, t.jy AS week_year,
       floor(c.doy / (cast(c.leap AS int) + 365.24) * 1000) / 10 AS percent_passed,
       {_duck_list("ZODIAC_NAMES")}[c.jm] AS zodiac,
       {_duck_list("YEAR_ANIMALS")}[c.jy % 12 + 1] AS year_animal,
       translate(cast(c.jy AS varchar) || '/' || cast(c.jm AS varchar) || '/' || cast(c.jd AS varchar),
                 '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS text_fa
FROM c JOIN t ON t.date = c.date""")
def q_calendar_days(spark, sf_dir):
    t = domain(spark, sf_dir)
    days = t.reservations.select(F.col("created_at").cast("date").alias("date")).distinct()
    from eventide.functions.calendar import with_calendar
    return (with_calendar(days)
            .select(F.col("date").cast("string").alias("date"), "jy", "jm", "jd", "month_name",
                    "month_short", "season", "season_name", "weekday", "weekday_name", "leap",
                    "month_len", "day_of_year", "days_left", "week", "week_year",
                    "percent_passed", "zodiac", "year_animal", "text_fa"))


OTP_AS_OF_EPOCH = 1705320000  # 2024-01-15 12:00:00 UTC, inside the code data's month


@register("verified_phones", ["d_otp_issued", "d_otp_attempt"], f"""
, cand AS (SELECT a.id AS attempt_id, a.phone, a.attempted_at, i.id AS otp_id, i.expires_at
           FROM d_otp_attempt a JOIN d_otp_issued i
             ON a.phone = i.phone AND a.code = i.code AND a.user_ip = i.user_ip
            AND i.created_at <= a.attempted_at),
best AS (SELECT attempt_id, phone, attempted_at, arg_max(otp_id, (expires_at, otp_id)) AS otp_id,
                max(expires_at) AS expires_at FROM cand GROUP BY attempt_id, phone, attempted_at),
used AS (SELECT DISTINCT otp_id, phone, expires_at FROM best
         WHERE floor(epoch(attempted_at)) < expires_at),
latest AS (SELECT phone, arg_max(otp_id, (expires_at, otp_id)) AS otp_id, max(expires_at) AS expires_at
           FROM used GROUP BY phone)
SELECT phone, otp_id, expires_at, {OTP_AS_OF_EPOCH} - expires_at < 60 AS verified FROM latest""")
def q_verified_phones(spark, sf_dir):
    from eventide.plans.commerce import otp_match
    from eventide.streaming.jobs import verified_phones
    t = domain(spark, sf_dir)
    m = otp_match(t.otp_issued, t.otp_attempt)
    used = (m.filter(F.col("status").isin("ok", "reused"))
            .select("otp_id", "phone", "expires_at").distinct())
    return verified_phones(used, OTP_AS_OF_EPOCH)


# ---------------------------------------------------------------- snapshots, filters and checks

_SETTLED_SQL = """
, tx1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY id) AS rn
                         FROM d_transactions) WHERE rn = 1),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY authority ORDER BY confirmed_at, conf_id)
                      AS rn FROM d_confirmations) WHERE rn = 1),
done AS (SELECT t.id AS tx_id, t.reservation_id, c.confirmed_at, e.is_approval
         FROM c1 c JOIN tx1 t ON c.authority = t.authority
         LEFT JOIN d_reservations r ON t.reservation_id = r.id LEFT JOIN d_events e ON r.event_id = e.id
         WHERE t.status <> 'paid')"""
_SETTLED_VIEWS = ["d_confirmations", "d_transactions", "d_reservations", "d_events"]


_SETTLED_TRANSACTIONS = _SETTLED_SQL + """
SELECT t.id, t.reservation_id, t.type, t.amount,
       CASE WHEN d.tx_id IS NOT NULL THEN 'paid' ELSE t.status END AS status, t.authority, t.card_hash,
       t.card_pan, CASE WHEN d.tx_id IS NOT NULL THEN 100000000000 + t.id ELSE t.ref_id END AS ref_id,
       t.created_at, coalesce(d.confirmed_at, t.updated_at) AS updated_at,
       coalesce(d.confirmed_at, t.paid_at) AS paid_at
FROM d_transactions t LEFT JOIN done d ON d.tx_id = t.id"""


@register("settled_transactions", _SETTLED_VIEWS, _SETTLED_TRANSACTIONS)
def q_settled_transactions(spark, sf_dir):
    from eventide.plans.commerce import settle_batch
    t = domain(spark, sf_dir)
    return settle_batch(t, t.confirmations)[1]


@register("merged_transactions", _SETTLED_VIEWS, _SETTLED_TRANSACTIONS)
def q_merged_transactions(spark, sf_dir):
    from eventide.plans.commerce import settle_batch
    from eventide.sources.sinks import merge_buckets, read_buckets, write_buckets
    from eventide.streaming.jobs import scratch_dir
    t = domain(spark, sf_dir)
    path = scratch_dir(spark, "transactions")
    write_buckets(t.transactions, path, "id", 64)
    done = settle_batch(t, t.confirmations)[0].filter("verdict = 'settled'")
    at = F.col("confirmed_at")
    updates = done.select(F.col("transaction_id").alias("id"), F.lit("paid").alias("status"), "ref_id",
                          at.alias("paid_at"), at.alias("updated_at"))
    merge_buckets(spark, path, updates, "id", "updated_at", 64)
    out = read_buckets(spark, path)
    return t.transactions if out is None else out


@register("settled_reservations", _SETTLED_VIEWS, _SETTLED_SQL + """
, last AS (SELECT reservation_id, arg_max(CASE WHEN is_approval THEN 'need-approval' ELSE 'paid' END,
                                          confirmed_at) AS status, max(confirmed_at) AS at
           FROM done WHERE reservation_id IS NOT NULL GROUP BY reservation_id)
SELECT r.id, r.event_id, r.user_id, r.code, r.discount_code_id, r.price, r.find_buddy,
       coalesce(l.status, r.status) AS status, r.created_at, coalesce(l.at, r.updated_at) AS updated_at,
       r.group_members
FROM d_reservations r LEFT JOIN last l ON l.reservation_id = r.id""")
def q_settled_reservations(spark, sf_dir):
    from eventide.plans.commerce import settle_batch
    t = domain(spark, sf_dir)
    return settle_batch(t, t.confirmations)[2]


@register("ingest_medias", _EV_VIEWS + ["d_events"], _EV_CHECK_SQL + """
, links AS (SELECT m.id, max((SELECT max(id) FROM d_events) + v.sub_id) AS event_id
            FROM (SELECT sub_id, trim(unnest(string_split(media_ids, ','))) AS uuid FROM v WHERE reasons = '') v
            JOIN d_event_medias m ON m.uuid = v.uuid GROUP BY m.id)
SELECT m.id, m.uuid, coalesce(l.event_id, m.event_id) AS event_id, m.type, m.url, m.created_at, m.uploader_id
FROM d_event_medias m LEFT JOIN links l ON l.id = m.id""")
def q_ingest_medias(spark, sf_dir):
    from eventide.operators.quality import ingest_events, validate_events
    t = domain(spark, sf_dir)
    ok, _ = validate_events(t.event_submissions, t.event_categories, t.event_medias, t.leaders,
                            t.users, AS_OF)
    return ingest_events(ok, t.events, t.event_medias, AS_OF)[1]


@register("event_catalog_filtered", _CATALOG_VIEWS, f"""
, {_LEADER_SQL.strip()}
SELECT e.id, e.title, e.location, ec.name AS category, e.start_time, e.grouping, e.price
FROM d_events e {_DECOR_JOINS}
WHERE e.status = 'verified' AND NOT e.is_private AND lower(e.location) LIKE '%econ%'
  AND e.category_id IN (0, 1, 3) AND e.grouping = 2
  AND ((hour(e.start_time) >= 6 AND hour(e.start_time) < 12)
       OR (hour(e.start_time) >= 14 AND hour(e.start_time) < 23))""")
def q_event_catalog_filtered(spark, sf_dir):
    from eventide.plans.catalog import event_catalog
    out = event_catalog(domain(spark, sf_dir), AS_OF, location="econ", categories="0,1,3", grouping=2,
                        hours="6-12,14-23")
    return flat(out).select("id", "title", "location", "category", "start_time", "grouping", "price")


_CATALOG_WHERE = "WHERE e.status = 'verified' AND NOT e.is_private"


@register("event_catalog_leader")
def q_event_catalog_leader(spark, sf_dir):
    """FLT-6: one leader's list, which keeps events of any status."""
    from eventide.plans.catalog import catalog_rank, event_catalog
    return flat(catalog_rank(event_catalog(domain(spark, sf_dir), AS_OF, leader_id=3, sort=False)))


ORACLES["event_catalog_leader"] = ORACLES["event_catalog"].replace(
    _CATALOG_WHERE, "WHERE NOT e.is_private AND e.leader_id = 3")


@register("event_catalog_day")
def q_event_catalog_day(spark, sf_dir):
    """FLT-4: the events of one day, given in the Jalali calendar."""
    from eventide.plans.catalog import catalog_rank, event_catalog
    return flat(catalog_rank(event_catalog(domain(spark, sf_dir), AS_OF, day="1374/03/08", sort=False)))


ORACLES["event_catalog_day"] = ORACLES["event_catalog"].replace(
    _CATALOG_WHERE, _CATALOG_WHERE + " AND cast(e.start_time AS date) = DATE '1995-05-29'")


@register("submission_thumbnails", ["d_event_submissions", "d_event_medias"], """
, mu AS (SELECT sub_id, trim(unnest(string_split(media_ids, ','))) AS uuid,
                unnest(generate_series(1, len(string_split(media_ids, ',')))) AS pos FROM d_event_submissions)
SELECT mu.sub_id, arg_min(em.id, mu.pos) AS thumbnail_id FROM mu
JOIN d_event_medias em ON em.uuid = mu.uuid WHERE em.type = 'image' GROUP BY mu.sub_id""")
def q_submission_thumbnails(spark, sf_dir):
    """WIN-6: the first image of each submission's media list."""
    from eventide.operators.windows import first_image
    t = domain(spark, sf_dir)
    lists = t.event_submissions.select("sub_id", F.transform(F.split("media_ids", ","), F.trim).alias("uuids"))
    medias = t.event_medias.select(F.col("uuid").alias("id"), "type")
    found = first_image(lists, medias, "uuids", "sub_id").withColumnRenamed("thumbnail_id", "uuid")
    return found.join(t.event_medias.select("uuid", F.col("id").alias("thumbnail_id")), "uuid").drop("uuid")


@register("contact_duplicates_otps", ["d_users", "d_otp_issued"], f"""
, c AS (SELECT 'u' || cast(id AS varchar) AS id, phone FROM d_users
        UNION ALL SELECT 'o' || cast(id AS varchar) AS id, phone FROM d_otp_issued)
SELECT phone_norm, id, n FROM (
  SELECT {_norm_phone_sql('phone')} AS phone_norm, id,
         count(*) OVER (PARTITION BY {_norm_phone_sql('phone')}) AS n FROM c)
WHERE n > 1""")
def q_contact_duplicates_otps(spark, sf_dir):
    """TXT-2 over users and one-time codes."""
    from eventide.functions.text import standardise_contacts
    t = domain(spark, sf_dir)
    return standardise_contacts(
        t.users.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"), "phone").unionByName(
            t.otp_issued.select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("id"), "phone")))


@register("open_chats", ["d_conversations", "d_participants", "d_reservations"], """
, m AS (SELECT p.conversation_id, cast(coalesce(sum(r.group_members), 0) AS bigint) AS members
        FROM d_participants p LEFT JOIN d_reservations r ON r.id = p.reservation_id GROUP BY p.conversation_id)
SELECT c.id AS conversation_id, c.conversation_size, coalesce(m.members, 0) AS members,
       c.conversation_size - coalesce(m.members, 0) AS room
FROM d_conversations c LEFT JOIN m ON m.conversation_id = c.id WHERE c.status = 'pending'""")
def q_open_chats(spark, sf_dir):
    from eventide.operators.stats import chat_members
    t = domain(spark, sf_dir)
    m = chat_members(t.participants, t.reservations)
    c = t.conversations.filter(F.col("status") == "pending").select(
        F.col("id").alias("conversation_id"), "conversation_size")
    members = F.coalesce("members", F.lit(0)).cast("long")
    return c.join(m, "conversation_id", "left").select(
        "conversation_id", "conversation_size", members.alias("members"),
        (F.col("conversation_size") - members).alias("room"))


@register("booking_users", ["d_booking_requests", "d_users"], """
SELECT request_id, user_id, user_id IN (SELECT id FROM d_users) AS known FROM d_booking_requests""")
def q_booking_users(spark, sf_dir):
    from eventide.operators.joins import split_by_presence
    t = domain(spark, sf_dir)
    users = t.users.select(F.col("id").alias("user_id"))
    known, unknown = split_by_presence(t.booking_requests.select("request_id", "user_id"), users, "user_id")
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False))).select(
        "request_id", "user_id", "known")


@register("live_otps", ["d_otp_issued", "d_otp_attempt"], f"""
, cand AS (SELECT a.id AS attempt_id, a.attempted_at, i.id AS otp_id, i.expires_at
           FROM d_otp_attempt a JOIN d_otp_issued i
             ON a.phone = i.phone AND a.code = i.code AND a.user_ip = i.user_ip
            AND i.created_at <= a.attempted_at),
best AS (SELECT attempt_id, attempted_at, arg_max(otp_id, (expires_at, otp_id)) AS otp_id,
                max(expires_at) AS expires_at FROM cand GROUP BY attempt_id, attempted_at),
used AS (SELECT DISTINCT otp_id FROM best WHERE floor(epoch(attempted_at)) < expires_at)
SELECT id, phone, page, expires_at FROM d_otp_issued
WHERE id NOT IN (SELECT otp_id FROM used) AND {OTP_AS_OF_EPOCH} < expires_at""")
def q_live_otps(spark, sf_dir):
    from eventide.functions.exprs import live_codes
    from eventide.plans.commerce import otp_match
    t = domain(spark, sf_dir)
    used = otp_match(t.otp_issued, t.otp_attempt).filter(F.col("status") == "ok").select(
        F.col("otp_id").alias("id"), F.lit(True).alias("is_used"))
    codes = t.otp_issued.join(used, "id", "left").withColumn("is_used", F.coalesce("is_used", F.lit(False)))
    return live_codes(codes, OTP_AS_OF_EPOCH).select("id", "phone", "page", "expires_at")


@register("group_member_rows", ["d_group_members"], """
SELECT reservation_id, first_name, last_name, national_id,
       concat_ws(',', CASE WHEN trim(coalesce(first_name, '')) = '' THEN 'first_name' END,
                      CASE WHEN trim(coalesce(last_name, '')) = '' THEN 'last_name' END) AS missing
FROM d_group_members""")
def q_group_member_rows(spark, sf_dir):
    from eventide.sources.sinks import explode_group_members
    # Stand-in input: reservations that arrive with their members as an array.
    requests = domain(spark, sf_dir).group_members.groupBy("reservation_id").agg(
        F.collect_list(F.struct("first_name", "last_name", "national_id")).alias("group_members_list"))
    ok, bad = explode_group_members(requests)
    return ok.withColumn("missing", F.lit("")).unionByName(
        bad.withColumn("missing", F.array_join("missing", ",")))
