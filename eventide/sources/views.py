"""Domain tables of the marketplace, derived from the driver's parquet tables.

Each view is one SQL text that both Spark and DuckDB run: Spark through
``spark.sql(text, part=df, ...)`` and DuckDB as a CTE of the oracle query.
The texts only rename and re-shape columns into the marketplace schema
(FIXTURES section B); none of the library's work happens here.

Placeholders: ``{TS}`` is the timestamp type (``timestamp_ntz`` in Spark,
``timestamp`` in DuckDB), ``{EPOCH}`` the seconds-since-1970 function, and
``{table}`` a raw input table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eventide.sources.tables import load

# Fixed as-of time standing in for every NOW() of the reference.
AS_OF = "1998-06-01 00:00:00"

_BASE = "cast('1995-01-01 00:00:00' as {TS})"

VIEWS: dict[str, str] = {
    "d_users": """
SELECT c_custkey AS id,
       lower(replace(c_name, '#', '_')) AS username,
       split_part(c_name, '#', 1) AS first_name,
       CASE WHEN c_custkey % 97 = 13 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
       CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
       '09' || lpad(cast(c_custkey AS string), 9, '0') AS phone,
       lpad(cast(c_custkey * 7 + 1 AS string), 10, '0') AS national_id,
       cast(cast('1960-01-01 00:00:00' as {TS}) + interval '1' day * cast(c_custkey * 13 % 15000 AS int) AS date) AS birth_date,
       CASE WHEN c_custkey = 0 THEN 'admin' ELSE 'user' END AS role,
       c_custkey % 50 <> 49 AS is_active,
       cast('1990-01-01 00:00:00' as {TS}) + interval '1' day * cast(c_custkey % 3000 AS int) AS registered_at,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'avatars/u' || cast(c_custkey AS string) || '.jpg' END AS avatar
FROM {customer}""",
    "d_leaders": """
SELECT s_suppkey AS id,
       s_suppkey + 7 AS user_id,
       s_name AS bio,
       CASE WHEN s_suppkey % 11 = 0
            THEN '["' || cast(s_nationkey % 5 AS string) || '",' || cast((s_nationkey + 2) % 5 AS string) || ']'
            ELSE '[' || cast(s_nationkey % 5 AS string) || ',' || cast((s_nationkey + 2) % 5 AS string) || ']'
       END AS categories_id,
       cast('1994-06-01 00:00:00' as {TS}) + interval '1' day * cast(s_suppkey % 1000 AS int) AS registered_at
FROM {supplier}""",
    "d_event_categories": """
SELECT cast(r_regionkey AS bigint) AS id, r_name AS name FROM {region}""",
    "d_events": """
SELECT id, title, description, slug, category_id, start_time,
       CASE WHEN id % 4 = 0 THEN NULL ELSE start_time + interval '3' hour END AS end_time,
       location, address, lat, lng, price, capacity, grouping, creator_id, leader_id,
       thumbnail_id, views, status, is_private, is_approval,
       start_time - interval '30' day AS created_at
FROM (
  SELECT p_partkey AS id,
         p_name AS title,
         'A ' || lower(p_type) || ' ' || p_name || ' meetup hosted with ' || p_brand AS description,
         replace(p_name, ' ', '-') || '-' || cast(p_partkey AS string) AS slug,
         p_partkey % 5 AS category_id,
         """ + _BASE + """ + interval '1' day * cast(p_partkey * 37 % 2400 AS int)
              + interval '1' hour * cast(p_size % 24 AS int) AS start_time,
         p_type AS location,
         p_brand || ' street ' || cast(p_size AS string) AS address,
         35.0 + cast(p_partkey % 100 AS double) / 100 AS lat,
         51.0 + cast(p_size AS double) / 100 AS lng,
         cast(round(p_retailprice) AS bigint) AS price,
         cast(p_size % 30 + 5 AS int) AS capacity,
         cast(p_partkey % 4 AS int) AS grouping,
         p_partkey % (SELECT count(*) FROM {supplier}) + 7 AS creator_id,
         p_partkey % (SELECT count(*) FROM {supplier}) AS leader_id,
         p_partkey * 2 AS thumbnail_id,
         cast(p_size * p_partkey % 1000 AS bigint) AS views,
         CASE p_partkey % 13 WHEN 1 THEN 'pending' WHEN 2 THEN 'deleted' WHEN 3 THEN 'reported'
              ELSE 'verified' END AS status,
         p_partkey % 7 = 0 AS is_private,
         p_partkey % 3 = 0 AS is_approval
  FROM {part}) p""",
    "d_event_medias": """
SELECT p_partkey * 2 AS id, 'media-' || cast(p_partkey * 2 AS string) AS uuid, p_partkey AS event_id,
       'image' AS type, 'events/' || cast(p_partkey AS string) || '/cover.jpg' AS url,
       """ + _BASE + """ + interval '1' day * cast(p_partkey % 900 AS int) AS created_at,
       p_partkey % (SELECT count(*) FROM {supplier}) + 7 AS uploader_id
FROM {part}
UNION ALL
SELECT p_partkey * 2 + 1 AS id, 'media-' || cast(p_partkey * 2 + 1 AS string) AS uuid,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS event_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'video' ELSE 'image' END AS type,
       'events/' || cast(p_partkey AS string) || '/extra.bin' AS url,
       """ + _BASE + """ + interval '1' day * cast(p_partkey % 900 AS int) + interval '1' minute AS created_at,
       p_partkey % (SELECT count(*) FROM {supplier}) + 7 AS uploader_id
FROM {part}""",
    "d_reservations": """
SELECT o_orderkey AS id,
       cast(floor(o_orderkey * 2 / 15) AS bigint) AS event_id,
       o_custkey AS user_id,
       'RES_' || cast(o_orderkey AS string) AS code,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 26 ELSE NULL END AS discount_code_id,
       cast(round(o_totalprice / 100) AS bigint) AS price,
       o_orderkey % 4 = 1 AS find_buddy,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending-pay'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'canceled' ELSE 'need-approval' END END AS status,
       cast(o_orderdate AS {TS}) AS created_at,
       cast(o_orderdate AS {TS}) + interval '1' day AS updated_at,
       cast(o_orderkey % 5 + 1 AS int) AS group_members
FROM {orders}""",
    "d_transactions": """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 50 = 49 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS reservation_id,
       'payment' AS type,
       cast(round(o_totalprice / 100) AS bigint) AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'canceled' END AS status,
       'A' || lpad(cast(o_orderkey AS string), 35, '0') AS authority,
       CASE WHEN o_orderstatus = 'F' THEN md5('card-' || cast(o_custkey AS string)) END AS card_hash,
       CASE WHEN o_orderstatus = 'F' THEN '603799******' || lpad(cast(o_custkey % 10000 AS string), 4, '0') END AS card_pan,
       CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 1000 + 7 END AS ref_id,
       cast(o_orderdate AS {TS}) AS created_at,
       cast(o_orderdate AS {TS}) + interval '1' day AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS {TS}) + interval '2' hour END AS paid_at
FROM {orders}""",
    "d_ratings": """
SELECT l_orderkey * 10 + l_linenumber AS id,
       l_orderkey AS from_user_id,
       l_suppkey + 7 AS to_user_id,
       l_orderkey % 100 AS conversation_id,
       cast((l_linenumber - 1) % 5 + 1 AS int) AS score,
       l_returnflag || l_linestatus AS comment,
       cast(l_shipdate AS {TS}) AS created_at
FROM {lineitem}""",
    "d_leader_followers": """
SELECT leader_id, follower_id, leader_id * 10000000000 + follower_id AS id
FROM (SELECT DISTINCT l_suppkey AS leader_id, o_custkey AS follower_id
      FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) f""",
    "d_discount_codes": """
SELECT cast(n_nationkey + 1 AS bigint) AS id,
       'CODE' || cast(n_nationkey % 20 AS string) AS code,
       CASE WHEN n_nationkey % 4 = 1 THEN cast(n_nationkey * 7 AS bigint) END AS event_id,
       CASE WHEN n_nationkey % 4 = 2 THEN cast(n_regionkey AS bigint) END AS category_id,
       CASE WHEN n_nationkey % 4 = 3 THEN cast(n_nationkey % (SELECT count(*) FROM {supplier}) AS bigint) END AS leader_id,
       cast(CASE n_nationkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 50 ELSE 10 END AS int)
           AS discount_percent,
       cast(CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 100 * (n_nationkey + 1) END AS bigint) AS discount_max,
       cast(50 * (n_nationkey % 7) AS bigint) AS discount_constant,
       cast(CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE n_nationkey * 20 END AS int) AS capacity,
       cast(0 AS bigint) AS creator_id,
       CASE WHEN n_nationkey % 6 = 5 THEN cast('1998-01-01 00:00:00' as {TS})
            ELSE cast('2002-01-01 00:00:00' as {TS}) END AS expires_on,
       """ + _BASE + """ AS created_at
FROM {nation}""",
    "d_conversations": """
SELECT conv_id AS id,
       conv_id % 2 = 1 AS is_group,
       CASE WHEN conv_id % 2 = 1 THEN 'Group ' || cast(conv_id AS string) END AS name,
       conv_id * 7 % (SELECT count(*) FROM {part}) AS event_id,
       cast(CASE WHEN conv_id % 2 = 1 THEN 4 ELSE 2 END AS int) AS conversation_size,
       CASE WHEN conv_id % 5 = 0 THEN 'pending' ELSE 'completed' END AS status,
       cast('1998-05-01 00:00:00' as {TS}) + interval '1' day * cast(conv_id % 60 AS int) AS expires_on,
       cast('1998-04-01 00:00:00' as {TS}) + interval '1' hour * cast(conv_id % 500 AS int) AS created_at
FROM (SELECT DISTINCT conv_id FROM {conversations}) c""",
    "d_participants": """
SELECT conv_id * 10 + k AS id, conv_id AS conversation_id, (conv_id * 3 + k) % (SELECT count(*) FROM {customer}) AS user_id,
       conv_id * 10 + k AS reservation_id,
       cast('1998-04-01 00:00:00' as {TS}) + interval '1' hour * cast(conv_id % 500 AS int) AS joined_at
FROM (SELECT DISTINCT conv_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS k FROM {conversations}
      UNION ALL
      SELECT DISTINCT conv_id, 2 AS k FROM {conversations} WHERE conv_id % 2 = 1) p""",
    "d_messages": """
SELECT conv_id * 1000000 + turn AS id,
       conv_id AS conversation_id,
       (conv_id * 3 + CASE WHEN role = 'user' THEN 0 ELSE 1 END) % (SELECT count(*) FROM {customer}) AS sender_id,
       text,
       CASE WHEN turn % 3 = 2 THEN conv_id * 1000000 + turn - 1 END AS reply_to,
       turn % 2 = 0 AS read,
       cast('1998-04-01 00:00:00' as {TS}) + interval '1' hour * cast(conv_id % 500 AS int)
         + interval '1' minute * cast(CASE WHEN turn = 3 THEN 2 ELSE turn END AS int) AS created_at
FROM {conversations}""",
    "d_memories": """
SELECT doc_id AS id,
       'mem-' || cast(doc_id AS string) AS uuid,
       doc_id % (SELECT count(*) FROM {customer}) AS user_id,
       doc_id % (SELECT count(*) FROM {part}) AS event_id,
       doc_id * 2 AS thumbnail_id,
       text AS caption,
       CASE WHEN doc_id % 8 = 7 THEN 'deleted' WHEN doc_id % 4 = 3 THEN 'pending' ELSE 'published' END AS status,
       cast('1998-01-01 00:00:00' as {TS}) + interval '1' hour * cast(doc_id % 200000 AS int) AS created_at,
       cast('1998-01-01 00:00:00' as {TS}) + interval '1' hour * cast(doc_id % 200000 AS int) + interval '5' minute AS updated_at
FROM {documents}""",
    "d_memory_medias": """
SELECT doc_id * 2 AS id, doc_id AS memory_id, 'image' AS type,
       'memories/' || cast(doc_id AS string) || '/0.jpg' AS url
FROM {documents}
UNION ALL
SELECT doc_id * 2 + 1 AS id, doc_id AS memory_id,
       CASE WHEN doc_id % 2 = 0 THEN 'video' ELSE 'image' END AS type,
       'memories/' || cast(doc_id AS string) || '/1.bin' AS url
FROM {documents}""",
    "d_memory_hashtags": """
SELECT doc_id AS memory_id, lang AS hashtag FROM {documents} WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id AS memory_id, source AS hashtag FROM {documents} WHERE doc_id % 7 <> 0
UNION ALL
SELECT doc_id AS memory_id, lang AS hashtag FROM {documents} WHERE doc_id % 10 = 1""",
    "d_memory_likes": """
SELECT DISTINCT event_id % (SELECT count(*) FROM {documents}) AS memory_id, user_id FROM {events} WHERE event_type = 'click'""",
    "d_memory_comments": """
SELECT event_id AS id, event_id % (SELECT count(*) FROM {documents}) AS memory_id, user_id, props AS comment, ts AS created_at
FROM {events} WHERE event_type = 'view'""",
    "d_memories_saved": """
SELECT DISTINCT event_id % (SELECT count(*) FROM {documents}) AS memory_id, user_id FROM {events} WHERE event_type = 'purchase'""",
    "d_notifications": """
SELECT event_id AS id,
       CASE WHEN event_id % 3 = 0 THEN event_id % (SELECT count(*) FROM {part}) END AS event_id,
       CASE WHEN event_id % 3 = 1 THEN event_id END AS reservation_id,
       cast(NULL AS bigint) AS pay_id,
       cast(NULL AS bigint) AS ticket_id,
       user_id,
       'notice ' || event_type AS title,
       coalesce(props, '') AS message,
       CASE event_id % 6 WHEN 0 THEN 'warning' WHEN 1 THEN 'stern-warning' WHEN 2 THEN 'ads'
            WHEN 3 THEN 'offer' WHEN 4 THEN 'notice' ELSE 'update' END AS type,
       value > 50 AS urgent,
       event_id % 2 = 0 AS read,
       ts AS created_at
FROM {events} WHERE event_type IN ('signup', 'purchase')""",
    "d_support_tickets": """
SELECT event_id AS id,
       event_id % (SELECT count(*) FROM {part}) AS event_id,
       user_id,
       'ticket ' || cast(event_id AS string) AS subject,
       lpad(cast(event_id % 100000 AS string), 6, '0') AS code,
       CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN ' answered' WHEN 2 THEN 'user-response'
            ELSE 'finished' END AS status,
       CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS priority,
       ts AS created_at,
       ts + interval '1' hour AS updated_at
FROM {events} WHERE event_type = 'error'""",
    "d_reports": """
SELECT o_orderkey AS id,
       o_custkey AS reporter_id,
       CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN (o_custkey + 1) % (SELECT count(*) FROM {customer}) END AS reported_user_id,
       CASE WHEN o_orderkey % 7 = 1 THEN o_orderkey % 100 END AS reported_conversation_id,
       CASE WHEN o_orderkey % 7 = 2 THEN (o_orderkey % 100) * 1000000 END AS reported_message_id,
       CASE WHEN o_orderkey % 7 = 3 THEN cast(floor(o_orderkey * 2 / 15) AS bigint) END AS reported_event_id,
       CASE WHEN o_orderkey % 7 = 4 THEN o_orderkey % (SELECT count(*) FROM {supplier}) END AS reported_leader_id,
       CASE WHEN o_orderkey % 7 = 5 THEN o_orderkey % (SELECT count(*) FROM {documents}) END AS reported_memory_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS reason,
       cast(o_orderdate AS {TS}) AS created_at
FROM {orders}""",
    "d_otp_issued": """
SELECT event_id AS id,
       '09' || lpad(cast(user_id AS string), 9, '0') AS phone,
       lpad(cast((user_id * 7919 + cast(floor({EPOCH}(ts) / 3600) AS bigint)) % 100000 AS string), 5, '0') AS code,
       cast(floor({EPOCH}(ts)) AS bigint) + 120 AS expires_at,
       CASE WHEN event_id % 3 = 0 THEN 'register' ELSE 'login' END AS page,
       '10.0.0.' || cast(user_id % 4 AS string) AS user_ip,
       ts AS created_at
FROM {events} WHERE event_type = 'signup'""",
    "d_otp_attempt": """
SELECT event_id * 10 + 1 AS id,
       '09' || lpad(cast(user_id AS string), 9, '0') AS phone,
       CASE WHEN event_id % 5 = 0 THEN '99999'
            ELSE lpad(cast((user_id * 7919 + cast(floor({EPOCH}(ts) / 3600) AS bigint)) % 100000 AS string), 5, '0')
       END AS code,
       CASE WHEN event_id % 7 = 0 THEN '10.9.9.9' ELSE '10.0.0.' || cast(user_id % 4 AS string) END AS user_ip,
       ts + interval '1' second * cast(event_id % 200 AS int) AS attempted_at
FROM {events} WHERE event_type = 'signup'
UNION ALL
SELECT event_id * 10 + 2 AS id,
       '09' || lpad(cast(user_id AS string), 9, '0') AS phone,
       lpad(cast((user_id * 7919 + cast(floor({EPOCH}(ts) / 3600) AS bigint)) % 100000 AS string), 5, '0') AS code,
       '10.0.0.' || cast(user_id % 4 AS string) AS user_ip,
       ts AS attempted_at
FROM {events} WHERE event_type = 'view'""",
    "d_code_requests": """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 29 = 0 THEN 'NOCODE' ELSE 'CODE' || cast(o_orderkey % 20 AS string) END AS code,
       cast(floor(o_orderkey * 2 / 15) AS bigint) AS event_id
FROM {orders}""",
    "d_confirmations": """
SELECT o_orderkey * 2 AS conf_id,
       CASE WHEN o_orderkey % 97 = 0 THEN 'A' || lpad('x' || cast(o_orderkey AS string), 35, '0')
            ELSE 'A' || lpad(cast(o_orderkey AS string), 35, '0') END AS authority,
       cast(o_orderdate AS {TS}) + interval '3' hour AS confirmed_at
FROM {orders}
UNION ALL
SELECT o_orderkey * 2 + 1 AS conf_id, 'A' || lpad(cast(o_orderkey AS string), 35, '0') AS authority,
       cast(o_orderdate AS {TS}) + interval '1' hour * cast(2 + o_orderkey % 3 AS int) AS confirmed_at
FROM {orders} WHERE o_orderkey % 10 = 1""",
    "d_booking_requests": """
SELECT event_id AS request_id,
       (user_id * 7 + event_id) % (SELECT count(*) FROM {part}) AS event_id,
       user_id,
       cast('1997-01-01 00:00:00' as {TS})
         + interval '1' second * cast(cast(floor({EPOCH}(ts)) AS bigint) - 1704067200 AS int) AS requested_at,
       cast(cast(floor(value) AS bigint) % 4 + 1 AS bigint) AS size,
       event_id % 3 = 0 AS find_buddy
FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "d_registrations": """
SELECT c_custkey AS row_id,
       CASE c_custkey % 4 WHEN 0 THEN 'علی' WHEN 1 THEN 'مریم' WHEN 2 THEN split_part(c_name, '#', 1)
            ELSE 'ر' END AS first_name,
       CASE c_custkey % 5 WHEN 0 THEN 'احمدی' WHEN 1 THEN 'کریمی' WHEN 2 THEN 'رضایی'
            WHEN 3 THEN 'Smith' ELSE 'محمدی نژاد' END AS last_name,
       CASE c_custkey % 6 WHEN 0 THEN '09' || lpad(cast(c_custkey % 50 AS string), 9, '0')
            WHEN 1 THEN '091' || lpad(cast(c_custkey + 500000 AS string), 8, '0')
            WHEN 2 THEN '9' || lpad(cast(c_custkey AS string), 9, '0')
            ELSE '092' || lpad(cast(c_custkey AS string), 8, '0') END AS phone,
       CASE c_custkey % 7 WHEN 0 THEN '1111111111'
            WHEN 1 THEN lpad(cast(c_custkey * 7 + 1 AS string), 10, '0')
            ELSE lpad(cast(c_custkey * 7919 % 1000000000 AS string), 9, '0')
                 || cast(c_custkey % 10 AS string) END AS national_id
FROM {customer}""",
    "d_group_members": """
SELECT l_orderkey * 10 + l_linenumber AS member_id,
       l_orderkey AS reservation_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE 'عضو' END AS first_name,
       CASE WHEN l_linenumber = 6 THEN '' ELSE 'گروه ' || cast(l_linenumber AS string) END AS last_name,
       CASE l_partkey % 4
            WHEN 0 THEN '13' || cast(60 + l_suppkey % 20 AS string) || '/'
                        || lpad(cast(l_partkey % 13 + 1 AS string), 2, '0') || '/'
                        || lpad(cast(l_suppkey % 31 + 1 AS string), 2, '0')
            WHEN 1 THEN cast(1970 + l_suppkey % 30 AS string) || '-'
                        || lpad(cast(l_partkey % 12 + 1 AS string), 2, '0') || '-'
                        || lpad(cast(l_orderkey % 28 + 1 AS string), 2, '0')
            WHEN 2 THEN translate('13' || cast(50 + l_orderkey % 40 AS string) || '/0'
                        || cast(l_linenumber AS string) || '/1' || cast(l_suppkey % 9 AS string),
                        '0123456789', '۰۱۲۳۴۵۶۷۸۹')
            ELSE '' END AS birth_date,
       lpad(cast(l_orderkey * 31 + l_linenumber AS string), 10, '0') AS national_id
FROM {lineitem}""",
    "d_event_submissions": """
SELECT p_partkey AS sub_id,
       CASE WHEN p_partkey % 17 = 0 THEN 0 WHEN p_partkey % 23 = 0 THEN 100 ELSE p_partkey % (SELECT count(*) FROM {supplier}) + 7 END
         AS creator_id,
       CASE WHEN p_partkey % 31 = 0 THEN 'abc' ELSE p_name END AS title,
       cast(p_partkey % 6 AS string) AS category,
       CASE WHEN p_partkey % 5 = 0
            THEN '13' || cast(78 + p_partkey % 2 AS string) || '/' || lpad(cast(p_partkey % 12 + 1 AS string), 2, '0')
                 || '/' || lpad(cast(p_partkey % 29 + 1 AS string), 2, '0')
            ELSE cast(1999 + p_partkey % 3 AS string) || '/' || lpad(cast(p_partkey % 12 + 1 AS string), 2, '0')
                 || '/' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0') END AS start_date,
       lpad(cast(p_size % 24 AS string), 2, '0') || ':30' AS start_time,
       CASE WHEN p_partkey % 5 = 0
            THEN '13' || cast(78 + p_partkey % 2 AS string) || '/' || lpad(cast(p_partkey % 12 + 1 AS string), 2, '0')
                 || '/' || lpad(cast(p_partkey % 29 + 1 AS string), 2, '0')
            ELSE cast(1999 + p_partkey % 3 AS string) || '/' || lpad(cast(p_partkey % 12 + 1 AS string), 2, '0')
                 || '/' || lpad(cast(p_partkey % 28 + 1 AS string), 2, '0') END AS end_date,
       cast(p_size % 24 + 2 AS string) || ':00' AS end_time,
       'سالن ' || cast(p_size AS string) AS location_name,
       'خیابان آزادی پلاک ' || cast(p_partkey AS string) AS address,
       CASE WHEN p_partkey % 19 = 0 THEN '95.5' ELSE cast(35 + p_partkey % 50 AS string) || '.123' END
         AS coordinate_lat,
       CASE WHEN p_partkey % 2 = 0 THEN '120.5' ELSE '51.4' END AS coordinate_lng,
       'خیابان آزادی پلاک ' || cast(p_partkey AS string) AS coordinate_address,
       p_name || ' ' || lower(p_type) || ' ' || p_brand AS description,
       CASE WHEN p_partkey % 9 = 0 THEN 'media-' || cast(p_partkey * 2 + 1 AS string)
            ELSE 'media-' || cast(p_partkey * 2 + 1 AS string) || ',media-' || cast(p_partkey * 2 AS string)
       END AS media_ids,
       cast(p_size % 30 + 5 AS string) AS capacity,
       cast(p_partkey % 4 AS string) AS grouping,
       cast(cast(round(p_retailprice) AS bigint) AS string) || ',000' AS price,
       p_partkey % 7 = 0 AS private,
       p_partkey % 3 = 0 AS approval,
       CASE WHEN p_partkey % 17 = 0 THEN cast(p_partkey % (SELECT count(*) FROM {supplier}) AS string) END AS leader
FROM {part}""",
    "d_part_keys": """
SELECT 'media-' || cast(p_partkey * 2 + 1 AS string) AS uuid, p_partkey % (SELECT count(*) FROM {supplier}) + 7 AS uploader_id
FROM {part} WHERE p_partkey % 5 = 0""",
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def raw_inputs(view: str) -> list[str]:
    return sorted({m for m in _PLACEHOLDER.findall(VIEWS[view]) if m not in ("TS", "EPOCH")})


def _dialect(text: str, engine: str) -> str:
    ts, epoch = ("timestamp_ntz", "unix_timestamp") if engine == "spark" else ("timestamp", "epoch")
    return text.replace("{TS}", ts).replace("{EPOCH}", epoch)


def duckdb_ctes(names: list[str], recursive: bool = False) -> str:
    """``WITH`` clause defining the given views for the DuckDB oracle."""
    parts = []
    for n in names:
        body = _dialect(VIEWS[n], "duckdb")
        body = _PLACEHOLDER.sub(lambda m: m.group(1), body)
        parts.append(f"{n} AS ({body.strip()})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


@dataclass
class Domain:
    """Lazily built domain DataFrames for one input folder."""

    spark: SparkSession
    sf_dir: str
    _raw: dict = field(default_factory=dict)
    _views: dict = field(default_factory=dict)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = load(self.spark, self.sf_dir, name)
        return self._raw[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            args = {r: self.raw(r) for r in raw_inputs(name)}
            self._views[name] = self.spark.sql(_dialect(VIEWS[name], "spark"), **args)
        return self._views[name]

    def __getattr__(self, item: str) -> DataFrame:
        if item.startswith("_"):
            raise AttributeError(item)
        key = "d_" + item
        if key in VIEWS:
            return self.view(key)
        raise AttributeError(item)


def domain(spark: SparkSession, sf_dir: str) -> Domain:
    """Domain tables for one input folder. Pins the session time zone to UTC
    (the wall-clock times of the data are zone-less) and makes sure a reliable
    checkpoint folder exists for the jobs that cut lineage."""
    from eventide.session import ensure_checkpoint_dir, ship_package
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return Domain(spark, sf_dir)
