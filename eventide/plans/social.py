"""Chat, memories and per-user lists (Q13-Q21).

The reference answers these with correlated subqueries (latest message,
"the other member LIMIT 1", like / comment counts). Here each becomes an
aggregate on its own key joined once: latest message per conversation is a
``max`` of a (time, id, payload) struct, the other member is taken from the
two lowest participants of the chat (never a pair list), and counts are
grouped by memory id before the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.exprs import (coalesce_text, full_name, full_url, minute_text, nested,
                                      ts_lit, unattached)
from eventide.operators.ranks import group_rank
from eventide.operators.stats import count_per, hashtags_per_memory
from eventide.operators.windows import first_per, latest_message


def two_lowest_members(participants: DataFrame) -> DataFrame:
    """WIN-2 helper: per chat, the lowest-id participant and the lowest-id
    participant whose user differs from the first one's user."""
    first = first_per(participants, "conversation_id", ["id"], ["id", "user_id"], prefix="first_")
    rest = (participants.join(first, "conversation_id")
            .filter(F.col("user_id") != F.col("first_user_id")))
    second = first_per(rest, "conversation_id", ["id"], ["id", "user_id"], prefix="second_")
    return first.join(second, "conversation_id", "left")


def other_member(participants: DataFrame, users: DataFrame) -> DataFrame:
    """WIN-2: for every (chat, user) the first other member by participant id;
    participants without a row in ``users`` are passed over."""
    known = participants.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    two = two_lowest_members(known)
    return (participants.select("conversation_id", "user_id").join(two, "conversation_id")
            .select("conversation_id", "user_id",
                    F.when(F.col("first_user_id") != F.col("user_id"), F.col("first_user_id"))
                    .otherwise(F.col("second_user_id")).alias("other_user_id")))


def inbox(t, as_of: str, users=None, rank: bool = False) -> DataFrame:
    """Q13: completed chats of each user with display name / avatar, the last
    message and its sender; live chats (expires_on >= as-of) rank first
    (``rank`` adds each chat's place in its user's list, ORD-4).

    Group chats show the chat name and the event's thumbnail *id* (as the
    reference does); pair chats show the other member's name and avatar.
    """
    parts = t.participants
    if users is not None:
        parts = parts.filter(F.col("user_id").isin(list(users)))
    conv = t.conversations.filter(F.col("status") == "completed")
    mine = parts.select("conversation_id", "user_id").join(
        conv.select(F.col("id").alias("conversation_id"), "is_group", "name", "event_id",
                    "expires_on"), "conversation_id")
    others = other_member(t.participants.join(
        conv.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi"), t.users)
    u = t.users.select(F.col("id").alias("other_user_id"),
                       full_name("first_name", "last_name").alias("other_name"),
                       F.col("avatar").alias("other_avatar"))
    thumbs = t.events.select(F.col("id").alias("event_id"), "thumbnail_id")
    last = latest_message(t.messages)
    senders = t.users.select(F.col("id").alias("last_sender_id"),
                             full_name("first_name", "last_name").alias("last_sender_name"))
    now = ts_lit(as_of)
    # JN-10 (correlated "other member" / thumbnail lookups, decorrelated) and
    # JN-9 (join on the latest message of the chat, from WIN-1)
    out = (mine.join(others, ["conversation_id", "user_id"], "left")
            .join(u, "other_user_id", "left")
            .join(thumbs, "event_id", "left")
            .join(last, "conversation_id", "left")
            .join(senders, "last_sender_id", "left")
            .select("user_id", F.col("conversation_id").alias("id"),
                    F.when(F.col("is_group"), F.col("name")).otherwise(F.col("other_name"))
                    .alias("name"),
                    F.when(F.col("is_group"), F.col("thumbnail_id").cast("string"))
                    .otherwise(F.col("other_avatar")).alias("avatar"),
                    "is_group", "expires_on",
                    nested(text=F.col("last_text"), time=F.col("last_created_at"))
                    .alias("last_message"),
                    "last_sender_name",
                    F.when(F.col("expires_on") >= now, 0).otherwise(1).alias("live_rank")))
    return inbox_rank(out) if rank else out


def inbox_rank(df: DataFrame) -> DataFrame:
    """ORD-4 as a column ``order_rank`` per user: live chats first, then newest
    last message (chats without messages last), then chat id."""
    return group_rank(df, ["user_id"], ["live_rank", F.col("last_message.time").desc_nulls_last(), "id"],
                      "order_rank")


def thread(t, viewer: int, conversations=None, sort: bool = False, rank: bool = False) -> DataFrame:
    """Q14: the messages of each chat as seen by ``viewer``: is_self, sender
    object (avatar only in group chats), and the replied message or NULL.
    ``rank`` adds the message's place in its chat as ``order_rank``."""
    m = t.messages
    if conversations is not None:
        m = m.filter(F.col("conversation_id").isin(list(conversations)))
    r = t.messages.select(F.col("id").alias("reply_to"), F.col("id").alias("r_id"),
                          F.col("sender_id").alias("r_sender_id"), F.col("text").alias("r_text"))
    c = t.conversations.select(F.col("id").alias("conversation_id"), "expires_on", "is_group")
    ur = t.users.select(F.col("id").alias("r_sender_id"),
                        full_name("first_name", "last_name").alias("r_sender"))
    us = t.users.select(F.col("id").alias("sender_id"),
                        full_name("first_name", "last_name").alias("s_name"),
                        F.col("avatar").alias("s_avatar"))
    # JN-8: aliased self left join of a message to the message it replies to
    out = (m.join(r, "reply_to", "left").join(c, "conversation_id", "left")
           .join(ur, "r_sender_id", "left").join(us, "sender_id", "left"))
    out = out.select(
        "id", "conversation_id", "expires_on", "text", minute_text("created_at").alias("time"),
        (F.col("sender_id") == F.lit(viewer)).alias("is_self"),
        nested(name=F.col("s_name"),
               avatar=F.when(F.col("is_group"), F.col("s_avatar"))).alias("sender"),
        F.when(F.col("reply_to").isNotNull(),
               nested(id=F.col("r_id"), sender=F.col("r_sender"), text=F.col("r_text")))
        .alias("reply_to"))
    # ORD-5: messages in id order within each chat
    if rank:
        return group_rank(out, ["conversation_id"], ["id"], "order_rank")
    return out.orderBy("conversation_id", "id") if sort else out


def memories_feed(t, viewer: int, uuids=None, sort: bool = False) -> DataFrame:
    """Q15: published memories with event and user objects, like / comment
    counts, distinct hashtags and the viewer's liked / saved / following flags.

    Counts are aggregated per memory before the join; viewer flags are
    semi-filtered scans of the viewer's own rows. ``is_following`` tests the
    memory author's *user* id as leader id, as the reference does. A user
    with a NULL last name keeps the user object with a NULL name (the
    reference builds the object by text concatenation, which loses it whole).
    """
    mem = t.memories.filter(F.col("status") == "published")
    if uuids is not None:
        mem = mem.filter(F.col("uuid").isin(list(uuids)))
    u = t.users.select(F.col("id").alias("user_id"),
                       full_name("first_name", "last_name").alias("u_name"),
                       F.coalesce("avatar", F.lit("")).alias("u_avatar"))
    ev = t.events.select(F.col("id").alias("event_id"), F.col("title").alias("e_title"),
                         F.col("slug").alias("e_slug"), F.col("location").alias("e_location"),
                         F.col("start_time").alias("e_start"))
    mm = t.memory_medias.select(F.col("id").alias("thumbnail_id"), F.col("url").alias("thumb"))
    # JN-11: correlated count subqueries as per-memory counts joined once
    likes = count_per(t.memory_likes, "memory_id", "like_count", "id")
    comments = count_per(t.memory_comments, "memory_id", "comment_count", "id")
    tags = hashtags_per_memory(t.memory_hashtags).withColumnRenamed("memory_id", "id")
    # JN-12: existence flags from the viewer's distinct keys + left join
    liked = (t.memory_likes.filter(F.col("user_id") == viewer)
             .select(F.col("memory_id").alias("id")).distinct().withColumn("is_liked", F.lit(True)))
    saved = (t.memories_saved.filter(F.col("user_id") == viewer)
             .select(F.col("memory_id").alias("id")).distinct().withColumn("is_saved", F.lit(True)))
    follows = (t.leader_followers.filter(F.col("follower_id") == viewer)
               .select(F.col("leader_id").alias("user_id")).distinct()
               .withColumn("is_following", F.lit(True)))
    out = (mem.join(u, "user_id").join(ev, "event_id", "left").join(mm, "thumbnail_id", "left")
           .join(likes, "id", "left").join(comments, "id", "left").join(tags, "id", "left")
           .join(liked, "id", "left").join(saved, "id", "left").join(follows, "user_id", "left"))
    blank = F.lit("")  # SC-1: IFNULL(x, '') of the reference
    out = out.select(
        "id", "uuid",
        nested(name=coalesce_text("e_title"), slug=coalesce_text("e_slug"),
               location=coalesce_text("e_location"),
               start_time=coalesce_text(minute_text("e_start"))).alias("event"),
        nested(id=F.col("user_id"), name=F.col("u_name"), avatar=F.col("u_avatar")).alias("user"),
        "caption", full_url("thumb").alias("thumbnail"),
        minute_text("created_at").alias("created_at"),
        F.coalesce("like_count", F.lit(0)).alias("like_count"),
        F.coalesce("comment_count", F.lit(0)).alias("comment_count"),
        F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"),
        F.coalesce("is_liked", F.lit(False)).alias("is_liked"),
        F.coalesce("is_saved", F.lit(False)).alias("is_saved"),
        F.coalesce("is_following", F.lit(False)).alias("is_following"),
        F.col("created_at").alias("created_ts"))
    # ORD-5: newest first
    return out.orderBy(F.col("created_ts").desc(), F.col("id").desc()) if sort else out


def memory_medias(t, uuids=None, sort: bool = False) -> DataFrame:
    """Q16: media of published memories (ORD-5: in media id order when
    ``sort``)."""
    mem = t.memories.filter(F.col("status") == "published")
    if uuids is not None:
        mem = mem.filter(F.col("uuid").isin(list(uuids)))
    out = (mem.select(F.col("id").alias("memory_id"), "uuid")
           .join(t.memory_medias.select(F.col("id").alias("media_id"), "memory_id", "type",
                                         "url"), "memory_id")
            .select("memory_id", "uuid", "media_id", "type", full_url("url").alias("url")))
    return out.orderBy("memory_id", "media_id") if sort else out


def stories(t, sort: bool = False) -> DataFrame:
    """Q17: published memories with category and user object (newest first
    when ``sort``)."""
    mem = t.memories.filter(F.col("status") == "published")
    ev = t.events.select(F.col("id").alias("event_id"), "category_id")
    cats = t.event_categories.select(F.col("id").alias("category_id"),
                                     F.col("name").alias("category"))
    u = t.users.select(F.col("id").alias("user_id"), "first_name", "last_name", "avatar")
    out = (mem.join(ev, "event_id", "left").join(cats, "category_id", "left")
           .join(u, "user_id", "left")
           .select("id", "caption", "created_at", "category_id", "category",
                   nested(id=F.col("user_id"), name=full_name("first_name", "last_name"),
                          avatar=F.col("avatar")).alias("user")))
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc()) if sort else out


def temp_medias(t, uploaders=None) -> DataFrame:
    """Q18: media not yet attached to an event, per uploader."""
    m = unattached(t.event_medias)
    if uploaders is not None:
        m = m.filter(F.col("uploader_id").isin(list(uploaders)))
    return m.select("uploader_id", F.col("uuid").alias("id"), "url", "type")


def user_notifications(t, users=None) -> DataFrame:
    """Q19: notification rows per user (SRC-2 full-row scan)."""
    n = t.notifications
    return n if users is None else n.filter(F.col("user_id").isin(list(users)))


def user_tickets(t, users=None) -> DataFrame:
    """Q20: support ticket rows per user (SRC-2 full-row scan)."""
    s = t.support_tickets
    return s if users is None else s.filter(F.col("user_id").isin(list(users)))


REPORT_TARGETS = ["user", "conversation", "message", "event", "leader", "memory"]


def report_targets(t) -> tuple[DataFrame, DataFrame]:
    """Q21 / DQ-4: reports unpivoted to one row per named target, and the
    reports naming none (the reference refuses those)."""
    rep = t.reports
    cols = [f"reported_{k}_id" for k in REPORT_TARGETS]
    stack = "stack({n}, {body}) AS (target_kind, target_id)".format(
        n=len(cols), body=", ".join(f"'{k}', {c}" for k, c in zip(REPORT_TARGETS, cols)))
    long = (rep.selectExpr("id", "reporter_id", "reason", "created_at", stack)
            .filter(F.col("target_id").isNotNull()))
    none = rep.filter(F.coalesce(*[F.col(c) for c in cols]).isNull())
    return long, none
