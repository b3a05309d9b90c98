"""Second paths and properties of the composed jobs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.operators.folds import match_groups
from eventide.plans.catalog import similar_events
from eventide.plans.commerce import discount_amount, settle_batch
from eventide.sources.sinks import apply_updates, assign_codes, cascade_delete
from eventide.sources.views import AS_OF


def test_similar_at_most_three_never_self(t_small):
    df = similar_events(t_small, AS_OF)
    assert df.filter("source_id = " + "source_id").groupBy("source_id").count().filter(
        "count > 3").count() == 0
    assert df.join(t_small.events.select(F.col("id").alias("source_id"), F.col("slug").alias("s")),
                   "source_id").filter("slug = s").count() == 0


def test_similar_fallback_when_alone(spark):
    class T:
        pass
    t = T()
    base = dt.datetime(2000, 1, 1)
    t.events = spark.createDataFrame(
        [(1, 0, base, base - dt.timedelta(days=1), "a", "A", 10, 1),
         (2, 1, base, base - dt.timedelta(days=2), "b", "B", 20, 2),
         (3, 1, base, base - dt.timedelta(days=3), "c", "C", 30, 3)],
        "id long, category_id long, start_time timestamp_ntz, created_at timestamp_ntz, "
        "slug string, title string, price long, thumbnail_id long")
    t.event_medias = spark.createDataFrame([(1, "u1")], "id long, url string")
    t.event_categories = spark.createDataFrame([(0, "zero"), (1, "one")], "id long, name string")
    out = {(r.source_id, r.slug, r.is_fallback) for r in
           similar_events(t, "1999-01-01 00:00:00").collect()}
    # event 1 is alone in its category: it gets the global list minus itself
    assert (1, "b", True) in out and (1, "c", True) in out and (1, "a", True) not in out
    assert (2, "c", False) in out and (3, "b", False) in out


def test_discount_amount_rules(spark):
    row = spark.range(1).select(
        discount_amount(F.lit(1000), F.lit(50), F.lit(100), F.lit(0)).alias("capped"),
        discount_amount(F.lit(1000), F.lit(10), F.lit(0), F.lit(0)).alias("pct"),
        discount_amount(F.lit(1000), F.lit(0), F.lit(0), F.lit(1500)).alias("const")).first()
    assert float(row.capped) == 100 and float(row.pct) == 100 and float(row.const) == 1500


def test_settle_twice_is_settle_once(spark, t_small):
    conf = t_small.confirmations
    v1, tx1, res1 = settle_batch(t_small, conf)

    class T2:
        pass
    t2 = T2()
    t2.transactions, t2.reservations, t2.events = tx1, res1, t_small.events
    v2, tx2, _ = settle_batch(t2, conf)
    assert v1.filter("verdict = 'settled'").count() > 0
    assert v2.filter("verdict = 'settled'").count() == 0
    assert tx1.exceptAll(tx2).count() == 0


def test_apply_updates_latest_wins(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, s string, v long")
    upd = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1)], "id long, s string, at long")
    got = {r.id: (r.s, r.v) for r in apply_updates(base, upd, "id", "at").collect()}
    assert got == {1: ("y", 10), 2: ("b", 20)}


def test_cascade_delete_follows_replies(spark):
    msgs = spark.createDataFrame(
        [(1, 10, 100, None), (2, 10, 101, 1), (3, 10, 102, 2), (4, 11, 100, None), (5, 11, 103, 4)],
        "id long, conversation_id long, sender_id long, reply_to long")
    gone_conv = spark.createDataFrame([(99,)], "id long")
    removed = spark.createDataFrame([(1,)], "id long")
    keep = cascade_delete(msgs, removed_conversations=gone_conv, removed_messages=removed)
    assert sorted(r.id for r in keep.collect()) == [4, 5]
    keep2 = cascade_delete(msgs, removed_users=spark.createDataFrame([(100,)], "id long"))
    assert sorted(r.id for r in keep2.collect()) == []


def test_cascade_delete_has_no_depth_limit(spark):
    chain = [(i, 1, 1, i - 1 if i else None) for i in range(70)] + [(100, 1, 1, 101), (101, 1, 1, 100)]
    msgs = spark.createDataFrame(chain, "id long, conversation_id long, sender_id long, reply_to long")
    gone = spark.createDataFrame([(0,), (100,)], "id long")
    assert cascade_delete(msgs, removed_messages=gone).count() == 0


def test_assign_codes_unique_and_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    free = assign_codes(df, "k", digits=4)
    existing = free.filter("k % 10 = 3").select("code")  # 500 codes are gone
    a, b = (assign_codes(df, "k", existing, digits=4) for _ in range(2))
    assert a.count() == a.select("code").distinct().count() == 5000
    assert a.join(b, ["k", "code"]).count() == 5000
    assert a.join(existing, "code").count() == 0
    assert a.join(free, ["k", "code"]).count() == 4500


def test_assign_codes_has_no_small_limit(spark):
    df = spark.range(2_000_000).withColumnRenamed("id", "k")
    assert assign_codes(df, "k").select("code").distinct().count() == 2_000_000
    with pytest.raises(ValueError):
        assign_codes(df, "k", digits=6)
    with pytest.raises(RuntimeError):  # every code is taken
        full = assign_codes(df.limit(100), "k", digits=2)
        assign_codes(df.limit(100), "k", full.select("code"), digits=2)


def test_match_groups_properties(t_small):
    m = match_groups(t_small).cache()
    placed = m.filter("placed")
    assert placed.filter("chat_fill > chat_size").count() == 0
    assert placed.filter("(chat_status = 'completed') <> (chat_fill = chat_size)").count() == 0
    dup = placed.groupBy("event_id", "kind", "chat_no", "user_id").count().filter("count > 1")
    assert dup.count() == 0
    assert placed.filter("kind = 'buddy'").count() > 0 and placed.filter("kind = 'group'").count() > 0


def _first_fit_brute(rows, grouping):
    """Independent statement of MAT-1 for one event: returns
    {(reservation_id, kind): (chat_no, fill_after_all, status)}."""
    out = {}
    for kind in ("buddy", "group"):
        if kind == "group" and grouping < 2:
            continue
        cap = 2 if kind == "buddy" else grouping
        chats = []  # dicts with fill, users
        placed = []
        for r in rows:
            if kind == "buddy" and not r["find_buddy"]:
                continue
            w = 1 if kind == "buddy" else r["group_members"]
            target = next((i for i, c in enumerate(chats)
                           if c["fill"] < cap and c["fill"] + w <= cap and r["user_id"] not in c["users"]),
                          None)
            if target is None:
                if w > cap:
                    out[(r["reservation_id"], kind)] = (None, None, None)
                    continue
                chats.append({"fill": 0, "users": set()})
                target = len(chats) - 1
            chats[target]["fill"] += w
            chats[target]["users"].add(r["user_id"])
            placed.append((r["reservation_id"], target))
        for rid, i in placed:
            c = chats[i]
            out[(rid, kind)] = (i + 1, c["fill"], "completed" if c["fill"] == cap else "pending")
    return out


def test_match_groups_equals_brute_force(t_small):
    res = (t_small.reservations.filter(F.col("status").isin("paid", "need-approval"))
           .join(t_small.events.select(F.col("id").alias("event_id"), "grouping"), "event_id")
           .select(F.col("id").alias("reservation_id"), "event_id", "user_id", "group_members",
                   "find_buddy", "grouping", F.col("updated_at").alias("paid_at")).collect())
    by_event = {}
    for r in sorted(res, key=lambda r: (r.event_id, r.paid_at, r.reservation_id)):
        by_event.setdefault(r.event_id, []).append(r.asDict())
    want = {}
    for ev, rows in by_event.items():
        want.update(_first_fit_brute(rows, rows[0]["grouping"]))
    got = {(r.reservation_id, r.kind): (r.chat_no, r.chat_fill, r.chat_status)
           for r in match_groups(t_small).collect()}
    assert got == want


def test_explode_group_members(spark):
    from eventide.sources.sinks import explode_group_members
    df = spark.createDataFrame(
        [(1, [("a", "b", "1370/01/01", "0012345679"), ("c", "d", "1990-01-01", "1234567891")]),
         (2, []), (3, [(None, None, "x", "y"), ("e", " ", None, None)])],
        "reservation_id long, group_members_list array<struct<first_name:string, last_name:string,"
        " birth_date:string, national_id:string>>")
    ok, bad = explode_group_members(df)
    assert sorted((r.reservation_id, r.first_name) for r in ok.collect()) == [(1, "a"), (1, "c")]
    assert [(r.reservation_id, r.missing) for r in bad.collect()] == [
        (3, ["first_name", "last_name"]), (3, ["last_name"])]


def test_validate_events_rules(spark, t_small):
    from eventide.operators.quality import validate_events
    base = dict(creator_id=7, title="Night hike", category="1", start_date="1378/05/10",
                start_time="18:30", end_date="1378/05/10", end_time="21:00",
                location_name="کوه دماوند", address="جاده هراز کیلومتر ۵۰",
                coordinate_lat="35.95", coordinate_lng="52.11",
                coordinate_address="جاده هراز کیلومتر ۵۰", description="x" * 25,
                media_ids="media-3,media-2", capacity="12", grouping="4", price="150,000",
                private=False, approval=True, leader=None)
    cases = {
        1: ({}, []),
        2: ({"title": "abc"}, ["title_length"]),
        3: ({"grouping": "5"}, ["grouping"]),                 # does not divide 12
        4: ({"grouping": "12"}, []),                           # equal to capacity -> 0
        5: ({"coordinate_lng": "120.5"}, []),                  # we allow up to 180
        6: ({"media_ids": "media-1"}, ["no_image"]),           # part 0's extra media is a video
        7: ({"end_time": "17:00"}, ["end_before_start"]),
        8: ({"start_date": "1376/01/10", "end_date": "1376/01/10"}, ["start_in_past"]),
        9: ({"category": "9"}, ["category"]),
        10: ({"creator_id": 0, "leader": "3"}, []),            # admin names a leader
    }
    rows = []
    for sid, (over, _) in cases.items():
        r = dict(base, **over)
        r["sub_id"] = sid
        rows.append(r)
    schema = ("sub_id long, creator_id long, title string, category string, start_date string, "
              "start_time string, end_date string, end_time string, location_name string, "
              "address string, coordinate_lat string, coordinate_lng string, "
              "coordinate_address string, description string, media_ids string, capacity string, "
              "grouping string, price string, private boolean, approval boolean, leader string")
    raw = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", "))
                                 for r in rows], schema)
    ok, bad = validate_events(raw, t_small.event_categories, t_small.event_medias,
                              t_small.leaders, t_small.users,
                              "1998-06-01 00:00:00")
    reasons = {r.sub_id: sorted(r.reasons) for r in bad.collect()}
    for sid, (_, want) in cases.items():
        assert reasons.get(sid, []) == sorted(want), sid
    acc = {r.sub_id: r for r in ok.collect()}
    assert acc[4].grouping == 0 and acc[1].grouping == 4
    assert acc[1].price == 150000 and acc[1].status == "pending" and acc[1].leader_id == 0
    assert acc[10].status == "verified" and acc[10].leader_id == 3
    assert acc[1].thumbnail_id == 3  # first image in list order (media-3 is an image)


def test_folds_survive_tiny_arrow_batches(spark, t_small):
    """State carried across Arrow batches: with 3 rows per batch nearly every
    event straddles a batch boundary; results must not change."""
    from eventide.operators.folds import admit_bookings
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        base_m = {(r.reservation_id, r.kind): (r.chat_no, r.chat_fill)
                  for r in match_groups(t_small).collect()}
        base_a = {r.request_id: (r.reason, r.left_before)
                  for r in admit_bookings(t_small, t_small.booking_requests, partitions=5).collect()}
        spark.conf.set(key, "3")
        small_m = {(r.reservation_id, r.kind): (r.chat_no, r.chat_fill)
                   for r in match_groups(t_small).collect()}
        small_a = {r.request_id: (r.reason, r.left_before)
                   for r in admit_bookings(t_small, t_small.booking_requests, partitions=5).collect()}
    finally:
        spark.conf.set(key, old)
    assert small_m == base_m
    assert small_a == base_a


def test_ingest_links_media_to_new_events(spark, t_small):
    from eventide.operators.quality import ingest_events, validate_events
    ok, _ = validate_events(t_small.event_submissions, t_small.event_categories,
                            t_small.event_medias, t_small.leaders, t_small.users,
                            "1998-06-01 00:00:00")
    new_events, medias = ingest_events(ok, t_small.events, t_small.event_medias,
                                       "1998-06-01 00:00:00")
    top = t_small.events.agg(F.max("id")).first()[0]
    ev = {r.sub_id: r.id for r in new_events.select("sub_id", "id").collect()}
    assert ev and all(i == top + s for s, i in ev.items())
    wanted = {}
    for r in ok.select("sub_id", "media_ids").collect():
        for u in r.media_ids.split(","):
            wanted[u.strip()] = ev[r.sub_id]
    got = {r.uuid: r.event_id for r in medias.filter(F.col("uuid").isin(list(wanted))).collect()}
    assert got == wanted
    assert medias.count() == t_small.event_medias.count()


def test_a_rejected_row_holds_no_phone_against_a_later_one(spark):
    from eventide.operators.quality import check_users
    rows = [(1, "x", "احمدی", "09121111111", "0012345679"), (2, "علی", "احمدی", "09121111111", "0012345679"),
            (3, "علی", "احمدی", "09121111111", "1234567891")]
    raw = spark.createDataFrame(rows, "row_id long, first_name string, last_name string, phone string, national_id string")
    users = spark.createDataFrame([], "phone string, national_id string")
    got = {r.row_id: r for r in check_users(raw, users, secret="k").collect()}
    assert got[1].reasons == ["first_name"] and got[2].reasons == [] and got[3].reasons == ["phone_repeated"]
    other = check_users(raw, users, secret="l").filter("row_id = 2").first()
    assert got[2].national_id != other.national_id and "0012345679" not in got[2].national_id


def test_numbers_that_do_not_fit_are_quarantined(spark, t_small):
    from eventide.operators.quality import ingest_events, validate_events
    good = t_small.event_submissions
    wrong = ["9" * 20, "3000000000", "70000", "007", "-3", "1.5", "abc", None]
    first = good.limit(1).drop("capacity", "sub_id").crossJoin(spark.createDataFrame(
        list(enumerate(wrong, 10**6)), "sub_id long, capacity string")).select(*good.columns)
    ok, bad = validate_events(good.unionByName(first), t_small.event_categories, t_small.event_medias,
                              t_small.leaders, t_small.users, "1998-06-01 00:00:00")
    reasons = {r.sub_id: r.reasons for r in bad.filter("sub_id >= 1000000").collect()}
    assert len(reasons) == len(wrong) and all("capacity" in r for r in reasons.values())
    new, _ = ingest_events(ok, t_small.events, t_small.event_medias, "1998-06-01 00:00:00")
    assert new.count() > 0 and new.filter("slug IS NULL OR slug = '' OR views <> 0").count() == 0


def test_chats_of_one_busy_event_are_quick_and_first_fit(spark, t_small):
    import random
    import time

    from eventide.operators.folds import _match_partition
    import pandas as pd
    rng = random.Random(3)
    n = 65_000
    rows = pd.DataFrame({"reservation_id": range(n), "event_id": 1, "user_id": [rng.randrange(n) for _ in range(n)],
                         "group_members": [rng.randrange(1, 7) for _ in range(n)],
                         "find_buddy": [rng.random() < 0.5 for _ in range(n)], "grouping": 6})
    t0 = time.process_time()
    got = pd.concat(list(_match_partition(iter([rows]))))
    assert time.process_time() - t0 < 15 and len(got) == n + rows["find_buddy"].sum()
    few = rows.head(400)
    want, chats = {}, {"buddy": [], "group": []}
    for r in few.itertuples():
        for kind, w, cap in ([("buddy", 1, 2)] if r.find_buddy else []) + [("group", r.group_members, 6)]:
            for i, c in enumerate(chats[kind]):
                if c[0] + w <= cap and r.user_id not in c[1]:
                    break
            else:
                i, c = len(chats[kind]), [0, set()]
                chats[kind].append(c)
            c[0] += w
            c[1].add(r.user_id)
            want[r.reservation_id, kind] = i + 1
    small = pd.concat(list(_match_partition(iter([few]))))
    assert {(r.reservation_id, r.kind): r.chat_no for r in small.itertuples()} == want


def test_one_huge_request_changes_nothing(spark, t_small):
    from eventide.operators.folds import admit_bookings
    base = t_small.booking_requests
    huge = base.limit(1).withColumn("request_id", F.lit(10**9)).withColumn("size", F.lit(10**9).cast("long"))
    a = admit_bookings(t_small, base, partitions=6)
    b = admit_bookings(t_small, base.unionByName(huge), partitions=6)
    rows = lambda d: sorted((r.request_id, r.admitted, r.reason) for r in d.collect() if r.request_id < 10**9)
    assert rows(a) == rows(b)
    assert b.filter("request_id = 1000000000").first().admitted is False


def test_inbox_passes_over_members_without_a_user(spark):
    from eventide.plans.social import other_member
    parts = spark.createDataFrame([(1, 7, 99), (2, 7, 1), (3, 7, 2)], "id long, conversation_id long, user_id long")
    users = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r.user_id: r.other_user_id for r in other_member(parts, users).collect()}
    assert got == {99: 1, 1: 2, 2: 1}
