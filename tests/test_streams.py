"""Streaming jobs: same rows whatever the files look like, nothing lost, nothing twice."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.streaming.jobs import (admit_stream, file_stream, otp_throttle, scratch_dir, settle_stream, settlement_snapshots)
from eventide.streaming.ordered import OrderedJob
from tests.test_throttle import loop, some

BASE = dt.datetime(2024, 1, 1, 10, 0, 0)


def test_settle_stream_twice_settles_once(spark, t_small):
    """Again below the same root, which is a file:// URI: nothing is settled twice."""
    root = "file://" + scratch_dir(spark, "settle").removeprefix("file:").replace("//", "/")
    s1 = file_stream(t_small.confirmations, "conf-a", "confirmed_at")
    job = settle_stream(s1, t_small.transactions, t_small.reservations, t_small.events, root)
    n1 = job.table("out").count()
    again = OrderedJob(spark, root, "confirmed_at", 86_400, job.step)
    again.release(t_small.confirmations.withColumn("confirmed_at", F.col("confirmed_at").cast("timestamp")), "x")
    again.release(None, "y")
    out = job.table("out")
    assert n1 > 0 and out.count() == n1 == out.select("authority").distinct().count()
    tx, res = settlement_snapshots(out, t_small.transactions, t_small.reservations)
    assert tx.count() == t_small.transactions.count() and res.count() == t_small.reservations.count()
    paid = tx.join(out, tx["id"] == out["transaction_id"])
    assert paid.count() == n1 and paid.filter("status <> 'paid' OR paid_at IS NULL").count() == 0


def requests(spark):
    rows = [dict(id=i, phone=None if i % 9 == 8 else f"09{i % 3}", page="login" if i % 5 else "register",
                 created_at=BASE + dt.timedelta(seconds=(i * 37) % 900)) for i in range(120)]
    rows += [dict(id=1000 + i, phone="hot", page="login", created_at=BASE + dt.timedelta(seconds=i * 7))
             for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, phone string, page string, created_at timestamp")


@pytest.mark.parametrize("files", [1, 3, 8])
def test_throttle_is_the_loop_for_any_files(spark, files):
    rows, df = requests(spark)
    s = file_stream(df.repartition(files), "thr", "created_at", n_files=2)
    job = otp_throttle(s, scratch_dir(spark, "thr"), delay_seconds=3000)
    got = {r.id: r.accepted for r in job.table("out").collect()}
    assert got == loop(rows) and job.table("late").count() == 0
    assert 0 < sum(got.values()) < len(got)


@pytest.mark.parametrize("files", [1, 8])
def test_a_trigger_takes_a_slice_however_many_files(spark, files):
    rows, df = requests(spark)
    s = file_stream(df.repartition(files), "few", "created_at", n_files=3)
    job = OrderedJob(spark, scratch_dir(spark, "few"), "created_at", 3000, lambda ready, state, before: (ready, None))
    job.run(s)
    assert [n.split("-", 1)[1] for n in job.commits()] == ["0", "1", "2", "drain3"]
    assert job.table("out").count() == len(rows) and job.table("late").count() == 0


@pytest.mark.parametrize("files", [3, 8])
def test_a_used_code_frees_its_phone(spark, files):
    rows, uses = some(files)
    df = spark.createDataFrame(rows, "id long, phone string, page string, created_at timestamp")
    u = spark.createDataFrame(uses, "phone string, page string, used_at timestamp")
    job = otp_throttle(file_stream(df.repartition(files), "thr", "created_at", n_files=2), scratch_dir(spark, "use"),
                       delay_seconds=5000, uses=file_stream(u.repartition(files), "use", "used_at", n_files=2))
    assert {r.id: r.accepted for r in job.table("out").collect()} == loop(rows, uses)
    assert loop(rows, uses) != loop(rows)


def test_uses_over_many_steps_and_a_restart(spark):
    from eventide.streaming.jobs import _throttle_step
    rows, uses = some(1)
    line = spark.createDataFrame(
        [(r["id"], r["phone"], r["page"], r["created_at"], True) for r in rows]
        + [(None, u["phone"], u["page"], u["used_at"], False) for u in uses],
        "id long, phone string, page string, created_at timestamp, request boolean")
    root = scratch_dir(spark, "steps")
    for k in range(5):  # a new job object each time: it goes on from what is written
        job = OrderedJob(spark, root, "created_at", 0, _throttle_step)
        at = F.unix_seconds("created_at") - 1704067200
        job.release(line.filter((at >= 800 * k) & (at < 800 * (k + 1))), str(k))
    job.release(None, "end")
    assert {r.id: r.accepted for r in job.table("out").collect()} == loop(rows, uses)


def test_throttle_over_many_steps_keeps_its_state(spark):
    rows, df = requests(spark)
    from eventide.streaming.jobs import _throttle_step
    job = OrderedJob(spark, scratch_dir(spark, "thr"), "created_at", 0, _throttle_step)
    for k in range(4):  # in time order: every step starts from the last one's state
        lo, hi = BASE + dt.timedelta(seconds=700 * k), BASE + dt.timedelta(seconds=700 * (k + 1))
        job.release(df.filter((F.col("created_at") >= F.lit(lo)) & (F.col("created_at") < F.lit(hi))), str(k))
    job.release(None, "end")
    assert {r.id: r.accepted for r in job.table("out").collect()} == loop(rows)


def test_late_rows_are_kept_with_a_reason(spark):
    rows, df = requests(spark)
    from eventide.streaming.jobs import _throttle_step
    job = OrderedJob(spark, scratch_dir(spark, "late"), "created_at", 60, _throttle_step)
    job.release(df.filter("id >= 1000"), "0")
    job.release(df.filter("id < 1000").withColumn(
        "created_at", F.when(F.col("id") == 5, None).otherwise(F.col("created_at"))), "1")
    job.release(df, "1")  # a repeated micro-batch does nothing
    job.release(None, "end")
    late = {r.id: r.reason for r in job.table("late").collect()}
    out = {r.id for r in job.table("out").collect()}
    assert late[5] == "no-time" and set(late.values()) == {"late", "no-time"}
    assert not out & set(late) and out | set(late) == {r["id"] for r in rows}


def test_admission_is_the_same_for_any_files(spark, t_small):
    df = t_small.booking_requests.select("request_id", "event_id", "user_id", "requested_at", "size", "find_buddy")
    found = []
    for files in (1, 5):
        s = file_stream(df.repartition(files), "adm", "requested_at", n_files=2)
        job = admit_stream(s, t_small.events, t_small.reservations, scratch_dir(spark, "adm"), 10**9)
        found.append(sorted((r.request_id, r.admitted, r.reason) for r in job.table("out").collect()))
    assert found[0] == found[1] and len(found[0]) == df.count()
