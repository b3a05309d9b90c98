"""SNK-3 in key buckets, the ledger of ST-5 and the cost of a late step."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.session import children
from eventide.sources import sinks
from eventide.streaming import ordered
from eventide.streaming.jobs import file_stream, scratch_dir, settle_stream

BASE = dt.datetime(2024, 1, 1)


def table(spark):
    return spark.range(2000).select(F.col("id"), F.lit("new").alias("status"), (F.col("id") * 3).alias("ref"),
                                    F.lit(0).cast("long").alias("at"))


def changes(spark, ids):
    rows = [(i, "paid", 1) for i in ids] + [(ids[0], "late", 5), (99_999, "nobody", 1)]
    return spark.createDataFrame(rows, "id long, status string, at long")


def files(spark, path):
    return {n: children(spark, f"{path}/{n}") for n in children(spark, path) if n.startswith(sinks.BUCKET)}


def rows(df):
    return sorted(map(tuple, df.select("id", "status", "ref", "at").collect()))


def test_ten_updates_rewrite_at_most_their_buckets(spark):
    path = scratch_dir(spark, "buckets")
    sinks.write_buckets(table(spark), path, "id", 64)
    before = files(spark, path)
    ups = changes(spark, list(range(0, 900, 100)))
    want = rows(sinks.apply_updates(table(spark), ups, "id", "at"))
    touched = sinks.merge_buckets(spark, path, ups, "id", "at", 64)
    after = files(spark, path)
    changed = {n for n in before if before[n] != after[n]}
    assert len(before) == 64 and 0 < len(changed) <= len(touched) <= 10
    assert rows(sinks.read_buckets(spark, path)) == want
    sinks.merge_buckets(spark, path, ups, "id", "at", 64)  # the same again changes nothing
    assert rows(sinks.read_buckets(spark, path)) == want


def test_a_merge_cut_short_is_finished_or_forgotten(spark, monkeypatch):
    path = scratch_dir(spark, "cut")
    sinks.write_buckets(table(spark), path, "id", 16)
    ups = changes(spark, [3, 4, 5])
    want = rows(sinks.apply_updates(table(spark), ups, "id", "at"))
    real, calls = sinks._finish_merge, []

    def dies(spark, p):
        calls.append(p)
        if len(calls) > 1:  # after the new buckets are written
            raise RuntimeError("lost")
        return real(spark, p)
    monkeypatch.setattr(sinks, "_finish_merge", dies)
    with pytest.raises(RuntimeError):
        sinks.merge_buckets(spark, path, ups, "id", "at", 16)
    monkeypatch.setattr(sinks, "_finish_merge", real)
    assert "_SUCCESS" in children(spark, f"{path}-merge")
    assert rows(sinks.read_buckets(spark, path)) == want and not children(spark, f"{path}-merge")
    # New buckets that are not whole (no mark of success) do not count.
    table(spark).limit(5).withColumn(sinks.BUCKET, F.lit(0)).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(sinks.BUCKET).parquet(f"{path}-merge")
    assert rows(sinks.read_buckets(spark, path)) == want and not children(spark, f"{path}-merge")


def test_merge_into_an_empty_table_and_without_updates(spark):
    path = scratch_dir(spark, "none")
    sinks.write_buckets(table(spark).limit(0), path, "id", 8)
    assert sinks.read_buckets(spark, path) is None
    assert sinks.merge_buckets(spark, path, changes(spark, [1]), "id", "at", 8) == []
    sinks.write_buckets(table(spark), path, "id", 8)
    assert sinks.merge_buckets(spark, path, changes(spark, [1]).limit(0), "id", "at", 8) == []
    assert rows(sinks.read_buckets(spark, path)) == rows(table(spark))


def payments(spark):
    tx = spark.createDataFrame([(i, f"A{i}" if i % 7 else None, "paid" if i % 5 == 0 else "pending", i)
                                for i in range(200)], "id long, authority string, status string, reservation_id long")
    res = spark.range(200).select("id", (F.col("id") % 4).alias("event_id"))
    ev = spark.range(4).select("id", (F.col("id") % 2 == 0).alias("is_approval"))
    conf = [(i, f"A{(i * 13) % 230}", BASE + dt.timedelta(minutes=i)) for i in range(400)]
    conf += [(900, None, BASE), (901, "A1", BASE + dt.timedelta(hours=9))]
    paid = {f"A{i}" for i in range(200) if i % 7 and i % 5}
    want = {}
    for cid, a, at in sorted(conf, key=lambda r: (r[2], r[0])):
        if a in paid and a not in want:
            want[a] = cid
    return tx, res, ev, spark.createDataFrame(conf, "conf_id long, authority string, confirmed_at timestamp"), want


def test_settlement_over_steps_with_a_failure_and_a_restart(spark, monkeypatch):
    tx, res, ev, conf, want = payments(spark)
    root = scratch_dir(spark, "ledger")
    job = settle_stream(file_stream(conf, "led", "confirmed_at", n_files=4), tx, res, ev, root, buckets=16)
    got = job.table("out").select("authority", "conf_id").collect()
    assert len(got) == len(want) and {r.authority: r.conf_id for r in got} == want

    # Step by step; the third dies after the ledger was brought up to date.
    job = ordered.OrderedJob(spark, scratch_dir(spark, "ledger"), "confirmed_at", 0, job.step)
    sinks.write_buckets(sinks.apply_updates(
        tx.filter("authority IS NOT NULL").selectExpr("authority", "id transaction_id", "status t_status",
                                                     "reservation_id"), conf.selectExpr(
            "authority", "'x' nothing", "confirmed_at").limit(0), "authority", "confirmed_at"),
        f"{root}/ledger", "authority", 16)
    real = sinks.read_buckets
    slice_of = F.expr("CASE conf_id WHEN 900 THEN 0 WHEN 901 THEN 3 ELSE conf_id div 100 END")
    for k in range(4):  # slices of time, so that no row is late
        part = conf.filter(slice_of == k)
        if k == 2:
            step = job.step

            def dies(*a):
                step(*a)
                raise RuntimeError("lost")
            job.step = dies
            with pytest.raises(RuntimeError):
                job.release(part, str(k))
            job.step = step
        job.release(part, str(k))
    job.release(None, "end")
    got = job.table("out").select("authority", "conf_id").collect()
    assert len(got) == len({r.authority for r in got}) and {r.authority: r.conf_id for r in got} == want
    # A step reads the buckets of its own authorities alone.
    ups = conf.filter("authority = 'A1'")
    mine = real(spark, f"{root}/ledger", sinks.touched_buckets(ups, "authority", 16))
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_late_step_costs_what_an_early_one_does(spark, monkeypatch):
    seen = []
    real = ordered.children
    monkeypatch.setattr(ordered, "children", lambda s, p: seen.append(p) or real(s, p))

    def step(ready, state, before):
        assert before is None or before.count() <= 5  # one step's output, never all
        n = ready.count() + (state.first().n if state is not None else 0)
        return ready, spark.range(1).select(F.lit(n).alias("n"))
    root = scratch_dir(spark, "cost")
    job, calls = ordered.OrderedJob(spark, root, "t", 0, step), []
    for k in range(12):
        rows = [(5 * k + i, BASE + dt.timedelta(minutes=5 * k + i)) for i in range(5)]
        del seen[:]
        job.release(spark.createDataFrame(rows, "id long, t timestamp"), str(k))
        calls.append(len(seen))
    assert len(set(calls[1:])) == 1
    job.release(None, "end")
    assert sorted(r.id for r in job.table("out").collect()) == list(range(60))
    left = [n for n in children(spark, root) if "wait" in children(spark, f"{root}/{n}")]
    assert len(left) == 1 and len(job.commits()) == 13


def test_a_merge_writes_a_row_once_and_in_every_task(spark, monkeypatch):
    path = scratch_dir(spark, "once")
    sinks.write_buckets(table(spark).repartition(4), path, "id", 2)
    parts = [[n for n in names if n.startswith("part-")] for names in files(spark, path).values()]
    assert [len(p) for p in parts] == [4, 4]  # more tasks than buckets
    made, real = [], sinks._finish_merge
    monkeypatch.setattr(sinks, "_finish_merge", lambda s, p: made.append(files(s, f"{p}-merge")) or real(s, p))
    ups = changes(spark, list(range(0, 900, 100)))
    assert sinks.merge_buckets(spark, path, ups, "id", "at", 2) == [0, 1]
    assert made[-1] and files(spark, path) == made[-1]  # moved, not written again
    assert rows(sinks.read_buckets(spark, path)) == rows(sinks.apply_updates(table(spark), ups, "id", "at"))


def test_moves_cut_short_are_finished(spark, monkeypatch):
    path = scratch_dir(spark, "moves")
    sinks.write_buckets(table(spark), path, "id", 8)
    ups = changes(spark, list(range(0, 2000, 10)))
    real, moved = sinks.replace, []

    def dies(s, old, by):
        if len(moved) == 3:
            sinks.remove(s, old)  # the worst place: the old bucket is gone, the new one not yet there
            raise RuntimeError("lost")
        moved.append(old)
        real(s, old, by)
    monkeypatch.setattr(sinks, "replace", dies)
    with pytest.raises(RuntimeError):
        sinks.merge_buckets(spark, path, ups, "id", "at", 8)
    monkeypatch.setattr(sinks, "replace", real)
    assert rows(sinks.read_buckets(spark, path)) == rows(sinks.apply_updates(table(spark), ups, "id", "at"))
    assert not children(spark, f"{path}-merge")


def test_updates_keep_repeated_and_null_keys(spark):
    base = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v long")
    ups = spark.createDataFrame([("a", 9, 1), (None, 8, 1), ("a", 7, 2)], "k string, v long, at long")
    got = sorted(map(str, map(tuple, sinks.apply_updates(base, ups, "k", "at").collect())))
    assert got == sorted(map(str, [("a", 7), ("a", 7), (None, 3), ("b", 4)]))
