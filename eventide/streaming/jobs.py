"""Structured Streaming operators (ST-1..7).

The reference checks each request against the database as it arrives. Here
the append tables arrive as folders of parquet files (``stream()``), and each
online check is a streaming query:

* ST-1 ``otp_throttle``: a code request is accepted if its (phone, page) has
  no live code.
* ST-2 ``otp_match``: attempts matched to issued codes (same phone, code and
  ip; inside the code's lifetime); a code verifies only once.
* ST-3 ``verified_phones``: latest used code per phone and whether it is
  still fresh (a batch job over the used codes).
* ST-4 ``accept_messages``: stream-static join against chats, accept while
  the chat has not expired.
* ST-5 ``settle_stream``: first confirmation per authority settles it, once.
* ST-6 ``live_fill``: running seats per event from a change feed of signed
  seat deltas (streaming ``groupBy().sum()``, update mode).
* ST-7 ``admit_stream``: admission in time order with seats left as state.

ST-1, ST-2, ST-5 and ST-7 depend on order. They are ``OrderedJob``s: rows wait
for the watermark and are applied in (time, id) order whatever the files look
like, and late rows are kept with a reason (see ``ordered``). Their steps are
ordinary distributed batch jobs, so a hot key is split over tasks.

Event time is ``timestamp`` (watermarks refuse ``timestamp_ntz``); the
session time zone is UTC so wall clock values are unchanged.
"""

from __future__ import annotations

import uuid
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.throttle import CODE_LIFETIME_S, throttle
from eventide.session import children, ensure_checkpoint_dir
from eventide.sources.sinks import HASH, apply_updates, by_hash, merge_buckets, read_buckets, touched_buckets, write_buckets
from eventide.streaming.ordered import OrderedJob

FRESH_AFTER_USE_S = 60  # fixed value: a used code keeps a phone verified this long


# ------------------------------------------------------------------ plumbing

def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/eventide-streams/{name}-{uuid.uuid4().hex[:12]}"


def write_as_files(df: DataFrame, path: str, order_col: str, n_files: int = 4) -> None:
    """Write a batch table as ``n_files`` time slices, one parquet append per
    slice in ``order_col`` order, so a file stream with maxFilesPerTrigger
    reads older slices first. Slice edges are approximate quantiles (n-1
    numbers); each slice is an ordinary distributed write."""
    key = F.unix_micros(F.col(order_col).cast("timestamp"))
    edges = df.select(key.alias("_k")).approxQuantile(
        "_k", [i / n_files for i in range(1, n_files)], 0.0001)
    lo = None
    for hi in edges + [None]:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (key > F.lit(lo))
        if hi is not None:
            cond = cond & (key <= F.lit(hi))
        df.filter(cond).write.mode("append").parquet(path)
        lo = hi


def disorder_seconds(df: DataFrame, order_col: str, n_files: int = 4) -> float:
    """By how much rows written with ``write_as_files`` can arrive out of order:
    the longest slice, since files of one slice come in any order."""
    key = F.unix_micros(F.col(order_col).cast("timestamp"))
    edges = df.select(key.alias("_k")).approxQuantile(
        "_k", [i / n_files for i in range(n_files + 1)], 0.0001)
    ends = df.agg(F.min(key), F.max(key)).first()
    edges = [ends[0], *edges[1:-1], ends[1]] if edges else [0]
    return max([b - a for a, b in zip(edges[:-1], edges[1:])], default=0) / 1e6


def run_available_now(query_df: DataFrame, out_path: str, mode: str = "append",
                      fmt: str = "parquet", checkpoint: str | None = None) -> None:
    """Run a streaming DataFrame over everything available, into a file sink."""
    spark = query_df.sparkSession
    ckpt = checkpoint or scratch_dir(spark, "ckpt")
    q = (query_df.writeStream.format(fmt).outputMode(mode)
         .option("checkpointLocation", ckpt).option("path", out_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(query_df: DataFrame, fn, checkpoint: str | None = None,
                      mode: str = "append") -> None:
    spark = query_df.sparkSession
    ckpt = checkpoint or scratch_dir(spark, "ckpt")
    q = (query_df.writeStream.outputMode(mode).foreachBatch(fn)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ ST-1

def _throttle_step(ready: DataFrame, state: DataFrame | None, before: DataFrame | None):
    """One release of requests and uses, decided by ``throttle`` from the state's
    live codes; the new state is what can still throttle."""
    keys = ["phone", "page"]
    if "request" in ready.columns:
        asked, used = ready.filter("request"), ready.filter("not request").withColumnRenamed("created_at", "used_at")
    else:
        asked, used = ready, None
    out = throttle(asked, used, state).checkpoint()
    ends = out.filter("accepted").groupBy(*keys).agg(
        F.max(F.struct(F.unix_micros("created_at").alias("at"), F.col("expires_at").alias("live"))).alias("e"))
    ends = ends.select(*keys, "e.at", "e.live")
    if state is not None:  # codes from before, unless a newer one was issued
        ends = ends.unionByName(state.select(*keys, F.lit(None).cast("long").alias("at"), "live"))
        ends = ends.groupBy(*keys).agg(F.max(F.struct("live", "at")).alias("e")).select(*keys, "e.at", "e.live")
    if used is not None:
        last = used.groupBy(*keys).agg(F.max(F.unix_micros("used_at")).alias("freed"))
        ends = ends.alias("e").join(last.alias("u"), F.col("e.phone").eqNullSafe(F.col("u.phone"))
                                    & F.col("e.page").eqNullSafe(F.col("u.page")), "left").filter(
            F.col("freed").isNull() | (F.col("freed") < F.col("at"))).select("e.phone", "e.page", "live")
    ends = ends.select(*keys, "live")
    newest = ready.agg(F.max(F.unix_seconds("created_at"))).first()[0]
    return out, ends if newest is None else ends.filter(F.col("live") > newest)


def otp_throttle(requests: DataFrame, root: str, delay_seconds: int = 600,
                 uses: DataFrame | None = None) -> OrderedJob:
    """ST-1: accept a code request only if the (phone, page) has no unused live
    code (issued less than 120 s before). Requests ``(id, phone, page,
    created_at)``; output adds ``accepted`` and the new code's ``expires_at``
    (epoch seconds). A second stream ``uses`` ``(phone, page, used_at)`` ends the
    code that is alive then (without it, a used code throttles until it expires).
    The state holds one expiry per live (phone, page)."""
    if uses is None:
        return OrderedJob(requests.sparkSession, root, "created_at", delay_seconds, _throttle_step).run(requests)
    cols = ["phone", "page"]
    both = requests.select("id", *cols, "created_at", F.lit(True).alias("request")).unionByName(
        uses.select(F.lit(None).cast(requests.schema["id"].dataType).alias("id"), *cols,
                    F.col("used_at").alias("created_at"), F.lit(False).alias("request")))
    return OrderedJob(requests.sparkSession, root, "created_at", delay_seconds, _throttle_step, "request",
                      ("true", "false")).run(both)


# ------------------------------------------------------------------ ST-2 / ST-3

def _match_step(ready: DataFrame, state: DataFrame | None, before: DataFrame | None):
    """Attempts joined to the codes they can match; state: codes that may still
    match later, with their use."""
    codes = ready.filter("issued").select(
        F.col("id").alias("otp_id"), F.col("phone").alias("i_phone"), F.col("code").alias("i_code"),
        F.col("user_ip").alias("i_ip"), F.col("at").alias("created_at"), F.lit(False).alias("used"))
    codes = codes if state is None else codes.unionByName(state)
    tries = ready.filter("not issued").select(F.col("id").alias("attempt_id"), "phone", "code", "user_ip",
                                              F.col("at").alias("attempted_at"))
    end = F.col("created_at") + F.expr(f"INTERVAL {CODE_LIFETIME_S} SECONDS")
    found = tries.join(codes, (F.col("phone") == F.col("i_phone")) & (F.col("code") == F.col("i_code"))
                       & (F.col("user_ip") == F.col("i_ip")) & (F.col("attempted_at") >= F.col("created_at"))
                       & (F.col("attempted_at") < end)).select(
        "attempt_id", "otp_id", "phone", "attempted_at", "used").checkpoint()
    first = found.groupBy("otp_id").agg(F.min(F.struct("attempted_at", "attempt_id")).alias("f"))
    out = (found.join(first, "otp_id").withColumn(
        "first_use", ~F.col("used") & (F.col("f.attempt_id") == F.col("attempt_id")))
        .select("attempt_id", "otp_id", "phone", "attempted_at", "first_use"))
    newest = ready.agg(F.max("at")).first()[0]
    live = codes if newest is None else codes.filter(end > F.lit(newest))
    live = (live.join(first.select("otp_id", F.lit(True).alias("hit")), "otp_id", "left")
            .withColumn("used", F.col("used") | F.coalesce("hit", F.lit(False))).drop("hit"))
    return out, live


def otp_match(issued: DataFrame, attempts: DataFrame, root: str, delay_seconds: int = 300) -> OrderedJob:
    """ST-2: attempts matched to issued codes of the same phone, code and ip,
    the attempt inside the code's lifetime [created_at, created_at+120s). Per
    code the earliest matching attempt is its ``first_use``. Both streams are
    one here, so that they share a watermark and a late output."""
    cols = ("id", "phone", "code", "user_ip")
    both = issued.select(*cols, F.col("created_at").alias("at"), F.lit(True).alias("issued")).union(
        attempts.select(*cols, F.col("attempted_at").alias("at"), F.lit(False).alias("issued")))
    return OrderedJob(issued.sparkSession, root, "at", delay_seconds, _match_step, "issued",
                      ("true", "false")).run(both)


def verified_phones(used_codes: DataFrame, as_of_epoch: int) -> DataFrame:
    """ST-3: per phone, the latest used code (by expires_at, then id) and
    whether it still verifies the phone at ``as_of_epoch``: the code expired
    less than 60 s before. Input ``(otp_id, phone, expires_at)``; the latest
    code per phone is a ``max`` of a struct (partial aggregation)."""
    latest = (used_codes.groupBy("phone")
              .agg(F.max(F.struct("expires_at", "otp_id")).alias("l")))
    return (latest.select("phone", F.col("l.otp_id").alias("otp_id"),
                          F.col("l.expires_at").alias("expires_at"))
            .withColumn("verified", F.lit(as_of_epoch) - F.col("expires_at") < FRESH_AFTER_USE_S))


# ------------------------------------------------------------------ ST-4

def accept_messages(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """ST-4: messages of existing chats sent while the chat is not expired
    (stream-static inner join, then a filter on event time)."""
    c = conversations.select(F.col("id").alias("conversation_id"),
                             F.col("expires_on").cast("timestamp").alias("expires_on"))
    return (messages.join(c, "conversation_id")
            .withColumn("accepted", F.col("created_at") <= F.col("expires_on")))


# ------------------------------------------------------------------ ST-5

def settle_stream(confirmations: DataFrame, transactions: DataFrame, reservations: DataFrame,
                  events: DataFrame, root: str, delay_seconds: int = 86_400,
                  buckets: int = 64) -> OrderedJob:
    """ST-5: settle payment confirmations ``(conf_id, authority, confirmed_at)``.

    The first confirmation of an authority by (time, id) settles its
    transaction unless that is paid or was settled by an earlier step. The
    transactions lie below ``root`` as a ledger in buckets by authority, written when
    the job starts (with all that was settled before). A step first marks
    what the step before settled as paid (SNK-3 on the buckets that hold such an authority;
    repeated after a failure, that changes nothing), then reads the buckets of its own
    authorities only: the bytes of a step do not grow with the number of steps.
    Running it again below the same root settles nothing twice.
    ``settlement_snapshots`` turns the output into new tables (SNK-3).
    """
    spark, ledger = confirmations.sparkSession, f"{root.rstrip('/')}/ledger"
    tx = by_hash(transactions.filter("authority IS NOT NULL"), "authority").groupBy(HASH, "authority").agg(
        F.min(F.struct("id", "status", "reservation_id")).alias("t"))
    tx = tx.select("authority", F.col("t.id").alias("transaction_id"),
                   F.col("t.status").alias("t_status"), F.col("t.reservation_id").alias("reservation_id"))
    res = reservations.select(F.col("id").alias("reservation_id"), "event_id")
    # Events grow with the input: that their Parquet file is small is no reason to broadcast them.
    ev = events.select(F.col("id").alias("event_id"), "is_approval").hint("merge")

    def paid(settled: DataFrame) -> DataFrame:
        return settled.select("authority", F.lit("paid").alias("t_status"), "confirmed_at")

    def step(ready: DataFrame, state: DataFrame | None, before: DataFrame | None):
        if before is not None:
            merge_buckets(spark, ledger, paid(before), "authority", "confirmed_at", buckets)
        ready = ready.filter("authority IS NOT NULL")
        firsts = (by_hash(ready, "authority").groupBy(HASH, "authority")
                  .agg(F.min(F.struct("confirmed_at", "conf_id")).alias("c")).select(HASH, "authority", "c.*"))
        mine = read_buckets(spark, ledger, touched_buckets(ready, "authority", buckets))
        mine = tx.limit(0) if mine is None else mine
        rows = (firsts.join(by_hash(mine, "authority"), [HASH, "authority"]).filter(F.col("t_status") != "paid")
                .join(res, "reservation_id", "left").join(ev, "event_id", "left"))
        return rows.select("conf_id", "authority", "confirmed_at", "transaction_id", "reservation_id",
                           F.when(F.col("is_approval"), "need-approval").otherwise("paid")
                           .alias("reservation_status"),
                           (F.lit(100_000_000_000) + F.col("transaction_id")).alias("ref_id")), None

    job = OrderedJob(spark, root, "confirmed_at", delay_seconds, step)
    past = job.table("out")
    write_buckets(tx if past is None else apply_updates(tx, paid(past), "authority", "confirmed_at"),
                  ledger, "authority", buckets)
    return job.run(confirmations)


def settlement_snapshots(settled: DataFrame, transactions: DataFrame,
                         reservations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-3 for ST-5: the transactions and reservations with the settled rows'
    new status, reference number and times."""
    at = F.col("confirmed_at").cast("timestamp_ntz")
    tx = settled.select(F.col("transaction_id").alias("id"), F.lit("paid").alias("status"), "ref_id",
                        at.alias("paid_at"), at.alias("updated_at"))
    res = settled.filter("reservation_id IS NOT NULL").select(
        F.col("reservation_id").alias("id"), F.col("reservation_status").alias("status"),
        at.alias("updated_at"))
    return (apply_updates(transactions, tx, "id", "updated_at"),
            apply_updates(reservations, res, "id", "updated_at"))


# ------------------------------------------------------------------ ST-6

def live_fill(seat_changes: DataFrame) -> DataFrame:
    """ST-6: running seats per event from a change feed of bookings
    ``(reservation_id, event_id, seats_delta, change_ts)``: each change
    carries its signed seat change (+members when a booking is created,
    -members when a live booking is canceled, 0 for status changes between
    live states). Streaming ``groupBy().sum()`` in update mode; the state
    is one number per event."""
    return seat_changes.groupBy("event_id").agg(F.sum("seats_delta").alias("filled"))


# ------------------------------------------------------------------ ST-7

def admit_stream(requests: DataFrame, events: DataFrame, reservations: DataFrame, root: str,
                 delay_seconds: int = 600) -> OrderedJob:
    """ST-7: stream twin of ADM-1. Every released step runs the batch admission,
    which splits a busy event over tasks; the state is the seats each event
    has given away so far, on top of its reservations, which are summed up once. Requests
    ``(request_id, event_id, user_id, requested_at, size, find_buddy)``."""
    from eventide.operators.folds import admit_bookings
    from eventide.operators.stats import seats_filled
    ensure_checkpoint_dir(requests.sparkSession)
    booked = seats_filled(reservations).select("event_id", F.lit("paid").alias("status"),
                                               F.col("filled").alias("group_members")).checkpoint()

    def step(ready: DataFrame, state: DataFrame | None, before: DataFrame | None):
        held = booked if state is None else booked.unionByName(state.select(
            "event_id", F.lit("paid").alias("status"), F.col("given").alias("group_members")))
        wall = ready.withColumn("requested_at", F.col("requested_at").cast("timestamp_ntz"))
        out = admit_bookings(SimpleNamespace(events=events, reservations=held), wall).checkpoint()
        given = out.filter("admitted").groupBy("event_id").agg(F.sum("size").cast("long").alias("given"))
        if state is not None:
            given = given.unionByName(state).groupBy("event_id").agg(F.sum("given").alias("given"))
        return out, given

    return OrderedJob(requests.sparkSession, root, "requested_at", delay_seconds, step).run(requests)


def file_stream(df: DataFrame, name: str, time_col: str, n_files: int = 4) -> DataFrame:
    """Lay a batch table down as time-ordered files in a fresh scratch folder
    and open it as a stream (event time as timestamp). A slice is as many files
    as its write had tasks, so a trigger takes the files of one slice, not one
    file: ``n_files`` micro-batches whatever the size of the table."""
    from eventide.sources.tables import stream
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    write_as_files(df, path, time_col, n_files)
    schema = spark.read.parquet(path).schema
    files = sum(n.startswith("part-") for n in children(spark, path))
    return stream(spark, path, schema, time_col=time_col, max_files_per_trigger=max(1, -(-files // n_files)))


def run_to_table(query_df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available input into a parquet folder and read
    the result back as a batch DataFrame."""
    spark = query_df.sparkSession
    out = scratch_dir(spark, name + "-out")
    run_available_now(query_df, out, mode=mode)
    return spark.read.parquet(out)


def run_update_snapshot(query_df: DataFrame, name: str, key: str, root: str | None = None) -> DataFrame:
    """Run an update-mode stream; each micro-batch writes the keys it changed to
    its own folder (again after a restart, with the same rows). Returns the
    latest row of every key."""
    spark = query_df.sparkSession
    root = root or scratch_dir(spark, name + "-changes")

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(
            f"{root}/changes/step={epoch}")

    run_foreach_batch(query_df, put, checkpoint=f"{root}/checkpoint", mode="update")
    if not children(spark, f"{root}/changes"):
        raise ValueError("the stream has not written any change yet")
    rows = spark.read.parquet(f"{root}/changes").drop("step")
    values = [c for c in rows.columns if c not in (key, "_epoch")]
    return rows.groupBy(key).agg(F.max(F.struct("_epoch", *values)).alias("_l")).select(
        key, *[f"_l.{c}" for c in values])
