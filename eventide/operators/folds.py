"""Order-dependent jobs: booking admission (ADM-1) and chat matching (MAT-1).

ADM-1 is a fold per event over requests in (time, id) order whose state is
the seats left. A rejected request takes no seat, so a running sum is wrong,
and one event may receive a third of all requests, so the fold must not run
in one task per event. The plan:

1. Requests are range-partitioned by (event, time, id) and checkpointed, so a
   hot event spans many partitions while each partition holds a contiguous
   run of it ("chunk").
2. Per chunk, Spark aggregates the seat sum of the requests that pass the
   static checks. Only events spanning partitions need cross-partition state,
   and there are fewer than P of them (P = partitions), so their chunk table
   has at most 2P rows: a proven bound, safe to broadcast.
3. For a spanning event, seats left entering each chunk follow from prefix
   sums up to the first chunk whose requests no longer all fit (the overflow
   chunk). From the first rejection on, seats left are below the rejected
   request's size, so later chunks are summarised by a transfer vector over
   that small range and composed in order.
4. A last pass replays every chunk from its exact entry state, all events of an
   Arrow batch at once (``decide_segments``).

Every row is decided exactly; no task ever holds more than its partition.

MAT-1 places paid bookings into chats per event in (paid time, id) order.
Its input per event is bounded by the event's seat capacity (SMALLINT in the
schema, so at most 65,535 bookings once admission has run), and only
(time, id, size, user) per booking enter the per-event state.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.exprs import plus_week
from eventide.operators.stats import seats_filled
from eventide.session import ensure_checkpoint_dir

_CHUNK_SCHEMA = ("event_id bigint, pid int, kind string, left_out long, "
                 "vec array<long>")


def _static_columns(req: DataFrame, events: DataFrame, base: DataFrame) -> DataFrame:
    ev = events.select(F.col("id").alias("event_id"), F.lit(True).alias("_exists"),
                       F.col("capacity").cast("long").alias("capacity"),
                       F.col("grouping").cast("long").alias("grouping"), "start_time")
    b = base.select("event_id", F.col("filled").cast("long").alias("base_filled"))
    # Events grow with the input: that their Parquet file is small is no reason to send
    # them through the driver. A hot event's requests are split by the skew join.
    r = (req.join(ev.hint("merge"), "event_id", "left").join(b.hint("merge"), "event_id", "left")
         .withColumn("base_filled", F.coalesce("base_filled", F.lit(0)))
         .withColumn("_exists", F.coalesce("_exists", F.lit(False))))
    gviol = (F.col("grouping") > 2) & (F.col("size") > F.col("grouping"))
    closed = F.col("requested_at") > F.col("start_time")
    return (r.withColumn("_gviol", F.coalesce(gviol, F.lit(False)))
            .withColumn("_closed", F.coalesce(closed, F.lit(False)))
            .withColumn("left0", F.col("capacity") - F.col("base_filled"))
            # A request above the seats left at the start can never be admitted.
            .withColumn("_ok", F.col("_exists") & ~F.col("_gviol") & ~F.col("_closed")
                        & F.coalesce(F.col("size") <= F.col("left0"), F.lit(False))))


def _decide(left_in: int, sizes: np.ndarray, ok: np.ndarray):
    """Replay one run of requests from ``left_in`` seats: returns (seats left
    before each row, admitted per row, seats left after the run).

    Vectorised: while every passing request still fits, admission is a
    cumulative sum; after the first rejection fewer seats remain than that
    request's size, so only a handful more admissions can follow, each found
    with one array search instead of a per-row loop.
    """
    n = len(sizes)
    before = np.empty(n, dtype=np.int64)
    adm = np.zeros(n, dtype=bool)
    left = int(left_in)
    eff = np.where(ok, sizes, 0).astype(np.int64)
    csum = np.cumsum(eff)
    # first row whose inclusive running sum no longer fits
    over = int(np.searchsorted(csum, left, side="right")) if left >= 0 else 0
    if over > 0:
        before[:over] = left - (csum[:over] - eff[:over])
        adm[:over] = ok[:over]
        left -= int(csum[over - 1])
    i = over
    while i < n:
        if left <= 0:
            before[i:] = left
            break
        nxt = np.flatnonzero(ok[i:] & (sizes[i:] <= left))
        if len(nxt) == 0:
            before[i:] = left
            break
        j = i + int(nxt[0])
        before[i:j + 1] = left
        adm[j] = True
        left -= int(sizes[j])
        i = j + 1
    return before, adm, left


def decide_segments(seg: np.ndarray, left: np.ndarray, sizes: np.ndarray, ok: np.ndarray):
    """Replay many runs of requests at once: row i belongs to run ``seg[i]``
    (ascending), which starts with ``left[seg[i]]`` seats. Returns (seats left
    before each row, admitted per row, seats left after each run).

    In a round the requests that fit the seats now left are summed up within
    their runs (a cumulative sum less its value at the run's start); all rows
    up to the first one that exceeds the seats are decided. That one was larger
    than what is left now, so every round of a run refuses a smaller size than
    the last: there are at most as many rounds as different sizes, whatever the
    number of rows and runs.
    """
    left = left.astype(np.int64).copy()
    before, admitted = np.empty(len(seg), np.int64), np.zeros(len(seg), bool)
    rest = np.arange(len(seg))
    while len(rest):
        s = seg[rest]
        fits = ok[rest] & (sizes[rest] <= left[s])
        take = np.where(fits, sizes[rest], 0)
        total = np.cumsum(take)
        first = np.flatnonzero(np.diff(s, prepend=-1))
        base = np.repeat(total[first] - take[first], np.diff(first, append=len(s)))
        inside = total - base
        done = inside <= np.maximum(left[s], 0)  # never again true behind the first excess
        r = rest[done]
        before[r] = left[s[done]] - (inside - take)[done]
        admitted[r] = fits[done] & (before[r] > 0)
        used = np.zeros(len(left), np.int64)
        np.maximum.at(used, s[done], inside[done])
        left -= used
        rest = rest[~done]
    return before, admitted, left


def _transfer_from(state: np.ndarray, sizes: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Advance a transfer vector (seats left for each entry value) by the
    given requests: each different entry value is replayed with ``_decide``."""
    values, where = np.unique(state, return_inverse=True)
    return np.array([_decide(int(v), sizes, ok)[2] for v in values], dtype=np.int64)[where]


def admit_bookings(t, requests: DataFrame, partitions: int | None = None) -> DataFrame:
    """ADM-1: decide each booking request ``(request_id, event_id, user_id,
    requested_at, size, find_buddy)`` in (time, id) order within its event.

    Rejection reasons in the reference's order: ``no-event``; ``full`` (no
    seat left); ``too-many`` (size above seats left, or grouping > 2 and size
    above grouping); ``closed`` (requested after the start). Otherwise
    ``admitted``. Seats already taken are the event's non-canceled bookings
    (pending payment counts). ``find_buddy`` is kept only when grouping < 2.
    Output adds ``left_before``, ``admitted``, ``reason`` and ``left_after``.
    """
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = seats_filled(t.reservations)
    rows = _static_columns(requests, t.events, base)
    cols = ["request_id", "event_id", "user_id", "requested_at", "size", "find_buddy",
            "capacity", "grouping", "left0", "_exists", "_gviol", "_closed", "_ok"]
    sorted_rows = (rows.select(*cols)
                   .repartitionByRange(P, "event_id", "requested_at", "request_id")
                   .sortWithinPartitions("event_id", "requested_at", "request_id")
                   .checkpoint(eager=True)
                   .withColumn("pid", F.spark_partition_id()))

    # -- chunk statistics (a Spark aggregate, partial on the map side)
    chunks = (sorted_rows.groupBy("event_id", "pid")
              .agg(F.sum(F.when(F.col("_ok"), F.col("size")).otherwise(0)).alias("ok_sum"),
                   F.max(F.when(F.col("_ok"), F.col("size"))).alias("ok_max"),
                   F.first("left0").alias("left0")))
    spanning = chunks.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # fewer than P events can span partitions: at most 2P chunk rows below
    span_chunks = chunks.join(spanning.select("event_id"), "event_id", "left_semi")

    from pyspark.sql import Window
    w = Window.partitionBy("event_id").orderBy("pid")
    pre = (span_chunks
           .withColumn("sum_before", F.coalesce(F.sum("ok_sum").over(
               w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("left_all_in", F.col("left0") - F.col("sum_before"))
           .withColumn("overflows", F.col("left_all_in") < F.col("ok_sum")))
    first_over = (pre.filter("overflows").groupBy("event_id")
                  .agg(F.min("pid").alias("over_pid")))
    pre = pre.join(first_over, "event_id", "left")
    # After the overflowing chunk fewer seats are left than its largest request
    # had, and never more than came in: at most the event's seats.
    over_max = pre.filter(F.col("pid") == F.col("over_pid")).select(
        "event_id", F.least("ok_max", F.greatest(F.col("left_all_in"), F.lit(0)) + 1).alias("domain"))
    plan = (pre.join(over_max, "event_id", "left")
            .withColumn("kind", F.when(F.col("over_pid").isNull() | (F.col("pid") < F.col("over_pid")),
                                       "pre")
                        .when(F.col("pid") == F.col("over_pid"), "over").otherwise("post"))
            .select("event_id", "pid", "kind", "left_all_in",
                    F.coalesce("domain", F.lit(0)).cast("long").alias("domain")))
    # Everything below is a deterministic function of the checkpointed input
    # (partition ids included), so a recomputation after a lost executor
    # gives the same rows; the small plan is written because it is used twice.
    plan = plan.checkpoint()

    # -- per chunk summary of overflow / post chunks (spanning events only).
    # A partition arrives in Arrow batches, so the state of the current event
    # is carried from one batch to the next.
    def summarise(it):
        cur, kind, left, vec = None, None, None, None

        def flush():
            if cur is None:
                return None
            return pd.DataFrame({"event_id": [cur[0]], "pid": [cur[1]], "kind": [kind],
                                 "left_out": [left if kind == "over" else None],
                                 "vec": [vec.tolist() if kind == "post" else None]})

        for pdf in it:
            if pdf.empty:
                continue
            for (ev, pid), g in pdf.groupby(["event_id", "pid"], sort=False):
                if cur != (ev, pid):
                    out = flush()
                    if out is not None:
                        yield out
                    cur, kind = (ev, pid), g["kind"].iloc[0]
                    left = int(g["left_all_in"].iloc[0]) if kind == "over" else None
                    vec = (np.arange(int(g["domain"].iloc[0]), dtype=np.int64)
                           if kind == "post" else None)
                sizes = g["size"].to_numpy(np.int64)
                ok = g["_ok"].to_numpy(bool)
                if kind == "over":
                    _, _, left = _decide(left, sizes, ok)
                else:
                    vec = _transfer_from(vec, sizes, ok)
        out = flush()
        if out is not None:
            yield out

    # Only spanning events' chunks get here: at most two per partition.
    joined = sorted_rows.join(F.broadcast(plan.filter("kind <> 'pre'")), ["event_id", "pid"])
    summaries = joined.select("event_id", "pid", "kind", "left_all_in", "domain", "size",
                              "_ok").mapInPandas(summarise, _CHUNK_SCHEMA)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        out, left = [], None
        for _, r in pdf.iterrows():
            if r["kind"] == "over":
                out.append((r["event_id"], r["pid"], None))
                left = int(r["left_out"])
            else:
                out.append((r["event_id"], r["pid"], left))
                vec = r["vec"]
                # left <= 0 admits nothing, so it passes a chunk unchanged
                if left is not None and 0 <= left < len(vec):
                    left = int(vec[left])
        return pd.DataFrame(out, columns=["event_id", "pid", "left_post_in"])

    post_in = (summaries.groupBy("event_id")
               .applyInPandas(compose, "event_id bigint, pid int, left_post_in long"))
    entry = (plan.join(post_in, ["event_id", "pid"], "left")
             .select("event_id", "pid",
                     F.when(F.col("kind") == "post", F.col("left_post_in"))
                     .otherwise(F.col("left_all_in")).alias("left_in")))

    out_schema = T.StructType(
        [f for f in sorted_rows.drop("pid").schema.fields if not f.name.startswith("_")]
        + [T.StructField("left_before", T.LongType()), T.StructField("admitted", T.BooleanType()),
           T.StructField("reason", T.StringType()), T.StructField("left_after", T.LongType())])
    keep = [f.name for f in out_schema.fields[:-4]]

    def replay(it):
        cur, carried = None, None  # the event that a batch ended with, and its seats left
        for pdf in it:
            if pdf.empty:
                continue
            ev = pdf["event_id"].to_numpy()
            new = np.concatenate(([True], ev[1:] != ev[:-1]))
            seg, first = np.cumsum(new) - 1, np.flatnonzero(new)
            exists = pdf["_exists"].to_numpy(bool)
            start = pdf["left_in"].fillna(pdf["left0"]).fillna(0).to_numpy(np.int64)[first]
            if cur is not None and ev[0] == cur:
                start[0] = carried
            sizes = pdf["size"].to_numpy(np.int64)
            before, adm, left = decide_segments(seg, start, sizes, pdf["_ok"].to_numpy(bool))
            cur, carried = ev[-1], int(left[-1])
            large = (sizes > before) | pdf["_gviol"].to_numpy(bool)
            reason = np.select([~exists, before <= 0, large, pdf["_closed"].to_numpy(bool)],
                               ["no-event", "full", "too-many", "closed"], "admitted")
            res = pdf[keep].copy()
            res["left_before"] = pd.Series(before, dtype="Int64").where(exists)
            res["admitted"] = adm
            res["reason"] = reason
            res["left_after"] = pd.Series(before - np.where(adm, sizes, 0), dtype="Int64").where(exists)
            res["find_buddy"] = res["find_buddy"] & (pdf["grouping"].fillna(0) < 2)
            yield res

    final = sorted_rows.join(F.broadcast(entry), ["event_id", "pid"], "left")
    return final.mapInPandas(replay, out_schema)


# ------------------------------------------------------------------ MAT-1

_MATCH_SCHEMA = ("reservation_id long, event_id long, user_id long, kind string, chat_no int, "
                 "placed boolean, chat_fill int, chat_size int, chat_status string")


class _Chats:
    """First fit among the open chats of one kind of one event.

    Open chats stand in heaps by the room they have left, so the oldest one
    with room is found without looking at full ones; a chat leaves with its
    rows as soon as it is full.
    """

    def __init__(self, kind: str, size: int):
        self.kind, self.size, self.count = kind, size, 0
        self.rooms: dict[int, list[int]] = {}
        self.chats: dict[int, tuple[set, list]] = {}

    def rows(self, no: int, fill: int, status: str) -> list[tuple]:
        return [(rid, ev, user, self.kind, no, True, fill, self.size, status)
                for rid, ev, user in self.chats.pop(no)[1]]

    def place(self, rid, ev, user, weight: int) -> list[tuple]:
        """Put a booking into a chat; returns the rows that are final now."""
        if weight > self.size:
            return [(rid, ev, user, self.kind, None, False, None, self.size, None)]
        aside, found = [], None
        while found is None:
            best = min(((h[0], r) for r, h in self.rooms.items() if r >= weight), default=None)
            if best is None:
                self.count += 1
                found, room = self.count, self.size
                self.chats[found] = (set(), [])
                break
            no, room = best
            self._pop(room)
            if user in self.chats[no][0]:
                aside.append((no, room))
            else:
                found = no
        for no, r in aside:
            heappush(self.rooms.setdefault(r, []), no)
        users, rows = self.chats[found]
        users.add(user)
        rows.append((rid, ev, user))
        room -= weight
        if room == 0:
            return self.rows(found, self.size, "completed")
        heappush(self.rooms.setdefault(room, []), found)
        return []

    def _pop(self, room: int) -> None:
        heappop(self.rooms[room])
        if not self.rooms[room]:
            del self.rooms[room]

    def close(self) -> list[tuple]:
        """Rows of the chats that stay open."""
        return [row for r, h in self.rooms.items() for no in h
                for row in self.rows(no, self.size - r, "pending")]


def _match_partition(it):
    """Rows arrive sorted by (event, paid time, id); one event's open chats are
    kept until the next event starts, across Arrow batches."""
    cur, buddies, groups = None, None, None

    def close():
        return (buddies.close() + groups.close()) if cur is not None else []

    for pdf in it:
        out = []
        cols = [pdf[c].to_numpy() for c in
                ("reservation_id", "event_id", "user_id", "group_members", "find_buddy",
                 "grouping")]
        for rid, ev, user, members, buddy, grouping in zip(*cols):
            if ev != cur:
                out += close()
                cur = ev
                buddies = _Chats("buddy", 2)
                groups = _Chats("group", int(grouping) if grouping == grouping else 0)
            if buddy:
                out += buddies.place(rid, ev, user, 1)
            if groups.size >= 2:
                out += groups.place(rid, ev, user, int(members))
        if out:
            yield pd.DataFrame(out, columns=_MATCH_COLS)
    rest = close()
    if rest:
        yield pd.DataFrame(rest, columns=_MATCH_COLS)


_MATCH_COLS = ["reservation_id", "event_id", "user_id", "kind", "chat_no", "placed",
               "chat_fill", "chat_size", "chat_status"]


def match_groups(t, paid: DataFrame | None = None) -> DataFrame:
    """MAT-1: place paid bookings into buddy pairs and event group chats.

    Per event, in (paid time, id) order, first fit: a booking joins the
    oldest pending chat of its kind with room that the user is not in yet,
    else opens a new one. Buddy chats have size 2 and each buddy counts 1;
    group chats (events with grouping >= 2) have size = grouping and count
    the booking's members; a chat is ``completed`` when exactly full, and a
    booking larger than the chat size is not placed. Chat expiry is the event
    end (or start) plus one week.

    This builds the reference's intent: its group lookup always returns a row
    and its chat insert is malformed, so it cannot run as written.
    """
    res = paid if paid is not None else t.reservations.filter(
        F.col("status").isin("paid", "need-approval"))
    ev = t.events.select(F.col("id").alias("event_id"), "grouping", "start_time", "end_time")
    rows = (res.select(F.col("id").alias("reservation_id"), "event_id", "user_id",
                       "group_members", "find_buddy",
                       F.col("updated_at").alias("paid_at"))
            .join(ev.select("event_id", "grouping"), "event_id"))
    # Only bookings that can be placed enter the per-event state.
    rows = (rows.filter(F.col("find_buddy") | (F.col("grouping") >= 2))
            .repartition("event_id")
            .sortWithinPartitions("event_id", "paid_at", "reservation_id"))
    matched = rows.mapInPandas(_match_partition, _MATCH_SCHEMA)
    expiry = ev.select("event_id",
                       plus_week(F.coalesce("end_time", "start_time")).alias("chat_expires_on"))
    return matched.join(expiry, "event_id", "left")
