"""Code requests throttled by live codes (the rule of ST-1 and OTP-1).

A request of a (phone, page) is accepted if no unused code of it is alive; an
accepted one issues a code that lives 120 s, and its use ends it at once. The
rule is sequential per key and one key may hold any part of the rows, so rows
(requests and uses) are range-partitioned by (phone, page, time, id) and one key
spans tasks. Inside a task every request knows the request that would be accepted
next after it - the first one 120 s later, or the first one after the next use -
and all keys of an Arrow batch walk along these jumps together. Each task sums up
what its first key's rows do to each of the 121 ways a code can still be alive
when they begin; chained over the tasks (one small row each, whatever the number
of requests) that gives every task its true start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.operators.ranks import ranged

CODE_LIFETIME_S = 120   # fixed value: lifetime of a one-time code
FREE = -(1 << 60)       # no live code: below every time


class _Runs:
    """Rows of one batch, sorted by key and time, with their jumps."""

    def __init__(self, phone: np.ndarray, page: np.ndarray, secs: np.ndarray, request: np.ndarray):
        n = len(secs)
        self.n, self.secs, self.request = n, secs.astype(np.int64), request.astype(bool)
        new = np.ones(n, bool)
        new[1:] = (phone[1:] != phone[:-1]) | (page[1:] != page[:-1])
        self.seg, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.end = np.append(self.first[1:], n)
        self.keys = [(phone[i], page[i]) for i in (self.first[0], self.first[-1])]
        self.low = int(self.secs.min())
        self.span = int(self.secs.max()) - self.low + 2 * CODE_LIFETIME_S + 2
        self.line = self.seg * self.span + (self.secs - self.low)
        at = np.arange(n)

        def following(mask):
            """First row at or behind each place where the mask holds, n if none."""
            x = np.append(np.where(mask, at, n), n)
            return np.minimum.accumulate(x[::-1])[::-1]

        self.next_request = following(self.request)
        self.next_use = following(~self.request)
        after = np.searchsorted(self.line, self.line + CODE_LIFETIME_S)
        jump = self.next_request[np.minimum(after, np.minimum(self.next_use[1:] + 1, n))]
        self.jump = np.where(jump < self.end[self.seg], jump, n)

    def entry(self, k, live: np.ndarray) -> np.ndarray:
        """Row accepted first in the run ``k`` for each live time, n if none."""
        to = np.clip(live - self.low, 0, self.span)
        row = np.searchsorted(self.line, k * self.span + to)
        row = self.next_request[np.minimum(row, np.minimum(self.next_use[self.first[k]] + 1, self.n))]
        return np.where(row < self.end[k], row, self.n)

    def walk(self, row: np.ndarray, taken: np.ndarray | None = None) -> np.ndarray:
        """Last row accepted from each first one on (n stays n); marks them all in ``taken``."""
        last, open_ = row.copy(), np.flatnonzero(row < self.n)
        while len(open_):
            here = last[open_]
            if taken is not None:
                taken[here] = True
            to = self.jump[here]
            open_ = open_[to < self.n]
            last[open_] = to[to < self.n]
        return last

    def leave(self, k: int, live: np.ndarray, last: np.ndarray) -> np.ndarray:
        """When the run's code ends, given the live time it began with and its last accepted row."""
        row = np.where(last < self.n, last, self.first[k])
        used = self.next_use[np.where(last < self.n, row + 1, row)] < self.end[k]
        out = np.where(last < self.n, self.secs[row] + CODE_LIFETIME_S, live)
        return np.where(used, FREE, out)


def _runs(pdf: pd.DataFrame) -> _Runs:
    return _Runs(pdf["phone"].to_numpy(object), pdf["page"].to_numpy(object), pdf["s"].to_numpy(), pdf["request"].to_numpy())


def _live(pdf: pd.DataFrame, rows) -> np.ndarray:
    return pdf["live"].fillna(FREE).to_numpy(np.int64)[rows]


def _summarise(it):
    first = last = pid = base = vec = None
    live, start = FREE, FREE
    for pdf in it:
        if not len(pdf):
            continue
        r = _runs(pdf)
        head, tail = r.keys
        if first is None:
            first, last, pid, base = head, head, int(pdf["pid"].iloc[0]), int(r.secs[0])
            start = int(_live(pdf, [0])[0])
            vec = base + np.arange(CODE_LIFETIME_S + 1)
        if head == first:
            vec = r.leave(0, vec, r.walk(r.entry(0, vec)))
        if tail != first:
            k = len(r.first) - 1
            come = np.array([live]) if k == 0 and tail == last else _live(pdf, [r.first[k]])
            live = int(r.leave(k, come, r.walk(r.entry(k, come)))[0])
        last = tail
    if first is not None:
        yield pd.DataFrame({"pid": [pid], "k1": [repr(first)], "k2": [repr(last)], "base": [base],
                            "vec": [vec.tolist()], "live": [live], "start": [start]})


def throttle(requests: DataFrame, uses: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """Requests ``(id, phone, page, created_at)`` with ``accepted`` and, for those
    that are, ``expires_at`` (epoch seconds), in (time, id) order per (phone, page).

    ``uses`` ``(phone, page, used_at)`` end the key's live code, of requests made
    at that time or before. ``state`` ``(phone, page, live)`` are codes alive from
    before. A NULL phone or page is a value like any other.
    """
    keys = ["phone", "page"]
    rows = requests.select("id", *keys, F.col("created_at").alias("at"), F.lit(True).alias("request"))
    if uses is not None:
        rows = rows.unionByName(uses.select(F.lit(None).cast(requests.schema["id"].dataType).alias("id"), *keys,
                                            F.col("used_at").alias("at"), F.lit(False).alias("request")))
    # Wall-clock times count as UTC, whatever the session's zone.
    rows = rows.withColumn("s", F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000).cast("long"))
    if state is None:
        rows = rows.withColumn("live", F.lit(None).cast("long"))
    else:
        rows = rows.alias("r").join(state.alias("l"), F.col("r.phone").eqNullSafe(F.col("l.phone"))
                                    & F.col("r.page").eqNullSafe(F.col("l.page")), "left").select("r.*", "l.live")
    rows = ranged(rows, *keys, "at", F.col("request").desc(), "id").withColumn("pid", F.spark_partition_id())
    parts = rows.select("pid", *keys, "s", "request", "live").mapInPandas(
        _summarise, "pid int, k1 string, k2 string, base long, vec array<bigint>, live long, start long").collect()
    starts: dict[int, int] = {}
    key, live = None, FREE
    for r in sorted(parts, key=lambda r: r.pid):  # one row per task
        starts[r.pid] = live if r.k1 == key else r.start
        way = min(max(starts[r.pid] - r.base, 0), CODE_LIFETIME_S)
        live = (r.vec[way] if r.k1 == r.k2 else r.live)
        key = r.k2

    kind = requests.select("id", *keys, "created_at").schema

    def decide(it):
        last, live = None, FREE
        for pdf in it:
            if not len(pdf):
                continue
            r = _runs(pdf)
            come = _live(pdf, r.first)
            if last is None:
                come[0] = starts[int(pdf["pid"].iloc[0])]
            elif r.keys[0] == last:
                come[0] = live
            taken = np.zeros(r.n, bool)
            ends = r.walk(r.entry(np.arange(len(r.first)), come), taken)
            k = len(r.first) - 1
            last, live = r.keys[1], int(r.leave(k, come[k:], ends[k:])[0])
            out = pdf.loc[r.request, ["id", *keys, "at"]].rename(columns={"at": "created_at"})
            mine = taken[r.request]
            out["accepted"] = mine
            out["expires_at"] = pd.Series(r.secs[r.request] + CODE_LIFETIME_S, out.index, "Int64").where(mine)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return rows.mapInPandas(decide, f"{fields}, accepted boolean, expires_at long")
