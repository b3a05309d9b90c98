"""The throttle against a plain loop: uses, hot keys, many partitions and small batches."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from eventide.operators.throttle import throttle

BASE = dt.datetime(2024, 1, 1)


def loop(rows, uses=()):
    """id -> accepted; a used code frees its (phone, page)."""
    line = [(r["created_at"], 0, r["id"], (r["phone"], r["page"])) for r in rows]
    line += [(u["used_at"], 1, 0, (u["phone"], u["page"])) for u in uses]
    live, out = {}, {}
    for at, kind, id_, key in sorted(line, key=lambda x: x[:3]):
        s = int((at - BASE).total_seconds())
        if kind:
            live.pop(key, None)
        elif key in live and s < live[key]:
            out[id_] = False
        else:
            out[id_], live[key] = True, s + 120
    return out


def some(seed, n=600):
    rnd = random.Random(seed)

    def key():
        return dict(phone=rnd.choice(["hot"] * 5 + ["a", "b", None]), page=rnd.choice(["login", "login", None]))

    def at():
        return BASE + dt.timedelta(milliseconds=rnd.randrange(0, 4_000_000, 500))

    rows = [dict(id=i, created_at=at(), **key()) for i in range(n)]
    return rows, [dict(used_at=at(), **key()) for _ in range(n // 4)]


@pytest.mark.parametrize("parts, batch", [(1, 10_000), (16, 10_000), (16, 3), (3, 7)])
@pytest.mark.parametrize("used", [False, True])
def test_equals_the_loop(spark, parts, batch, used):
    rows, uses = some(parts + batch)
    df = spark.createDataFrame(rows, "id long, phone string, page string, created_at timestamp_ntz")
    u = spark.createDataFrame(uses, "phone string, page string, used_at timestamp_ntz") if used else None
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch),
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = throttle(df, u).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert {r.id: r.accepted for r in got} == loop(rows, uses if used else ())
    assert all((r.expires_at is not None) == r.accepted for r in got)


def test_state_and_empty(spark):
    kind = "id long, phone string, page string, created_at timestamp_ntz"
    s = int((BASE - dt.datetime(1970, 1, 1)).total_seconds())
    df = spark.createDataFrame([(1, "a", "p", BASE), (2, "a", "p", BASE + dt.timedelta(seconds=50)),
                                (3, "b", "p", BASE)], kind)
    state = spark.createDataFrame([("a", "p", s + 30), ("c", "p", s + 99)], "phone string, page string, live long")
    got = {r.id: (r.accepted, r.expires_at) for r in throttle(df, state=state).collect()}
    assert got == {1: (False, None), 2: (True, s + 170), 3: (True, s + 120)}
    assert throttle(df.limit(0)).count() == 0
    u = spark.createDataFrame([("a", "p", BASE + dt.timedelta(seconds=-5))], "phone string, page string, used_at timestamp_ntz")
    assert {r.id: r.accepted for r in throttle(df, u, state).collect()} == {1: True, 2: False, 3: True}
