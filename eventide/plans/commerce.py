"""Pricing, settlement and code audits: PRC-1, STL-1, OTP-1 (batch jobs).

All three are joins and per-key aggregates. "First row per key" is a ``min``
of a struct (partial aggregation on the map side), never a window over a
possibly hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.stats import code_usage
from eventide.operators.throttle import throttle
from eventide.operators.windows import first_per
from eventide.sources.sinks import apply_updates

MONEY = "decimal(18,2)"


def discount_amount(price, percent, dmax, constant):
    """Amount of a code on a price: percent of price (capped by a non-zero
    max) when the percent is non-zero, else the constant."""
    pct = F.round(price.cast(MONEY) * percent / F.lit(100), 2).cast(MONEY)
    capped = F.when((dmax.isNotNull()) & (dmax != 0), F.least(pct, dmax.cast(MONEY))).otherwise(pct)
    return F.when(F.coalesce(percent, F.lit(0)) != 0, capped).otherwise(
        F.coalesce(constant, F.lit(0)).cast(MONEY))


def discount_quotes(t, requests: DataFrame, as_of: str) -> DataFrame:
    """PRC-1: quote each (request_id, code, event_id) request.

    Verdict in order: ``not-found`` (no code with that text; codes are not
    unique, the lowest id wins), ``expired`` (expires_on < as-of),
    ``out-of-scope`` (a set event / category / leader differs from the
    *target* event's), ``used-up`` (capacity > 0 and seats already sold under
    the code >= capacity), else ``ok``. Amount and final price only for ok;
    final = max(0, event price - amount), per booking (not times group size).

    Deviation from the reference, on purpose: it joins the code's own event,
    so category codes never apply, and its leader test reads a parameter the
    booking path does not pass; here scope and price use the target event.
    """
    codes = first_per(t.discount_codes, "code", ["id"],
                      ["id", "expires_on", "event_id", "category_id", "leader_id", "capacity",
                       "discount_percent", "discount_max", "discount_constant"], prefix="c_")
    usage = code_usage(t.reservations).select(F.col("discount_code_id").alias("c_id"),
                                              F.col("filled").alias("c_filled"))
    ev = t.events.select(F.col("id").alias("event_id"), F.col("price").alias("e_price"),
                         F.col("category_id").alias("e_category_id"),
                         F.col("leader_id").alias("e_leader_id"))
    q = (requests.join(codes, "code", "left").join(usage, "c_id", "left")
         .join(ev, "event_id", "left"))
    now = F.lit(as_of).cast("timestamp_ntz")
    filled = F.coalesce(F.col("c_filled"), F.lit(0))
    scope_bad = ((F.col("c_event_id").isNotNull() & (F.col("c_event_id") != F.col("event_id")))
                 | (F.col("c_category_id").isNotNull()
                    & ~F.col("c_category_id").eqNullSafe(F.col("e_category_id")))
                 | (F.col("c_leader_id").isNotNull()
                    & ~F.col("c_leader_id").eqNullSafe(F.col("e_leader_id"))))
    verdict = (F.when(F.col("c_id").isNull(), "not-found")
               .when(F.col("c_expires_on") < now, "expired")
               .when(scope_bad, "out-of-scope")
               .when((F.col("c_capacity") > 0) & (filled >= F.col("c_capacity")), "used-up")
               .otherwise("ok"))
    amount = discount_amount(F.col("e_price"), F.col("c_discount_percent"),
                             F.col("c_discount_max"), F.col("c_discount_constant"))
    q = q.withColumn("verdict", verdict)
    ok = F.col("verdict") == "ok"
    return q.select("request_id", "code", "event_id", F.col("c_id").alias("code_id"), "verdict",
                    F.when(ok, amount).alias("amount"),
                    F.when(ok, F.greatest(F.lit(0).cast(MONEY),
                                          F.col("e_price").cast(MONEY) - amount)).alias(
                        "final_price"))


def settle_batch(t, confirmations: DataFrame):
    """STL-1: apply payment confirmations ``(conf_id, authority, confirmed_at)``.

    The first confirmation of an authority (by time, then id) settles its
    transaction unless it is already paid; later ones are ``duplicate``.
    A settled transaction becomes paid with ``paid_at`` = confirmation time
    and a deterministic ``ref_id``; its reservation becomes ``need-approval``
    when the event needs approval, else ``paid``. Settling twice changes
    nothing the second time (the transaction is then already paid).

    Returns (verdicts, new transactions snapshot, new reservations snapshot).
    """
    tx = first_per(t.transactions, "authority", ["id"], ["id", "status", "reservation_id"],
                   prefix="t_")
    firsts = first_per(confirmations, "authority", ["confirmed_at", "conf_id"], ["conf_id"],
                       prefix="first_")
    res = t.reservations.select(F.col("id").alias("t_reservation_id"),
                                F.col("event_id").alias("r_event_id"))
    ev = t.events.select(F.col("id").alias("r_event_id"), "is_approval")
    v = (confirmations.join(firsts, "authority", "left").join(tx, "authority", "left")
         .join(res, "t_reservation_id", "left").join(ev, "r_event_id", "left"))
    verdict = (F.when(F.col("conf_id") != F.col("first_conf_id"), "duplicate")
               .when(F.col("t_id").isNull(), "not-found")
               .when(F.col("t_status") == "paid", "already-paid")
               .otherwise("settled"))
    v = v.withColumn("verdict", verdict)
    settled = F.col("verdict") == "settled"
    verdicts = v.select(
        "conf_id", "authority", "confirmed_at", "verdict",
        F.col("t_id").alias("transaction_id"), F.col("t_reservation_id").alias("reservation_id"),
        F.when(settled, F.when(F.col("is_approval"), "need-approval").otherwise("paid"))
        .alias("reservation_status"),
        F.when(settled, F.lit(100_000_000_000) + F.col("t_id")).alias("ref_id"))
    done = verdicts.filter(F.col("verdict") == "settled")
    tx_updates = done.select(F.col("transaction_id").alias("id"), F.lit("paid").alias("status"),
                             "ref_id", F.col("confirmed_at").alias("paid_at"),
                             F.col("confirmed_at").alias("updated_at"))
    res_updates = done.filter(F.col("reservation_id").isNotNull()).select(
        F.col("reservation_id").alias("id"), F.col("reservation_status").alias("status"),
        F.col("confirmed_at").alias("updated_at"))
    new_tx = apply_updates(t.transactions, tx_updates, "id", "updated_at")
    new_res = apply_updates(t.reservations, res_updates, "id", "updated_at")
    return verdicts, new_tx, new_res


def otp_match(issued: DataFrame, attempts: DataFrame) -> DataFrame:
    """JN-15 / ST-2 batch twin: each attempt ``(id, phone, code, user_ip,
    attempted_at)`` against issued codes of the same phone, code and ip that
    were created before it; the newest such code (by expires_at) is the match.
    ``ok`` when the attempt is before expiry, else ``expired``; ``wrong`` when
    there is none. Only the first ``ok`` attempt uses a code; later ones are
    ``reused``.
    """
    # An as-of join without pairs: codes and attempts of one (phone, code, ip) in
    # one line of time; the newest code before an attempt is a running maximum
    # inside the hour, or else the newest of the hours before.
    key = ["phone", "code", "user_ip"]
    code = F.struct("expires_at", F.col("id").alias("otp_id"))
    lines = issued.select(*key, F.col("created_at").alias("at"), code.alias("issue"),
                          F.lit(None).cast("long").alias("attempt_id")).union(
        attempts.select(*key, F.col("attempted_at").alias("at"),
                        F.lit(None).cast("struct<expires_at:bigint,otp_id:bigint>"), "id"))
    known = F.lit(True)
    for c in key:  # a NULL matches nothing
        known = known & F.col(c).isNotNull()
    lines = (lines.withColumn("issue", F.when(known, F.col("issue")))
             .withColumn("hour", F.floor(F.unix_timestamp("at") / 3600)))
    first_codes = F.col("attempt_id").isNotNull()  # at equal times codes come first
    inside = Window.partitionBy(*key, "hour").orderBy("at", first_codes, "attempt_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hours = lines.groupBy(*key, "hour").agg(F.max("issue").alias("top"))
    before = Window.partitionBy(*key).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("carry", F.max("top").over(before)).filter("carry IS NOT NULL").drop("top")
    found = lines.withColumn("own", F.max("issue").over(inside)).filter("attempt_id IS NOT NULL")
    found = found.join(hours, [*key, "hour"], "left").withColumn("b", F.greatest("own", "carry"))
    m = found.select("attempt_id", "phone", F.col("at").alias("attempted_at"),
                     F.unix_timestamp("at").alias("att_epoch"), F.col("b.otp_id").alias("otp_id"),
                     F.col("b.expires_at").alias("expires_at"))
    m = m.withColumn("status", F.when(F.col("otp_id").isNull(), "wrong")
                     .when(F.col("att_epoch") < F.col("expires_at"), "ok").otherwise("expired"))
    first_ok = (m.filter(F.col("status") == "ok").groupBy("otp_id")
                .agg(F.min(F.struct("attempted_at", "attempt_id")).alias("f"))
                .select("otp_id", F.col("f.attempt_id").alias("first_ok")))
    return (m.join(first_ok, "otp_id", "left")
            .withColumn("status", F.when((F.col("status") == "ok")
                                         & (F.col("attempt_id") != F.col("first_ok")), "reused")
                        .otherwise(F.col("status")))
            .drop("first_ok", "att_epoch"))


def otp_audit(issued: DataFrame, attempts: DataFrame) -> DataFrame:
    """OTP-1: per phone, code requests, those of them that the throttle refuses
    (a code of the phone and page was alive and unused; an ``ok`` attempt uses
    the code it matched), and the attempt outcomes."""
    m = otp_match(issued, attempts).checkpoint()
    uses = (m.filter("status = 'ok'").join(issued.select(F.col("id").alias("otp_id"), "page"), "otp_id")
            .select("phone", "page", F.col("attempted_at").alias("used_at")))
    req = throttle(issued, uses).groupBy("phone").agg(
        F.count(F.lit(1)).alias("requests"), F.sum((~F.col("accepted")).cast("int")).alias("throttled"))
    att = m.groupBy("phone").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.sum((F.col("status") == "ok").cast("int")).alias("matched"),
        F.sum((F.col("status") == "expired").cast("int")).alias("expired"),
        F.sum((F.col("status") == "wrong").cast("int")).alias("wrong"),
        F.sum((F.col("status") == "reused").cast("int")).alias("reused"))
    out = req.join(att, "phone", "full")
    return out.select("phone", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                 for c in ["requests", "throttled", "attempts", "matched", "expired", "wrong",
                                           "reused"]])
