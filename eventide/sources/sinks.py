"""Writes re-aimed as snapshot jobs (SNK-2..6).

The reference updates rows one request at a time inside MySQL transactions.
Here a change set is a DataFrame and every write produces a complete new
snapshot (written once, e.g. ``df.write.mode("overwrite").parquet``), so a
failed job leaves the previous snapshot untouched and a retried task
recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.session import children, ensure_checkpoint_dir, remove, replace

HASH = "_key_hash"


def by_hash(df: DataFrame, key: str) -> DataFrame:
    """The key's hash as column ``HASH``. Grouped or joined by it and the key, rows are
    sorted by a number: keys that begin alike are not compared byte by byte."""
    return df.withColumn(HASH, F.xxhash64(key))


def apply_updates(base: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-3: keyed update as a snapshot merge.

    The latest update per key (by ``order``, then by its own values) wins;
    updated columns replace the base values, other columns are kept.
    Keys absent from ``base`` are ignored (an UPDATE touches existing rows).
    """
    cols = [c for c in updates.columns if c != key]
    latest = (by_hash(updates, key).groupBy(HASH, key)
              .agg(F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols]))
                   .alias("_u")))
    merged = by_hash(base, key).join(latest, [HASH, key], "left")
    out = []
    for c in base.columns:
        if c in cols:
            out.append(F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c))
                       .alias(c))
        else:
            out.append(F.col(c))
    return merged.select(*out)


# ------------------------------------------------- SNK-3 on a table in key buckets

BUCKET = "key_bucket"


def bucket_of(key: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write (again) a keyed table as one folder per bucket of its key's hash.
    Every task writes its rows of all buckets: there may be fewer buckets than cores,
    and a bucket is as many files as there are tasks."""
    remove(df.sparkSession, f"{path}-merge")
    (df.withColumn(BUCKET, bucket_of(key, buckets))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(path))


def read_buckets(spark: SparkSession, path: str, touched: list[int] | None = None) -> DataFrame | None:
    """The table, or only its ``touched`` buckets (other folders are not read);
    None if it holds no bucket at all."""
    _finish_merge(spark, path)
    if not any(n.startswith(BUCKET) for n in children(spark, path)):
        return None
    df = spark.read.parquet(path)
    return (df if touched is None else df.filter(F.col(BUCKET).isin(touched))).drop(BUCKET)


def touched_buckets(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """Buckets that hold a key of ``rows``: at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def merge_buckets(spark: SparkSession, path: str, updates: DataFrame, key: str, order: str,
                  buckets: int) -> list[int]:
    """SNK-3 in place: ``apply_updates`` on the buckets that hold an update; the
    others are neither read nor written. Returns the rewritten buckets.

    The new buckets are first written whole beside the table, then their folders are
    moved into its place, so a row is written once. A merge that was cut short is finished (or, if the new buckets were not yet
    whole, forgotten) before the table is read again, and merging the same updates
    twice changes nothing. One writer at a time. ``updates`` is evaluated twice.
    """
    touched = touched_buckets(updates, key, buckets)
    base = read_buckets(spark, path, touched)
    if not touched or base is None:
        return []
    write_buckets(apply_updates(base, updates, key, order), f"{path}-merge", key, buckets)
    _finish_merge(spark, path)
    return touched


def _finish_merge(spark: SparkSession, path: str) -> None:
    ready = children(spark, f"{path}-merge")
    if "_SUCCESS" in ready:  # a bucket that is gone from here is in place already
        for n in ready:
            if n.startswith(BUCKET):
                replace(spark, f"{path}/{n}", f"{path}-merge/{n}")
    if ready:
        remove(spark, f"{path}-merge")


def delete_keys(base: DataFrame, keys: DataFrame) -> DataFrame:
    """SNK-4: delete rows matching every column of ``keys`` (e.g. uuid and
    uploader), as a left anti join."""
    return base.join(keys, keys.columns, "left_anti")


def cascade_delete(messages: DataFrame, removed_conversations: DataFrame | None = None,
                   removed_users: DataFrame | None = None,
                   removed_messages: DataFrame | None = None) -> DataFrame:
    """SNK-5: ON DELETE CASCADE of messages by conversation, by sender and by
    the message replied to (transitively).

    Reply chains are followed one level per round with a semi join; each
    round's frontier is checkpointed so lineage stays short. Stops when a
    round removes nothing: chains of any depth are followed, and a cycle ends
    too, since every round takes rows out of what is kept.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    keep = messages
    if removed_conversations is not None:
        keep = keep.join(removed_conversations.select(F.col(removed_conversations.columns[0])
                                                      .alias("conversation_id")),
                         "conversation_id", "left_anti")
    if removed_users is not None:
        keep = keep.join(removed_users.select(F.col(removed_users.columns[0]).alias("sender_id")),
                         "sender_id", "left_anti")
    gone = messages.join(keep.select("id"), "id", "left_anti").select("id")
    if removed_messages is not None:
        gone = gone.unionByName(removed_messages.select(F.col(removed_messages.columns[0])
                                                        .alias("id"))).distinct()
    keep = keep.join(gone, "id", "left_anti")
    frontier = gone
    while True:
        hit = keep.join(frontier.select(F.col("id").alias("reply_to")), "reply_to", "left_semi")
        hit = hit.select("id").checkpoint()
        if hit.isEmpty():
            return keep
        keep = keep.join(hit, "id", "left_anti").checkpoint()
        frontier = hit


# A multiplier without the factors 2 and 5 permutes the numbers below any 10**d;
# with ids below 10**12 the products stay within 64 bits.
CODE_FACTOR, CODE_SHIFT, CODE_DIGITS = 7_368_787, 104_729, 12


def code_number(key, digits: int = CODE_DIGITS) -> F.Column:
    """Place of a key in the code space: a permutation of 0 .. 10**digits - 1."""
    return F.pmod(key * CODE_FACTOR + CODE_SHIFT, F.lit(10 ** digits))


def assign_codes(df: DataFrame, key: str, existing: DataFrame | None = None,
                 prefix: str = "RES_", digits: int = CODE_DIGITS, out: str = "code") -> DataFrame:
    """SNK-6: deterministic unique codes ``prefix`` + ``digits`` digits.

    A bijection of the integer key on the code space, so codes cannot collide
    and nothing is shuffled. Codes that clash with ``existing`` (AGG-11's
    count of rows with this code) move on: the key plus a whole number of key
    ranges is coded instead, until no clash is left; only clashing keys take
    part in that. Raises when a key is negative or does not fit the space, or
    when no free range is left (``digits``: at most 12).
    """
    space = 10 ** digits
    if not 1 <= digits <= 12:
        raise ValueError("digits must be 1 to 12")
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    if low < 0 or high >= space:
        raise ValueError(f"keys {low} .. {high} do not fit {digits} digits")

    def coded(d: DataFrame, turn: int) -> DataFrame:
        n = code_number(F.col(key).cast("long") + turn * (high + 1), digits)
        return d.withColumn(out, F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0")))

    whole = coded(df, 0)
    if existing is None:
        return whole
    ensure_checkpoint_dir(df.sparkSession)
    taken = existing.select(F.col(existing.columns[0]).alias(out)).distinct()
    done, rest, turn = whole.join(taken, out, "left_anti"), whole.join(taken, out, "left_semi"), 1
    rest = rest.checkpoint()
    while not rest.isEmpty():
        if (turn + 1) * (high + 1) > space:
            raise RuntimeError("code space too full to assign unique codes")
        again = coded(rest.drop(out), turn)
        done = done.unionByName(again.join(taken, out, "left_anti"))
        rest, turn = again.join(taken, out, "left_semi").checkpoint(), turn + 1
    return done.select(*df.columns, out)


def authority_code(amount, key) -> F.Column:
    """SNK-6: payment authority: 'A' (or 'F' for a zero amount) + 35 chars,
    left padded with '0', derived from the key's MD5 (not random)."""
    body = F.lpad(F.md5(key.cast("string")), 35, "0")
    return F.concat(F.when(amount > 0, F.lit("A")).otherwise(F.lit("F")), body)


def explode_group_members(requests: DataFrame, members_col: str = "group_members_list",
                          key: str = "reservation_id") -> tuple[DataFrame, DataFrame]:
    """SNK-2: child rows, one per group member, from an array<struct> column, as
    (accepted, quarantine). A member without a first or last name goes to
    quarantine with the missing fields in ``missing``; no member is lost."""
    rows = requests.select(key, F.inline(members_col))
    absent = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c))
              for c in ("first_name", "last_name")]
    rows = rows.withColumn("missing", F.array_compact(F.array(*absent)))
    return rows.filter(F.size("missing") == 0).drop("missing"), rows.filter(F.size("missing") > 0)
