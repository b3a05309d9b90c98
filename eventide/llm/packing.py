"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. A document longer
than the largest is cut into full sequences and a rest. Pieces are placed in
descending length into the open bin they leave the least room in; where none
fits, a bin is opened whose size has the least cost per token when it is
filled with what is still unplaced. At the end each bin shrinks to the
smallest permitted size that holds its contents. Shards of bounded size, cut
by a hash, are packed independently, so work is spread evenly at any scale.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare

SIZES = (1024, 2048, 4096, 8192)


def sequence_cost(size: int, largest: int, attention: float) -> float:
    """Cost of one sequence: linear in its size, plus attention's quadratic share."""
    return size + attention * size * size / largest


class _Left:
    """Lengths still unplaced, with their counts."""

    def __init__(self, lengths: np.ndarray):
        values, counts = np.unique(lengths, return_counts=True)
        self.values, self.counts = values.tolist(), dict(zip(values.tolist(), counts.tolist()))

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            del self.counts[n]
            del self.values[bisect_left(self.values, n)]

    def fill(self, room: int) -> int:
        """Tokens that the largest fitting pieces, again and again, bring into ``room``."""
        used, at = 0, bisect_right(self.values, room)
        while at:
            v = self.values[at - 1]
            used += v * min(self.counts[v], (room - used) // v)
            at = min(at - 1, bisect_right(self.values, room - used))
        return used


def pack(lengths: np.ndarray, sizes=SIZES, attention: float = 0.25):
    """Bin and offset of every piece, and the size of every bin."""
    sizes = sorted(sizes)
    cost = {s: sequence_cost(s, sizes[-1], attention) for s in sizes}
    down = lambda n: sizes[bisect_left(sizes, n)]
    left, rooms, bins_at = _Left(lengths), [], {}
    used: list[int] = []
    room: list[int] = []
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        left.take(n)
        at = bisect_left(rooms, n)
        if at < len(rooms):  # the open bin with the least room left
            r = rooms[at]
            b = heappop(bins_at[r])  # ties: the bin opened first
            if not bins_at[r]:
                del bins_at[r]
                del rooms[at]
        else:
            best = min((cost[down(full)] / full, s) for s in sizes[bisect_left(sizes, n):]
                       for full in (n + left.fill(s - n),))
            b, r = len(used), best[1]
            used.append(0)
            room.append(r)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        r -= n
        if r:
            if r not in bins_at:
                rooms.insert(bisect_left(rooms, r), r)
            heappush(bins_at.setdefault(r, []), b)
    return bin_of, offset, np.array([down(u) for u in used], np.int64)


def pack_documents(spark: SparkSession, lengths: DataFrame, *, key: str = "doc_id",
                   length: str = "length", sizes=SIZES, attention: float = 0.25,
                   shard_rows: int = 4096) -> DataFrame:
    """Rows (key, doc_length, copy, piece, start, length, bin_id, bin_size, bin_offset).

    Every document appears with all its pieces; key, ``doc_length`` and ``copy``
    name it. Defined results: a NULL or
    zero length has one row with length 0 and no bin; equal rows are told apart
    by ``copy`` (0, 1, ...); ties are placed in the order of key, length,
    copy and piece; an empty table stays empty; other columns are not read. ``shard_rows``
    is the expected number of pieces in a shard.
    """
    prepare(spark)
    most = max(sizes)
    rows = (lengths.select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
            .groupBy("key", "n").agg(F.count("*").alias("copies")))
    pieces = (rows.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
              .withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (n - 1) div {most}))")))
              .withColumn("start", F.col("piece") * most)
              .withColumn("length", F.least(F.lit(most).cast("long"), F.col("n") - F.col("start")))
              .select("key", F.col("n").alias("doc_length"), "copy", "piece", "start", "length")
              .checkpoint())
    real = pieces.filter("length > 0")
    shards = max(1, -(-real.count() // shard_rows))
    shard = F.pmod(F.xxhash64("key", "doc_length", "copy", "piece"), F.lit(shards))

    def place(pdf):
        pdf = pdf.sort_values(["key", "doc_length", "copy", "piece"], kind="stable", ignore_index=True)
        b, at, size = pack(pdf["length"].to_numpy(), sizes, attention)
        return pdf.drop(columns="shard").assign(
            bin_id=pdf["shard"].to_numpy() * (1 << 24) + b, bin_size=size[b], bin_offset=at)

    kind = lengths.schema[key].dataType.simpleString()
    out = (real.withColumn("shard", shard).groupBy("shard")
           .applyInPandas(place, f"key {kind}, doc_length long, copy long, piece long, start long, length long, "
                                 "bin_id long, bin_size long, bin_offset long"))
    none = F.lit(None).cast("long")
    rest = pieces.filter("length <= 0").select(
        "key", "doc_length", "copy", "piece", "start", F.lit(0).cast("long"), none, none, none)
    return out.union(rest).withColumnRenamed("key", key)


def byte_lengths(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Length of each text in UTF-8 bytes: its tokens under a byte vocabulary."""
    return docs.select(key, F.octet_length(F.col(text)).cast("long").alias("length"))


def packing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Packing of every whole document, one row per piece."""
    return pack_documents(spark, byte_lengths(docs))
