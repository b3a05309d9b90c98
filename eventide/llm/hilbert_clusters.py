"""Centroid clustering over zone maps along a space-filling curve.

Vectors become integers, so every distance, sum and mean is exact. They are
ordered along a Hilbert curve through the leading principal directions of a
bounded sample and cut into blocks of neighbours; each block keeps the box
(least and greatest value of every component) around its vectors and their sum.
In a round, the box tells which centroids can be nearest to any of the block's
vectors: a centroid falls out when its least distance to the box exceeds
another's greatest one, or when the whole box lies on the other's side of the
plane between the two. Vectors are compared with the remaining centroids only,
exactly; a block with one candidate is added as a whole by its sum.

The sample and the curve decide only which vectors share a block, never a
result. Blocks are cut from a range partitioning with a tie breaker, so that
any number of equal vectors spreads over tasks and blocks.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare

BLOCK = 256        # vectors of a block
SAMPLE = 4096      # vectors that the curve's directions are taken from
AXES, BITS = 8, 7  # directions and bits of each: a curve position has 56 bits
LIMIT = 1 << 26    # components beyond +-LIMIT are taken as +-LIMIT: squares stay in 64 bits
EXACT = 1 << 21    # up to here products of vectors are exact in doubles


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers below ``2**bits``.

    The bit planes are turned from the highest down (exchange or inversion of
    the lower bits), then Gray-coded and interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            on = (x[i] >> b) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def fit_curve(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions of the sample, and along each the quantiles that cut its cells."""
    centred = sample - sample.mean(0)
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :AXES]
    cuts = np.quantile(sample @ axes, np.arange(1, 1 << BITS) / (1 << BITS), axis=0)
    return axes, cuts


def place(curve: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    axes, cuts = curve
    p = x @ axes
    return hilbert(np.stack([np.searchsorted(cuts[:, j], p[:, j]) for j in range(p.shape[1])], 1), BITS)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(blocks, centroids) booleans: can the centroid be nearest to a point of the box?

    Never False for a centroid that is nearest, or as near as another with a
    larger number, to a point of the box.
    """
    lo, hi = low[:, None, :], high[:, None, :]
    least = (np.maximum(np.maximum(lo - centroids, centroids - hi), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(centroids - lo), np.abs(centroids - hi)) ** 2).sum(2)
    open_ = least <= most.min(1, keepdims=True)
    # |x-b|^2 - |x-c|^2 = 2x(c-b) + |b|^2 - |c|^2 is below 0 on the whole box: c is never nearest.
    best = centroids[((centroids - (low + high)[:, None, :] // 2) ** 2).sum(2).argmin(1)]
    away = centroids[None] - best[:, None, :]
    top = 2 * np.where(away > 0, hi * away, lo * away).sum(2)
    gap = top + (best ** 2).sum(1)[:, None] - (centroids ** 2).sum(1)
    return open_ & (gap >= 0)


def nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of the centroids ``numbers``
    (ascending; ties go to the smaller number), exact."""
    c = centroids[numbers]
    if max(np.abs(x).max(), np.abs(c).max()) <= EXACT:
        f, g = x.astype(np.float64), c.astype(np.float64)
        dist = (f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)
        best = dist.argmin(1)
        return numbers[best], dist[np.arange(len(x)), best].astype(np.int64)
    dist = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    best = dist.argmin(1)
    return numbers[best], dist[np.arange(len(x)), best]


_BLOCKS = "ids array<long>, low binary, high binary, total binary, vectors binary"


def _bytes(column, kind, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.int64)


def _batch(arrays: dict, schema: dict):
    import pyarrow as pa
    return pa.RecordBatch.from_pydict({k: pa.array(v, schema[k]) for k, v in arrays.items()})


def _quantise(dim: int, scale: int):
    """Batches (key, vector) to (key, integers): vectors of ``dim`` finite components only."""
    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc
        for b in it:
            e = b.column(1)
            size = np.array(pc.fill_null(pc.list_value_length(e), -1))
            right = np.flatnonzero(size == dim)
            flat = e.take(pa.array(right)).flatten()  # NULL components become NaN
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(1)
            # floor(scale * x); a product beyond the doubles is beyond the limit, too.
            with np.errstate(over="ignore"):
                q = np.clip(np.floor(scale * x[good]), -LIMIT, LIMIT).astype("<i4")
            yield _batch({"key": b.column(0).take(pa.array(right[good])),
                          "q": [r.tobytes() for r in q]}, {"key": pa.int64(), "q": pa.binary()})
    return run


def _blocks(dim: int):
    """Sorted batches (key, q) to blocks of neighbours."""
    def run(it):
        import pyarrow as pa

        def cut(keys, x):
            return {"ids": keys, "low": x.min(0).astype("<i4").tobytes(), "high": x.max(0).astype("<i4").tobytes(),
                    "total": x.sum(0, dtype=np.int64).astype("<i8").tobytes(), "vectors": x.astype("<i4").tobytes()}

        kinds = {"ids": pa.list_(pa.int64()), **dict.fromkeys(("low", "high", "total", "vectors"), pa.binary())}
        keys, x = [], np.zeros((0, dim), np.int64)
        for b in it:
            keys += b.column(0).to_pylist()
            x = np.concatenate((x, _bytes(b.column(1), "<i4", dim)))
            full = len(keys) // BLOCK * BLOCK
            out = [cut(keys[i:i + BLOCK], x[i:i + BLOCK]) for i in range(0, full, BLOCK)]
            keys, x = keys[full:], x[full:]
            if out:
                yield _batch({k: [r[k] for r in out] for k in kinds}, kinds)
        if keys:
            yield _batch({k: [v] for k, v in cut(keys, x).items()}, kinds)
    return run


def _assigned(batch, dim: int, centroids: np.ndarray):
    """Per block: ids, its vectors, its sum, numbers and distances (None: all of one candidate)."""
    low, high = _bytes(batch.column(1), "<i4", dim), _bytes(batch.column(2), "<i4", dim)
    total = _bytes(batch.column(3), "<i8", dim)
    open_ = candidates(low, high, centroids)
    for i in range(batch.num_rows):
        yield batch.column(0)[i], batch.column(4)[i], total[i], np.flatnonzero(open_[i])


def _sums(dim: int, centroids: np.ndarray):
    """Blocks to this task's number and sum of vectors by centroid and component."""
    def run(it):
        import pyarrow as pa
        k = len(centroids)
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in it:
            for ids, raw, total, numbers in _assigned(b, dim, centroids):
                if len(numbers) == 1:
                    n[numbers[0]] += len(ids)
                    s[numbers[0]] += total
                    continue
                x = np.frombuffer(raw.as_py(), "<i4").reshape(-1, dim).astype(np.int64)
                best, _ = nearest(x, centroids, numbers)
                for c in np.unique(best):
                    n[c] += (best == c).sum()
                    s[c] += x[best == c].sum(0)
        c = np.flatnonzero(n)
        yield _batch({"c": np.repeat(c, dim), "j": np.tile(np.arange(dim), len(c)),
                      "n": np.repeat(n[c], dim), "s": s[c].ravel()},
                     {"c": pa.int32(), "j": pa.int32(), "n": pa.int64(), "s": pa.int64()})
    return run


def _rows(dim: int, centroids: np.ndarray):
    """Blocks to (key, cluster, distance) of every vector."""
    def run(it):
        import pyarrow as pa
        kinds = {"key": pa.int64(), "cluster": pa.int32(), "distance": pa.int64()}
        for b in it:
            for ids, raw, _, numbers in _assigned(b, dim, centroids):
                x = np.frombuffer(raw.as_py(), "<i4").reshape(-1, dim).astype(np.int64)
                best, dist = nearest(x, centroids, numbers)
                yield _batch({"key": ids.values, "cluster": best, "distance": dist}, kinds)
    return run


def cluster(spark: SparkSession, vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding",
            dim: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, seed: str = "1:") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly ``dim`` components, none NULL or non-finite; a
    component x is taken as floor(scale * x), and one beyond +-2**26 as +-2**26.
    The first centroids are the k kept rows of least sha256(seed + key), ties by
    the components (a NULL key counts as an empty text); fewer rows give fewer
    centroids. ``rounds`` times all vectors are assigned and every centroid with
    vectors becomes their mean, rounded down; then vectors are assigned once
    more. Equal vectors and repeated rows count as often as they are there; an
    inertia beyond a long is NULL; an empty table gives no rows; other columns
    are not read.
    """
    prepare(spark)
    kept = (vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("e"))
            .mapInArrow(_quantise(dim, scale), "key long, q binary")
            .withColumn("tie", F.xxhash64("key", F.monotonically_increasing_id())).checkpoint())
    total = kept.count()
    first = (kept.withColumn("h", F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256))
             .orderBy("h", "q").limit(k).collect())
    centroids = np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, dim)
    if total:
        sample = kept.select("q").sample(min(1.0, 2.0 * SAMPLE / total), seed=1).limit(SAMPLE).collect() or first
        curve = fit_curve(np.array([np.frombuffer(r.q, "<i4") for r in sample], np.float64))

        def along(it):
            import pyarrow as pa
            for b in it:
                at = place(curve, _bytes(b.column(1), "<i4", dim).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], ["key", "q", "tie", "at"])

        placed = kept.mapInArrow(along, "key long, q binary, tie long, at long")
        blocks = (placed.repartitionByRange("at", "tie").sortWithinPartitions("at", "tie")
                  .select("key", "q").mapInArrow(_blocks(dim), _BLOCKS).checkpoint())
    else:
        blocks = spark.createDataFrame([], _BLOCKS)
    for _ in range(rounds if total else 0):
        parts = blocks.mapInArrow(_sums(dim, centroids), "c int, j int, n long, s long")
        means = parts.groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        centroids = centroids.copy()
        for r in means.collect():  # k * dim rows
            centroids[r.c, r.j] = int(r.s) // r.n
    found = blocks.mapInArrow(_rows(dim, centroids), "key long, cluster int, distance long").checkpoint()
    # One row per centroid, at most k: a proven bound for the broadcast and the driver.
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def fits(n: int):
        return n if n < 1 << 63 else None

    names = spark.createDataFrame(
        [(c, fits(s), fits(sum(sums.values())), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(
        F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
