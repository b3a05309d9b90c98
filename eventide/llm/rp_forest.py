"""Embedding near-duplicates by a random-projection tree forest.

Every tree halves the unit vectors again and again by a random direction and a
threshold; a vector within the spill margin of a threshold goes down both
sides. Vectors that meet in a leaf of any tree are compared, in double
precision, and linked from the wanted cosine on; a union of the links gives
the components.

Vectors of different lengths never link: every length has a forest of its own, and
the length is part of a leaf's key.

The thresholds are the medians of a bounded, documented sample; below the
levels the sample can fill, a node splits at its last sampled ancestor's
centre, so depth follows the size of the table and leaves stay small. Every
vector is then sent down every tree. Equal vectors are one row with a number
of copies throughout. A leaf with many vectors is cut into pairs of blocks for
several tasks. A pair that meets in several leaves counts in the first of them
only, so links are counted without writing pairs: each block returns, per
vector, its number of links and one edge towards its local component. Which
leaves a linked vector is in besides is worked out again where it is linked:
no copy of a vector carries its list of leaves, so a copy costs its numbers
and some thirty bytes at any depth.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare, unit_hash
from eventide.llm.components import connected_components

SAMPLE_BYTES, BLOCK = 32 << 20, 1024
# Most oversized leaves that are broadcast (28 bytes each); beyond, they are joined.
HOT_LEAVES = 200_000


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, from the bytes of the rows' numbers."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def depth_for(rows: int, leaf_rows: int, spill: float) -> int:
    """Levels until a leaf holds ``leaf_rows``, counting what the spill sends both ways."""
    twice = math.erf(spill / math.sqrt(2))  # share of a normal projection inside the margin
    return max(0, math.ceil(math.log(max(rows, 1) / leaf_rows) / math.log(2 / (1 + twice))))


def fit_forest(sample: np.ndarray, depth: int, trees: int, spill: float, seed: int = 5) -> dict:
    """Directions per tree and level, and thresholds: medians of the sampled
    levels, below them the projected centre of the last sampled ancestor."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    known = min(depth, int(np.log2(max(1, len(sample) / 16))))
    planes = rng.normal(size=(trees, max(depth, 1), dim))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    cuts = []
    for t in range(trees):
        p = sample @ planes[t].T
        node, levels = np.zeros(len(sample), np.int64), []
        for level in range(known):
            order = np.lexsort((p[:, level], node))
            first = np.searchsorted(node[order], np.arange(1 << level))
            size = np.diff(first, append=len(sample))
            mid = order[np.minimum(first + size // 2, len(sample) - 1)]
            cut = np.where(size > 0, p[mid, level], 0.0)
            levels.append(cut)
            node = 2 * node + (p[:, level] > cut[node])
        n = np.bincount(node, minlength=1 << known)
        c = np.stack([np.bincount(node, sample[:, j], minlength=1 << known) for j in range(dim)], 1)
        centres = c / np.maximum(n, 1)[:, None]
        cuts.append(levels + [centres @ planes[t, level] for level in range(known, depth)])
    return {"planes": planes, "cuts": cuts, "known": known, "depth": depth,
            "margin": spill / np.sqrt(dim)}


def route(forest: dict, x: np.ndarray, trees: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf (tree and path in one number) of every place of every row,
    in the first ``trees`` trees.

    Projections are summed component by component, so a row's leaves do not
    depend on the rows beside it (a matrix product may round otherwise).
    """
    rows, homes = [], []
    known, margin = forest["known"], forest["margin"]
    for t, planes in enumerate(forest["planes"][:trees]):
        p = np.zeros((len(x), len(planes)))
        for j in range(x.shape[1]):
            p += x[:, j, None] * planes[None, :, j]
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for level in range(forest["depth"]):
            cut = forest["cuts"][t][level][node >> max(0, level - known)]
            v = p[row, level]
            left, right = v <= cut + margin, v > cut - margin
            row, node = (np.concatenate((row[left], row[right])),
                         np.concatenate((2 * node[left], 2 * node[right] + 1)))
        rows.append(row)
        homes.append((t << 48) | node)
    return np.concatenate(rows), np.concatenate(homes)


def leaf_links(pdf, cosine: float, kind: str, forest: dict):
    """Links inside one leaf, or between its two blocks: counts and local roots."""
    if len(pdf) < 2:
        return None
    u = units(pdf["vec"].tolist(), kind)
    home, lo = pdf["home"].iloc[0], pdf["lo"].iloc[0]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    if lo != pdf["hi"].iloc[0]:  # two blocks: pairs across them only
        side = pdf["blk"].to_numpy() == lo
        near &= side[:, None] != side[None, :]
    if not near.any():
        return None
    # Only linked vectors go on. A pair belongs to the first leaf that both are in.
    linked = np.flatnonzero(near.any(1))
    pdf, u, near = pdf.iloc[linked], u[linked], near[np.ix_(linked, linked)]
    row, flat = route(forest, u, (int(home) >> 48) + 1)
    early = flat < home
    own = near
    if early.any():
        code, at = np.unique(flat[early], return_inverse=True)
        there = np.zeros((len(pdf), len(code)), np.float32)
        there[row[early], at] = 1
        own = near & ~(there @ there.T > 0)
    copies, rid = pdf["copies"].to_numpy(), pdf["rid"].to_numpy()
    label = np.arange(len(pdf))
    while True:  # smallest position reachable inside the block
        low = np.where(near, label[None, :], len(pdf)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return rid, own @ copies, rid[label]


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, key: str = "vec_id",
                    vector: str = "embedding", cosine: float = 0.95, trees: int = 8,
                    leaf_rows: int = 512, spill: float = 0.15, sample_rows: int = 20_000) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Defined results: vectors that are NULL, empty, zero or hold a NULL or
    non-finite component link with nothing; vectors of any length are compared
    with those of their length; equal vectors link with each other; repeated rows count as
    rows; a component's id is its smallest non-NULL key; an empty table stays
    empty; other columns are not read. The forest is fitted on a sample of about
    ``sample_rows`` vectors (at most 32 MB; at least 64 of each length), every vector
    is indexed.
    """
    prepare(spark)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("e"))
    # Single-precision vectors travel as such; cosines are taken in double.
    kind = "<f4" if "float" in vectors.schema[vector].dataType.simpleString() else "<f8"
    big = F.lit(float("inf"))
    ok = (F.size("e") > 0) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == big)) & \
        F.exists("e", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # One row per different vector, numbered once and for all by the checkpoint.
    nodes = (rows.filter("ok").groupBy("e").agg(F.count("*").alias("copies"), F.min("key").alias("low"))
             .withColumn("d", F.size("e")).withColumn("rid", F.monotonically_increasing_id()).checkpoint())
    lengths = {r.d: r.n for r in nodes.groupBy("d").agg(F.count("*").alias("n")).collect()}  # one row a length
    if not lengths:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"),
                           F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    total = sum(lengths.values())
    most = min(sample_rows, SAMPLE_BYTES // (8 * max(lengths)))
    rates = spark.createDataFrame([(d, max(64.0, most * n / total) / n) for d, n in lengths.items()],
                                  "d int, rate double")
    chosen = nodes.join(F.broadcast(rates), "d").filter(unit_hash(F.col("e")) < F.col("rate"))
    samples: dict[int, list] = {d: [] for d in lengths}
    for r in chosen.select("d", "e").collect():  # the bounded sample
        samples[r.d].append(np.asarray(r.e, kind).tobytes())
    forests = {}
    for d, n in lengths.items():
        depth = depth_for(n, leaf_rows, spill) if samples[d] else 0
        sample = units(sorted(samples[d]), kind) if samples[d] else np.ones((1, d))
        forests[d] = fit_forest(sample, depth, trees, spill)
    shared = spark.sparkContext.broadcast(forests)

    def leaves(it):
        import pandas as pd
        for whole in it:
            for d, pdf in whole.groupby("d"):
                raw = [np.asarray(e, kind).tobytes() for e in pdf["e"]]
                home, n = np.unique(route(shared.value[d], units(raw, kind))[1], return_counts=True)
                yield pd.DataFrame({"d": d, "home": home, "n": n})

    def place(it):
        import pandas as pd
        for whole in it:
            for d, pdf in whole.groupby("d"):
                raw = [np.asarray(e, kind).tobytes() for e in pdf["e"]]
                row, home = route(shared.value[d], units(raw, kind))
                yield pd.DataFrame({"d": d, "home": home, "rid": pdf["rid"].to_numpy()[row],
                                    "copies": pdf["copies"].to_numpy()[row],
                                    "vec": [raw[i] for i in row]})

    # Vectors are shuffled once, by leaf: only the few leaves beyond a block are known before.
    sizes = nodes.select("e", "d").mapInPandas(leaves, "d int, home long, n long")
    hot = (sizes.groupBy("d", "home").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK)
           .withColumn("nb", F.ceil(F.col("n") / BLOCK)).drop("n").checkpoint())
    if hot.count() <= HOT_LEAVES:
        hot = F.broadcast(hot)
    placed = nodes.select("rid", "e", "d", "copies").mapInPandas(
        place, "d int, home long, rid long, copies long, vec binary")
    blocks = (placed.join(hot, ["d", "home"], "left").withColumn("nb", F.coalesce("nb", F.lit(1).cast("long")))
              .withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("nb")))
              .withColumn("j", F.explode(F.expr("sequence(0L, nb - 1)")))
              .withColumn("lo", F.least("blk", "j")).withColumn("hi", F.greatest("blk", "j"))
              .select("d", "home", "lo", "hi", "blk", "rid", "copies", "vec"))
    group = ["d", "home", "lo", "hi"]

    def compare(it):
        import pandas as pd
        wait = None
        for pdf in it:
            if not len(pdf):
                continue
            pdf = pdf if wait is None else pd.concat([wait, pdf], ignore_index=True)
            new = (pdf[group] != pdf[group].shift()).any(axis=1).to_numpy()
            cut = np.flatnonzero(new)
            for a, b in zip(cut[:-1], cut[1:]):
                if (found := leaf_links(pdf.iloc[a:b], cosine, kind, shared.value[pdf["d"].iloc[a]])) is not None:
                    yield pd.DataFrame(dict(zip(("a", "n", "b"), found)))
            wait = pdf.iloc[cut[-1]:]  # this group may go on
        if wait is not None and (found := leaf_links(wait, cosine, kind, shared.value[wait["d"].iloc[0]])) is not None:
            yield pd.DataFrame(dict(zip(("a", "n", "b"), found)))

    found = (blocks.repartition(*group).sortWithinPartitions(*group)
             .mapInPandas(compare, "a long, n long, b long").checkpoint())
    links = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rid")
    whole = connected_components(found.select("a", "b")).withColumnRenamed("id", "rid")
    where = (nodes.select("rid", "e", "copies", "low").join(whole, "rid", "left").join(links, "rid", "left")
             .withColumn("component", F.coalesce("component", "rid")))
    low = where.groupBy("component").agg(F.min("low").alias("component_id"))
    names = where.join(low, "component").select(
        "e", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    good = rows.filter("ok").join(names, "e").select("key", "n_links", "component_id")
    alone = rows.filter("not ok").select("key", F.lit(0).cast("long"), F.col("key"))
    return good.union(alone).select(F.col("key").alias(key), "n_links", "component_id",
                                    F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
