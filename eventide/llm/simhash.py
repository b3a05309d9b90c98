"""SimHash near-duplicates by pivot distance tables.

A text's fingerprint has 64 bits, each the majority of that bit over the XXH64
hashes of its word shingles. Fingerprints link when they differ in at most
``max_bits`` bits.

*Pivots.* The bit positions are cut into ``max_bits + 3`` parts. Each part has
a family of reference fingerprints that equal one common base outside the part
and differ only inside it, so the distances from x to them, less its distance
to the base, depend on x's bits in that part alone. *Candidates.* ``max_bits``
flipped bits touch at most ``max_bits`` parts: a linked pair has equal rows of
the distance table for some three families, and those three rows are the key
of an equi join. *Discard.* By the triangle inequality a pair whose distances
to any pivot differ by more than ``max_bits`` cannot link: pairs are dropped by
their largest coordinate difference over further pivots. *Verify.* Survivors
are compared bit by bit.

Equal fingerprints are one node from the start, so a group of copies of any
size is one row of the search. Pairs live only inside numpy blocks: each block
returns at most one edge per row (a spanning forest of its links), and a key
with many fingerprints is cut into pairs of blocks that tasks share. Nothing
is capped or dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import fresh, prepare, row_udf
from eventide.llm.components import connected_components

BITS, FAMILY, GLOBAL, BLOCK = 64, 8, 8, 256


def shingle_hashes(text: str, k: int, seed: int) -> list[int]:
    """XXH64 of every k-word shingle (repeats included) of the A-Z lower-cased
    text; the whole sequence if it is shorter; none without a word."""
    from xxhash import xxh64_intdigest as xx
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    return [xx(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())]


def fingerprints(model: dict, texts: list[str]) -> dict:
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        h = np.array(shingle_hashes(t, model["k"], model["seed"]), "<u8")
        if len(h):
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h)).view("<u8")[0]
    return {"fp": out.view(np.int64)}


def pivots(max_bits: int, seed: int = 2024) -> tuple[int, list[list[int]], list[int]]:
    """The common base, the families of each part and the pivots for discarding,
    as signed 64-bit numbers."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, dtype=np.int64)
    families = []
    for part in np.array_split(np.arange(BITS), max_bits + 3):
        masks = [sum(1 << int(b) for b in part[rng.random(len(part)) < 0.5]) for _ in range(FAMILY)]
        families.append([int(np.uint64(int(base) ^ m).astype(np.int64)) for m in masks])
    more = rng.integers(-(1 << 63), (1 << 63) - 1, GLOBAL, dtype=np.int64, endpoint=True)
    return int(base), families, more.tolist()


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot)))


def forest(pdf, max_bits: int):
    """Links inside groups of rows (sorted by group): one edge per row at most."""
    group, fp = pdf["g"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
    co = np.stack([pdf[f"d{j}"].to_numpy() for j in range(GLOBAL)], 1).astype(np.int8)
    left, right = [], []
    at, step = np.arange(len(fp)), 0
    while True:
        step += 1
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.abs(co[at] - co[at + step]).max(1) <= max_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= max_bits]
        left.append(near)
        right.append(near + step)
    label = np.arange(len(fp))
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while len(a):
            low = np.minimum(label[a], label[b])
            if (label[a] == low).all() and (label[b] == low).all():
                break
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
    return pdf["fp"].to_numpy(), pdf["fp"].to_numpy()[label]


def linked(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``nodes(fp)`` exactly
    as the links within ``max_bits`` bits do."""
    base, families, more = pivots(max_bits)
    fp = F.col("fp")
    table = nodes.select(
        "fp", *[distance(fp, p).cast("byte").alias(f"d{j}") for j, p in enumerate(more)],
        *[F.array(*[distance(fp, p) - distance(fp, base) for p in fam]).alias(f"f{i}")
          for i, fam in enumerate(families)])
    kept = ["fp", *[f"d{j}" for j in range(GLOBAL)]]
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"f{j}") for j in c])
                     for i, c in enumerate(combinations(range(max_bits + 3), 3))])
    rows = table.select(*kept, F.explode(keys).alias("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = (rows.join(counts, "key")
            .withColumn("nb", F.ceil(F.col("n") / BLOCK))
            .withColumn("i", F.pmod(F.xxhash64("fp"), F.col("nb")))
            .withColumn("j", F.explode(F.expr("sequence(0L, nb - 1)")))
            .withColumn("g", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))))

    def links(it):
        import pandas as pd
        wait = None
        for pdf in it:  # a group may go on in the next batch
            pdf = pdf if wait is None else pd.concat([wait, pdf], ignore_index=True)
            last = pdf["g"].to_numpy() == pdf["g"].iloc[-1] if len(pdf) else np.empty(0, bool)
            wait, pdf = pdf[last], pdf[~last]
            if len(pdf):
                a, b = forest(pdf, max_bits)
                yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})
        if wait is not None and len(wait):
            a, b = forest(wait, max_bits)
            yield pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return (rows.select("g", *kept).repartition("g").sortWithinPartitions("g", "fp")
            .mapInPandas(links, "a long, b long"))


def marked(spark: SparkSession, docs: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """All columns of ``docs`` but ``text``, and the fingerprint ``fp``. Written once:
    the fingerprints are read three times, the texts only here."""
    udf = row_udf(spark, "fp long", {"k": shingle, "seed": seed}, fingerprints)
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, udf(F.col(text)).alias("h")).select(
        *rest, F.col("h.fp").alias("fp")).checkpoint()


def with_component(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes(fp, ...)``, one row a fingerprint, with the smallest fingerprint
    reachable over links as ``component``."""
    whole = connected_components(linked(nodes.select("fp"), max_bits))
    return nodes.join(whole.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))


def simhash_groups(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                   shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``key``, ``fp`` and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest key reachable over links. Defined results:
    texts that are NULL, empty or without a word have fingerprint zero, which
    links like any other; repeated rows stay and share a component; NULL keys
    are never a component's smallest key unless it has no other; an empty
    table stays empty; other columns are not read.
    """
    prepare(spark)
    marks = marked(spark, docs.select(F.col(key).alias("key"), F.col(text).alias("t")), "t", shingle, seed)
    where = with_component(marks.groupBy("fp").agg(F.min("key").alias("first")), max_bits)
    low = where.groupBy("component").agg(F.min("first").alias("component_id"))
    names = where.join(low, "component").select("fp", "component_id")
    return marks.join(names, "fp").select(F.col("key").alias(key), "fp", "component_id")


def simhash_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    out = simhash_groups(spark, docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def keep_first(spark: SparkSession, docs: DataFrame, key: str = "doc_id", *, text: str = "text",
               shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row of every group of near-duplicates: that of the smallest key.

    Rows are told apart by a number of their own and groups by their smallest
    fingerprint, so NULL and repeated keys lose no text: a NULL key comes after
    all others, and of rows with equal keys the first one stays.
    """
    prepare(spark)
    row = fresh(docs, "row_number")
    # Written once, so that a row has the same number each time it is read.
    rows = docs.withColumn(row, F.monotonically_increasing_id()).checkpoint()
    first = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    marks = marked(spark, rows.select(first.alias("first"), F.col(text).alias("t")), "t", shingle, seed)
    where = with_component(marks.groupBy("fp").agg(F.min("first").alias("first")), max_bits)
    kept = where.groupBy("component").agg(F.min("first").alias("first")).select(
        F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
