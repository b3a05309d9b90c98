"""Merkle manifest of a table: subtree exchange between superblocks.

Rows are leaves, ordered by key inside their group; two consecutive nodes
become their hash until one is left (a last single node is hashed alone), and
the groups' subroots do the same, ordered by group, up to the root.

A group's leaves are numbered by a range partitioning (its chunks in several
partitions are joined by at most one offset per partition) and cut into
*superblocks* of ``2**LEVELS`` leaves. A superblock is a whole subtree, so it
reduces alone to one node; those nodes are cut into superblocks again, until
each group has one. Then the exchange goes the other way: the nodes of a
superblock and the outer nodes it requires (the siblings from its own root up
to the table's root, one row) are cogrouped, and one function finishes the local
reduction, joins the proof and folds it. No task holds more than a superblock,
whatever a group's size; nothing but counts reaches the driver.

A first superblock that is not full is the only one of its group and reduces
until one node is left; a full one takes LEVELS steps either way; every other
one takes exactly LEVELS steps. So no superblock needs its group's size.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare
from eventide.operators.ranks import global_rank, ranged

LEVELS = 12  # a superblock holds 4,096 nodes


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduce_block(nodes: list[str], first: bool, levels: int) -> list[list[str]]:
    """All levels of a superblock, its nodes first and its one root last."""
    out = [nodes]
    while len(out[-1]) > 1 or (not first and len(out) <= levels):
        low = out[-1]
        out.append([digest("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return out


def path(block: list[list[str]], i: int) -> tuple[str, str]:
    """Sides (L, R or N: none) and siblings of node ``i``, level by level."""
    sides, siblings = [], []
    for level in block[:-1]:
        j = i ^ 1
        if j < len(level):
            sides.append("R" if j > i else "L")
            siblings.append(level[j])
        else:
            sides.append("N")
        i >>= 1
    return "".join(sides), "".join(siblings)


def fold(leaf: str, sides: str, siblings: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in sides:
        if side == "N":
            leaf = digest(leaf)
            continue
        other, at = siblings[at:at + 64], at + 64
        leaf = digest(leaf + other if side == "R" else other + leaf)
    return leaf


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over the fields' texts: ``-`` if NULL, else bytes, ``:``, value."""
    parts = []
    for f in fields:
        v = f.cast("string")
        parts.append(F.when(f.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)))
    return F.sha2(F.concat(*parts), 256)


def _numbered(leaves: DataFrame, levels: int) -> DataFrame:
    """(g, sb, pos, key, leaf, candidate): each leaf's place in its group."""
    spark = leaves.sparkSession
    rows = ranged(leaves, "g", "key", "leaf", "tie")
    rows = rows.drop("tie").withColumn("pid", F.spark_partition_id())
    # Ends of each partition: its first and last group, and how many leaves they have there.
    chunk = rows.groupBy("pid", "g").agg(F.count(F.lit(1)).alias("n"))
    ends = (chunk.groupBy("pid").agg(F.min(F.struct("g", "n")).alias("low"), F.max(F.struct("g", "n")).alias("high"))
            .orderBy("pid").collect())
    carry, open_g, seen = {}, None, 0
    for e in ends:  # one row per partition
        carry[e.pid] = (e.low.g, seen if e.low.g == open_g else 0)
        alone = e.low.g == e.high.g and e.low.g == open_g
        open_g, seen = e.high.g, e.high.n + (seen if alone else 0)
    offsets = spark.createDataFrame([(p, g, n) for p, (g, n) in carry.items()] or [(0, "", 0)],
                                    "pid int, first_g string, before long")

    def number(it):
        cur, at = None, 0
        for pdf in it:
            if not len(pdf):
                continue
            run = pdf.groupby("g", sort=False).cumcount().to_numpy()
            g = pdf["g"].to_numpy()
            start = pdf["before"].to_numpy(np.int64) * (g == pdf["first_g"].to_numpy())
            if g[0] == cur:  # the group goes on from the batch before
                start[g == cur] = at
            pos = start + run
            cur, at = g[-1], int(pos[-1]) + 1
            yield pdf.assign(pos=pos, sb=pos >> levels)[["g", "sb", "pos", "key", "leaf", "candidate"]]

    return rows.join(F.broadcast(offsets), "pid").select(
        "g", "key", "leaf", "candidate", "first_g", "before").mapInPandas(
        number, "g string, sb long, pos long, key long, leaf string, candidate string")


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (g, sb, pos, leaf) from the given nodes to one node per group."""
    def up(pdf):
        pdf = pdf.sort_values("pos")
        sb = pdf["sb"].iloc[0]
        top = reduce_block(pdf["leaf"].tolist(), sb == 0, levels)[-1][0]
        return pdf.iloc[:1].assign(pos=sb, sb=sb >> levels, leaf=top)[["g", "sb", "pos", "leaf"]]

    tables = [nodes]
    while True:
        low = tables[-1].select("g", "sb", "pos", "leaf")
        tables.append(low.groupBy("g", "sb").applyInPandas(
            up, "g string, sb long, pos long, leaf string").checkpoint())
        if not (tables[-1].agg(F.max("pos")).first()[0] or 0):
            return tables


_OUTER = "g string, pos long, sides string, siblings string, subroot string, root string"


def _descend(tables: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Outer nodes (_OUTER) of every node of ``tables[0]``, given those of the last table."""
    def down(nodes, outer):
        nodes = nodes.sort_values("pos")
        o = outer.iloc[0]
        block = reduce_block(nodes["leaf"].tolist(), nodes["sb"].iloc[0] == 0, levels)
        found = [path(block, i) for i in range(len(nodes))]
        return nodes[["g", "pos"]].assign(
            sides=[s + o["sides"] for s, _ in found], siblings=[s + o["siblings"] for _, s in found],
            subroot=o["subroot"], root=o["root"])

    for nodes in reversed(tables[:-1]):
        outer = (nodes.groupBy("g", "sb").cogroup(outer.withColumnRenamed("pos", "sb").groupBy("g", "sb"))
                 .applyInPandas(down, _OUTER))
    return outer


def manifest(spark: SparkSession, rows: DataFrame, *, fields: list[str], key: str = "doc_id",
             group: str = "lang", candidate: Column | None = None, with_proof: bool = True,
             levels: int = LEVELS) -> DataFrame:
    """(key, leaf, subroot, root, sides, siblings, proof_sha256, folded_root, verified).

    One row per row of ``rows``: its leaf is the hash of ``fields``; leaves of a
    group stand by key (NULL first, then by leaf), groups by name (NULL first).
    ``sides`` and ``siblings`` (left out without ``with_proof``) are the proof
    that ``fold`` takes. ``candidate`` is the leaf to be proven instead of the
    row's own, where it is not NULL; it is folded along the original siblings
    and ``verified`` tells whether it leads to the root.

    Defined results: NULL fields hash as ``-``, so they differ from empty texts;
    repeated rows are leaves of their own, side by side; a NULL key or group
    comes first and is a key or group like any other; texts of any length are
    hashed whole; an empty table gives an empty manifest; other columns are not read.
    """
    prepare(spark)
    names = {f: F.col(f) for f in fields}
    leaf = leaf_hash(*names.values())
    leaves = rows.select(
        # '' for NULL and '=' before every name: the order of names, NULL first.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).cast("long").alias("key"), leaf.alias("leaf"),
        (F.lit(None).cast("string") if candidate is None else candidate).alias("candidate"),
        F.monotonically_increasing_id().alias("tie"))
    numbered = _numbered(leaves, levels)
    tables = _climb(numbered, levels)
    # The subroots are the leaves of the table's own tree, in one group.
    subroots = global_rank(tables[-1].select(F.col("g").alias("name"), "leaf"), ["name"], "pos").select(
        F.lit("").alias("g"), F.shiftright(F.col("pos") - 1, levels).alias("sb"),
        (F.col("pos") - 1).alias("pos"), "leaf", "name").checkpoint()
    crown = _climb(subroots.select("g", "sb", "pos", "leaf"), levels)
    none = F.lit("")
    top = crown[-1].select("g", "pos", none.alias("sides"), none.alias("siblings"),
                           none.alias("subroot"), F.col("leaf").alias("root"))
    above = _descend(crown, top, levels).select("pos", "sides", "siblings", "root")
    outer = subroots.join(above, "pos").select(
        F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "sides", "siblings",
        F.col("leaf").alias("subroot"), "root")
    outer = _descend(tables[1:], outer, levels).withColumnRenamed("pos", "sb")

    def finish(nodes, outer):
        nodes = nodes.sort_values("pos")
        o = outer.iloc[0]
        leaves = nodes["leaf"].tolist()
        block = reduce_block(leaves, nodes["sb"].iloc[0] == 0, levels)
        proofs = [(s + o["sides"], t + o["siblings"]) for s, t in (path(block, i) for i in range(len(leaves)))]
        out = nodes[["key", "leaf"]].assign(subroot=o["subroot"], root=o["root"])
        if with_proof:
            out["sides"] = [s for s, _ in proofs]
            out["siblings"] = [t for _, t in proofs]
        out["proof_sha256"] = [digest(t) for _, t in proofs]
        out["folded_root"] = [fold(c or x, s, t) for c, x, (s, t) in zip(nodes["candidate"], leaves, proofs)]
        return out.assign(verified=out["folded_root"] == out["root"])

    kind = "key long, leaf string, subroot string, root string, {}proof_sha256 string, " \
           "folded_root string, verified boolean"
    found = numbered.groupBy("g", "sb").cogroup(outer.groupBy("g", "sb")).applyInPandas(
        finish, kind.format("sides string, siblings string, " if with_proof else ""))
    return found.withColumnRenamed("key", key) if key != "key" else found


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Manifest of ``documents``; every row whose crc32(doc_id) is divisible by 7
    is proven with n_chars + 1 (a NULL n_chars or doc_id stays as it is)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # no overflow at the largest long
    changed = leaf_hash(*[more if f == "n_chars" else F.col(f) for f in FIELDS])
    return manifest(spark, docs, fields=FIELDS, candidate=F.when(hit, changed), with_proof=False)
