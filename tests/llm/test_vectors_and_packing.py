"""Embedding near-duplicates, components, packing and the pipeline."""
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventide.llm import packing, rp_forest
from eventide.llm.components import connected_components
from eventide.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def check(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("rid", F.lit("x")).withColumn("e", F.lit("y"))
    got = sorted(map(tuple, rp_forest.near_duplicates(spark, df, leaf_rows=32).collect()),
                 key=lambda r: (r[0] is None, r))
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    f32 = [None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]] for r in rows]
    n, comp = brute.linked_vectors(f32)
    low = {c: min((r[0] for r, d in zip(rows, comp) if d == c and r[0] is not None), default=None) for c in comp}
    want = sorted([(r[0], k, low[c], r[0] == low[c]) for r, k, c in zip(rows, n, comp)],
                  key=lambda r: (r[0] is None, r))
    assert got == want


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(300)]
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(0, 0.12, 16)).tolist(), 1) for i in range(150)]  # about the limit
    rows += [(2000 + i, rows[0][1], 1) for i in range(40)]  # copies
    rows += [(2100, (2 * np.array(rows[0][1])).tolist(), 1)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [], 0),
             (3004, [None] + [1.0] * 15, 0), (3005, [float("inf")] + [1.0] * 15, 0), (3006, [1.0, 2.0], 0)]
    check(spark, rows)


def test_vectors_of_every_length(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n, (dim, many) in enumerate([(8, 200), (4, 10), (3, 80), (1, 5)]):
        base = [rng.normal(size=dim).tolist() for _ in range(many // 2)]
        rows += [(1000 * n + i, v, 0) for i, v in enumerate(base)]
        rows += [(1000 * n + 500 + i, (1.01 * np.array(v)).tolist(), 0) for i, v in enumerate(base)]
    check(spark, rows)


def test_one_crowded_leaf_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rp_forest, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=8)
    check(spark, [(i, (centre + rng.normal(0, 0.15, 8)).tolist(), 0) for i in range(150)])


def test_vectors_of_the_table_and_empty(spark):
    rows = [(r.vec_id, list(r.embedding), 0) for r in brute.table(spark, "embeddings", SF).collect()]
    check(spark, rows)
    empty = spark.createDataFrame([], KIND)
    assert rp_forest.near_duplicates(spark, empty).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in connected_components(df).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 299: 299, 300: 299}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def whole(rows, lengths, sizes):
    """Every document complete, no bin overfull, pieces side by side."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_length, r.copy].append((r.start, r.length))
        if r.length:
            bins[r.bin_id].append((r.bin_offset, r.length, r.bin_size))
    got = sorted((k[0], sum(n for _, n in v)) for k, v in docs.items())
    assert got == sorted(lengths)
    for v in docs.values():
        at = 0
        for start, n in sorted(v):
            assert start == at
            at += n
    for v in bins.values():
        at = 0
        for offset, n, size in sorted(v):
            assert offset == at
            at += n
        assert size == min(s for s in sizes if s >= at)


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(5)
    lengths = [(i, int(n)) for i, n in enumerate(rng.integers(0, 300, 800))] + [(900, 5000), (1, 7), (1, 7)]
    df = spark.createDataFrame(lengths + [(901, None)], "doc_id long, length long").withColumn("copy", F.lit("x"))
    rows = packing.pack_documents(spark, df, sizes=(64, 128, 512), shard_rows=200).collect()
    whole(rows, lengths + [(901, 0)], (64, 128, 512))
    used = sum(r.length for r in rows)
    assert used / sum({r.bin_id: r.bin_size for r in rows if r.length}.values()) > 0.95
    assert all(r.bin_id is None for r in rows if not r.length)


def plain_pack(lengths, sizes, attention):
    """The same rules, one piece and one bin at a time."""
    left = sorted(lengths, reverse=True)
    bins = []  # [room, pieces]
    while left:
        n = left.pop(0)
        open_bins = [b for b in bins if b[0] >= n]
        if open_bins:
            best = min(open_bins, key=lambda b: b[0])
        else:
            def price(size):
                room, full = size - n, n
                for m in left:
                    if m <= room:
                        room, full = room - m, full + m
                down = min(s for s in sizes if s >= full)
                return (down + attention * down * down / max(sizes)) / full, size
            size = min(price(s) for s in sizes if s >= n)[1]
            best = [size, []]
            bins.append(best)
        best[0] -= n
        best[1].append(n)
    return sorted(tuple(b[1]) for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_packing_equals_the_plain_rules(seed):
    lengths = np.random.default_rng(seed).integers(1, 200, 150)
    bins, _, size = packing.pack(lengths, (64, 128, 256), 0.25)
    got = defaultdict(list)
    for b, n in sorted(zip(bins.tolist(), lengths.tolist()), key=lambda x: -x[1]):
        got[b].append(n)
    want = plain_pack(lengths.tolist(), (64, 128, 256), 0.25)
    assert sorted(len(v) for v in got.values()) == sorted(map(len, want))
    assert sorted(sum(v) for v in got.values()) == sorted(map(sum, want))


def test_op7_packs_every_document(spark):
    docs = brute.table(spark, "documents", SF).collect()
    whole(QUERIES["op7_packing"](spark, SF).collect(),
          [(r.doc_id, len((r.text or "").encode())) for r in docs], packing.SIZES)


def test_pipeline_stages(spark, tmp_path):
    docs = brute.table(spark, "documents", SF)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    n = {k: v.count() for k, v in kept.items()}
    assert n["quality_classifier"] < n["language_id"] and n["simhash_near_dedup"] <= n["quality_classifier"]
    fps = [brute.fingerprint(r.text) for r in kept["simhash_near_dedup"].collect()]
    assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
    clean = kept["pii"].collect()
    assert len(clean) == len(fps) and not any(brute.spans(brute.PII, r.text)[2] for r in clean)
    whole(kept["best_fit_packing"].collect(), [(r.doc_id, len(r.text.encode())) for r in clean], packing.SIZES)


def test_pipeline_query_is_the_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "bin_id", "bin_size"} <= set(out.columns) and out.count() > 0
