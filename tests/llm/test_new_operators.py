"""WARC salvage, Merkle manifest and centroid clustering against plain restatements."""
import base64
import gzip
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.llm import hilbert_clusters, merkle, warc
from eventide.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def order(r):
    return tuple((x is not None, x) for x in r)


# ------------------------------------------------------------------ WARC

PAGES = "page_id long, url string, html string"


def plain_pages(rows):
    groups = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        groups[html or ""].append((page is not None, page or 0, i))
    out = []
    for html, mine in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        last = max(mine)
        for m in mine:
            page = m[1] if m[0] else None
            to = last[1] if last[0] else None
            out.append((page, len(data), digest, *(("response", None) if m == last else ("revisit", to))))
    return sorted(out, key=order)


def stored(spark, tmp_path, rows, kind, parts=3):
    path = str(tmp_path / "table")
    spark.createDataFrame(rows, kind).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(b"y")) \
        .repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def test_pages_written_and_read_back(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://é/ \r\nX: y", "é" * 50_000),
             (None, "u", "lonely"), (None, "u", "both"), (None, "v", "both"), (7, "w", "<p>0</p>"),
             (103, "u", "same"), (103, "u", "same"), (103, "u", "same"), (-5, "u", "\x1f\x8b\x08")]
    got = warc.page_archives(spark, stored(spark, tmp_path, rows, PAGES))
    assert sorted(map(tuple, got.collect()), key=order) == plain_pages(rows)


def test_op11_on_the_table(spark):
    rows = [tuple(r) for r in brute.table(spark, "pages", SF).select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op11_warc"](spark, SF).collect()), key=order) == plain_pages(rows)


def test_no_pages(spark):
    assert warc.page_archives(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_archives_are_plain_gzip_and_hold_their_payloads(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"text {i}" * 200) for i in range(50)]
    path = str(tmp_path / "warc")
    warc.write_warc(spark, spark.createDataFrame(rows, PAGES).coalesce(1), path, archive_bytes=2000)
    files = list((tmp_path / "warc").glob("part-*"))
    assert len(files) > 5
    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert whole.count(b"WARC-Type: response") == 50
    got = {r.page_id: (bytes(r.payload).decode(), r.target_uri) for r in warc.read_warc(spark, path).collect()}
    assert got == {i: (h, u) for i, u, h in rows}
    assert warc.gaps(warc.read_warc(spark, path)).count() == 0


def some_records(n=12):
    return [warc.page_record(i, f"u{i}", (f"<p>{i}</p>" * (1 + 50 * (i % 3))).encode(), i, None, None)
            for i in range(n)]


@pytest.mark.parametrize("zipped", ["yes", "no", "mixed"])
@pytest.mark.parametrize("seed", range(4))
def test_salvage_recovers_all_whole_records(zipped, seed):
    rng = np.random.default_rng(seed)
    parts = some_records()
    parts = [warc.member(p) if zipped == "yes" or (zipped == "mixed" and i % 2) else p for i, p in enumerate(parts)]
    bad = set(rng.choice(12, 3, replace=False).tolist())
    data, at, spans = b"", 0, {}
    for i, p in enumerate(parts):
        if i in bad:
            kind = rng.integers(3)
            if kind == 0:    # a byte changed in the record's second half
                k = len(p) // 2 + int(rng.integers(len(p) // 2 - 12))
                p = p[:k] + bytes([p[k] ^ 0x55]) + p[k + 1:]
            elif kind == 1:  # the end is missing
                p = p[:len(p) - 9]
            else:            # garbage before a record without its first bytes
                p = b"\x00junk\x1f\x8b\x08 WARC/1.1\r\n" + p[5:]
        spans[i] = (at, len(p))
        data, at = data + p, at + len(p)
    rows = list(warc.salvage(data))
    good = {r["page_id"]: (r["offset"], r["length"]) for r in rows if r["record_type"] == "response"}
    assert good == {i: spans[i] for i in range(12) if i not in bad}
    lost = [k for r in rows if r["record_type"] == "gap" for k in range(r["offset"], r["offset"] + r["length"])]
    assert lost == [k for i in sorted(bad) for k in range(spans[i][0], sum(spans[i]))]


def test_salvage_log_of_a_damaged_archive(spark, tmp_path):
    parts = [warc.member(p) for p in some_records(4)]
    parts[1] = parts[1][:30] + b"\xff\xff" + parts[1][32:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts) + b"tail")
    (tmp_path / "empty.warc").write_bytes(b"")
    got = warc.read_warc(spark, str(tmp_path))
    assert sorted(r.page_id for r in got.filter("record_type = 'response'").collect()) == [0, 2, 3]
    log = sorted((r.offset, r.length) for r in warc.gaps(got).collect())
    ends = np.cumsum([len(p) for p in parts]).tolist()
    assert log == [(ends[0], len(parts[1])), (ends[3], 4)]
    assert all(r.note for r in warc.gaps(got).collect())


def test_members_of_several_records_and_foreign_fields():
    both = b"".join(some_records(2))
    other = warc.record("warcinfo", {"WARC-Block-Digest": "sha256:abc", "Content-Type": "application/warc-fields"}, b"a: b")
    rows = list(warc.salvage(warc.member(both) + warc.EMPTY_MEMBER + other))
    assert [r["record_type"] for r in rows] == ["response", "response", "warcinfo"]
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(warc.EMPTY_MEMBER)) == []


# ------------------------------------------------------------------ Merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(r, more=0):
    vals = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))


def plain_tree(nodes):
    """All levels, and each node's siblings with sides."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    proofs = []
    for i in range(len(nodes)):
        mine = []
        for low in levels[:-1]:
            a = i - i % 2
            mine.append((low[a:i], low[i + 1:a + 2]))
            i //= 2
        proofs.append(mine)
    return levels[-1][0], proofs


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        mine = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = (mine, *plain_tree([plain_leaf(r) for r in mine]))
    root, above = plain_tree([trees[g][1] for g in names])
    out = []
    for g, upper in zip(names, above):
        mine, subroot, proofs = trees[g]
        for r, lower in zip(mine, proofs):
            steps = lower + upper
            x = plain_leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for left, right in steps:
                x = h("".join(left) + x + "".join(right))
            out.append((r[0], plain_leaf(r), subroot, root, h("".join("".join(a + b) for a, b in steps)), x, x == root))
    return sorted(out, key=order)


def check_manifest(spark, tmp_path, rows, levels):
    df = stored(spark, tmp_path, rows, DOCS).withColumn("pos", F.lit(1)).withColumn("G", F.lit("z"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf_hash(*[F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in merkle.FIELDS])
    got = merkle.manifest(spark, df, fields=merkle.FIELDS, candidate=F.when(hit, changed), levels=levels)
    rows_ = got.collect()
    assert all(merkle.fold(r.leaf, r.sides, r.siblings) == r.root for r in rows_)
    want = plain_manifest(rows)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                   for r in rows_), key=order) == want


@pytest.mark.parametrize("levels", [1, 2, 3, 12])
def test_manifest_against_the_plain_tree(spark, tmp_path, levels):
    rows = [(i, f"text {i}", "en", "web", i) for i in range(45)]  # a hot group
    rows += [(i, "t", "de", None, None) for i in range(100, 108)]
    rows += [(200, "t", None, "s", 1), (201, "", None, "s", 1), (202, None, None, "s", 1),
             (300, "long " * 50_000, "fr", "s", 250_000), (301, "é", "ÿ", "s", 1), (302, "x", "", "s", 1),
             (None, "a", "en", "web", 1), (None, "b", "en", "web", 1), (5, "again", "en", "web", 1),
             (7, "same", "en", "w", 1), (7, "same", "en", "w", 1), (7, "same", "en", "w", 1)]
    rows += [(400 + i, "t", f"l{i:02}", "s", 3) for i in range(21)]
    check_manifest(spark, tmp_path, rows, levels)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_manifests(spark, tmp_path, n):
    check_manifest(spark, tmp_path, [(i, "t", "en", "s", 1) for i in range(n)], 2)


def test_op12_on_the_table(spark):
    rows = [tuple(r) for r in brute.table(spark, "documents", SF)
            .select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = QUERIES["op12_merkle"](spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(rows)
    assert sorted(map(tuple, got.collect()), key=order) == want
    assert 0 < sum(not r[-1] for r in want) < len(want) / 3


def test_no_manifest(spark):
    assert merkle.document_manifest(spark, spark.createDataFrame([], DOCS)).count() == 0


def test_groups_go_on_over_partitions_and_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(i, "t", "ab"[i % 7 == 0], "s", 1) for i in range(200)]
        check_manifest(spark, tmp_path, rows, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ------------------------------------------------------------------ clusters

VECS = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, dim, k, rounds):
    kept = []
    for key, e, *_ in rows:
        if e is None or len(e) != dim or any(x is None or not math.isfinite(np.float32(x)) for x in e):
            continue
        kept.append((key, [min(max(math.floor(64 * float(np.float32(x))), -(1 << 26)), 1 << 26) for x in e]))

    def bytes_of(v):
        return np.array(v, "<i4").tobytes()

    first = sorted(kept, key=lambda r: (h(f"1:{'' if r[0] is None else r[0]}"), bytes_of(r[1])))[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for i in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found) if c == i]
            if mine:
                centroids[i] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    by = defaultdict(int)
    for d, c in found:
        by[c] += d
    return sorted([(key, c, d, by[c], sum(by.values()), h(",".join(map(str, centroids[c]))))
                   for (key, _), (d, c) in zip(kept, found)], key=order)


def check_clusters(spark, rows, **kw):
    df = spark.createDataFrame(rows, VECS).withColumn("cluster", F.lit("x")).withColumn("e", F.lit("y"))
    dim = kw.setdefault("dim", 8)
    got = hilbert_clusters.cluster(spark, df.repartition(3), **kw)
    assert sorted(map(tuple, got.collect()), key=order) == plain_clusters(
        rows, dim, kw.get("k", 16), kw.get("rounds", 3))


def test_clusters_against_the_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(hilbert_clusters, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(9, 8))
    rows = [(i, (centre[i % 9] + rng.normal(0, 0.1, 8)).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(200)]  # a hot vector
    rows += [(2000, None, 0), (2001, [], 0), (2002, [1.0] * 7, 0), (2003, [None] + [1.0] * 7, 0),
             (2004, [float("nan")] * 8, 0), (2005, [float("inf")] * 8, 0), (2006, [0.0] * 8, 0),
             (None, [0.5] * 8, 0), (None, [0.25] * 8, 0), (3, [0.125] * 8, 0), (3, [0.125] * 8, 0)]
    check_clusters(spark, rows)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)]  # 16 centroids, two places
    check_clusters(spark, rows)
    check_clusters(spark, [(i, [float(i)] * 8, 0) for i in range(5)])
    assert hilbert_clusters.cluster(spark, spark.createDataFrame([], VECS)).count() == 0
    assert hilbert_clusters.cluster(spark, spark.createDataFrame([(1, None, 0)], VECS)).count() == 0


def test_large_components_are_exact_or_clamped(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=8) * 1e5).tolist(), 0) for i in range(60)] + [(99, [3e38, -3e38] * 4, 0)]
    check_clusters(spark, rows, k=4)


def test_op13_on_the_table(spark):
    rows = [tuple(r) for r in brute.table(spark, "embeddings", SF).select("vec_id", "embedding").collect()]
    got = QUERIES["op13_hilbert_clusters"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=order) == plain_clusters(rows, 64, 16, 3)


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (8, 1)):
        cells = np.stack(np.unravel_index(np.arange(1 << (n * bits)), [1 << bits] * n), 1)
        at = hilbert_clusters.hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_candidates_keep_every_nearest_centroid():
    rng = np.random.default_rng(0)
    dropped = 0
    for _ in range(200):
        c = rng.integers(-20, 20, (16, 5))
        x = rng.integers(-20, 20, 5) + rng.integers(-4, 4, (30, 5))
        open_ = hilbert_clusters.candidates(x.min(0)[None], x.max(0)[None], c)[0]
        best = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        assert open_[best].all()
        dropped += (~open_).sum()
    assert dropped > 1000
