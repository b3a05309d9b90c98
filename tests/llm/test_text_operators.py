"""Operators on the texts of ``documents`` against plain restatements."""
import hashlib
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventide.llm import bpe, langid, line_crf, nptext, pii, quality_nn, range_coder, secrets, simhash
from eventide.llm import token_files
from eventide.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = ["", " \t\n", None, "x", "Zoë 🙂 naïve — 漢字 ½", "aaaa aaaaa aaaaaaa", "a<|endoftext|>b",
       "ΣΑΣ İ ǅ ﬁ don't I'LL 'S", "word " * 3000, "x" * 30000, "1.2.3.4.5 x@y.com_foo@bar.com +1 (2) 3-4567890",
       "token=short secret=api_key=abcdefghijklmnop", "line\nline\n\nline\r\nend"]


@pytest.fixture(scope="module")
def texts(spark):
    """All documents of the smallest table, then odd ones, some of them twice."""
    odd = [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows = spark.createDataFrame(odd + odd[:4] + [(None, "no id here", "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    df = brute.table(spark, "documents", SF).select(*rows.columns).union(rows)
    # Other columns named like those that the operators make.
    for c in ("score", "kept", "key", "t", "k", "fp", "h", "spans", "row", "language", "quality_score"):
        df = df.withColumn(c, F.lit("other"))
    return df.cache()


def both(texts, out):
    """(text, result row) pairs, matched by id; repeated ids have equal texts."""
    by = {r.doc_id: r.text for r in texts.select("doc_id", "text").collect()}
    rows = out.collect()
    assert len(rows) == texts.count()
    return [(by[r.doc_id] or "", r) for r in rows]


def test_language_learns_and_rejects(spark, texts):
    pairs = both(texts, langid.language_id(spark, texts))
    lang = {r.doc_id: r.lang for r in texts.collect()}
    right = [r.lang_pred == lang[r.doc_id] for _, r in pairs if r.held_out and lang[r.doc_id]]
    assert np.mean(right) > 0.95
    for t, r in pairs:
        assert r.held_out == (r.doc_id is not None and brute.held_out(r.doc_id))
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t))


def test_language_without_labels_is_und(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.language_id(spark, df).collect()[0].lang_pred == "und"


def test_language_ignores_labels_of_held_out_rows(spark):
    docs = brute.table(spark, "documents", SF)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx")
                            .otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.language_id(spark, d).collect())) for d in (docs, wrong))
    assert a == b


def test_quality_classifier_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_quality_classifier"](spark, sf).toPandas()
    assert out["score"].between(0, 1).all() and len(out) == 1000
    assert ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    lab = brute.table(spark, "labels", sf).toPandas().merge(out[out["held_out"]], on="doc_id")
    good, bad = lab[lab.quality == 1]["score"], lab[lab.quality == 0]["score"]
    assert np.mean([g > b for g, b in product(good, bad)]) > 0.9


def test_quality_classifier_odd_rows_and_one_label(spark, texts):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0), (4, 0), (4, 1)],
                                   "doc_id long, quality int")
    pairs = both(texts, quality_nn.quality_classifier(spark, texts, labels))
    assert {r.score for _, r in pairs} == {1.0}  # the share of label 1 among usable rows


def test_quality_word_vectors_cover_unlabelled_documents(spark):
    """Words that only unlabelled documents hold have context vectors."""
    rows = [(i, f"good word number{'abc'[i % 3]} here" if i % 2 else "bad stuff, bad stuff") for i in range(60)]
    rows += [(1000 + i, "zebra quagga okapi") for i in range(40)] + [(None, "lemur zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality_nn.fit(spark, df, labels)
    assert model["net"] is not None
    ids = quality_nn.tokens(["zebra quagga okapi lemur"], model["bits"])[0]
    assert (np.linalg.norm(model["vectors"][ids], axis=1) > 0.99).all()


def test_quality_words_that_share_an_id_differ():
    bits, words = 1, ["alpha", "beta", "gamma"]  # two ids for all words
    ids, _, whole = quality_nn.tokens(words, bits)
    assert len(set(ids.tolist())) <= 2 and len(set(whole.tolist())) == 4  # and one shape
    x = quality_nn.pool(words, np.zeros((1 << bits, quality_nn.DIM), np.float32), bits)
    assert len(np.unique(x[:, :quality_nn.DIM], axis=0)) == 3


def test_secrets_base_spans(spark, texts):
    for t, r in both(texts, secrets.secret_scan(spark, texts)):
        n, digest, line = brute.spans(brute.SECRETS, t)
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == (n, digest), t[:80]
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == line.split(",") * bool(line)


def test_secrets_ownership(spark):
    key, copied = "Zk9fQ2xVb7TtRr4WmN1pXy8", "Qw3Er5Ty7Ui9Op1As2Df4Gh"
    rows = [(1, f"a {key} b", "me"), (2, f"c {copied}", "x"), (3, f"d {copied}", "y"), (4, f"e {copied}", "z"),
            (5, f"password={copied}", None), (6, f"token: {'f' * 16}", "me")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in secrets.secret_scan(spark, df).collect()}
    assert out[1].spans == f"live:2:{2 + len(key)}" and out[1].n_live == 1
    assert out[2].spans == out[3].spans == "" and out[2].n_example == 0
    assert out[5].n_assign == 1 and out[5].n_live == 0 and out[5].n_example == 1
    assert out[6].n_hex == out[6].n_assign == 1 and out[6].n_live == 0


def test_secrets_two_owners_and_many_repositories(spark):
    """A copy under a second source hides no key; one owner's many copies are an example."""
    two, hot, few = "Zk9fQ2xVb7TtRr4WmN1pXy8", "Qw3Er5Ty7Ui9Op1As2Df4Gh", "Mn8Bv7Cx6Zl5Kj4Hg3Fd2Sa"
    rows = [(1, two, "a"), (2, two, "b"), *[(10 + i, hot, "c") for i in range(10)],
            *[(10, hot, "c")] * 3, *[(30 + i, few, "c") for i in range(9)], *[(30, few, "c")] * 3]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = secrets.secret_scan(spark, df).collect()
    assert len(out) == len(rows)
    for r in out:
        live = not 10 <= r.doc_id < 20
        assert r.spans == ("live:0:23" if live else "") and r.n_live == live, r
    df = df.withColumn("text", F.concat(F.lit("password="), "text"))
    for r in secrets.secret_scan(spark, df).collect():
        hot_one = 10 <= r.doc_id < 20
        assert (r.n_assign, r.n_live, r.n_example) == (1, not hot_one, hot_one), r


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    for t, r in both(texts, bpe.bpe_digests(spark, texts)):
        ids = lib.encode(t, add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest()), t[:60]


def test_bpe_encode_decode_frames(spark):
    df = spark.createDataFrame([(1, "Hello  World"), (2, None)], "doc_id long, text string")
    out = bpe.decode(spark, bpe.encode(spark, df)).orderBy("doc_id").collect()
    assert out[0].text == "hello</w> world</w>" and out[1].ids == [] and out[1].text == ""


def test_token_files_round_trip(spark, texts, tmp_path):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(token_files.vocabulary_path())
    df = texts.filter("doc_id is not null").dropDuplicates(["doc_id"])
    token_files.write_tokens(spark, df, str(tmp_path / "t"))
    got = {r.doc_id: r for r in token_files.read_documents(spark, str(tmp_path / "t")).collect()}
    at = 0
    for r in df.orderBy("doc_id").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, list(g.ids)) == (at, len(ids), ids)
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_repeated_null_and_empty(spark, texts):
    assert token_files.token_files(spark, texts).count() == texts.count()
    assert token_files.token_files(spark, texts.limit(0)).count() == 0


def test_a_damaged_block_is_found():
    row = token_files.pack_chunk(0, 0, [1, None], [np.arange(3000, dtype="<u4"), np.array([7], "<u4")])
    keys, docs = token_files.unpack_chunks([row])[0]
    assert keys == [1, None] and docs[0].tolist() == list(range(3000)) and docs[1].tolist() == [7]
    bad = bytearray(row["payload"])
    bad[40] ^= 255
    with pytest.raises(ValueError):
        token_files.unpack_chunks([row | {"payload": bytes(bad)}])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65534), max_size=300), st.integers(1, 20))
def test_range_coder_round_trip(ids, repeat):
    ids = np.array(ids * repeat, np.int64)
    sizes = np.array([min(range_coder.BLOCK, len(ids) - i) for i in range(0, len(ids), range_coder.BLOCK)], int)
    back = range_coder.decode_blocks(range_coder.encode_blocks(ids), sizes)
    assert back.tolist() == ids.tolist()


def test_range_coder_learns():
    ids = np.tile(np.random.default_rng(1).integers(0, 50_000, 100), 200)
    assert sum(map(len, range_coder.encode_blocks(ids))) < 0.5 * len(ids)


def test_quality_rule_counts(spark, texts):
    labels = brute.table(spark, "labels", SF)
    for t, r in both(texts, line_crf.quality_rules(spark, texts, labels)):
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute.rule_counts(t), t[:80]
        assert not (r.kept and r.base_failed) and 0 <= r.content_share <= 1


def test_line_labels_cover_every_line(spark, texts):
    net = line_crf.fit(spark, texts, brute.table(spark, "labels", SF))
    for t, r in both(texts, line_crf.line_labels(spark, texts, net)):
        assert len(r.lines) == len(t.split("\n"))


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 3, 7]
    net = {"w": rng.normal(size=2), "trans": rng.normal(size=(2, 2)), "start": rng.normal(size=2)}
    x, doc = rng.normal(size=(sum(sizes), 2)), np.repeat(np.arange(4), sizes)
    got, at = line_crf.viterbi(net, x, doc, 4), 0
    for n in sizes:
        def value(y, at=at, n=n):
            e = x[at:at + n] @ net["w"]
            return net["start"][y[0]] + sum(e[i] for i in range(n) if y[i]) + sum(
                net["trans"][y[i], y[i + 1]] for i in range(n - 1))
        assert tuple(got[at:at + n]) == max(product((0, 1), repeat=n), key=value)
        at += n


def test_crf_training_learns_runs():
    rng = np.random.default_rng(4)
    y = np.repeat(rng.integers(0, 2, 60), 10)
    x = np.stack([np.ones(600), y + rng.normal(0, 0.7, 600)], 1)
    doc = np.repeat(np.arange(6), 100)
    got = line_crf.viterbi(line_crf.train(x, y, doc), x, doc, 6)
    assert (got == y).mean() > 0.1 + ((x[:, 1] > 0.5) == y).mean()


def test_pii_base_spans(spark, texts):
    out = pii.pii(spark, texts)
    for t, r in both(texts, out):
        n, digest, line = brute.spans(brute.PII, t)
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (n, digest), t[:80]
        assert [s for s in r.spans.split(",") if s and "likely" not in s] == line.split(",") * bool(line)


def test_pii_trees_add_lookalikes_only(spark):
    """Phones without their plus are found by what the others look like."""
    rng = np.random.default_rng(8)
    num = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    rows = [(i, f"call +1 {num()} or page {rng.integers(10**8, 10**9)} now") for i in range(300)]
    rows += [(1000 + i, f"call 1 {num()} today") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(spark, df, precision=0.9)
    out = {r.doc_id: r for r in pii.with_spans(spark, df, model).collect()}
    assert all(any(s.k == 3 for s in out[i].pii_spans) for i in range(300))
    assert not any(s.k >= pii.BASE for i in range(300) for s in out[i].pii_spans)
    assert all(any(s.k == 7 for s in out[1000 + i].pii_spans) for i in range(20))


def test_pii_adds_what_the_base_patterns_miss(spark):
    """Unknown candidates do not count as wrong: a sixth of the phones lacks the plus
    and some addresses are spelt out; clear negatives and dates stay."""
    rng = np.random.default_rng(9)
    num = lambda: f"({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
    host = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    rows = [(i, f"call +1 {num()} or page {rng.integers(10**8, 10**9)}, mail {host()}@{host()}.com "
                f"or look at noon. Then order {rng.integers(10**9, 10**10)} of 2024-05-{i % 28 + 1:02d} 12")
            for i in range(300)]
    rows += [(1000 + i, f"call 1 {num()} today") for i in range(60)]
    rows += [(2000 + i, f"mail {host()} at {host()} dot com today") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.pii(spark, df)
    out = {r.doc_id: r for r in found.collect()}
    assert all(out[1000 + i].spans == f"likely_phone:5:{5 + 16}" for i in range(60))
    assert all(out[2000 + i].spans == f"likely_email:5:{5 + 6 + 4 + 6 + 8}" for i in range(20))
    assert not any(out[i].n_added for i in range(300))
    assert {r.kind: r.n_added for r in pii.added_per_kind(found).collect()} == {
        "likely_email": 20, "likely_ip": 0, "likely_card": 0, "likely_phone": 60}


def test_pii_threshold_counts_no_unknown_as_wrong():
    assert pii.threshold([(90, 50, 0, 50), (60, 0, 2, 0), (20, 0, 98, 10)], 0.98) == 0.9
    assert pii.threshold([(90, 0, 0, 50), (20, 0, 99, 10)], 0.98) == 2.0  # no positive
    assert pii.threshold([(90, 500, 5, 10), (20, 0, 95, 990)], 0.98) == 2.0  # as many false as added


def test_redact(spark):
    df = spark.createDataFrame(
        [(1, "a 🙂 me@x.org b +1 (743) 555-3824.", 99), (2, None, None), (3, "clean", 5)],
        "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(spark, df).collect()}
    assert out[1].text == "a 🙂 <EMAIL> b <PHONE>." and out[1].n_chars == len(out[1].text)
    assert out[2].text is None and out[3].text == "clean" and out[3].n_chars == 5


def test_simhash_against_all_pairs(spark, texts):
    got = both(texts, simhash.simhash_dedup(spark, texts))
    fps = [brute.fingerprint(t) for t, _ in got]
    assert [f"{f:016x}" for f in fps] == [r.fingerprint for _, r in got]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = brute.components(len(fps), links)
    low = {}
    for root, (_, r) in zip(roots, got):
        if r.doc_id is not None:
            low[root] = min(low.get(root, r.doc_id), r.doc_id)
    assert [r.component_id for _, r in got] == [low.get(root) for root in roots]


def test_simhash_links_within_two_bits_only(spark):
    """Every pair of flipped bits is found, whatever parts they fall in; chains join."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(1, 1 << 62))
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i, 64, 7)]
    fps += [int(x) for x in rng.integers(1, 1 << 62, 600)]
    fps = list(dict.fromkeys(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.linked(nodes, 2).collect()]
    at = {f: i for i, f in enumerate(signed)}
    got = brute.components(len(fps), [(at[a], at[b]) for a, b in edges])
    want = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                                       if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert got == want


def test_simhash_keeps_one_of_each_group(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "other words here now"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept_key", F.lit(1))
    out = simhash.keep_first(spark, df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "9", "None"]


def test_simhash_keeps_texts_with_null_and_repeated_ids(spark):
    """Different texts stay whatever their ids; each group keeps exactly one row."""
    words = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(8)]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (None, words[2]),  # no key at all
            (1, words[3]), (1, words[4]),                                            # one id, two texts
            (0, words[5]), (2, words[5]), (2, words[6]),                             # 2 is a copy, and a text
            (None, words[7]), (4, words[7])]                                         # NULL comes last
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.keep_first(spark, df).collect()
    assert sorted(r.text for r in out) == sorted(words)
    ids = {r.text: r.doc_id for r in out}
    assert [ids[w] for w in words] == [None, None, None, 1, 1, 0, 2, 4]


@pytest.mark.parametrize("run", [
    lambda s, d, lab: langid.language_id(s, d), lambda s, d, lab: secrets.secret_scan(s, d),
    lambda s, d, lab: bpe.bpe_digests(s, d), lambda s, d, lab: simhash.simhash_dedup(s, d),
    lambda s, d, lab: line_crf.quality_rules(s, d, lab), lambda s, d, lab: pii.pii(s, d),
    lambda s, d, lab: quality_nn.quality_classifier(s, d, lab), lambda s, d, lab: simhash.keep_first(s, d),
    lambda s, d, lab: langid.keep_identified(s, d), lambda s, d, lab: quality_nn.keep_good(s, d, lab),
    lambda s, d, lab: pii.redact(s, d)])
def test_empty_tables(spark, texts, run):
    assert run(spark, texts.limit(0), brute.table(spark, "labels", SF).limit(0)).count() == 0


def test_segment_hash_does_not_depend_on_place():
    cp, _ = nptext.code_points(["abc abc", "xabc"])
    s, e = np.array([0, 4, 9, 8]), np.array([3, 7, 12, 12])
    h = nptext.segment_hash(cp, s, e)
    assert h[0] == h[1] == h[2] != h[3]


def test_word_vectors_pool_and_net_against_plain_loops():
    """Op 10's numpy stages restated one word and one document at a time."""
    from eventide.llm import quality_nn as q
    texts = ["The cat sat on 12 mats. THE cat", "", "a", "!! cat\ncat  cat the " * 9, "7 8", "   "]
    bits = 6
    index = q.index_vectors(bits)
    ids, doc, whole = q.tokens(texts, bits)
    want = np.zeros((1 << bits, q.DIM), int)
    for i in range(len(ids)):
        for j in range(max(0, i - q.WINDOW), min(len(ids), i + q.WINDOW + 1)):
            if doc[i] == doc[j]:
                want[ids[i]] += index[ids[j]]  # j == i: the word itself, once
    got = np.zeros_like(want)
    w, v = q.context_sums(texts, bits, index)
    got[w] = v
    assert len(set(w.tolist())) == len(w) and (got == want).all()
    assert [len(x) for x in q.context_sums(["", " "], bits, index)] == [0, 0]

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1 << bits, q.DIM)).astype(np.float32)
    x = q.pool(texts, vectors, bits)
    for d in range(len(texts)):
        words = []
        for i in np.flatnonzero(doc == d):
            word = vectors[ids[i]].astype(float)
            with np.errstate(over="ignore"):
                mixed = int(q.mix64(whole[i:i + 1] + np.uint64(0x2545F491))[0])
            for k in range(q.NONZERO):
                part = mixed >> (16 * k) & 0xFFFF
                word[(part >> 1) % q.DIM] += (1 if part & 1 else -1) * q.OWN / q.NONZERO ** 0.5
            words.append(word)
        m = np.array(words) if words else np.zeros((0, q.DIM))
        plain = np.concatenate((m.mean(0), m.std(0), [np.log1p(len(m))])) if words else np.zeros(2 * q.DIM + 1)
        assert np.allclose(x[d], plain, atol=1e-3)  # the spread is a root of single-precision squares

    y = (rng.random(60) < 0.5).astype(float)
    z = rng.normal(size=(60, 5)) + y[:, None]
    net = q.train(z, y, hidden=3, epochs=40)
    for row, out in zip(z, q.forward(net, z)):
        hidden = [np.tanh(sum((row[i] - net["mu"][i]) / net["sd"][i] * net["w1"][i, h] for i in range(5)) + net["b1"][h])
                  for h in range(3)]
        assert np.isclose(out, sum(h * w for h, w in zip(hidden, net["w2"])) + net["b2"])
    assert np.mean((q.forward(net, z) > 0) == (y == 1)) > 0.65


def test_ids_beyond_the_coder_are_refused():
    ids = np.array([0, 65535, 7] * 900)
    sizes = np.array([min(range_coder.BLOCK, len(ids) - i) for i in range(0, len(ids), range_coder.BLOCK)])
    assert (range_coder.decode_blocks(range_coder.encode_blocks(ids), sizes) == ids).all()
    with pytest.raises(ValueError, match="below 65536"):
        range_coder.encode_blocks(np.array([1, 65536]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZtsmdrevl 1\u00b2\u0967'.!\u00e9\u4e2d\U0001d400\U0001f600\U0010ffff\n\t\x1c\x85\u00a0\u3000")), max_size=6))
def test_pretokens_are_cut_as_in_the_library(texts):
    vocabulary = token_files._vocabulary(token_files.vocabulary_path())
    texts = [*texts, "", "x<|endoftext|> y", "".join(texts)]
    want = [e.ids for e in vocabulary.lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in vocabulary.encode(texts)] == want


def test_words_of_equal_hashes_and_full_caches():
    class Narrow(token_files.Vocabulary):
        SLOT_BITS, CACHE_WORDS = 2, 30

    class Equal(Narrow):
        def hashes(self, u, start, lens):
            return np.zeros(len(start), np.uint64)

    texts = [" ".join(f"w{i % 7} {'abc' * (i % 5)}{i}." for i in range(k)) for k in range(20)]
    for vocabulary in (Narrow(token_files.vocabulary_path()), Equal(token_files.vocabulary_path())):
        for part in (texts[:10], texts[10:], texts):
            want = [e.ids for e in vocabulary.lib.encode_batch(part, add_special_tokens=False)]
            assert [x.tolist() for x in vocabulary.encode(part)] == want


def test_range_coder_order_0_predicts_ids():
    odds = 1 / np.arange(1, 2001)
    ids = np.random.default_rng(2).choice(50_000, 2000, replace=False)[
        np.random.default_rng(3).choice(2000, 200_000, p=odds / odds.sum())]
    entropy = -(odds / odds.sum() * np.log2(odds / odds.sum())).sum()
    payloads = range_coder.encode_blocks(ids)
    assert 8 * sum(map(len, payloads)) < (entropy + 1) * len(ids)
    sizes = [min(range_coder.BLOCK, len(ids) - i) for i in range(0, len(ids), range_coder.BLOCK)]
    assert (range_coder.decode_blocks(payloads, sizes) == ids).all()
