"""Quality rules with line labelling: a linear-chain CRF marks each line of a
text as content or boilerplate, and the share of content decides retention.

Counting rules (words, symbols, repeated lines and 5-word windows) fail a text
outright. For the rest each line gets features, a two-state chain scores them
together with the change of state between neighbours, and Viterbi decoding
finds the best labelling of the whole text. The chain's weights maximise the
likelihood of weakly labelled lines: those of a text labelled good are
content, those of a bad one and repeated lines are boilerplate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import fold_of, prepare, row_udf, unit_hash
from eventide.llm.langid import _letters
from eventide.llm.nptext import (U64, code_points, is_space, mix64, owner, runs, segment_hash,
                                 sums, text_blocks)

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
FEATURES = 11


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur at least twice, and which equal an earlier one."""
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def analyse(texts: list[str]) -> dict:
    """Counts per text and features per line of a batch of texts."""
    cp, off = code_points(texts)
    ws, we = runs(~is_space(cp))
    wdoc = owner(ws, off)
    n = len(texts)
    n_words = np.bincount(wdoc, minlength=n)
    word_chars = np.bincount(wdoc, we - ws, minlength=n).astype(np.int64)
    symbol = np.isin(cp, np.frombuffer(SYMBOLS.encode("utf-32-le"), "<u4"))
    # Lines: every text ends in the newline that separates it from the next.
    le = np.flatnonzero(cp == 10)
    ls = np.concatenate(([0], le[:-1] + 1))
    ldoc = owner(ls, off)
    wline = np.searchsorted(le, ws)
    line_words = np.bincount(wline, minlength=len(ls))
    line_chars = np.bincount(wline, we - ws, minlength=len(ls))
    salt = mix64(np.arange(n, dtype=U64) + U64(1))  # equal only within one text
    with np.errstate(over="ignore"):
        twice, later = _repeated(segment_hash(cp, ls, le) + salt[ldoc])
        full = line_words > 0
        dup_lines = np.bincount(ldoc[full & later], minlength=n)
        # Words in windows that occur twice or more.
        covered = np.zeros(len(ws), bool)
        m = len(ws) - WINDOW + 1
        if m > 0:
            wh, h = segment_hash(cp, ws, we), np.zeros(m, U64)
            for k in range(WINDOW):
                h = mix64(h + wh[k:k + m] + U64(k + 1))
            at = np.flatnonzero(wdoc[:m] == wdoc[WINDOW - 1:])
            at = at[_repeated(h[at] + salt[wdoc[at]])[0]]
            edge = np.zeros(len(ws) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            covered = np.cumsum(edge[:-1]) > 0
    letter, lo = _letters()[cp], np.append(ls, len(cp))
    per = np.maximum(line_chars, 1)
    upper = (cp >= 65) & (cp <= 90)
    last = np.full(len(ls), 32, np.uint32)
    last[wline] = cp[we - 1]
    x = np.stack([
        np.ones(len(ls)), np.minimum(np.log1p(line_words), 5), line_words == 0,
        sums(symbol, lo) / per, sums((cp >= 48) & (cp <= 57), lo) / per, sums(upper, lo) / per,
        1 - sums(letter, lo) / per, np.minimum(line_chars / np.maximum(line_words, 1), 20) / 10,
        np.isin(last, [33, 46, 63]), twice & full,
        np.bincount(wline, covered, minlength=len(ls)) / np.maximum(line_words, 1)], 1).astype(float)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": sums(symbol, off),
            "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(wdoc[covered], minlength=n),
            "x": x, "line_doc": ldoc, "line_chars": line_chars, "dup": twice & full}


def viterbi(net: dict, x: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Best labels (1: content) of all lines; ``doc`` is their text, in order.

    All texts of the batch advance together, one line a step.
    """
    emit, trans, start = x @ net["w"], net["trans"], net["start"]
    first = np.searchsorted(doc, np.arange(n))
    size = np.searchsorted(doc, np.arange(n), side="right") - first
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    back = np.zeros((len(x), 2), np.int8)
    best = np.zeros((n, 2))
    longest = int(size.max()) if n else 0
    alive = np.searchsorted(-size, -np.arange(longest), side="left")
    for t in range(longest):
        k = alive[t]
        at = first[:k] + t
        if t == 0:
            best[:k] = start
        else:
            score = best[:k, :, None] + trans  # from, to
            back[at] = score.argmax(1)
            best[:k] = score.max(1)
        best[:k, 1] += emit[at]
    label = np.zeros(len(x), np.int8)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        ends = size[:k] == t + 1
        now = np.where(ends, state[:k], label[np.minimum(at + 1, len(x) - 1)])
        label[at] = np.where(ends, now, back[np.minimum(at + 1, len(x) - 1), now])
    return label


def train(x: np.ndarray, y: np.ndarray, doc: np.ndarray, steps: int = 150, rate: float = 0.1,
          decay: float = 1e-3, longest: int = 64) -> dict:
    """Weights of greatest penalised likelihood (Adam; forward-backward).

    Texts of many lines are cut into chains of ``longest`` lines.
    """
    pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
    new = (pos % longest) == 0
    chain, at = np.cumsum(new) - 1, pos % longest
    rows = chain[-1] + 1
    X = np.zeros((rows, longest, x.shape[1]))
    Y, M = np.zeros((rows, longest), int), np.zeros((rows, longest), bool)
    X[chain, at], Y[chain, at], M[chain, at] = x, y, True
    theta = np.zeros(x.shape[1] + 6)  # weights, transitions, start
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    total = M.sum()
    both = M[:, 1:] & M[:, :-1]
    pairs = np.array([[(both & (Y[:, :-1] == a) & (Y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    starts = np.bincount(Y[:, 0], minlength=2)
    hits = X[M & (Y == 1)].sum(0)
    for step in range(1, steps + 1):
        w, trans, start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.zeros((rows, longest, 2))
        e[..., 1] = X @ w
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = start + e[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(a[:, t - 1, :1] + trans[0], a[:, t - 1, 1:] + trans[1]) + e[:, t]
            a[:, t] = np.where(M[:, t, None], nxt, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            f = e[:, t + 1] + b[:, t + 1]
            prv = np.logaddexp(trans[:, 0] + f[:, :1], trans[:, 1] + f[:, 1:])
            b[:, t] = np.where(M[:, t + 1, None], prv, b[:, t])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None])
        joint = np.exp(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None])
        g = np.concatenate((hits - (X * (p[..., 1] * M)[..., None]).sum((0, 1)),
                            (pairs - joint[both].sum(0)).ravel(), starts - p[:, 0].sum(0))) / total
        g -= decay * theta
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return {"w": theta[:-6], "trans": theta[-6:-2].reshape(2, 2), "start": theta[-2:]}


def judge(net: dict | None, texts: list[str], share: float) -> dict:
    a = analyse(texts)
    n = len(texts)
    failed = (a["n_words"] < LEAST_WORDS) | (100 * a["n_repeat_words"] > MOST_REPEATED * a["n_words"])
    label = np.ones(len(a["x"]), np.int8) if net is None else viterbi(net, a["x"], a["line_doc"], n)
    content = np.bincount(a["line_doc"], a["line_chars"] * label, minlength=n)
    part = content / np.maximum(a["word_chars"], 1)
    cut = np.searchsorted(a["line_doc"], np.arange(n + 1))
    return {**{k: a[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            "base_failed": failed, "kept": ~failed & (part >= share), "content_share": part,
            "lines": [label[cut[i]:cut[i + 1]].astype(bool) for i in range(n)]}


def _judge(model, texts):
    return judge(model["net"], texts, model["share"])


def _counts(model, texts):
    out = judge(model["net"], texts, model["share"])
    del out["lines"]
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, key: str = "doc_id",
        text: str = "text", label: str = "quality", rows: int = 2500) -> dict | None:
    """The chain, fitted on a bounded sample of about ``rows`` labelled texts
    (chosen by a hash of the key, outside fold 0); None without both labels."""
    prepare(spark)
    lab = (labels.select(F.col(key).alias("k"), F.col(label).alias("y"))
           .filter((fold_of(F.col("k")) != 0) & F.col("y").isin(0, 1))
           .groupBy("k").agg(F.min("y").alias("y")))
    chosen = lab.filter(unit_hash(F.col("k")) < rows / max(lab.count(), 1))  # about ``rows``: broadcast
    sample = (docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null")
              .join(F.broadcast(chosen), "k").dropDuplicates(["k"]).repartition(8, "k"))

    def lines(it):
        import pandas as pd
        for pdf in it:
            texts = pdf["t"].tolist()
            for i, j in text_blocks(texts):
                a = analyse(texts[i:j])
                good = pdf["y"].to_numpy()[i:j][a["line_doc"]] == 1
                yield pd.DataFrame({"k": pdf["k"].to_numpy()[i:j][a["line_doc"]],
                                    "at": np.arange(len(a["x"])),
                                    "y": (good & ~a["dup"]).astype(int), "x": list(a["x"])})

    table = (sample.mapInPandas(lines, "k long, at long, y long, x array<double>").toPandas()
             .sort_values(["k", "at"]))
    y = table["y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    return train(np.stack(table["x"].tolist()), y, table["k"].to_numpy())


def line_labels(spark: SparkSession, docs: DataFrame, net: dict | None, *, key: str = "doc_id",
                text: str = "text", share: float = 0.5) -> DataFrame:
    """Per row of ``docs``: key, counts, base_failed, kept, content_share and
    ``lines``, an array with true for each \\n-split line that is content.

    Defined results: a NULL text has no word and fails; without a chain (no
    labels to learn from) every line is content; repeated rows get equal
    results; an empty table stays empty; other columns are not read.
    """
    prepare(spark)
    udf = row_udf(spark, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                  "n_repeat_words long, base_failed boolean, kept boolean, content_share double, "
                  "lines array<boolean>", {"net": net, "share": share}, _judge)
    return docs.select(key, udf(F.col(text)).alias("q")).select(key, "q.*")


def quality_rules(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and content_share per document."""
    model = {"net": fit(spark, docs, labels), "share": 0.5}
    udf = row_udf(spark, "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                  "n_repeat_words long, base_failed boolean, kept boolean, content_share double",
                  model, _counts)
    return docs.select("doc_id", udf(F.col("text")).alias("q")).select("doc_id", "q.*")
