"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and reduced to letters and single spaces; every 1-, 2-
and 3-gram of a text is hashed to one of ``2**bits`` buckets. The matrix of
log-probabilities (languages x buckets, fixed size) is broadcast and a batch
is scored as one sparse product: the buckets of all texts in a flat index
array, the texts' borders as row pointers, summed per text and language.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import fold_of, fresh, held_out, prepare, row_udf, unit_hash
from eventide.llm.nptext import code_points, text_blocks

UND = "und"
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], bits: int):
    """For n = 1, 2, 3: the buckets of all n-grams in text order, and their texts."""
    cp, off = code_points([t.lower() for t in texts], " ")
    letter = _letters()[cp]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each run of letters
    c = np.where(letter, cp, np.uint32(32))[keep].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))[keep]
    with np.errstate(over="ignore"):
        for n in (1, 2, 3):
            m = len(c) - n + 1
            if m <= 0:
                break
            x = np.full(m, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
            for k in range(n):
                x += c[k:k + m] * _MULT[k]
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
            same = doc[:m] == doc[n - 1:]
            yield (x >> np.uint32(32 - bits))[same], doc[:m][same]


def score(model: dict, texts: list[str]) -> dict:
    """Most likely language and its posterior; ``und`` and 0 without a letter."""
    langs, logp, prior = model["langs"], model["logp"], model["prior"]
    pred, conf = np.full(len(texts), UND, object), np.zeros(len(texts))
    if langs and texts:
        total = np.tile(prior, (len(texts), 1))
        rows = np.empty(0, np.int64)
        for idx, doc in grams(texts, model["bits"]):
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                rows = rows if len(rows) else doc[first]  # texts with a letter
                for k in range(len(langs)):
                    total[doc[first], k] += np.add.reduceat(logp[k][idx], first)
        if len(rows):
            s = total[rows]
            best = s.argmax(1)  # ties: the first language in order
            p = 1 / np.exp(s - s[np.arange(len(s)), best][:, None]).sum(1)
            pred[rows], conf[rows] = np.array(langs, object)[best], np.clip(p, 0, 1)
    return {"lang_pred": pred, "score": conf}


def fit(spark: SparkSession, docs: DataFrame, *, text: str = "text", lang: str = "lang",
        key: str = "doc_id", bits: int = 16, rows_per_lang: int = 1500, max_langs: int = 64,
        smoothing: float = 0.5) -> dict:
    """Learn from rows with a text and a language outside fold 0.

    The classifier is fitted on a bounded sample: about ``rows_per_lang`` rows
    of each language, chosen by a hash of the key (all rows of a rarer one).
    More than ``max_langs`` language values raise an error.
    """
    prepare(spark)
    # Columns are renamed by position, so clashing extra names do no harm.
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    rows = rows.filter((fold_of(F.col("k")) != 0) & F.col("t").isNotNull() & F.col("l").isNotNull())
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n"))
              .limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} language values")
    langs = sorted(counts)
    model = {"langs": langs, "bits": bits, "logp": np.empty((0, 0)), "prior": np.empty(0)}
    if not langs:
        return model
    share = F.element_at(F.create_map(*[F.lit(v) for x in langs
                                        for v in (x, rows_per_lang / counts[x])]), F.col("l"))
    sample = rows.filter(unit_hash(F.col("k")) < share).select("t", "l").repartition(8)
    where = {x: i for i, x in enumerate(langs)}

    def count(it):
        import pandas as pd
        total = np.zeros((len(where), 1 << bits), np.int64)
        for pdf in it:
            texts, ls = pdf["t"].tolist(), np.array([where[x] for x in pdf["l"]])
            for a, b in text_blocks(texts):
                for idx, doc in grams(texts[a:b], bits):
                    flat = ls[a:b][doc] * (1 << bits) + idx.astype(np.int64)
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
        li, bi = np.nonzero(total)
        yield pd.DataFrame({"l": li, "b": bi, "n": total[li, bi]})

    # At most languages x buckets rows, whatever the size of the input.
    found = (sample.mapInPandas(count, "l long, b long, n long")
             .groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas())
    c = np.full((len(langs), 1 << bits), smoothing)
    c[found["l"].to_numpy(), found["b"].to_numpy()] += found["n"].to_numpy()
    n = np.array([counts[x] for x in langs], float)
    model |= {"logp": np.log(c / c.sum(1, keepdims=True)), "prior": np.log(n / n.sum())}
    return model


def identify(spark: SparkSession, docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``docs`` with a struct column holding ``lang_pred`` and ``score``.

    Defined results: a NULL text or one without a letter gives (``und``, 0), as
    does every text when nothing could be learned; ties go to the language
    first in order; repeated rows get equal results; an empty table stays
    empty; whatever else the table holds is passed through unread. The struct
    is the last column.
    """
    prepare(spark)
    udf = row_udf(spark, "lang_pred string, score double", model, score)
    return docs.withColumn(fresh(docs, "language"), udf(F.col(text)))


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    out = identify(spark, docs.select("doc_id", "text"), fit(spark, docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                      "language.lang_pred", "language.score")


def keep_identified(spark: SparkSession, docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Rows whose language is identified with posterior ``min_score`` or more."""
    out = identify(spark, docs, fit(spark, docs))
    p = out.columns[-1]
    return (out.filter((F.col(f"`{p}`.lang_pred") != UND) & (F.col(f"`{p}`.score") >= min_score))
            .drop(p))
