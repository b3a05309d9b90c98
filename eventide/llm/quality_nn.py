"""Quality classifier: random-indexing word vectors, pooled per document, scored
by a two-layer network whose probabilities are calibrated by a temperature.

*Tokens* are runs of letters, runs of digits and runs of other signs (white
space ends a run); each is hashed to one of ``2**bits`` word ids, a letter run
also to a shape id (upper, capitalised, lower). *Random indexing*: every word
id has a fixed sparse ternary index vector; an id's vector is its own index
vector plus those of its neighbours within two words, summed over the texts of
all documents, centred and scaled to length one. When a text is scored, every
word also adds the index vector of its whole hash, so that words which share an
id differ. *Pooling*: mean and spread of the word vectors, and the logarithm of
the number of tokens. The *network* (one hidden layer of tanh units) is trained
in numpy on a bounded sample of labelled rows; one temperature, fitted on rows
the network has not seen, divides its logits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import fold_of, fresh, held_out, prepare, row_udf, unit_hash
from eventide.llm.langid import _letters
from eventide.llm.nptext import U64, code_points, is_space, mix64, segment_hash, text_blocks

DIM, NONZERO, WINDOW = 48, 4, 2
OWN = 0.25  # length of the index vector that a word adds when it is scored


def tokens(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all tokens in order (shape ids among them), their texts and
    whole hashes (ids are their upper bits)."""
    cp, off = code_points(texts)
    letter = _letters()[cp]
    kind = np.full(len(cp), 3, np.int8)
    kind[letter] = 1
    kind[(cp >= 48) & (cp <= 57)] = 2
    kind[is_space(cp)] = 0
    cut = np.flatnonzero(np.diff(kind, prepend=np.int8(0), append=np.int8(0)))
    start, end = cut[:-1], cut[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    k = kind[start]
    h = segment_hash(cp, start, end)
    h[k == 2] = mix64((end - start)[k == 2].astype(U64))  # numbers: by their length
    upper = (cp >= 65) & (cp <= 90)
    first, last = upper[start], upper[end - 1]
    shape = np.where(k == 1, 1 + first + 2 * last * (end - start > 1), 0)
    whole = np.empty((len(start), 2), U64)
    whole[:, 0] = h
    whole[:, 1] = mix64(shape.astype(U64) + U64(77))
    doc = np.searchsorted(off, start, side="right") - 1
    use = np.ones(whole.shape, bool)
    use[:, 1] = k == 1
    whole = whole[use]
    return (whole >> U64(64 - bits)).astype(np.int64), np.repeat(doc, 2).reshape(use.shape)[use], whole


def index_vectors(bits: int) -> np.ndarray:
    """Index vector of every word id (whole numbers: signs at NONZERO places),
    and a last row of zeros for places between documents."""
    with np.errstate(over="ignore"):
        h = mix64(np.arange(NONZERO << bits, dtype=U64) + U64(0x51ED270B))
    h = h.reshape(-1, NONZERO)
    out = np.zeros(((1 << bits) + 1, DIM), np.int8)
    for j in range(NONZERO):
        out[np.arange(len(h)), (h[:, j] % U64(DIM)).astype(np.int64)] += np.where(
            (h[:, j] >> U64(40)) & U64(1), -1, 1).astype(np.int8)
    return out


def row_sums(x: np.ndarray, first: np.ndarray, dtype) -> np.ndarray:
    """Sums of the runs of rows that start at ``first``, added row by row; long
    runs one at a time, which is many times as fast as ``reduceat``."""
    size = np.diff(first, append=len(x))
    out = np.empty((len(first), x.shape[1]), dtype)
    long = size >= 16
    for i in np.flatnonzero(long):
        x[first[i]:first[i] + size[i]].sum(0, dtype=dtype, out=out[i])
    if not long.all():
        rest = np.repeat(~long, size)
        start = np.concatenate(([0], np.cumsum(size[~long])))[:-1]
        out[~long] = np.add.reduceat(x[rest], start, axis=0, dtype=dtype)
    return out


def context_sums(texts: list[str], bits: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, vectors): index vectors of each word's neighbours and of the
    word itself, summed over its occurrences; exact whole numbers.

    Documents are set apart by WINDOW rows of zeros, so that the neighbours' sum
    is a few shifted additions of one small-integer matrix.
    """
    ids, doc, _ = tokens(texts, bits)
    if not len(ids):
        return np.empty(0, np.int64), np.empty((0, DIM), np.int64)
    apart = WINDOW * (np.concatenate(([0], np.cumsum(np.diff(doc) > 0))) + 1)
    at = np.arange(len(ids)) + apart
    padded = np.full(at[-1] + WINDOW + 1, 1 << bits)
    padded[at] = ids
    rows = index[padded]
    near = rows.copy()  # the word itself, once
    for step in range(1, WINDOW + 1):
        near[step:] += rows[:-step]
        near[:-step] += rows[step:]
    order = np.argsort(ids.astype(np.uint16) if bits <= 16 else ids, kind="stable")
    words = ids[order]
    first = np.flatnonzero(np.diff(words, prepend=-1))
    return words[first], row_sums(near[at[order]], first, np.int64)


def pool(texts: list[str], vectors: np.ndarray, bits: int) -> np.ndarray:
    """Per text: mean and spread of its word vectors, logarithm of its tokens.

    A word's vector is that of its id plus OWN-sized signs at NONZERO places of
    its whole hash. Those touch few entries, so their part of both sums is added
    per document: (b + o)^2 = b^2 + 2bo + o^2.
    """
    out = np.zeros((len(texts), 2 * DIM + 1))
    ids, doc, whole = tokens(texts, bits)
    if len(ids):
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        rows, n = doc[first], np.diff(first, append=len(doc))[:, None]
        v = vectors[ids]
        total, square = row_sums(v, first, np.float64), np.zeros((len(rows), DIM))
        with np.errstate(over="ignore"):
            mixed = mix64(whole + U64(0x2545F491))
        cell = np.repeat(np.arange(len(rows)) * DIM, n[:, 0])
        size, flat, lines = OWN * NONZERO ** -0.5, v.ravel(), np.arange(len(ids)) * DIM
        places, signs = [], []
        for j in range(NONZERO):  # 16 bits an entry: its place and its sign
            part = (mixed >> U64(16 * j)) & U64(0xFFFF)
            place = ((part >> U64(1)) % U64(DIM)).astype(np.int64)
            sign = np.where(part & U64(1), size, -size)
            value = flat[lines + place].astype(float)  # what stands there before this entry
            for p, s in zip(places, signs):
                value += np.where(p == place, s, 0.0)
            places.append(place)
            signs.append(sign)
            total += np.bincount(cell + place, sign, total.size).reshape(total.shape)
            square += np.bincount(cell + place, sign * (2 * value + sign), total.size).reshape(total.shape)
        square += row_sums(np.multiply(v, v, out=v), first, np.float64)
        mean = total / n
        out[rows, :DIM] = mean
        out[rows, DIM:-1] = np.sqrt(np.maximum(square / n - mean * mean, 0))
        out[rows, -1] = np.log1p(n[:, 0])
    return out


def forward(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - net["mu"]) / net["sd"]) @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01,
          decay: float = 1e-4, batch: int = 128, seed: int = 7) -> dict:
    """Adam on the cross entropy; the same rows in the same order give the same net."""
    rng = np.random.default_rng(seed)
    sd = x.std(0)
    net = {"mu": x.mean(0), "sd": np.where(sd > 1e-9, sd, 1.0),
           "w1": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden),
           "w2": rng.normal(0, hidden ** -0.5, hidden), "b2": np.zeros(())}
    z = (x - net["mu"]) / net["sd"]
    names = ("w1", "b1", "w2", "b2")
    m, s, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(z))
        for a in range(0, len(z), batch):
            i = order[a:a + batch]
            h = np.tanh(z[i] @ net["w1"] + net["b1"])
            d = (sigmoid(h @ net["w2"] + net["b2"]) - y[i]) / len(i)
            back = d[:, None] * net["w2"] * (1 - h * h)
            grad = {"w1": z[i].T @ back + decay * net["w1"], "b1": back.sum(0),
                    "w2": h.T @ d + decay * net["w2"], "b2": d.sum()}
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                s[k] = 0.999 * s[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - lr * (m[k] / (1 - 0.9 ** t)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** t)) + 1e-8)
    return net


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least cross entropy on unseen rows."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(20.0), 120))
    loss = [np.mean(np.logaddexp(0, z / t) - y * (z / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def score(model: dict, texts: list[str]) -> dict:
    if model["net"] is None:
        return {"score": np.full(len(texts), model["base"])}
    x = pool(texts, model["vectors"], model["bits"])
    return {"score": np.clip(sigmoid(forward(model["net"], x) / model["t"]), 0, 1)}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, text: str = "text",
        key: str = "doc_id", label: str = "quality", rows: int = 5000, bits: int = 15) -> dict:
    """Learn word vectors from all texts, and the rest from labelled rows outside
    fold 0.

    Network and temperature are fitted on a bounded sample of about ``rows``
    labelled documents, chosen by a hash of the key. Ids with NULL or contradicting labels are not used.
    Without rows of both labels the score is the share of label 1 (0.5
    without any row).
    """
    prepare(spark)
    lab = (labels.select(F.col(key).alias("k"), F.col(label).alias("y"))
           .filter((fold_of(F.col("k")) != 0) & F.col("y").isin(0, 1))
           .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top"))
           .filter(F.col("y") == F.col("top")).drop("top"))
    total = lab.count()
    # Of the ids, about ``rows`` pass the hash: a bounded table, so broadcast.
    chosen = lab.filter(unit_hash(F.col("k")) < rows / max(total, 1))
    sample = (docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
              .filter(F.col("t").isNotNull())
              .join(F.broadcast(chosen), "k").dropDuplicates(["k"]).repartition(8, "k").checkpoint())
    index = index_vectors(bits)

    def vector_rows(total):
        import pandas as pd
        w = np.flatnonzero(np.abs(total).sum(1))
        if len(w):
            yield pd.DataFrame({"w": w, "v": [r.tobytes() for r in total[w].astype("<f4")]})

    def contexts(it):
        total = np.zeros((1 << bits, DIM))
        for pdf in it:
            texts = pdf["t"].tolist()
            for a, b in text_blocks(texts):
                w, v = context_sums(texts[a:b], bits, index)
                total[w] += v
        yield from vector_rows(total)

    def add(it):
        total = np.zeros((1 << bits, DIM))
        for pdf in it:
            w = pdf["w"].to_numpy()
            order = np.argsort(w, kind="stable")
            first = np.flatnonzero(np.diff(w[order], prepend=-1))
            v = np.frombuffer(b"".join(pdf["v"].tolist()), "<f4").reshape(-1, DIM).astype(float)
            total[w[order][first]] += np.add.reduceat(v[order], first, axis=0)
        yield from vector_rows(total)

    kind = "w long, v binary"
    # A map task gives at most 2**bits short vectors, a part of its input; they meet
    # by id in as many tasks as the session shuffles into, and one of each id comes back.
    every = docs.select(F.col(text).alias("t")).filter("t is not null")
    found = every.mapInPandas(contexts, kind).repartition("w").mapInPandas(add, kind).toPandas()
    vectors = np.zeros((1 << bits, DIM), np.float32)
    if len(found):
        found = found.sort_values("w")
        v = np.frombuffer(b"".join(found["v"].tolist()), "<f4").reshape(-1, DIM).astype(float)
        v = np.sign(v) * np.log1p(np.abs(v))
        v -= v.mean(0)
        vectors[found["w"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    shared = spark.sparkContext.broadcast(vectors)

    def features(it):
        import pandas as pd
        for pdf in it:
            texts = pdf["t"].tolist()
            for a, b in text_blocks(texts):
                x = pool(texts[a:b], shared.value, bits)
                yield pd.DataFrame({"k": pdf["k"].to_numpy()[a:b], "y": pdf["y"].to_numpy()[a:b],
                                    "x": list(x)})

    table = (sample.mapInPandas(features, "k long, y int, x array<double>")
             .withColumn("u", unit_hash(F.col("k"), F.lit(1))).toPandas().sort_values("k"))
    y = table["y"].to_numpy(float)
    model = {"net": None, "bits": bits, "vectors": vectors,
             "base": float(y.mean()) if len(y) else 0.5, "t": 1.0}
    if 0 < y.sum() < len(y):
        x = np.stack(table["x"].tolist())
        unseen = table["u"].to_numpy() < 0.2
        if not 0 < y[~unseen].sum() < (~unseen).sum():
            unseen[:] = False
        model["net"] = train(x[~unseen], y[~unseen])
        if unseen.any():
            model["t"] = temperature(forward(model["net"], x[unseen]), y[unseen])
    return model


def with_score(spark: SparkSession, docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``docs`` with a last column: a struct holding the calibrated ``score``.

    Defined results: a NULL or empty text is scored as a document without
    tokens; repeated rows get equal scores; an empty table stays empty; other
    columns, whatever their names, pass through unread.
    """
    prepare(spark)
    return docs.withColumn(fresh(docs, "quality_score"),
                           row_udf(spark, "score double", model, score)(F.col(text)))


def quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame,
                       threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = with_score(spark, docs.select("doc_id", "text"), fit(spark, docs, labels))
    s = F.col("quality_score.score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"),
                      (s >= threshold).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame,
              threshold: float = 0.3) -> DataFrame:
    """Rows whose score reaches ``threshold``."""
    out = with_score(spark, docs, fit(spark, docs, labels))
    p = out.columns[-1]
    return out.filter(F.col(f"`{p}`.score") >= threshold).drop(p)
