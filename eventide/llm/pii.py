"""Personal data: generated candidates judged by boosted trees.

*Base.* Four strict patterns give spans that always stay. *Generators.* Wider
patterns propose further, overlapping spans: addresses with ``@`` spelt out,
and groups of digits with any usual separators. *Features.* Each candidate is
described by its format (digits, groups, separators) and its context (the
characters around it, telling words before it) - but not by the sign the base
patterns hinge on (the plus, the ``@``, the check digit), so that what is
learned from base spans carries over to spans they miss. *Labels.* A candidate
that a base span covers is a positive. One that cannot be personal data is a
clear negative: a card number whose check digit fails, more than 19 digits, an address
with a part over 255, a date, a version, page or order number, digits inside a word, a mail
address with a blank beside its dot or without letters at its end. All others
are *unknown*: they count neither way, and they alone can be added. *Trees.*
Gradient boosting (Spark ML) learns positives against clear negatives on a
bounded sample; the trees are then plain SQL expressions, evaluated in the row
of the text. *Thresholds.* From a histogram of the scores of all documents: of
the unknown candidates from a score on, at most as many are false as if every
unknown one were a negative and scored like the clear ones that the trees have
not seen. Each kind takes the least score at which that bound, and the share of
positives among the unseen labelled ones, keep the wanted precision. Everything
runs as Spark functions inside the row; only the histogram is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import fresh, prepare, unit_hash
from eventide.llm.spans import count_of, text_of, with_matches

# Fixed values of the contract: the base patterns. Repeats are possessive and
# starts are limited to where a match can begin (or the last one ended), which
# finds the same matches in linear time.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = ["email", "ip", "card", "phone", "likely_email", "likely_ip", "likely_card", "likely_phone"]
BASE = 4
# The generators.
SPELT = (rf"(?:(?<!{LOCAL})|\G){LOCAL}{{1,64}}+ ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{{1,63}}+"
         r"(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}+){1,8}+")
DIGITS = r"[+(]{0,2}[0-9](?:[ ().\-/]{0,3}[0-9]){6,24}+"
FEATURES = ["length", "digits", "letters", "groups", "spaces", "dots", "dashes", "parens", "slashes",
            "first_group", "last_group", "word_before", "word_after", "says_phone", "says_card",
            "says_address", "says_number", "tail_letters", "is_mail"]
# Clear negatives: a number word right before plain digits; a date at the start.
NUMBERED = r"\b(?:version|ver|v|release|build|pages?|pp?|isbn|issn|order|invoice|serial|sku|no\.|nr\.|id)[ :#=.]{0,3}$"
DATE = r"^(?:[12][0-9]{3}([-/.])[01]?[0-9]\1[0-3]?[0-9]|[0-3]?[0-9]([-/.])[01]?[0-9]\2[12][0-9]{3})(?![0-9])"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _count(c: Column, sign: str) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit(sign), F.lit("")))


def _spans(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end")))


def with_base(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of base spans (start, k, end)."""
    t, names = F.col(text), [f"{out}_{i}" for i in range(BASE)]
    number = t.rlike("[0-9]")
    tests = (t.contains("@") & t.contains("."), number & t.contains("."), number, t.contains("+"))
    for n, p, w in zip(names, (EMAIL, IP, CARD, PHONE), tests):
        df = with_matches(df, n, p, text=text, when=w)

    def long_enough(x, low, high):
        return F.char_length(_digits(x["m"])).between(low, high)

    # Three short tests first: most runs of digits are no card.
    ok = (lambda x: F.lit(True),
          lambda x: x["m"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"),
          lambda x: long_enough(x, 14, 19) & F.call_function("luhn_check", _digits(x["m"])),
          lambda x: long_enough(x, 10, 15))
    spans = [_spans(F.filter(n, ok[k]), k) for k, n in enumerate(names)]
    return df.withColumn(out, F.concat(*spans)).drop(*names)


def with_candidates(df: DataFrame, text: str, base: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of candidates: span, kind, features, the label
    ``y`` (1 if a base span covers it, 0 for a clear negative, NULL if unknown)
    and whether a base span touches it (``near``)."""
    t = F.col(text)
    marks = [t.contains(x) for x in ("@", "(at)", "[at]", " dot ")]
    some = marks[0] | marks[1] | marks[2] | marks[3]
    m, d = f"{out}_m", f"{out}_d"
    df = with_matches(df, m, SPELT, text=text, when=some, before=16, after=2)
    df = with_matches(df, d, DIGITS, text=text, when=t.rlike("[0-9]"), before=16, after=2)

    def describe(x, mail: bool):
        before = F.lower(x["before"])
        # Spelt-out signs read as signs, and the plus is left out: the features
        # of a span do not tell whether the base patterns could find it.
        v = F.regexp_replace(F.regexp_replace(
            x["m"], r" ?(?:\(at\)|\[at\]| at ) ?", "@"), r" ?(?:\(dot\)|\[dot\]| dot ) ?", ".") if mail else (
            F.replace(x["m"], F.lit("+"), F.lit("")))
        digits = _digits(v)
        n = F.char_length(digits)
        kind = F.lit(0) if mail else (
            F.when(_count(v, ".") == 3, F.when(n <= 12, 1).otherwise(3))
            .when(n.between(13, 19), 2).otherwise(3))
        says = lambda p: before.rlike(p).cast("double")
        f = {"length": F.char_length(v), "digits": n,
             "letters": F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")),
             "groups": F.regexp_count(v, F.lit("[0-9A-Za-z]+")), "spaces": _count(v, " "),
             "dots": _count(v, "."), "dashes": _count(v, "-"),
             "parens": _count(v, "(") + _count(v, ")"), "slashes": _count(v, "/"),
             "first_group": F.char_length(F.regexp_extract(v, "^[^0-9]*([0-9]*)", 1)),
             "last_group": F.char_length(F.regexp_extract(v, "([0-9]*)$", 1)),
             "word_before": x["before"].rlike(r"[\p{L}_.=:/-]$"),
             "word_after": x["after"].rlike(r"^[\p{L}_=:/-]"),
             "says_phone": says("tel|phone|call|mobile|fax"), "says_card": says("card|visa|pay"),
             "says_address": says("mail|contact|@|host|addr|ip"),
             "says_number": says("version|page|isbn|order|no\\.|id"),
             "tail_letters": F.char_length(F.regexp_extract(v, "([A-Za-z]*)$", 1)), "is_mail": F.lit(mail)}
        if mail:
            wrong = v.rlike(r" \.|\. ") | ~v.rlike("[A-Za-z]{2}$")
        else:
            joined = F.replace(v, F.lit(" "), F.lit(""))
            wrong = ((kind == 2) & ~F.call_function("luhn_check", digits) | (n > 19)
                     | joined.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & ~joined.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
                     | before.rlike(NUMBERED) & ~v.rlike(r"[ ()]") | v.rlike(DATE)
                     | before.rlike(r"[\p{L}_]$") | x["after"].rlike(r"^[\p{L}_]"))
        covered = F.exists(base, lambda b: (b["start"] <= x["start"] + F.lit(2)) & (b["end"] >= x["end"]))
        touched = F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("k"),
                        *[c.cast("double").alias(k) for k, c in f.items()],
                        F.when(covered, 1.0).when(wrong & ~touched, 0.0).alias("y"), touched.alias("near"))

    return df.withColumn(out, F.concat(F.transform(m, lambda x: describe(x, True)),
                                       F.transform(d, lambda x: describe(x, False)))).drop(m, d)


def _tree(node, x: Column) -> Column:
    """One regression tree as a nested conditional over a candidate's features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    s = node.split()
    return F.when(x[FEATURES[s.featureIndex()]] <= float(s.threshold()),
                  _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def probability(trees: list, x: Column) -> Column:
    """Boosted score of candidate ``x``: the logistic of twice the weighted sum."""
    total = F.lit(0.0)
    for weight, root in trees:
        total = total + F.lit(weight) * _tree(root, x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))


def fit(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text",
        rows: int = 6000, rounds: int = 10, depth: int = 3, precision: float = 0.98) -> dict:
    """Boosted trees and one threshold per kind.

    The trees are fitted on the labelled candidates of a bounded sample of about
    ``rows`` documents, chosen by a hash of the key; the thresholds come from
    the candidates of all documents. Without both labels in the sample there
    are no trees, and without a positive of a kind nothing of it is added.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    prepare(spark)
    df = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    share = rows / max(df.count(), 1)
    # A fifth of the sample is left unseen, for tables no larger than it.
    trained = (unit_hash(F.col("key")) < share) & (unit_hash(F.col("key"), F.lit(1)) >= 0.2)
    df = df.filter("t is not null")
    sample = with_candidates(with_base(df.filter(trained), "t", "base"), "t", "base", "c")
    # explode() would have Spark push a test of the arrays' sizes, with all the
    # expressions behind them, below the steps that share their results.
    found = sample.select(F.explode_outer("c").alias("c")).repartition(4).checkpoint().filter("c.y is not null")
    model = {"trees": [], "least": [2.0] * BASE}
    if len(found.select("c.y").distinct().collect()) < 2:
        return model
    table = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found.select("c.*"))
    gbt = GBTClassifier(labelCol="y", featuresCol="x", maxIter=rounds, maxDepth=depth, maxBins=32,
                        stepSize=0.3, seed=11, cacheNodeIds=False)
    fitted = gbt.fit(table)
    model["trees"] = [(w, t._call_java("rootNode")) for w, t in zip(fitted.treeWeights, fitted.trees)]
    # Labelled candidates of unseen rows, and the unknown ones that can be added.
    every = with_candidates(with_base(df.withColumn("trained", trained), "t", "base"), "t", "base", "c")
    used = F.filter("c", lambda x: F.when(x["y"].isNull(), ~x["near"]).otherwise(~F.col("trained")))
    every = every.select(F.explode_outer(F.transform(used, lambda x: F.struct(
        x["k"].alias("k"), F.floor(probability(model["trees"], x) * 100).alias("s"),
        x["y"].alias("y")))).alias("c"))
    # At most 4 kinds x 101 score steps come back.
    steps = every.groupBy("c.k", "c.s").agg(
        F.count_if(F.col("c.y") == 1).alias("hit"), F.count_if(F.col("c.y") == 0).alias("miss"),
        F.count_if(F.col("c.y").isNull()).alias("open"))
    by: dict[int, list] = {}
    for r in steps.collect():
        if r.k is not None:
            by.setdefault(r.k, []).append((r.s, r.hit, r.miss, r.open))
    for k, parts in by.items():
        model["least"][k] = threshold(parts, precision)
    return model


def threshold(steps: list[tuple[int, int, int, int]], precision: float) -> float:
    """The least score, of 0.5 or more, at which both bounds hold; 2 if none.

    ``steps``: score in hundredths, positives, clear negatives, unknown ones.
    Of the unknown candidates from a score on, no more than the share of clear
    negatives that get there times all unknown ones should be false.
    """
    negatives, unknown = sum(x[2] for x in steps), sum(x[3] for x in steps)
    best, hit, miss, some = 2.0, 0, 0, 0
    for s, h, m, u in sorted(steps, reverse=True):
        hit, miss, some = hit + h, miss + m, some + u
        false = miss / max(negatives, 1) * unknown
        if s >= 50 and hit and hit >= precision * (hit + miss) and false <= (1 - precision) * some:
            best = s / 100
    return best


def with_spans(spark: SparkSession, docs: DataFrame, model: dict, *, text: str = "text") -> DataFrame:
    """``docs`` with a last column: the array of all spans (start, k, end).

    ``k`` indexes ``KINDS``. Base spans stay as they are, whatever they overlap.
    A candidate is added where it is no clear negative, its score reaches its
    kind's threshold, no base span touches it and no better-scored candidate overlaps it (ties: the one
    that starts first, then the longer). Defined results: a NULL or empty text
    has no span; repeated rows get equal spans; an empty table stays empty;
    other columns pass through whatever their names.
    """
    prepare(spark)
    t, base, cand, out = (fresh(docs, x) for x in ("pii_text", "pii_base", "pii_c", "pii_spans"))
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = with_base(df, t, base)
    if not model["trees"]:
        return df.withColumn(out, F.sort_array(base)).drop(t, base)
    df = with_candidates(df, t, base, cand)
    least = F.array(*[F.lit(x) for x in model["least"]])
    df = df.withColumn(cand, F.transform(F.filter(
        cand, lambda x: ~x["near"] & x["y"].isNull()), lambda x: F.struct(
        (-probability(model["trees"], x)).alias("p"), x["start"].alias("start"),
        (-x["end"]).alias("e"), x["k"].alias("k"))))
    df = df.withColumn(cand, F.sort_array(F.filter(
        cand, lambda x: -x["p"] >= F.get(least, x["k"]))))
    # Best first: a candidate yields to any earlier one of the list that it overlaps.
    better = lambda x: F.exists(cand, lambda o: (o < x) & (o["start"] < -x["e"]) & (-o["e"] > x["start"]))
    added = F.transform(F.filter(cand, lambda x: ~better(x)), lambda x: F.struct(
        x["start"].alias("start"), (x["k"] + BASE).alias("k"), (-x["e"]).alias("end")))
    return df.withColumn(out, F.sort_array(F.concat(base, added))).drop(t, base, cand)


def pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their hash, all spans and the number added."""
    df = docs.select("doc_id", "text")
    out = with_spans(spark, df, fit(spark, docs))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["k"] < BASE)
    return out.select(
        "doc_id", *[count_of(spans, k).alias(f"n_{x}") for k, x in enumerate(KINDS[:BASE])],
        F.sha2(text_of(base, KINDS), 256).alias("base_sha256"), text_of(spans, KINDS).alias("spans"),
        F.size(F.filter(spans, lambda s: s["k"] >= BASE)).cast("long").alias("n_added"))


def added_per_kind(out: DataFrame) -> DataFrame:
    """kind, n_added: the added spans of each kind in the result of ``pii``."""
    kinds = F.array(*[F.lit(x) for x in KINDS[BASE:]])
    found = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.regexp_count(
        "spans", F.concat(k, F.lit(":"))).alias("n")))
    return (out.select(F.explode_outer(found).alias("x"))
            .groupBy("x.kind").agg(F.sum("x.n").alias("n_added")))


def redact(spark: SparkSession, docs: DataFrame, *, text: str = "text",
           n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by a mark such as ``<EMAIL>``.

    Overlapping spans become one mark, that of the first. A text without spans
    is unchanged; ``n_chars``, where the table has it, follows the new text.
    """
    df = with_spans(spark, docs, fit(spark, docs, text=text), text=text)
    spans = df.columns[-1]
    t = F.col(text)
    marks = F.array(*[F.lit(f"<{x.removeprefix('likely_').upper()}>") for x in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(a, s):
        new = F.struct(s["end"].alias("at"), F.concat(
            a["done"], F.when(s["start"] >= a["at"], F.concat(
                F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.get(marks, s["k"]))).otherwise("")).alias("done"))
        return F.when(s["end"] <= a["at"], a).otherwise(new)

    whole = F.aggregate(spans, start, step, lambda a: F.concat(
        a["done"], F.substring(t, a["at"] + 1, F.char_length(t))))
    new = F.when(F.size(spans) > 0, whole).otherwise(t)
    df = df.withColumn(text, new)
    if n_chars in df.columns:
        df = df.withColumn(n_chars, F.when(F.size(spans) > 0, F.char_length(F.col(text)).cast("long"))
                           .otherwise(F.col(n_chars)))
    return df.drop(spans)
