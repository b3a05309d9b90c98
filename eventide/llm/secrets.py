"""Secret scan: spans of likely credentials, told apart by corpus-wide ownership.

Patterns propose candidates: assigned secrets, access keys, long hex runs and,
as a wide net, long mixed tokens. Each candidate's hash is counted over the
whole corpus by distinct repositories and owners. A value that many owners or
very many repositories hold is an *example*, copied around; any other value that
looks random is *live*. Pattern spans always stay; mixed tokens become spans
only if they are live. All of it is Spark functions, joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import prepare
from eventide.llm.spans import count_of, text_of, with_matches

# Fixed values of the contract: patterns and least lengths.
ASSIGN = (r"((?i:password|passwd|secret|token|api_?key))" r"""["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "live"]
# The wide net: runs of 20 or more characters that keys are made of.
TOKEN = r"[A-Za-z0-9_+/=-]{20,}"


def _span(x: Column, kind: str, value: Column, live: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"),
                    x["end"].alias("end"), F.sha2(value, 256).alias("h"), live.alias("live"))


def _random_looking(v: Column) -> Column:
    """Letters and digits, and at least ten different characters."""
    return (v.rlike("[0-9]") & v.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(v, ""))) >= 10))


def candidates(docs: DataFrame, key: str, owner: str, text: str) -> DataFrame:
    """One row per document: key, owner and the arrays ``base`` and ``wide``."""
    df = docs.select(F.col(key).alias("key"), F.coalesce(F.col(owner), F.lit("")).alias("owner"),
                     F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    df = with_matches(df, "a", ASSIGN, text="t", when=t.contains("=") | t.contains(":"))
    df = with_matches(df, "c", ACCESS, text="t", when=t.contains("AKIA"))
    # A run of fewer than 16 fails alone and hides no other match.
    df = with_matches(df, "x", r"[0-9a-f]{16,}", text="t", when=t.rlike("[0-9a-f]{16}"))
    df = with_matches(df, "w", TOKEN, text="t", when=t.rlike(TOKEN)).drop("t")
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    base = F.concat(
        F.transform(F.filter("a", lambda x: F.char_length(value(x)) >= LEAST["assign"]),
                    lambda x: _span(x, "assign", value(x), _random_looking(value(x)))),
        F.transform(F.filter("c", lambda x: F.char_length(x["m"]) >= LEAST["access"]),
                    lambda x: _span(x, "access", x["m"], _random_looking(x["m"]))),
        F.transform(F.filter("x", lambda x: F.char_length(x["m"]) >= LEAST["hex"]),
                    lambda x: _span(x, "hex", x["m"], _random_looking(x["m"]))))
    df = df.withColumn("base", base)
    wide = F.transform(
        F.filter("w", lambda x: _random_looking(x["m"]) & x["m"].rlike("[A-Z]") & x["m"].rlike("[a-z]")
                 & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))),
        lambda x: _span(x, "live", x["m"], F.lit(True)))
    return df.select("key", "owner", "base", wide.alias("wide"))


def ownership(rows: DataFrame) -> DataFrame:
    """``rows(h, owner, key)`` -> per hash: distinct repositories and owners.

    A repository is known by its owner and its key. Three aggregates, each
    combined before its shuffle, so a value copied everywhere is no hot key.
    """
    return (rows.select("h", "owner", "key").distinct()
            .groupBy("h", "owner").agg(F.count("*").alias("n"))
            .groupBy("h").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners")))


def secret_spans(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id",
                 owner: str = "source", text: str = "text", example_owners: int = 3,
                 example_repos: int = 10) -> DataFrame:
    """``key`` and array ``spans`` of structs (start, k, end, n_repos, n_owners,
    live, example) for every row of ``docs``; ``k`` indexes ``KINDS``.

    A document (``key``) counts as a repository of its ``owner``. ``example``:
    held by ``example_owners`` owners or more, or in ``example_repos``
    repositories or more, whoever owns them; ``live``: no example and
    random-looking. Defined results: a NULL text is empty; a NULL owner is one
    owner of its own; repeated rows get a row each but count as one repository;
    an empty table stays empty; other columns are not read.
    """
    prepare(spark)
    # Written once, without texts: hashes, positions and a row number.
    found = candidates(docs, key, owner, text).withColumn("row", F.monotonically_increasing_id())
    found = found.checkpoint()
    every = F.concat("base", "wide")
    rows = found.select("row", "key", "owner", F.explode(every).alias("s")).select(
        "row", "key", "owner", "s.*")
    judged = (rows.join(ownership(rows), "h")
              .withColumn("example", (F.col("n_owners") >= example_owners)
                          | (F.col("n_repos") >= example_repos))
              .withColumn("live", F.col("live") & ~F.col("example"))
              .filter((F.col("k") != KINDS.index("live")) | F.col("live")))
    cols = ("start", "k", "end", "n_repos", "n_owners", "live", "example")
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,k:int,end:int,n_repos:bigint,n_owners:bigint,"
                           "live:boolean,example:boolean>>")
    with_any = F.size(every) > 0
    some = found.filter(with_any).select("row", "key").join(per_row, "row", "left")
    return (some.select("key", F.coalesce("spans", empty).alias("spans"))
            .union(found.filter(~with_any).select("key", empty)).withColumnRenamed("key", key))


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns, then n_live and n_example, for every document."""
    out = secret_spans(spark, docs)
    live = KINDS.index("live")
    base = F.filter("spans", lambda s: s["k"] < live)
    return out.select(
        "doc_id", *[count_of(F.col("spans"), k).alias(f"n_{x}") for k, x in enumerate(KINDS[:live])],
        F.sha2(text_of(base, KINDS), 256).alias("base_sha256"), text_of(F.col("spans"), KINDS).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"))
