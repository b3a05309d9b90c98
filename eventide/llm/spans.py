"""Regular-expression matches with their code-point positions, in Spark functions.

Spark returns the matches of a pattern but not where they stand. The texts
between the matches (``split`` by the same pattern) give it: a match starts at
the sum of all lengths before it. The sums run in blocks, so a text with very
many matches costs little more than linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256


def with_matches(df: DataFrame, name: str, pattern: str, *, text: str, when: Column,
                 before: int = 0, after: int = 0) -> DataFrame:
    """``df`` with an array column ``name`` of structs (start, end, m, before, after).

    All leftmost non-overlapping matches, in order; ``end`` is exclusive;
    ``before`` / ``after`` hold up to so many characters of the text between
    this match and its neighbours. The array is empty where ``when`` is not
    true (a cheap test that no match can fail) and for a NULL text.
    """
    g, h, s, b = (f"{name}__{x}" for x in "ghsb")
    t = F.when(when, F.col(text))
    gap = F.transform(F.split(t, pattern, -1), lambda x: F.struct(
        F.char_length(x).alias("n"), F.right(x, F.lit(before)).alias("r"),
        F.left(x, F.lit(after)).alias("l")))
    df = df.withColumns({g: gap, h: F.coalesce(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)),
                                               F.array().cast("array<string>"))})
    df = df.withColumn(s, F.expr(
        f"transform({h}, (x, i) -> {g}[i].n + if(i = 0, 0, char_length({h}[i - 1])))"))
    df = df.withColumn(b, F.expr(f"""
        transform(sequence(0, size({s}) div {_BLOCK}),
                  k -> aggregate(slice({s}, k * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x))"""))
    df = df.withColumn(b, F.expr(
        f"transform({b}, (x, k) -> aggregate(slice({b}, 1, k), 0, (a, y) -> a + y))"))
    df = df.withColumn(s, F.expr(f"""
        transform({s}, (x, i) -> {b}[i div {_BLOCK}] + aggregate(
            slice({s}, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK} + 1), 0, (a, y) -> a + y))"""))
    df = df.withColumn(name, F.expr(f"""
        transform({h}, (x, i) -> named_struct(
            'start', {s}[i], 'end', {s}[i] + char_length(x), 'm', x,
            'before', {g}[i].r, 'after', {g}[i + 1].l))"""))
    return df.drop(g, h, s, b)


def text_of(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of an array of structs (start, k, end), comma-joined by
    start and then by the order of ``kinds``."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat(
        F.get(names, s["k"]), F.lit(":"), s["start"].cast("string"), F.lit(":"),
        s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["k"] == kind)).cast("long")
