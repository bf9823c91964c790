"""Skills that submissions used, in order: rows have submission keys and skills (array)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(used: DataFrame, skills: DataFrame) -> DataFrame:
    """Per known skill: uses, their share, submissions that use it, and their share; a skill never picked has zeros."""
    marked = F.transform("skills", lambda x, i: F.struct(x.alias("skill"), (F.array_position("skills", x) == i + 1).cast("long").alias("first")))
    each = used.select(F.explode(marked).alias("m")).groupBy("m.skill").agg(F.count(F.lit(1)).alias("uses"), F.sum("m.first").alias("submissions"))
    all_ = used.agg(F.sum(F.size("skills")).alias("_uses"), F.count(F.lit(1)).alias("_submissions"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = skills.join(each, "skill", "left").crossJoin(all_)  # all_ is one row
    return out.select("skill", zero(F.col("uses")).alias("uses"), (zero(F.col("uses")) / F.col("_uses")).alias("use_share"), zero(F.col("submissions")).alias("submissions"), (zero(F.col("submissions")) / F.col("_submissions")).alias("submission_share"))


def lengths(used: DataFrame) -> DataFrame:
    return used.groupBy(F.size("skills").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def shares(used: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Per skill, a column for each value: its share of that value's uses."""
    counts = used.select(by, F.explode("skills").alias("skill")).groupBy(by, "skill").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(by).agg(F.sum("n").alias("all"))
    return counts.join(whole, by).groupBy("skill").pivot(by, list(values)).agg(F.first(F.round(F.col("n") / F.col("all"), 6)))


def together(used: DataFrame, size: int) -> DataFrame:
    """How many submissions use each pair (size 2) or triple (3) of different skills, names in order."""
    own = used.select(F.array_sort(F.array_distinct("skills")).alias("s"))
    after = lambda i: F.expr(f"slice(s, {i} + 2, size(s))")
    rows = own.select("s", F.posexplode("s").alias("i", "first"))
    rows = rows.select("s", "first", F.col("i"), F.posexplode(after("i")).alias("j", "second"))
    names = ["first", "second"]
    if size == 3:
        rows = rows.select("first", "second", F.explode(F.expr("slice(s, i + j + 3, size(s))")).alias("third"))
        names.append("third")
    return rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent, ties by name."""
    return counts.orderBy(F.desc("n"), *[c for c in counts.columns if c != "n"]).limit(k)


def token_totals(usage: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of each token counter and input + output. usage: keys and tokens, a struct."""
    names = ("cached_tokens", "input_tokens", "output_tokens", "reasoning_tokens", "requests")
    out = usage.groupBy(*keys).agg(*[F.sum(f"tokens.{n}").alias(n) for n in names])
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
