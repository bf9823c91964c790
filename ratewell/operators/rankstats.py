"""Rank statistics of groups of any size: ranks come from counts of equal values, not from one sorted task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ratewell.operators.selection import running, settled
from ratewell.operators.worklist import mixed_hash


def midranks(rows: DataFrame, keys: Sequence[str], value: str, name: str, times: str | None = None, cells: int = 1024) -> DataFrame:
    """Adds the mean of the ranks that equal values share; times: how often each row counts.

    Distinct values are dealt to cells by the upper bits of their order; the sum over a group's cells sees a row per
    cell and the one inside a cell the values there, so no task sorts a large group. What rows costs is paid once.
    """
    rows = settled(rows, "ranked")
    counts = rows.groupBy(*keys, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n"))
    ends = counts.groupBy(*keys).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    width = F.when(F.col("_high") > F.col("_low"), (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    placed = counts.join(ends, list(keys)).withColumn("_cell", F.coalesce(F.floor(width * cells), F.lit(0))).drop("_low", "_high")
    sums = placed.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_held"))
    sums = sums.select(*keys, "_cell", (F.sum("_held").over(W.partitionBy(*keys).orderBy("_cell")) - F.col("_held")).alias("_before"))
    up_to = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_cell").orderBy(value))
    ranked = placed.join(sums, [*keys, "_cell"]).select(*keys, value, (up_to - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranked, [*keys, value])


def correlations(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per keys: n and Spearman's rho, null without variance."""
    ranked = midranks(midranks(rows, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.nanvl(F.corr("_rx", "_ry"), F.lit(None).cast("double")), 6).alias("rho"))


def _normal_tail(z: F.Column) -> F.Column:
    """Upper tail of the normal distribution, from the complementary error function."""

    @F.pandas_udf(DoubleType())
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else 0.5 * math.erfc(v / math.sqrt(2)))

    return tail(z)


def mann_whitney(rows: DataFrame, keys: Sequence[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """Per keys: U of the first group and p of the two-sided, greater and less tests, with tie and continuity correction.

    U adds for each value of the first group how many of the second are smaller, half of those that are equal.
    """
    two = rows.where(F.col(group).isin(first, second))
    counts = two.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(group) == first).cast("long")).alias("tx"))
    ranked = running(counts.withColumn("ty", F.col("t") - F.col("tx")), keys, value, {"less": "ty"})
    t = F.col("t").cast("double")
    over = F.sum(F.col("tx") * (F.col("less") + F.col("ty") / 2))
    sums = ranked.groupBy(*keys).agg(over.alias("u"), F.sum("tx").cast("double").alias("nx"), F.sum("t").cast("double").alias("n"), F.sum(t * t * t - t).alias("ties"))
    nx, n = F.col("nx"), F.col("n")
    ny = n - nx
    out = sums.withColumn("mu", nx * ny / 2)
    out = out.withColumn("var", nx * ny * ((n * n * n - n) - F.col("ties")) / (n * 12 * (n - 1)))
    sd = F.when(F.col("var") > 0, F.sqrt("var"))
    bound = lambda p: F.when(F.col("var") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    up, down = (F.col("u") - F.col("mu") - 0.5) / sd, (F.col("u") - F.col("mu") + 0.5) / sd
    both = F.greatest(F.lit(0.0), (F.abs(F.col("u") - F.col("mu")) - 0.5) / sd)
    return out.where((nx > 0) & (ny > 0)).select(*keys, F.col("nx").cast("long").alias("n_first"), ny.cast("long").alias("n_second"), "u", bound(_normal_tail(both) * 2).alias("p_two_sided"), bound(_normal_tail(up)).alias("p_greater"), bound(1 - _normal_tail(down)).alias("p_less"))


def jonckheere(rows: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Per keys: J over ordered groups (group is their number) and p of the increasing and two-sided tests, no tie correction.

    Pairs are counted from values and their counts: a running count of smaller values per pair of groups.
    """
    cells = rows.groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("c"))
    # per value, how many of each earlier group are smaller or equal: the groups are few, so they are a map
    wide = cells.groupBy(*keys, value).agg(F.map_from_entries(F.collect_list(F.struct(group, "c"))).alias("here"))
    groups = cells.groupBy(*keys).agg(F.array_sort(F.collect_set(group)).alias("groups"))
    filled = wide.join(groups, list(keys))
    below = filled.select(*keys, value, F.posexplode("groups").alias("g", "id"), F.size("groups").alias("k"), F.coalesce(F.col("here")[F.col("groups")[F.col("g")]], F.lit(0)).alias("c"))
    counted = running(below, [*keys, "id"], value, {"less": "c"})
    before = W.partitionBy(*keys, value).orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("less") + F.col("c") / 2).over(before), F.lit(0.0))
    j = counted.withColumn("pairs", F.col("c") * earlier).groupBy(*keys).agg(F.sum("pairs").alias("j"))
    sizes = cells.groupBy(*keys, group).agg(F.sum("c").cast("double").alias("m")).groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("squares"), F.sum(F.col("m") * F.col("m") * (F.col("m") * 2 + 3)).alias("cubes"))
    n = F.col("n")
    out = j.join(sizes, list(keys)).where("k >= 2").withColumn("mu", (n * n - F.col("squares")) / 4).withColumn("var", (n * n * (n * 2 + 3) - F.col("cubes")) / 72)
    z = (F.col("j") - F.col("mu")) / F.when(F.col("var") > 0, F.sqrt("var"))
    return out.select(*keys, "k", F.col("n").cast("long").alias("n"), "j", _normal_tail(z).alias("p_increasing"), (_normal_tail(F.abs(z)) * 2).alias("p_two_sided"))


def bootstrap_draws(rows: DataFrame, keys: Sequence[str], replicates: int, seed: int = 42) -> DataFrame:
    """Each group's rows as drawn with replacement, replicate by replicate, as multiplicities.

    Draw d of replicate b takes the row at place hash(seed, b, d) mod n of the group's order, by modular arithmetic. Groups are samples that a
    statistic is wanted of; each replicate is a key of its own in what follows. Output: keys, replicate, place, times.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    drawn = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    place = mixed_hash(seed, F.col("replicate"), F.col("draw"), F.col("replicate") + F.col("draw")) % F.col("n")
    return drawn.groupBy(*keys, "replicate", place.alias("place")).agg(F.count(F.lit(1)).alias("times"))


def drawn_midranks(drawn: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Midranks of rows that count times each, in groups that are samples: one window, no join."""
    upto, same = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys, value)
    return drawn.withColumn("_same", F.sum("times").over(same)).withColumn(name, F.sum("times").over(upto) - (F.col("_same") - 1) / 2).drop("_same")


def weighted_correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str, times: str) -> DataFrame:
    """v: Pearson's correlation of rows that count times each; null without variance."""
    w, a, b = F.col(times).cast("double"), F.col(x), F.col(y)
    sums = rows.groupBy(*keys).agg(*[F.sum(v).alias(n) for n, v in (("n", w), ("sa", w * a), ("sb", w * b), ("saa", w * a * a), ("sbb", w * b * b), ("sab", w * a * b))])
    c = F.col
    va, vb = c("n") * c("saa") - c("sa") * c("sa"), c("n") * c("sbb") - c("sb") * c("sb")
    return sums.select(*keys, F.try_divide(c("n") * c("sab") - c("sa") * c("sb"), F.sqrt(va * vb)).alias("v"))


def percentile_interval(estimates: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """Lower and upper bounds: the entries at alpha / 2 and 1 - alpha / 2 of the sorted estimates that exist."""
    some = estimates.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("e"))
    at = lambda q: F.get("e", F.floor(F.size("e") * F.lit(q)).cast("int"))
    return some.where(F.size("e") >= least).select(*keys, F.size("e").alias("n_estimates"), F.round(at(alpha / 2), 6).alias("low"), F.round(at(1 - alpha / 2), 6).alias("high"))
