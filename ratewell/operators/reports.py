"""Tables over leaderboards: rows have domain, judge, model and a metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.functions.labels import REFERENCE, mode_of, profile_of
from ratewell.operators.rankstats import bootstrap_draws, correlations, drawn_midranks, percentile_interval, weighted_correlation
from ratewell.operators.selection import kendall, settled

#: Venues of each bucket, and the lower bounds of tiers of baseline ratings.
ACCEPTED, REJECTED = ("oral", "poster"), ("rejected", "withdrawn")
TIERS = (("top", 1560.0), ("mid", 1470.0))


def with_bucket(cases: DataFrame) -> DataFrame:
    return cases.withColumn("bucket", F.when(F.col("venue").isin(*ACCEPTED), "Accepted").when(F.col("venue").isin(*REJECTED), "Rejected"))


def tier_of(mean) -> F.Column:
    """Null counts as mid."""
    return F.when(mean.isNull() | F.isnan(mean), "mid").when(mean >= TIERS[0][1], "top").when(mean >= TIERS[1][1], "mid").otherwise("low")


def across_domains(board: DataFrame, metric: str, domains: Sequence[str], digits: int = 4) -> DataFrame:
    """Per judge and model: the mean over the domains it is in, a column per domain, and flags for each best value."""
    wide = board.groupBy("judge", "model").pivot("domain", list(domains)).agg(F.first(metric))
    mean = board.groupBy("judge", "model").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n_domains"))
    best = W.partitionBy("judge")
    out = wide.join(mean, ["judge", "model"])
    flags = [(F.col(c) == F.max(c).over(best)).alias(f"{c}_best") for c in (*domains, "mean")]
    rank = F.row_number().over(best.orderBy(F.desc("mean"), "model")).alias("rank")
    return out.select("judge", "model", *[F.round(c, digits).alias(c) for c in (*domains, "mean")], "n_domains", *flags, rank)


def shown_across(board: DataFrame, domains: Sequence[str], profiles: Sequence[str]) -> DataFrame:
    """Per judge and shown model, the reference among them: mean rating, mean win rate and the domains it is in, a column
    per domain, flags for each best value, the rank of the mean, and missing: a profile on the list that the judge's
    leaderboards lack, which has no figures."""
    labels = [REFERENCE, *(f"baseline:{p}" for p in profiles)]
    shown = board.where(F.col("model").isin(*labels))
    means = shown.groupBy("judge", "model").agg(F.round(F.avg("win_rate"), 6).alias("win_rate"))
    listed = board.select("judge").distinct().withColumn("model", F.explode(F.array(*map(F.lit, labels))))
    out = across_domains(shown, "rating", domains).join(means, ["judge", "model"])
    full = listed.join(out, ["judge", "model"], "left").where((F.col("model") != REFERENCE) | F.col("mean").isNotNull())
    return full.withColumn("missing", F.col("mean").isNull())


def bucket_gap(board: DataFrame) -> DataFrame:
    """Per judge and bucket the reference's rating; gap: its rating on accepted cases less that on rejected ones."""
    own = board.where(F.col("model") == REFERENCE).select("judge", "bucket", "rating")
    at = lambda name: F.max(F.when(F.col("bucket") == name, F.col("rating"))).over(W.partitionBy("judge"))
    return own.select("judge", "bucket", F.round("rating", 4).alias("reference_rating"), F.round(at("Accepted") - at("Rejected"), 4).alias("gap"))


def _ranked(rows: DataFrame) -> DataFrame:
    rank = lambda c: F.row_number().over(W.partitionBy("judge").orderBy(F.desc(c), "model"))
    return rows.select("*", rank("ratio").alias("recall_rank"), rank("rating").alias("arena_rank")).withColumn("delta", F.col("arena_rank") - F.col("recall_rank"))


def recall_against_arena(recalls: DataFrame, board: DataFrame) -> DataFrame:
    """recalls (judge, model, ratio) with the mean rating of board's domains and both ranks; delta: the rank by rating less that by recall."""
    return _ranked(recalls.join(board.groupBy("judge", "model").agg(F.avg("rating").alias("rating")), ["judge", "model"]))


def under_every_judge(rows: DataFrame) -> DataFrame:
    """rows of recall_against_arena of labels that all of its judges have, ranked anew, so that judges show the same labels."""
    judges = rows.select("judge").distinct().agg(F.count(F.lit(1)).alias("_all"))
    shared = rows.groupBy("model").agg(F.countDistinct("judge").alias("_judges")).crossJoin(judges).where("_judges = _all")  # judges is one row
    return _ranked(rows.drop("recall_rank", "arena_rank", "delta").join(shared.select("model"), "model", "left_semi"))


def anchors(rows: DataFrame) -> DataFrame:
    """rows of recall_against_arena for profiles in both modes only, ranked anew, with profile, headline and counter.

    headline: the profile that recall rates above the arena the most; counter: the one it rates below the most. Of
    equal ones the last and the first by recall.
    """
    named = rows.drop("recall_rank", "arena_rank", "delta").withColumn("mode", mode_of(F.col("model"))).withColumn("profile", profile_of(F.col("model")))
    both = named.withColumn("modes", F.size(F.collect_set("mode").over(W.partitionBy("judge", "profile")))).where("modes = 2").drop("modes", "mode")
    rank = lambda c: F.row_number().over(W.partitionBy("judge").orderBy(F.desc(c), "model"))
    placed = both.select("*", rank("ratio").alias("recall_rank"), rank("rating").alias("arena_rank")).withColumn("delta", F.col("arena_rank") - F.col("recall_rank"))
    at = F.struct("delta", "recall_rank")
    return placed.withColumn("headline", F.max_by("profile", at).over(W.partitionBy("judge"))).withColumn("counter", F.min_by("profile", at).over(W.partitionBy("judge")))


def _modes(board: DataFrame) -> DataFrame:
    return board.withColumn("mode", mode_of(F.col("model"))).withColumn("profile", profile_of(F.col("model")))


def uplift(board: DataFrame, metric: str, digits: int = 4) -> DataFrame:
    """Per judge and profile, over domains with both modes: the means, their difference and the domains' count."""
    rows = _modes(board).where("mode IN ('baseline', 'agent')")
    both = rows.groupBy("judge", "profile", "domain").agg(F.max(F.when(F.col("mode") == "baseline", F.col(metric))).alias("b"), F.max(F.when(F.col("mode") == "agent", F.col(metric))).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    out = both.groupBy("judge", "profile").agg(F.avg("b").alias("baseline"), F.avg("a").alias("agent"), F.count(F.lit(1)).alias("n_domains"))
    return out.withColumn("uplift", F.col("agent") - F.col("baseline")).select("judge", "profile", "n_domains", *[F.round(c, digits).alias(c) for c in ("baseline", "agent", "uplift")])


def tiers(uplifts: DataFrame) -> DataFrame:
    return uplifts.withColumn("tier", tier_of(F.col("baseline"))).groupBy("judge", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("uplift"), 4).alias("mean_uplift"))


def mode_means(board: DataFrame, metric: str, digits: int = 4) -> DataFrame:
    mean = lambda mode: F.avg(F.when(F.col("mode") == mode, F.col(metric)))
    rows = _modes(board).groupBy("judge", "profile").agg(*[F.round(mean(m), digits).alias(m) for m in ("baseline", "agent", REFERENCE)])
    return rows.where("(baseline IS NOT NULL AND agent IS NOT NULL) OR reference IS NOT NULL")


def _paired(board: DataFrame, first: str, second: str, metric: str = "rating") -> DataFrame:
    one = lambda judge, name: board.where(F.col("judge") == judge).select("domain", "model", F.col(metric).alias(name))
    return one(first, "x").join(one(second, "y"), ["domain", "model"])


def judge_correlation(board: DataFrame, first: str, second: str, least: int = 3) -> DataFrame:
    """Per domain, and for all as domain 'all', where the judges share enough models."""
    both = _paired(board, first, second)
    rows = both.union(both.withColumn("domain", F.lit("all")))
    rows = settled(rows, "paired")
    tau = kendall(rows, ["domain"], "x", "y").select("domain", "tau")
    return correlations(rows, ["domain"], "x", "y").join(tau, "domain").where(F.col("n") >= least)


def pooled_correlation(board: DataFrame, first: str, second: str, replicates: int, least: int = 3) -> DataFrame:
    """rho and tau over all cells (domain, model) that two judges share, and rho's percentile interval.

    Cells are as many as domains times models. Each replicate draws as many of them with replacement, kept as multiplicities;
    with fewer than `least` cells there is no row, and the bounds are null where too few replicates have a rho.
    """
    keys = ["all", "replicate"]
    cells = settled(_paired(board, first, second).select(F.lit("all").alias("all"), "domain", "model", "x", "y"), "cells")
    placed = cells.withColumn("place", F.row_number().over(W.partitionBy("all").orderBy("domain", "model")) - 1)
    drawn = bootstrap_draws(cells, ["all"], replicates).join(placed, ["all", "place"])
    ranked = drawn_midranks(drawn_midranks(drawn, keys, "x", "rx"), keys, "y", "ry")
    bounds = percentile_interval(weighted_correlation(ranked, keys, "rx", "ry", "times"), ["all"], "v")
    both = correlations(cells, ["all"], "x", "y").join(kendall(cells, ["all"], "x", "y").select("all", "tau"), "all").where(F.col("n") >= least)
    return both.join(bounds, "all", "left").select(F.col("n").alias("n_cells"), "rho", "tau", "low", "high")


def top_overlap(board: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """Each judge's first k of its own full list."""
    rank = F.row_number().over(W.partitionBy("domain", "judge").orderBy(F.desc("rating"), "model"))
    top = board.select("domain", "judge", "model", rank.alias("place")).where(F.col("place") <= k)
    both = top.where(F.col("judge") == first).select("domain", "model").join(top.where(F.col("judge") == second).select("domain", "model").withColumn("shared", F.lit(1)), ["domain", "model"], "left")
    return both.groupBy("domain").agg((F.count("shared") / k).alias("overlap"))


def rank_shift(board: DataFrame, first: str, second: str) -> DataFrame:
    """Ranks are taken among the shared models only."""
    rank = lambda c: F.row_number().over(W.partitionBy("domain").orderBy(F.desc(c), "model"))
    both = _paired(board, first, second)
    placed = both.select("domain", F.abs(rank("x") - rank("y")).alias("shift"))
    return placed.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("shift"), 6).alias("mean_shift"))
