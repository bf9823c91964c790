"""Rubric results: records have domain, judge, case_id, model, pair_scores, set_scores, recall and multi."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.functions.labels import POOLS, REFERENCE, in_pool, profile_of
from ratewell.functions.parsing import with_json
from ratewell.functions.rubric import PAIR_KEYS, SET_KEYS, pair_mean, recall_ratio, set_mean, summary


def rubric_scores(records: DataFrame) -> DataFrame:
    """Adds q_pair, q_set (null outside multi domains) and s_score, from the rubric's dimensions only."""
    q_set = F.when(F.col("multi"), set_mean(F.col("set_scores")))
    return records.withColumn("q_pair", pair_mean(F.col("pair_scores"))).withColumn("q_set", q_set).withColumn("s_score", summary(F.col("q_pair"), F.col("q_set"), F.col("multi")))


def record_summaries(records: DataFrame) -> DataFrame:
    """Adds pair_summary, set_summary and overall_score, from all keys and in any domain."""
    out = records.withColumn("pair_summary", pair_mean(F.col("pair_scores"), None)).withColumn("set_summary", set_mean(F.col("set_scores"), None))
    return out.withColumn("overall_score", summary(F.col("pair_summary"), F.col("set_summary"), F.lit(True)))


def by_pool(records: DataFrame, pools: Sequence[str] = POOLS) -> DataFrame:
    return records.withColumn("pool", F.explode(F.filter(F.array(*[F.lit(p) for p in pools]), lambda p: in_pool(F.col("model"), p))))


def dimension_means(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, dimension and mean: pair dimensions over all pairs, set dimensions over records, recall over records that
    have one, and S over records. Whatever keys a record has are dimensions; what a task has of one is summed before the
    shuffle."""
    cell = lambda name, value: F.struct(name.alias("dimension"), value.cast("double").alias("sum"), value.isNotNull().cast("long").alias("n"))
    none = F.array().cast("array<struct<dimension:string,sum:double,n:bigint>>")
    each = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: cell(e["key"], e["value"])), none)
    cells = F.concat(
        F.coalesce(F.flatten(F.transform("pair_scores", each)), none), F.when(F.col("multi"), each(F.col("set_scores"))).otherwise(none),
        F.array(cell(F.lit("recall"), recall_ratio(F.col("recall"))), cell(F.lit("S"), F.col("s_score"))),
    )
    rows = scored.select(*keys, F.explode(cells).alias("c")).where("c.n > 0")
    return rows.groupBy(*keys, "c.dimension").agg((F.sum("c.sum") / F.sum("c.n")).alias("mean"), F.sum("c.n").alias("n"))


def leaderboard(scored: DataFrame, keys: Sequence[str] = ("domain", "judge", "pool")) -> DataFrame:
    """Rating (mean S), rank, observations and the breakdown by dimension. Equal scores rank by label."""
    keys = list(keys)
    means = dimension_means(scored, [*keys, "model"])
    wide = means.groupBy(*keys, "model").agg(
        F.max(F.when(F.col("dimension") == "S", F.col("mean"))).alias("rating"), F.max(F.when(F.col("dimension") == "S", F.col("n"))).alias("n_observations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", F.round("mean", 4).alias("mean"))))).alias("breakdown"),
    )
    return wide.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("rating"), "model")))


def recall_table(records: DataFrame, domains: Sequence[str], least: int, profiles: Sequence[str] | None = None, rated: DataFrame | None = None) -> DataFrame:
    """Per judge and label: mean hits, total and ratio, the ratio's sample deviation (0 for one case) and cases.

    The reference, cases without a total and labels with fewer cases are left out; so are, where given, profiles that
    are not on the list and labels (judge, model) that rated lacks.
    """
    rows = records.where(F.col("domain").isin(*domains) & (F.col("model") != REFERENCE) & (F.col("recall.total") > 0)).withColumn("ratio", recall_ratio(F.col("recall")))
    if profiles is not None:
        rows = rows.where(profile_of(F.col("model")).isin(*profiles))
    out = rows.groupBy("judge", "model").agg(
        F.avg("recall.hits").alias("hits"), F.avg("recall.total").alias("total"), F.avg("ratio").alias("ratio"),
        F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)).alias("deviation"), F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= least)
    return out if rated is None else out.join(rated.select("judge", "model").distinct(), ["judge", "model"], "left_semi")


def parsed_verdicts(answers: DataFrame, text: str) -> DataFrame:
    """Adds valid, pair_scores, set_scores and k_mismatch, read from score verdicts in JSON, to answers (k, multi).

    A verdict that lacks a field or a score of its form is not valid and gives nulls. Sets are scored where multi only,
    without distinctness where k <= 1 and without nulls. k_mismatch: pairs are not as many as the k > 0 hypotheses.
    """
    v = F.from_json("json", "pair_scores array<map<string,string>>, rationale string, recall string, set_scores map<string,string>")
    found = with_json(answers, text).withColumn("v", v)
    number = lambda m, k: m[k].try_cast("double")
    known = lambda m, keys: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*[number(m, k) for k in keys])), lambda _, x: x.isNotNull())
    pairs, sets = F.col("v.pair_scores"), F.col("v.set_scores")
    fields = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    all_there = F.size(F.array_except(F.array(*map(F.lit, ("pair_scores", "rationale", "recall", "set_scores"))), fields)) == 0
    good_pairs = F.forall(pairs, lambda m: F.coalesce(F.size(known(m, PAIR_KEYS)) == len(PAIR_KEYS), F.lit(False)))
    no_sets = sets.isNull() & F.get_json_object("json", "$.set_scores").isNull()
    good_sets = number(sets, "breadth").isNotNull() & number(sets, "utility").isNotNull() & F.map_contains_key(sets, "distinctness") & (sets["distinctness"].isNull() | number(sets, "distinctness").isNotNull())
    valid = F.coalesce(all_there & F.col("v.rationale").isNotNull() & good_pairs & (no_sets | good_sets), F.lit(False))
    kept = F.map_filter(known(sets, SET_KEYS), lambda key, _: (key != "distinctness") | (F.col("k") > 1))
    set_scores = F.when(F.col("multi") & sets.isNotNull(), kept).otherwise(F.create_map().cast("map<string,double>"))
    found, valid = found.withColumn("_valid", valid), F.col("_valid")  # three columns ask for it
    return found.select(
        *answers.columns, valid.alias("valid"), F.when(valid, F.transform(pairs, lambda m: known(m, PAIR_KEYS))).alias("pair_scores"), F.when(valid, set_scores).alias("set_scores"),
        (valid & (F.col("k") > 0) & (F.size(pairs) != F.col("k"))).alias("k_mismatch"),
    )
