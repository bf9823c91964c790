"""Arena results: matches have domain, judge, case_id, model_a, model_b, forward and reverse scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.functions.labels import POOLS, REFERENCE, in_pool
from ratewell.functions.verdicts import consistent, debiased, winner_of


def with_scores(matches: DataFrame) -> DataFrame:
    """Adds score (debiased, for A) and consistent; a model against itself is left out."""
    f, r = F.col("forward"), F.col("reverse")
    return matches.where("model_a <> model_b").withColumn("score", debiased(f, r)).withColumn("consistent", consistent(f, r))


def by_pool(matches: DataFrame, pools: Sequence[str] = POOLS, models: tuple[str, str] = ("model_a", "model_b")) -> DataFrame:
    """One row per pool that both models are in, all in one pass over the matches."""
    mine = F.filter(F.array(*[F.lit(p) for p in pools]), lambda p: in_pool(F.col(models[0]), p) & in_pool(F.col(models[1]), p))
    return matches.withColumn("pool", F.explode(mine))


def restricted(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """Matches with both models on a list of labels."""
    for side in ("model_a", "model_b"):
        matches = matches.join(labels.select(F.col("label").alias(side)), side, "left_semi")
    return matches


def sides(scored: DataFrame) -> DataFrame:
    """Two rows per match: model, its score and the opponent."""
    side = F.explode(F.array(F.struct(F.col("model_a").alias("model"), F.col("model_b").alias("other"), F.col("score").alias("own")), F.struct(F.col("model_b").alias("model"), F.col("model_a").alias("other"), (1 - F.col("score")).alias("own"))))
    return scored.withColumn("side", side).select("*", "side.*").drop("side")


def win_loss_tie(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wins, losses, ties, observations and the strict win rate per keys and model."""
    count = lambda on: F.sum(on.cast("long"))
    out = sides(scored).groupBy(*keys, "model").agg(count(F.col("own") > 0.5).alias("win"), count(F.col("own") < 0.5).alias("loss"), count(F.col("own") == 0.5).alias("tie"))
    return out.withColumn("n_observations", F.col("win") + F.col("loss") + F.col("tie")).withColumn("win_rate", F.col("win") / F.col("n_observations"))


def pair_counts(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per keys and unordered pair (model_lo < model_hi): graded wins of each side and ties, n, won matches of each side, and consistent ones.

    A score s above a half is (s - 0.5) * 2 of a win and the rest of a tie. All that a leaderboard needs is a sum of these.
    """
    return pair_rows(scored, keys).groupBy(*keys, "model_lo", "model_hi").agg(*[F.sum(c).alias(c) for c in ("win_lo", "win_hi", "ties", "n", "n_lo", "n_hi", "n_consistent")])


def pair_rows(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each match adds to pair_counts."""
    low = F.col("model_a") < F.col("model_b")
    own = F.when(low, F.col("score")).otherwise(1 - F.col("score"))
    turned = scored.select(*keys, F.least("model_a", "model_b").alias("model_lo"), F.greatest("model_a", "model_b").alias("model_hi"), own.alias("s"), "consistent")
    win, s = lambda s: F.greatest(s - 0.5, F.lit(0.0)) * 2, F.col("s")
    count = lambda on: on.cast("long")
    return turned.select(
        *keys, "model_lo", "model_hi", win(s).alias("win_lo"), win(1 - s).alias("win_hi"), (1 - F.abs(s - 0.5) * 2).alias("ties"), F.lit(1).cast("long").alias("n"),
        count(s > 0.5).alias("n_lo"), count(s < 0.5).alias("n_hi"), F.coalesce(count(F.col("consistent")), F.lit(0)).alias("n_consistent"),
    )


def pair_matrix(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Graded wins of each side and ties, per keys and unordered pair, with the number of matches."""
    return pair_counts(scored, keys).select(*keys, "model_lo", "model_hi", "win_lo", "win_hi", "ties", "n")


def fit(win: np.ndarray, tie: np.ndarray, most: int = 1000, tolerance: float = 1e-6) -> tuple[np.ndarray, int, bool]:
    """Ratings of one group by the Bradley-Terry-Davidson fixed point, the rounds it took, and whether it converged.

    win[i, j]: graded wins of i over j; tie: symmetric. Strengths are updated one after the other, each with those
    before it already new; then they are scaled to a geometric mean of 1 and the tie parameter follows.
    """
    n = len(win)
    if n < 2:
        return np.full(n, 1500.0), 0, True
    met = win + win.T + tie
    np.fill_diagonal(met, 0)
    gain = (win + tie / 2).copy()
    np.fill_diagonal(gain, 0)
    won = np.where(met > 0, gain, 0).sum(1)
    upper = np.triu_indices(n, 1)
    ties, decided = tie[upper].sum(), win.sum()
    theta = 1 + 2 * ties / (decided + ties) if ties > 0 else 1.5
    strength = np.ones(n)
    for turn in range(1, most + 1):
        before, theta_before = strength.copy(), theta
        for i in range(n):
            g, o = strength[i], strength
            due = (met[i] * (theta * o / (g + theta * o) + o / (theta * g + o))).sum() / 2
            if due > 0:
                strength[i] = max(won[i] / due, 1e-4)
        strength = strength / math.exp(np.log(strength + 1e-15).mean())
        a, b = strength[upper[0]], strength[upper[1]]
        due = (met[upper] * 2 * np.sqrt(a * b) / (a + theta * b + theta * a + b)).sum()
        if due > 0:
            theta = max(1e-4, tie[upper][met[upper] > 0].sum() / due)
        if np.abs(strength - before).max() < tolerance and abs(theta - theta_before) < tolerance:
            break
    done = bool(np.abs(strength - before).max() < tolerance and abs(theta - theta_before) < tolerance)
    logs = np.log(strength + 1e-15)
    return (logs - logs.mean()) * 400 / math.log(10) + 1500, turn, done


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of one group: the models, the places of both sides, and the matrices of wins and ties."""
    models = np.array(sorted({*pdf.model_lo, *pdf.model_hi}))
    lo, hi = np.searchsorted(models, pdf.model_lo.to_numpy(str)), np.searchsorted(models, pdf.model_hi.to_numpy(str))
    win, tie = np.zeros((len(models),) * 2), np.zeros((len(models),) * 2)
    np.add.at(win, (lo, hi), pdf.win_lo.to_numpy())
    np.add.at(win, (hi, lo), pdf.win_hi.to_numpy())
    np.add.at(tie, (lo, hi), pdf.ties.to_numpy())
    return models, lo, hi, win, tie + tie.T


def _by_group(matrix: DataFrame, keys: Sequence[str], found, columns: str) -> DataFrame:
    """found(pdf), a frame of models, for each group of a pair matrix, which has a row per pair of models."""
    types = {f.name: f.dataType.simpleString() for f in matrix.schema}
    run = lambda pdf: pd.DataFrame({k: [pdf[k].iloc[0]] * len(out) for k in keys} | dict(out.items())) if len(out := found(pdf)) else pd.DataFrame()
    return matrix.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), columns]))


def ratings(matrix: DataFrame, keys: Sequence[str], most: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """Per keys and model: rating, iterations, converged."""

    def rate(pdf: pd.DataFrame) -> pd.DataFrame:
        models, _, _, win, tie = _matrices(pdf)
        found, turns, done = fit(win, tie, most, tolerance)
        return pd.DataFrame({"model": models, "rating": found, "iterations": turns, "converged": done})

    return _by_group(matrix, keys, rate, "model string, rating double, iterations int, converged boolean")


#: What a leaderboard has of each model, besides its keys.
BOARD = "model string, rating double, converged boolean, win long, loss long, tie long, n_observations long, win_rate double, position_consistency double, rank int"


def board_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """The leaderboard of one group, from its rows of pair_counts. Equal ratings rank by label."""
    models, lo, hi, win, tie = _matrices(pdf)
    found, _, done = fit(win, tie)
    won, lost, met = (np.zeros(len(models), np.int64) for _ in range(3))
    for at, own, other in ((lo, pdf.n_lo, pdf.n_hi), (hi, pdf.n_hi, pdf.n_lo)):
        np.add.at(won, at, own.to_numpy())
        np.add.at(lost, at, other.to_numpy())
        np.add.at(met, at, pdf.n.to_numpy())
    rank = np.empty(len(models), np.int32)
    rank[np.lexsort((models, -found))] = np.arange(1, len(models) + 1)
    return pd.DataFrame({
        "model": models, "rating": found, "converged": done, "win": won, "loss": lost, "tie": met - won - lost, "n_observations": met,
        "win_rate": won / met, "position_consistency": pdf.n_consistent.sum() / pdf.n.sum(), "rank": rank,
    })


def leaderboard(scored: DataFrame, keys: Sequence[str] = ("domain", "judge"), pools: Sequence[str] | None = None) -> DataFrame:
    """Rating, rank, wins, losses, ties and the group's share of consistent matches, per keys and model.

    Matches are reduced to pairs of models in one aggregate; pools, a key more where given, are dealt out after it.
    Equal ratings rank by label. keys may hold any columns of the matches, a bucket for instance.
    """
    keys, pairs = list(keys), pair_counts(scored, list(keys))
    if pools:
        keys, pairs = [*keys, "pool"], by_pool(pairs, pools, ("model_lo", "model_hi"))

    return _by_group(pairs, keys, board_of, BOARD)


def half_tie_rate(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(wins + ties / 2) / observations over all matches of the keys."""
    return win_loss_tie(scored, keys).select(*keys, "model", "n_observations", ((F.col("win") + F.col("tie") / 2) / F.col("n_observations")).alias("half_tie_rate"))


def reference_view(matches: DataFrame) -> DataFrame:
    """Matches of the reference, seen from its side: ref_score, and ref_win (1 both directions won, 0 both lost, else a half)."""
    scored = with_scores(matches).where((F.col("model_a") == REFERENCE) | (F.col("model_b") == REFERENCE))
    is_a = F.col("model_a") == REFERENCE
    mine = lambda score, a_letter: F.when(is_a, winner_of(score) == a_letter).otherwise(winner_of(score) == ("b" if a_letter == "a" else "a"))
    forward, reverse = F.col("forward"), F.col("reverse")
    won = mine(forward, "a") & mine(reverse, "b")
    lost = mine(forward, "b") & mine(reverse, "a")
    return scored.withColumn("ref_score", F.when(is_a, F.col("score")).otherwise(1 - F.col("score"))).withColumn("ref_win", F.when(won, 1.0).when(lost, 0.0).otherwise(0.5))


def agreement(matches: DataFrame, first: str, second: str, keys: Sequence[str] = ("domain",), labels: Sequence[str] | None = None, canonical: bool = False, order: str | None = None) -> DataFrame:
    """How often two judges name one winner in the forward direction, over cases they compared in the same orientation.

    labels: both models must be on this list. order: the column in which the last of repeated matches is the greatest;
    without one a repeated match raises. canonical: also compares opposite orientations, by turning each match to the order
    of its labels. Both judges are read in one aggregate.
    """
    rows = matches.where((F.col("model_a") != F.col("model_b")) & F.col("judge").isin(first, second))
    if labels is not None:
        rows = rows.where(F.col("model_a").isin(*labels) & F.col("model_b").isin(*labels))
    rows = rows.withColumn("_order", F.lit(0) if order is None else F.col(order))
    if canonical:
        low = F.col("model_a") < F.col("model_b")
        rows = rows.withColumn("forward", F.when(low, F.col("forward")).otherwise(1 - F.col("forward"))).withColumns({"model_a": F.least("model_a", "model_b"), "model_b": F.greatest("model_a", "model_b")})
    found = lambda judge: F.max(F.when(F.col("judge") == judge, F.struct("_order", "forward")))["forward"]
    again = lambda judge: F.count(F.when(F.col("judge") == judge, F.lit(1))) > 1
    last = lambda judge: found(judge) if order else F.when(again(judge), F.raise_error("repeated matches need an order")).otherwise(found(judge))
    both = rows.groupBy(*keys, "case_id", "model_a", "model_b").agg(last(first).alias("x"), last(second).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    same = (winner_of(F.col("x")) == winner_of(F.col("y"))).cast("double")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matches"), F.avg(same).alias("agreement"))


def rounded(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column), digits).alias(column)
