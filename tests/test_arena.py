from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.functions.labels import display_name, in_pool, mode_of, profile_of
from ratewell.functions.verdicts import consistent, debiased
from ratewell.operators import arena, reports

LABELS = ["reference", "baseline:m1", "baseline:m2", "agent:m1", "agent:m2"]


def made(spark, rows):
    return spark.createDataFrame(rows, "domain string, judge string, case_id string, model_a string, model_b string, forward double, reverse double")


@pytest.fixture(scope="module")
def matches(spark):
    rows = [("d", "j", f"c{c}", a, b, [1.0, 0.75, 0.5, 0.25][(i + j + c) % 4], [0.0, 0.25, 0.5, 1.0][(2 * i + j + c) % 4]) for c in range(6) for i, a in enumerate(LABELS) for j, b in enumerate(LABELS) if i < j]
    return made(spark, rows)


@pytest.mark.parametrize(("f", "r", "score", "same"), [(0.75, 0.25, 0.75, True), (0.75, 0.75, 0.5, False), (0.5, 0.5, 0.5, True), (0.0, 1.0, 0.0, True)])
def test_debiased(spark, f, r, score, same):
    row = spark.range(1).select(debiased(F.lit(f), F.lit(r)), consistent(F.lit(f), F.lit(r))).first()
    assert tuple(row) == (score, same)


def test_labels(spark):
    names = [("reference",), ("agent:claude:x-high",), ("plain",), ("baseline:a-thinking",)]
    df = spark.createDataFrame(names, "label string")
    profile = profile_of(F.col("label"))
    got = [tuple(r) for r in df.select(mode_of(F.col("label")), profile, display_name(profile), in_pool(F.col("label"), F.lit("agent"))).collect()]
    assert got == [("reference", "reference", "Reference", True), ("agent", "claude:x-high", "claude:x", True), ("baseline", "plain", "plain", False), ("baseline", "a-thinking", "a", False)]


def test_pools_keep_the_reference(matches):
    counts = {r["pool"]: r["count"] for r in arena.by_pool(matches.where("case_id = 'c0'")).groupBy("pool").count().collect()}
    assert counts == {"baseline": 3, "agent": 3, "full": 10}


def test_ratings_are_a_fixed_point():
    draw = np.random.default_rng(3)
    win = draw.integers(0, 9, (5, 5)).astype(float)
    np.fill_diagonal(win, 0)
    tie = draw.integers(0, 4, (5, 5)).astype(float)
    tie = np.triu(tie, 1) + np.triu(tie, 1).T
    rating, turns, done = arena.fit(win, tie)
    assert done and turns < 1000 and abs(rating.mean() - 1500) < 1e-9
    again, _, _ = arena.fit(win * 2, tie * 2)
    assert np.allclose(again, rating, atol=1e-6)
    # who wins more of everything is rated above
    strong = win.copy()
    strong[0] += 20
    assert arena.fit(strong, tie)[0].argmax() == 0


@pytest.mark.parametrize("seed", range(4))
def test_ratings_stay_where_they_are(seed):
    """One more round, written out pair by pair, gives the same strengths; expected ties are the ties there were."""
    draw = np.random.default_rng(seed)
    n = 3 + 2 * seed
    win = draw.integers(0, 40, (n, n)).astype(float)
    np.fill_diagonal(win, 0)
    tie = np.triu(draw.integers(1, 20, (n, n)).astype(float), 1)
    tie += tie.T
    rating, _, done = arena.fit(win, tie, tolerance=1e-11)
    strength = [10 ** ((r - 1500) / 400) for r in rating]
    met = win + win.T + tie

    def expected_ties(theta, g):
        return theta * sum(met[i, j] * 2 * math.sqrt(g[i] * g[j]) / ((1 + theta) * (g[i] + g[j])) for i in range(n) for j in range(i))

    low, high = 1e-4, 1e4
    for _ in range(300):  # more is expected of a larger theta
        theta = math.sqrt(low * high)
        low, high = (theta, high) if expected_ties(theta, strength) < np.triu(tie).sum() else (low, theta)
    again = list(strength)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        won = sum(win[i, j] + tie[i, j] / 2 for j in others)
        due = sum(met[i, j] * again[j] * (theta / (again[i] + theta * again[j]) + 1 / (theta * again[i] + again[j])) / 2 for j in others)
        again[i] = won / due
    middle = math.exp(sum(map(math.log, again)) / n)
    assert done and [x / middle for x in again] == pytest.approx(strength, rel=1e-6)


def test_pools_from_one_aggregate(spark, matches):
    """A pool's leaderboard is that of its own matches alone."""
    scored = arena.with_scores(matches)
    rows = lambda df: sorted((r["model"], round(r["rating"], 6), r["win"], r["loss"], r["tie"], r["rank"], round(r["position_consistency"], 9)) for r in df.collect())
    every = arena.leaderboard(scored, pools=["agent", "full"])
    for pool, part in (("agent", scored.where("model_a NOT LIKE 'baseline%' AND model_b NOT LIKE 'baseline%'")), ("full", scored)):
        assert rows(every.where(F.col("pool") == pool)) == rows(arena.leaderboard(part))


def test_anchors_and_gap(spark):
    recalls = spark.createDataFrame([("j", f"{m}:{p}", r) for p, rs in {"a": (0.9, 0.8), "b": (0.5, 0.4), "c": (0.2, 0.1)}.items() for m, r in zip(("baseline", "agent"), rs, strict=True)] + [("j", "agent:d", 1.0)], "judge string, model string, ratio double")
    ratings = {"a": 1400.0, "b": 1500.0, "c": 1700.0, "d": 1450.0}
    board = spark.createDataFrame([("j", d, f"{m}:{p}", x) for p, x in ratings.items() for m in ("baseline", "agent") for d in "xy"], "judge string, domain string, model string, rating double")
    rows = reports.anchors(reports.recall_against_arena(recalls, board)).collect()
    assert {(r["headline"], r["counter"]) for r in rows} == {("a", "c")} and {r["profile"] for r in rows} == {"a", "b", "c"}
    gap = reports.bucket_gap(spark.createDataFrame([("j", "Accepted", "reference", 1600.0), ("j", "Rejected", "reference", 1450.0), ("j", "Rejected", "x", 1900.0), ("k", "Accepted", "reference", 1.0)], "judge string, bucket string, model string, rating double"))
    assert sorted((r["judge"], r["bucket"], r["gap"]) for r in gap.collect()) == [("j", "Accepted", 150.0), ("j", "Rejected", 150.0), ("k", "Accepted", None)]


def test_two_players_follow_their_odds():
    rating, _, _ = arena.fit(np.array([[0.0, 30.0], [10.0, 0.0]]), np.zeros((2, 2)))
    assert rating[0] > 1500 > rating[1] and math.isclose(rating.sum(), 3000, rel_tol=1e-9)
    assert list(arena.fit(np.zeros((1, 1)), np.zeros((1, 1)))[0]) == [1500.0]


def test_flipping_sides_changes_nothing(spark, matches):
    flipped = matches.select("domain", "judge", "case_id", F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), F.col("reverse").alias("forward"), F.col("forward").alias("reverse"))
    board = lambda m: {r["model"]: (round(r["rating"], 6), r["win"], r["loss"], r["tie"]) for r in arena.leaderboard(arena.with_scores(m), ["domain", "judge"]).collect()}
    assert board(matches) == board(flipped)


def test_observations_and_wins_balance(matches):
    rows = arena.win_loss_tie(arena.with_scores(matches), ["domain"]).collect()
    assert sum(r["n_observations"] for r in rows) == 2 * matches.count()
    assert sum(r["win"] for r in rows) == sum(r["loss"] for r in rows)


def test_a_model_against_itself_is_left_out(spark):
    assert arena.with_scores(made(spark, [("d", "j", "c", "x", "x", 1.0, 0.0)])).count() == 0


def test_agreement_by_orientation(spark):
    rows = [("d", "j0", "c", "a", "b", 1.0, 0.0), ("d", "j1", "c", "b", "a", 0.0, 1.0), ("d", "j0", "e", "a", "b", 1.0, 0.0), ("d", "j1", "e", "a", "b", 0.0, 1.0)]
    one = lambda **k: arena.agreement(made(spark, rows), "j0", "j1", **k).select("n_matches", "agreement").first()
    assert tuple(one()) == (1, 0.0)
    assert tuple(one(canonical=True)) == (2, 0.5)
    assert tuple(one(labels=["a", "b"])) == (1, 0.0) and one(labels=["a"]) is None
    # the forward direction counts, not what both directions give together, and of repeats the last
    more = spark.createDataFrame([("d", "j0", "c", "a", "b", 1.0, 1.0, 1), ("d", "j1", "c", "a", "b", 0.0, 1.0, 1), ("d", "j1", "c", "a", "b", 0.75, 1.0, 2)], "domain string, judge string, case_id string, model_a string, model_b string, forward double, reverse double, at int")
    assert tuple(arena.agreement(more, "j0", "j1", order="at").select("n_matches", "agreement").first()) == (1, 1.0)
