"""Queries over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewell.functions.labels import POOLS, display_name, in_pool, mode_of, profile_of
from ratewell.functions.verdicts import SCORES, consistent, debiased, score_of, winner_of
from ratewell.operators import arena, reports
from ratewell.operators.selection import medians, settled
from ratewell.plans.rating_sql import boards
from ratewell.plans.tables import DOMAINS, ELIGIBLE, SHOWN, table, with_sql

Q = {}
SQL = {}


def query(sql: str | None = None, *uses: str, matches: str | None = None):
    """Registers a query under its name, with the SQL that states its rows; matches: a SELECT of the matches that are fitted."""

    def add(f):
        Q[f.__name__] = f
        if sql:
            tables = with_sql(*uses) if uses else ""
            SQL[f.__name__] = (tables if matches is None else boards(tables, matches)) + sql
        return f

    return add


#: Matches of leaderboards by domain and judge, by pool as well, and of baselines only. A group is its keys, joined.
GROUPS = "SELECT concat_ws('|', domain, judge) AS g, model_a, model_b, score, consistent FROM scored"
POOL_GROUPS = f"""SELECT concat_ws('|', domain, judge, pool) AS g, model_a, model_b, score, consistent FROM scored CROSS JOIN (SELECT 'baseline' AS pool UNION ALL SELECT 'agent' UNION ALL SELECT 'full') z
    WHERE {' AND '.join(f"({m} = 'reference' OR pool = 'full' OR starts_with({m}, concat(pool, ':')))" for m in ('model_a', 'model_b'))}"""
BASELINE_GROUPS = f"{GROUPS} WHERE (model_a = 'reference' OR starts_with(model_a, 'baseline:')) AND (model_b = 'reference' OR starts_with(model_b, 'baseline:'))"
KEY = "split_part(g, '|', 1) AS domain, split_part(g, '|', 2) AS judge"
#: The board as b, with domain and judge, and the models that reports show of it as e.
BOARD_SQL = f", b AS (SELECT {KEY}, * FROM fit_board), e AS (SELECT * FROM b WHERE model IN {ELIGIBLE})"
PAIRED_SQL = BOARD_SQL + ", m AS (SELECT x.domain, x.model, x.rating AS x, y.rating AS y FROM e x JOIN e y ON x.domain = y.domain AND x.model = y.model WHERE x.judge = 'j0' AND y.judge = 'j1')"
MODES_SQL = BOARD_SQL + ", r AS (SELECT *, CASE WHEN model = 'reference' THEN model ELSE split_part(model, ':', 1) END AS mode, CASE WHEN model = 'reference' THEN model ELSE split_part(model, ':', 2) END AS profile FROM b)"
UPLIFT_SQL = MODES_SQL + """, u AS (SELECT x.judge, x.profile, avg(x.rating) AS baseline, avg(y.rating) AS agent, count(*) AS n_domains FROM r x JOIN r y ON x.judge = y.judge AND x.domain = y.domain AND x.profile = y.profile
    WHERE x.mode = 'baseline' AND y.mode = 'agent' GROUP BY x.judge, x.profile)"""
TOP_SQL = """, o AS (SELECT *, row_number() OVER (PARTITION BY domain, judge ORDER BY rating DESC, model) AS place FROM e),
    t AS (SELECT x.domain, count(y.model) / 5.0::DOUBLE AS overlap FROM o x LEFT JOIN o y ON x.domain = y.domain AND x.model = y.model AND y.judge = 'j1' AND y.place <= 5 WHERE x.judge = 'j0' AND x.place <= 5 GROUP BY x.domain)"""
SHIFT_SQL = """, k AS (SELECT domain, abs(row_number() OVER (PARTITION BY domain ORDER BY x DESC, model) - row_number() OVER (PARTITION BY domain ORDER BY y DESC, model)) AS shift FROM m),
    h AS (SELECT domain, count(*) AS n, round(avg(shift), 6) AS mean_shift FROM k GROUP BY domain)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arena.with_scores(table(spark, sf_dir, "matches"))


def _restrict(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("reference",), ("baseline:m1",), ("baseline:m2",), ("agent:m1",), ("agent:m2",)], "label string")


LISTED = "('reference', 'baseline:m1', 'baseline:m2', 'agent:m1', 'agent:m2')"
IN_POOL = "({0} = 'reference' OR pool = 'full' OR starts_with({0}, concat(pool, ':')))"
POOLS_SQL = "(SELECT 'baseline' AS pool UNION ALL SELECT 'agent' UNION ALL SELECT 'full')"
TOKEN = "CASE {0} WHEN 1.0 THEN 'A>>B' WHEN 0.75 THEN 'A>B' WHEN 0.5 THEN 'A=B' WHEN 0.25 THEN 'B>A' ELSE 'B>>A' END"
WINNER = "CASE WHEN {0} > 0.5 THEN 'a' WHEN {0} < 0.5 THEN 'b' ELSE 'tie' END"


@query(f"SELECT judge, {TOKEN.format('forward')} AS token, forward AS score, {WINNER.format('forward')} AS winner, count(*) AS n FROM matches GROUP BY ALL", "matches")
def verdict_scores(spark, sf_dir):
    """Tokens to scores and winners."""
    token = F.create_map(*[F.lit(x) for k, v in SCORES.items() for x in (v, k)])[F.col("forward")]
    return table(spark, sf_dir, "matches").select("judge", token.alias("token")).withColumn("score", score_of(F.col("token"))).withColumn("winner", winner_of(F.col("score"))).groupBy("judge", "token", "score", "winner").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT judge, case_id, model_a, model_b, score, consistent FROM scored", "scored")
def debiased_scores(spark, sf_dir):
    """Every match's debiased score and whether both directions agree."""
    f, r = F.col("forward"), F.col("reverse")
    return table(spark, sf_dir, "matches").select("judge", "case_id", "model_a", "model_b", debiased(f, r).alias("score"), consistent(f, r).alias("consistent"))


@query(f"SELECT judge, domain, pool, count(*) AS n FROM matches CROSS JOIN {POOLS_SQL} WHERE {IN_POOL.format('model_a')} AND {IN_POOL.format('model_b')} GROUP BY ALL", "matches")
def pool_filter_matches(spark, sf_dir):
    """Matches of each pool, counted."""
    return arena.by_pool(table(spark, sf_dir, "matches")).groupBy("judge", "domain", "pool").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT domain, pool, model, count(*) AS n FROM records CROSS JOIN {POOLS_SQL} WHERE {IN_POOL.format('model')} GROUP BY ALL", "records")
def pool_filter_scores(spark, sf_dir):
    """Score records of each pool, counted by model."""
    pools = F.filter(F.array(F.lit("baseline"), F.lit("agent"), F.lit("full")), lambda p: in_pool(F.col("model"), p))
    return table(spark, sf_dir, "records").select("domain", "model", F.explode(pools).alias("pool")).groupBy("domain", "pool", "model").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT judge, case_id, model_a, model_b, forward, reverse FROM matches WHERE model_a IN {LISTED} AND model_b IN {LISTED}", "matches")
def restricted_matches(spark, sf_dir):
    """Matches between listed models."""
    return arena.restricted(table(spark, sf_dir, "matches"), _restrict(spark)).select("judge", "case_id", "model_a", "model_b", "forward", "reverse")


@query(
    "SELECT DISTINCT label, CASE WHEN label = 'reference' THEN 'reference' ELSE split_part(label, ':', 1) END AS mode, CASE WHEN label = 'reference' THEN label "
    "ELSE split_part(label, ':', 2) END AS profile, CASE WHEN label = 'reference' THEN 'Reference' ELSE concat(split_part(label, ':', 2), '-v') END AS shown "
    "FROM sub", "sub")
def split_labels(spark, sf_dir):
    """Mode, profile and the displayed name of each label."""
    profile = profile_of(F.col("label"))
    shown = display_name(F.when(F.col("label") == "reference", profile).otherwise(F.concat(profile, F.lit("-v-high"))))
    return table(spark, sf_dir, "sub").select("label").distinct().select("label", mode_of(F.col("label")).alias("mode"), profile.alias("profile"), shown.alias("shown"))


WLT = "CAST(sum(CASE WHEN own > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS win, CAST(sum(CASE WHEN own < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS loss, CAST(sum(CASE WHEN own = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tie"


@query(f"SELECT domain, judge, model, {WLT}, count(*) AS n_observations, round(avg(CASE WHEN own > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM sides GROUP BY domain, judge, model", "sides")
def win_loss_tie(spark, sf_dir):
    """Wins, losses and ties of each model."""
    return arena.win_loss_tie(scored(spark, sf_dir), ["domain", "judge"]).withColumn("win_rate", F.round("win_rate", 6))


BASELINE = "(SELECT judge, CASE side WHEN 1 THEN model_a ELSE model_b END AS model, CASE side WHEN 1 THEN score ELSE 1 - score END AS own FROM scored CROSS JOIN (SELECT 1 AS side UNION ALL SELECT 2) x WHERE (model_a = 'reference' OR starts_with(model_a, 'baseline:')) AND (model_b = 'reference' OR starts_with(model_b, 'baseline:')))"


@query(
    f"SELECT judge, model, count(*) AS n_observations, round((sum(CASE WHEN own > 0.5 THEN 1 ELSE 0 END) + sum(CASE WHEN own = 0.5 THEN 1 ELSE 0 END) / 2.0) "
    f"/ count(*), 6) AS half_tie_rate FROM {BASELINE} b GROUP BY judge, model", "scored")
def cross_domain_winrate(spark, sf_dir):
    """Share of wins over all domains among baselines and the reference, a tie counted half."""
    return arena.half_tie_rate(arena.by_pool(scored(spark, sf_dir), ["baseline"]), ["judge"]).withColumn("half_tie_rate", F.round("half_tie_rate", 6))


@query(
    """SELECT domain, judge, model_a AS model_lo, model_b AS model_hi, sum(CASE WHEN score > 0.5 THEN (score - 0.5) * 2 ELSE 0 END) AS win_lo,
    sum(CASE WHEN score < 0.5 THEN (0.5 - score) * 2 ELSE 0 END) AS win_hi, sum(1 - abs(score - 0.5) * 2) AS ties, count(*) AS n FROM scored GROUP BY domain, judge, model_a, model_b""",
    "scored",
)
def pair_matrix(spark, sf_dir):
    """Graded wins and ties of each pair of models."""
    return arena.pair_matrix(scored(spark, sf_dir), ["domain", "judge"])


@query(f" SELECT {KEY}, model, round(rating, 4) AS rating, CAST(turns AS INTEGER) AS iterations, done AS converged FROM fit_board", "scored", matches=GROUPS)
def btd_ratings(spark, sf_dir):
    """Ratings per domain and judge, with the rounds of the fixed point."""
    return arena.ratings(arena.pair_matrix(scored(spark, sf_dir), ["domain", "judge"]), ["domain", "judge"]).withColumn("rating", F.round("rating", 4))


@query(
    f" SELECT {KEY}, split_part(g, '|', 3) AS pool, model, round(rating, 4) AS rating, done AS converged, win, loss, tie, n_observations, round(win_rate, 6) AS win_rate, "
    "round(position_consistency, 6) AS position_consistency, rank FROM fit_board", "scored", matches=POOL_GROUPS,
)
def arena_leaderboard(spark, sf_dir):
    """Leaderboards of all domains, judges and pools in one pass."""
    return arena.leaderboard(scored(spark, sf_dir), pools=POOLS).withColumn("rating", F.round("rating", 4)).withColumn("win_rate", F.round("win_rate", 6)).withColumn("position_consistency", F.round("position_consistency", 6))


@query(
    f"SELECT domain, judge, pool, round(avg(CASE WHEN consistent THEN 1.0 ELSE 0.0 END), 6) AS position_consistency, count(*) AS n FROM scored CROSS JOIN {POOLS_SQL} "
    f"WHERE {IN_POOL.format('model_a')} AND {IN_POOL.format('model_b')} GROUP BY ALL", "scored")
def position_consistency(spark, sf_dir):
    """Share of matches in which both directions agree, per leaderboard."""
    return arena.by_pool(scored(spark, sf_dir)).groupBy("domain", "judge", "pool").agg(F.round(F.avg(F.col("consistent").cast("double")), 6).alias("position_consistency"), F.count(F.lit(1)).alias("n"))


@query(
    f" SELECT {KEY}, model, round(rating, 4) AS rating, done AS converged, win, loss, tie, n_observations, win_rate, position_consistency, rank FROM fit_board", "scored",
    matches=f"{GROUPS} WHERE model_a IN {LISTED} AND model_b IN {LISTED}",
)
def restricted_leaderboard(spark, sf_dir):
    """Leaderboards refitted on matches between listed models."""
    return arena.leaderboard(arena.restricted(scored(spark, sf_dir), _restrict(spark)), ["domain", "judge"]).withColumn("rating", F.round("rating", 4))


REF = """SELECT domain, judge, case_id, count(*) AS n, avg(CASE WHEN model_a = 'reference' THEN score ELSE 1 - score END) AS ref_score,
    avg(CASE WHEN (model_a = 'reference' AND forward > 0.5 AND reverse < 0.5) OR (model_b = 'reference' AND forward < 0.5 AND reverse > 0.5) THEN 1.0
    WHEN (model_a = 'reference' AND forward < 0.5 AND reverse > 0.5) OR (model_b = 'reference' AND forward > 0.5 AND reverse < 0.5) THEN 0.0 ELSE 0.5 END) AS ref_win
    FROM scored WHERE model_a = 'reference' OR model_b = 'reference' GROUP BY domain, judge, case_id"""


def _per_case(spark, sf_dir) -> DataFrame:
    view = arena.reference_view(table(spark, sf_dir, "matches"))
    return view.groupBy("domain", "judge", "case_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ref_score").alias("ref_score"), F.avg("ref_win").alias("ref_win"))


@query(f"SELECT domain, judge, case_id, n, round(ref_score, 6) AS ref_score, round(ref_win, 6) AS ref_win FROM ({REF}) x", "scored")
def reference_per_case(spark, sf_dir):
    """How the reference fares in each case."""
    return _per_case(spark, sf_dir).withColumn("ref_score", F.round("ref_score", 6)).withColumn("ref_win", F.round("ref_win", 6))


BUCKET = "CASE WHEN venue IN ('oral', 'poster') THEN 'Accepted' WHEN venue IN ('rejected', 'withdrawn') THEN 'Rejected' END"


@query(f"SELECT domain, {BUCKET} AS bucket, count(*) AS n FROM cases GROUP BY ALL", "cases")
def bucket_cases(spark, sf_dir):
    """Cases by bucket of their venue; other venues have none."""
    return reports.with_bucket(table(spark, sf_dir, "cases")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"SELECT r.judge, c.bucket, count(*) AS n, round(median(r.ref_score), 6) AS median_score, round(median(r.ref_win), 6) AS median_win FROM ({REF}) r JOIN "
    f"(SELECT case_id, {BUCKET} AS bucket FROM cases) c ON r.case_id = c.case_id WHERE c.bucket IS NOT NULL GROUP BY r.judge, c.bucket", "scored", "cases")
def bucket_summary(spark, sf_dir):
    """Exact medians of the reference's case scores by bucket."""
    buckets = reports.with_bucket(table(spark, sf_dir, "cases")).where("bucket IS NOT NULL").select("case_id", "bucket")
    rows = settled(_per_case(spark, sf_dir).join(buckets, "case_id").select("judge", "bucket", "ref_score", "ref_win"), "bucketed")
    found = medians(rows, ["judge", "bucket"], ["ref_score", "ref_win"])
    sizes = rows.groupBy("judge", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(found, ["judge", "bucket"]).select("judge", "bucket", "n", F.round("ref_score", 6).alias("median_score"), F.round("ref_win", 6).alias("median_win"))


@query(
    """ SELECT split_part(g, '|', 1) AS judge, split_part(g, '|', 2) AS bucket, round(rating, 4) AS reference_rating,
    round(max(rating) FILTER (split_part(g, '|', 2) = 'Accepted') OVER (PARTITION BY split_part(g, '|', 1)) - max(rating) FILTER (split_part(g, '|', 2) = 'Rejected') OVER (PARTITION BY split_part(g, '|', 1)), 4) AS gap
    FROM fit_board WHERE model = 'reference'""", "scored", "cases",
    matches=f"SELECT concat_ws('|', judge, bucket) AS g, model_a, model_b, score, consistent FROM scored s JOIN (SELECT case_id, {BUCKET} AS bucket FROM cases) c ON c.case_id = s.case_id WHERE bucket IS NOT NULL",
)
def bucket_btd(spark, sf_dir):
    """The reference's rating on each bucket's matches, and how far accepted cases lead rejected ones (null without both)."""
    buckets = reports.with_bucket(table(spark, sf_dir, "cases")).where("bucket IS NOT NULL").select("case_id", "bucket")
    board = arena.leaderboard(scored(spark, sf_dir).join(buckets, "case_id"), ["judge", "bucket"])
    return reports.bucket_gap(board)


LIST = str(ELIGIBLE)


@query(
    f"""SELECT a.domain AS domain, count(*) AS n_matches, round(avg(CASE WHEN {WINNER.format('a.forward')} = {WINNER.format('b.forward')} THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM matches a
    JOIN matches b ON a.domain = b.domain AND a.case_id = b.case_id AND a.model_a = b.model_a AND a.model_b = b.model_b
    WHERE a.judge = 'j0' AND b.judge = 'j1' AND a.model_a IN {LIST} AND a.model_b IN {LIST} GROUP BY a.domain""",
    "matches",
)
def judge_agreement(spark, sf_dir):
    """How often two judges name the same winner in the forward direction, among eligible models."""
    return arena.agreement(table(spark, sf_dir, "matches"), "j0", "j1", labels=ELIGIBLE).withColumn("agreement", F.round("agreement", 6))


@query(
    f""", again AS (SELECT domain, judge, case_id, model_a, model_b, forward, 1 AS created FROM matches UNION ALL SELECT domain, judge, case_id, model_a, model_b, 1 - forward, 2 FROM matches WHERE o % 5 = 0 AND judge = 'j0'),
    lasts AS (SELECT domain, judge, case_id, model_a, model_b, arg_max(forward, created) AS forward FROM again GROUP BY ALL)
    SELECT a.domain AS domain, count(*) AS n_matches, round(avg(CASE WHEN {WINNER.format('a.forward')} = {WINNER.format('b.forward')} THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM lasts a
    JOIN lasts b ON a.domain = b.domain AND a.case_id = b.case_id AND a.model_a = b.model_a AND a.model_b = b.model_b WHERE a.judge = 'j0' AND b.judge = 'j1' GROUP BY a.domain""",
    "matches",
)
def judge_agreement_last(spark, sf_dir):
    """The same over all models where a judge has compared some pairs twice: the later match counts."""
    rows = table(spark, sf_dir, "matches").withColumn("created", F.lit(1))
    again = rows.where("o % 5 = 0 AND judge = 'j0'").withColumns({"forward": 1 - F.col("forward"), "created": F.lit(2)})
    return arena.agreement(rows.unionByName(again), "j0", "j1", order="created").withColumn("agreement", F.round("agreement", 6))


def board(spark, sf_dir, pool: str = "full") -> DataFrame:
    return arena.leaderboard(scored(spark, sf_dir), pools=[pool])


def eligible_board(spark, sf_dir) -> DataFrame:
    """Leaderboards of baselines and the reference; of these, the models that reports show."""
    return board(spark, sf_dir, "baseline").where(F.col("model").isin(*ELIGIBLE))


@query()
def cross_domain_arena(spark, sf_dir):
    """Mean rating and mean win rate of shown baselines and the reference over the domains they are in, with a column per
    domain and flags for the judge's best; shown profiles that no leaderboard has are reported with nulls."""
    return reports.shown_across(board(spark, sf_dir, "baseline"), DOMAINS, SHOWN)


@query(UPLIFT_SQL + " SELECT judge, profile, n_domains, round(baseline, 4) AS baseline, round(agent, 4) AS agent, round(agent - baseline, 4) AS uplift FROM u", "scored", matches=GROUPS)
def mode_uplift(spark, sf_dir):
    """Agent mean less baseline mean over the domains that a profile has in both modes."""
    return reports.uplift(board(spark, sf_dir), "rating")


@query(
    UPLIFT_SQL + " SELECT judge, CASE WHEN round(baseline, 4) >= 1560 THEN 'top' WHEN round(baseline, 4) >= 1470 THEN 'mid' ELSE 'low' END AS tier, count(*) AS n, round(avg(round(agent - baseline, 4)), 4) AS mean_uplift FROM u GROUP BY ALL",
    "scored", matches=GROUPS,
)
def uplift_tiers(spark, sf_dir):
    """Profiles by tier of their baseline mean, with the mean uplift of each tier."""
    return reports.tiers(reports.uplift(board(spark, sf_dir), "rating"))


@query(
    MODES_SQL + " SELECT * FROM (SELECT judge, profile, " + ", ".join(f"round(avg(rating) FILTER (mode = '{m}'), 4) AS {m}" for m in ("baseline", "agent", "reference"))
    + " FROM r GROUP BY judge, profile) x WHERE (baseline IS NOT NULL AND agent IS NOT NULL) OR reference IS NOT NULL", "scored", matches=GROUPS,
)
def mode_means(spark, sf_dir):
    """Mean rating of each mode over its own domains, for profiles that have both, and the reference's."""
    return reports.mode_means(board(spark, sf_dir), "rating")


@query(
    PAIRED_SQL + """, a AS (SELECT domain, model, x, y FROM m UNION ALL SELECT 'all', concat(domain, model), x, y FROM m),
    k AS (SELECT domain, rank() OVER (PARTITION BY domain ORDER BY x) + (count(*) OVER (PARTITION BY domain, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY domain ORDER BY y) + (count(*) OVER (PARTITION BY domain, y) - 1) / 2.0 AS ry FROM a),
    rho AS (SELECT domain, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY domain),
    p AS (SELECT v.domain, sum(sign(v.x - w.x) * sign(v.y - w.y)) AS s, count(*) FILTER (v.x = w.x AND v.y <> w.y) AS tx, count(*) FILTER (v.y = w.y AND v.x <> w.x) AS ty, count(*) AS pairs FROM a v JOIN a w ON v.domain = w.domain AND v.model < w.model GROUP BY v.domain)
    SELECT rho.domain, n, rho, round(s / sqrt((pairs - tx) * (pairs - ty)), 6) AS tau FROM rho JOIN p ON p.domain = rho.domain WHERE n >= 3""", "scored", matches=BASELINE_GROUPS,
)
def judge_rank_corr(spark, sf_dir):
    """Spearman's and Kendall's correlation of two judges' ratings, per domain and over all."""
    return reports.judge_correlation(eligible_board(spark, sf_dir), "j0", "j1")


@query()
def judge_pooled_corr(spark, sf_dir):
    """The correlations over all cells (domain and model) that two judges share, with a bootstrap interval of rho."""
    return reports.pooled_correlation(eligible_board(spark, sf_dir), "j0", "j1", replicates=2000)


@query(BOARD_SQL + TOP_SQL + " SELECT domain, overlap FROM t", "scored", matches=BASELINE_GROUPS)
def topk_overlap(spark, sf_dir):
    """How many of the first five eligible models two judges share, per domain."""
    return reports.top_overlap(eligible_board(spark, sf_dir), "j0", "j1", 5)


@query(PAIRED_SQL + SHIFT_SQL + " SELECT domain, n, mean_shift FROM h", "scored", matches=BASELINE_GROUPS)
def rank_shift(spark, sf_dir):
    """Mean absolute difference of ranks among eligible models that two judges share."""
    return reports.rank_shift(eligible_board(spark, sf_dir), "j0", "j1")


@query(
    PAIRED_SQL + TOP_SQL + SHIFT_SQL + f""", g AS (SELECT a.domain, count(*) AS n_matches, avg(CASE WHEN {WINNER.format('a.forward')} = {WINNER.format('b.forward')} THEN 1.0 ELSE 0.0 END) AS agreement FROM matches a
    JOIN matches b ON a.domain = b.domain AND a.case_id = b.case_id AND a.model_a = b.model_a AND a.model_b = b.model_b WHERE a.judge = 'j0' AND b.judge = 'j1' AND a.model_a IN {ELIGIBLE} AND a.model_b IN {ELIGIBLE} GROUP BY a.domain)
    SELECT CAST(sum(n_matches) AS BIGINT) AS n_matches, sum(agreement * n_matches) / sum(n_matches) AS agreement, (SELECT avg(overlap) FROM t) AS mean_overlap, (SELECT avg(mean_shift) FROM h) AS mean_shift FROM g""",
    "scored", matches=BASELINE_GROUPS,
)
def judge_summary(spark, sf_dir):
    """Match-weighted agreement, mean overlap and mean rank shift of two judges."""
    b = eligible_board(spark, sf_dir)
    agreed = arena.agreement(table(spark, sf_dir, "matches"), "j0", "j1", labels=ELIGIBLE)
    agreed = agreed.agg(F.sum("n_matches").alias("n_matches"), (F.sum(F.col("agreement") * F.col("n_matches")) / F.sum("n_matches")).alias("agreement"))
    over = reports.top_overlap(b, "j0", "j1", 5).agg(F.avg("overlap").alias("mean_overlap"))
    shift = reports.rank_shift(b, "j0", "j1").agg(F.avg("mean_shift").alias("mean_shift"))
    return agreed.crossJoin(over).crossJoin(shift)  # one row each
