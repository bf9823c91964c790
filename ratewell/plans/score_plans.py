"""Queries over rubric records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.functions.rubric import PAIR_KEYS, SET_KEYS, recall_mismatch, recall_of
from ratewell.operators import arena, reports, score
from ratewell.operators.rankstats import correlations
from ratewell.operators.selection import settled
from ratewell.plans.arena_plans import BASELINE_GROUPS, BOARD_SQL, GROUPS, IN_POOL, POOLS_SQL
from ratewell.plans.arena_plans import board as arena_board
from ratewell.plans.rating_sql import boards
from ratewell.plans.tables import DOMAINS, ELIGIBLE, MULTI, SHOWN, table, with_sql

Q = {}
SQL = {}


def query(sql: str | None = None, *uses: str, matches: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = (with_sql(*uses) if matches is None else boards(with_sql(*uses), matches)) + sql
        return f

    return add


def records(spark, sf_dir) -> DataFrame:
    """The records in their nested form, recall parsed from its text."""
    value = lambda x: x.cast("double")
    c = F.col
    pair = lambda i: F.create_map(F.lit("grounding"), value(1 + (c("q") + i) % 5), F.lit("insight"), value(1 + (c("p") + 2 * i) % 5), F.lit("justification"), value(1 + (c("s") + c("n") + i) % 5))
    sets = F.create_map(F.lit("breadth"), value(1 + c("o") % 5), F.lit("distinctness"), F.when(c("k") > 1, value(1 + (c("o") + c("p")) % 5)), F.lit("utility"), value(1 + (c("o") + c("q")) % 5))
    return table(spark, sf_dir, "records").select(
        "domain", "judge", "case_id", "model", "multi", "k", F.transform(F.sequence(F.lit(0), c("k").cast("int") - 1), pair).alias("pair_scores"),
        F.when(c("multi"), F.map_filter(sets, lambda _, v: v.isNotNull())).otherwise(F.create_map().cast("map<string,double>")).alias("set_scores"), "recall_text", recall_of(c("recall_text")).alias("recall"),
    )


def scored(spark, sf_dir) -> DataFrame:
    return score.rubric_scores(records(spark, sf_dir))


@query("SELECT case_id, model, round(q_pair, 6) AS q_pair, round(q_set, 6) AS q_set, round(s_score, 6) AS s_score FROM summaries", "summaries")
def rubric_scores(spark, sf_dir):
    """Each record's scores from the rubric's dimensions."""
    return scored(spark, sf_dir).select("case_id", "model", *[F.round(x, 6).alias(x) for x in ("q_pair", "q_set", "s_score")])


@query("SELECT case_id, model, round(q_pair, 6) AS pair_summary, round(q_set, 6) AS set_summary, round(s_score, 6) AS overall_score FROM summaries", "summaries")
def record_summaries(spark, sf_dir):
    """Each record's scores from all keys that it has."""
    return score.record_summaries(records(spark, sf_dir)).select("case_id", "model", *[F.round(x, 6).alias(x) for x in ("pair_summary", "set_summary", "overall_score")])


_PAIR = "concat_ws(',', CAST(1 + (q + {0}) % 5 AS STRING), CAST(1 + (p + 2 * {0}) % 5 AS STRING), CAST(1 + (s + n + {0}) % 5 AS STRING))"


@query(
    f"SELECT case_id, model, v < 4 AS valid, v = 3 AS k_mismatch, CASE WHEN v < 4 THEN concat_ws(';', {_PAIR.format(0)}, CASE WHEN m > 1 THEN {_PAIR.format(1)} END, CASE WHEN m > 2 THEN {_PAIR.format(2)} END, CASE WHEN m > 3 THEN {_PAIR.format(3)} END) END AS pairs,"
    " CASE WHEN v < 4 AND multi THEN CAST(1 + o % 5 AS DOUBLE) END AS breadth, CASE WHEN v < 4 AND multi AND k > 1 AND p % 5 <> 0 THEN CAST(1 + (o + p) % 5 AS DOUBLE) END AS distinctness, CASE WHEN v < 4 AND multi THEN CAST(1 + (o + q) % 5 AS DOUBLE) END AS utility"
    " FROM (SELECT *, k + CASE WHEN (q + n) % 6 = 3 THEN 1 ELSE 0 END AS m, (q + n) % 6 AS v FROM records) x",
    "records",
)
def parse_score_verdicts(spark, sf_dir):
    """Score records from raw answers: plain, fenced, with a comma too many, with a pair too many, no JSON, a score missing."""
    c, v = F.col, (F.col("q") + F.col("n")) % 6
    own = lambda name, x: F.concat(F.lit(f'"{name}": '), x.cast("string"))
    pair = lambda i: F.concat(F.lit("{"), F.concat_ws(", ", own("grounding", 1 + (c("q") + i) % 5), own("insight", 1 + (c("p") + 2 * i) % 5), F.when((v != 5) | (i > 0), own("justification", 1 + (c("s") + c("n") + i) % 5))), F.lit("}"))
    pairs = F.array_join(F.transform(F.sequence(F.lit(0), c("k").cast("int") - 1 + F.when(v == 3, 1).otherwise(0)), pair), ", ")
    sets = F.concat_ws(", ", own("breadth", 1 + c("o") % 5), F.when(c("p") % 5 == 0, F.lit('"distinctness": null')).otherwise(own("distinctness", 1 + (c("o") + c("p")) % 5)), own("utility", 1 + (c("o") + c("q")) % 5))
    body = F.concat(F.lit('{"pair_scores": ['), pairs, F.lit('], "rationale": "seen", "recall": null, "set_scores": {'), sets, F.when(v == 2, "},}").otherwise("}}"))
    answer = F.when(v == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(v == 4, "I cannot say.").otherwise(body)
    found = score.parsed_verdicts(table(spark, sf_dir, "records").select("case_id", "model", "k", "multi", answer.alias("answer")), "answer")
    text = F.array_join(F.transform("pair_scores", lambda m: F.concat_ws(",", *[m[x].cast("int").cast("string") for x in PAIR_KEYS])), ";")
    return found.select("case_id", "model", "valid", "k_mismatch", text.alias("pairs"), *[c("set_scores")[x].alias(x) for x in SET_KEYS])


@query(
    "SELECT r.case_id, r.model, r.recall_text, x.hits AS hits, x.total AS total, coalesce(x.total <> 3 + r.o % 3, false) AS mismatch FROM records r JOIN recalls "
    "x ON r.case_id = x.case_id AND r.model = x.model", "records", "recalls")
def parse_recall(spark, sf_dir):
    """hits/total texts to numbers, anything else to null; whether the total is another than the reference's 3 to 5 hypotheses."""
    o = F.substring_index("case_id", ":", -1).cast("long")
    return records(spark, sf_dir).select("case_id", "model", "recall_text", F.col("recall.hits").cast("long").alias("hits"), F.col("recall.total").alias("total"), recall_mismatch(F.col("recall"), 3 + o % 3).alias("mismatch"))


LONG = """, long AS (SELECT domain, judge, model, 'grounding' AS dimension, grounding AS v FROM pairs UNION ALL SELECT domain, judge, model, 'insight', insight FROM pairs
    UNION ALL SELECT domain, judge, model, 'justification', justification FROM pairs UNION ALL SELECT domain, judge, model, 'breadth', breadth FROM sets
    UNION ALL SELECT domain, judge, model, 'distinctness', distinctness FROM sets WHERE distinctness IS NOT NULL UNION ALL SELECT domain, judge, model, 'utility', utility FROM sets
    UNION ALL SELECT domain, judge, model, 'recall', hits * 1.0 / total FROM recalls WHERE total IS NOT NULL UNION ALL SELECT domain, judge, model, 'S', s_score FROM summaries)
"""


@query(LONG + "SELECT domain, judge, model, dimension, round(avg(v), 6) AS mean, count(*) AS n FROM long GROUP BY ALL", "pairs", "sets", "recalls", "summaries")
def dimension_means(spark, sf_dir):
    """Means of every dimension per model."""
    return score.dimension_means(scored(spark, sf_dir), ["domain", "judge", "model"]).withColumn("mean", F.round("mean", 6))


@query(
    f"""SELECT domain, judge, pool, model, round(avg(s_score), 6) AS rating, count(*) AS n_observations, CAST(row_number() OVER (PARTITION BY domain, judge, pool ORDER BY avg(s_score) DESC, model) AS INTEGER) AS rank
    FROM summaries CROSS JOIN {POOLS_SQL} WHERE {IN_POOL.format('model')} GROUP BY domain, judge, pool, model""",
    "summaries",
)
def score_leaderboard(spark, sf_dir):
    """Leaderboards of all pools by mean S."""
    return score.leaderboard(score.by_pool(scored(spark, sf_dir))).select("domain", "judge", "pool", "model", F.round("rating", 6).alias("rating"), "n_observations", "rank")


def board(spark, sf_dir) -> DataFrame:
    return score.leaderboard(scored(spark, sf_dir), ["domain", "judge"])


@query(
    "SELECT model, " + ", ".join(f"round(avg(CASE WHEN domain = '{d}' THEN s_score END), 6) AS {d}" for d in DOMAINS)
    + ", count(DISTINCT domain) AS n_domains, round(" + "/".join(["(" + " + ".join(f"coalesce(avg(CASE WHEN domain = '{d}' THEN s_score END), 0)" for d in DOMAINS) + ")", "count(DISTINCT domain)"]) + ", 6) AS mean FROM summaries GROUP BY model",
    "summaries",
)
def cross_domain_scores(spark, sf_dir):
    """Mean S per domain and over domains."""
    return reports.across_domains(board(spark, sf_dir), "rating", DOMAINS, 6).select("model", *DOMAINS, "n_domains", "mean")


@query(LONG + "SELECT domain, model, " + ", ".join(f"round(avg(CASE WHEN dimension = '{k}' THEN v END), 6) AS {k}" for k in ("grounding", "insight", "justification", "breadth", "distinctness", "utility")) + " FROM long GROUP BY domain, model", "pairs", "sets", "recalls", "summaries")
def score_details(spark, sf_dir):
    """Means by dimension, a column each; set dimensions only where they apply."""
    means = score.dimension_means(scored(spark, sf_dir), ["domain", "model"])
    names = ["grounding", "insight", "justification", "breadth", "distinctness", "utility"]
    wide = means.groupBy("domain", "model").pivot("dimension", names).agg(F.first("mean"))
    return wide.select("domain", "model", *[F.round(n, 6).alias(n) for n in names])


RECALL = f"""SELECT judge, model, avg(hits) AS hits, avg(total) AS total, avg(hits * 1.0 / total) AS ratio, coalesce(stddev_samp(hits * 1.0 / total), 0.0) AS deviation, count(*) AS n FROM judged_recalls r
    WHERE total IS NOT NULL AND model <> 'reference' AND domain IN {MULTI} AND split_part(model, ':', 2) IN {SHOWN} AND EXISTS (SELECT 1 FROM sides x WHERE x.judge = r.judge AND x.model = r.model)
    GROUP BY judge, model HAVING count(*) >= 5"""


def judged_recalls(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "judged_recalls")
    return rows.withColumn("recall", F.when(F.col("total").isNotNull(), F.struct("hits", "total"))).drop("hits", "total")


def recall_rows(spark, sf_dir, least: int = 5) -> DataFrame:
    """Recall of shown models that both judges' arenas rate."""
    return score.recall_table(judged_recalls(spark, sf_dir), MULTI, least, SHOWN, arena.sides(arena.with_scores(table(spark, sf_dir, "matches"))))


@query("SELECT judge, model, round(hits, 6) AS hits, round(total, 6) AS total, round(ratio, 6) AS ratio, round(deviation, 6) AS deviation, n FROM (" + RECALL + ") x", "judged_recalls", "sides")
def recall_table(spark, sf_dir):
    """Recall of reference hypotheses per label."""
    return recall_rows(spark, sf_dir).select("judge", "model", *[F.round(x, 6).alias(x) for x in ("hits", "total", "ratio", "deviation")], "n")


@query("SELECT domain, model, round(avg(s_score), 6) AS overall, count(*) AS n FROM summaries WHERE contains(model, 'agent') GROUP BY domain, model", "summaries")
def overall_by_model(spark, sf_dir):
    """Mean overall score of labels that hold a text."""
    return score.record_summaries(records(spark, sf_dir)).where(F.col("model").contains("agent")).groupBy("domain", "model").agg(F.round(F.avg("overall_score"), 6).alias("overall"), F.count(F.lit(1)).alias("n"))


@query("SELECT domain, round(avg(CASE WHEN s_score >= 4 THEN 1.0 ELSE 0.0 END), 6) AS part FROM summaries GROUP BY domain", "summaries")
def fraction_at_least(spark, sf_dir):
    """Share of records with S of 4 or more."""
    return scored(spark, sf_dir).groupBy("domain").agg(F.round(F.coalesce(F.avg((F.col("s_score") >= 4).cast("double")), F.lit(0.0)), 6).alias("part"))


@query(
    """, m AS (SELECT domain, model, avg(q_pair) AS x, avg(s_score) AS y FROM summaries GROUP BY domain, model)
    SELECT domain, model, CAST(row_number() OVER (PARTITION BY domain ORDER BY x DESC, model) - row_number() OVER (PARTITION BY domain ORDER BY y DESC, model) AS INTEGER) AS delta FROM m""",
    "summaries",
)
def rubric_rank_delta(spark, sf_dir):
    """How far a model's rank by S differs from its rank by pair scores alone."""
    means = scored(spark, sf_dir).groupBy("domain", "model").agg(F.avg("q_pair").alias("x"), F.avg("s_score").alias("y"))
    rank = lambda c: F.row_number().over(W.partitionBy("domain").orderBy(F.desc(c), "model"))
    return means.select("domain", "model", (rank("x") - rank("y")).alias("delta"))


@query("SELECT model, count(*) AS n_judges, min(n) AS least_cases FROM (" + RECALL.replace(">= 5", ">= 30") + ") x GROUP BY model HAVING count(*) = (SELECT count(DISTINCT judge) FROM judged_recalls)", "judged_recalls", "sides")
def common_recall_rows(spark, sf_dir):
    """Labels with a recall row under every judge."""
    judges = judged_recalls(spark, sf_dir).agg(F.countDistinct("judge").alias("n_all"))
    held = recall_rows(spark, sf_dir, 30).groupBy("model").agg(F.count(F.lit(1)).alias("n_judges"), F.min("n").alias("least_cases"))
    return held.crossJoin(judges).where("n_judges = n_all").drop("n_all")  # judges is one row


@query("SELECT split_part(model, ':', 2) AS profile FROM (SELECT DISTINCT model FROM records WHERE model <> 'reference') x GROUP BY 1 HAVING count(*) = 2", "records")
def paired_models(spark, sf_dir):
    """Profiles that have both modes."""
    from ratewell.functions.labels import mode_of, profile_of

    rows = table(spark, sf_dir, "records").select(mode_of(F.col("model")).alias("mode"), profile_of(F.col("model")).alias("profile")).where("mode <> 'reference'")
    return rows.groupBy("profile").agg(F.countDistinct("mode").alias("modes")).where("modes = 2").select("profile")


def _spread(rows: str, name: str) -> str:
    """Per judge and domain the spread of ratings of shown baselines and the reference, and without the reference."""
    return f"{name} AS (SELECT judge, domain, max(rating) - min(rating) AS spread, max(rating) FILTER (model <> 'reference') - min(rating) FILTER (model <> 'reference') AS others FROM {rows} WHERE model IN {ELIGIBLE} GROUP BY judge, domain)"


@query(
    BOARD_SQL + f", rated AS (SELECT judge, domain, model, avg(s_score) AS rating FROM summaries GROUP BY judge, domain, model), {_spread('b', 'sa')}, {_spread('rated', 'ss')}"
    " SELECT sa.judge, sa.domain, round(sa.spread, 4) AS arena, round(ss.spread, 4) AS rubric, round(sa.others, 4) AS arena_others, round(ss.others, 4) AS rubric_others,"
    " CASE WHEN ss.spread <> 0 THEN round(sa.spread / ss.spread, 4) END AS ratio, CASE WHEN ss.others <> 0 THEN round(sa.others / ss.others, 4) END AS ratio_others FROM sa LEFT JOIN ss ON sa.judge = ss.judge AND sa.domain = ss.domain",
    "scored", "summaries", matches=BASELINE_GROUPS,
)
def spread_ratio(spark, sf_dir):
    """How far ratings of shown baselines spread in the arena and in the rubric, per judge and domain, with and without the reference.

    ratio_others leaves the reference out, as the published figure does.
    """
    spread = lambda b, name, on: b.where(on & F.col("model").isin(*ELIGIBLE)).groupBy("judge", "domain").agg((F.max("rating") - F.min("rating")).alias(name))
    a, s = arena_board(spark, sf_dir, "baseline"), score.leaderboard(score.by_pool(scored(spark, sf_dir), ["baseline"]))
    every, others, on = F.lit(True), F.col("model") != "reference", ["judge", "domain"]
    out = spread(a, "arena", every).join(spread(a, "arena_others", others), on)
    out = out.join(spread(s, "rubric", every), on, "left").join(spread(s, "rubric_others", others), on, "left")
    return out.select(*on, *[F.round(c, 4).alias(c) for c in ("arena", "rubric", "arena_others", "rubric_others")], F.round(F.try_divide("arena", "rubric"), 4).alias("ratio"), F.round(F.try_divide("arena_others", "rubric_others"), 4).alias("ratio_others"))


#: The domains over which ratings are averaged.
DOMAIN_SETS = {"all": DOMAINS, "real_world": MULTI, "research": DOMAINS[:3]}


@query(
    BOARD_SQL + " SELECT judge, z.domains, model, round(avg(rating), 4) AS rating, count(*) AS n_domains FROM b JOIN (VALUES "
    + ", ".join(f"('{name}', '{d}')" for name, held in DOMAIN_SETS.items() for d in held) + ") z(domains, domain) ON z.domain = b.domain GROUP BY judge, z.domains, model",
    "scored", matches=GROUPS,
)
def mean_ratings(spark, sf_dir):
    """Mean rating of every label over each set of domains."""
    rows = arena_board(spark, sf_dir).withColumn("domains", F.explode(F.filter(F.array(*map(F.lit, DOMAIN_SETS)), lambda d: F.array_contains(F.create_map(*[x for k, v in DOMAIN_SETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[d], F.col("domain")))))
    return rows.groupBy("judge", "domains", "model").agg(F.round(F.avg("rating"), 4).alias("rating"), F.count(F.lit(1)).alias("n_domains"))


def _recall_against_arena(spark, sf_dir, domains: str = "all") -> DataFrame:
    board_ = arena_board(spark, sf_dir).where(F.col("domain").isin(*DOMAIN_SETS[domains]))
    return reports.recall_against_arena(score.recall_table(judged_recalls(spark, sf_dir), MULTI, 5, SHOWN), board_)


#: Recall of labels against their mean rating, both ranked.
SHARED = BOARD_SQL + f""", rc AS (SELECT judge, model, avg(hits * 1.0 / total) AS ratio FROM judged_recalls WHERE total IS NOT NULL AND total > 0 AND model <> 'reference' AND domain IN {MULTI} AND split_part(model, ':', 2) IN {SHOWN} GROUP BY judge, model HAVING count(*) >= 5),
    rt AS (SELECT judge, model, avg(rating) AS rating FROM b GROUP BY judge, model), rb AS (SELECT rc.judge, rc.model, ratio, rating FROM rc JOIN rt ON rc.judge = rt.judge AND rc.model = rt.model),
    sh AS (SELECT * FROM rb WHERE model IN (SELECT model FROM rb GROUP BY model HAVING count(*) = (SELECT count(DISTINCT judge) FROM rb)))"""


@query(
    SHARED + """, rk AS (SELECT *, row_number() OVER (PARTITION BY judge ORDER BY ratio DESC, model) AS recall_rank, row_number() OVER (PARTITION BY judge ORDER BY rating DESC, model) AS arena_rank,
    rank() OVER (PARTITION BY judge ORDER BY ratio) + (count(*) OVER (PARTITION BY judge, ratio) - 1) / 2.0 AS x, rank() OVER (PARTITION BY judge ORDER BY rating) + (count(*) OVER (PARTITION BY judge, rating) - 1) / 2.0 AS y FROM sh),
    rho AS (SELECT judge, round(corr(x, y), 6) AS rho FROM rk GROUP BY judge)
    SELECT rk.judge, model, round(ratio, 6) AS ratio, round(rating, 4) AS rating, CAST(recall_rank AS INTEGER) AS recall_rank, CAST(arena_rank AS INTEGER) AS arena_rank, CAST(arena_rank - recall_rank AS INTEGER) AS delta, rho FROM rk JOIN rho ON rho.judge = rk.judge""",
    "scored", "judged_recalls", matches=GROUPS,
)
def recall_rank_delta(spark, sf_dir):
    """Rank by recall, rank by rating, their difference, and the judge's rank correlation, of labels with a row under every judge."""
    rows = settled(reports.under_every_judge(settled(_recall_against_arena(spark, sf_dir), "recalls")), "recalls")
    rho = correlations(rows, ["judge"], "ratio", "rating").select("judge", "rho")
    return rows.join(rho, "judge").select("judge", "model", F.round("ratio", 6).alias("ratio"), F.round("rating", 4).alias("rating"), "recall_rank", "arena_rank", "delta", "rho")


@query()
def recall_anchors(spark, sf_dir):
    """Of profiles in both modes, the one that recall rates furthest above the arena and the one it rates furthest below."""
    return reports.anchors(_recall_against_arena(spark, sf_dir)).groupBy("judge").agg(F.first("headline").alias("headline"), F.first("counter").alias("counter"), F.count(F.lit(1)).alias("n"))


@query()
def recall_trend(spark, sf_dir):
    """Least squares of rating on recall, over profiles in both modes without the headline one; null where too few are left."""
    rows = reports.anchors(_recall_against_arena(spark, sf_dir))
    rating, ratio = (F.when(F.col("profile") != F.col("headline"), F.col(c)) for c in ("rating", "ratio"))
    return rows.groupBy("judge").agg(F.first("headline").alias("outlier"), F.count(rating).alias("n"), F.round(F.regr_slope(rating, ratio), 6).alias("slope"), F.round(F.regr_intercept(rating, ratio), 6).alias("intercept"))
