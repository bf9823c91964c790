"""Queries of rank statistics, tests and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.operators import rankstats, reports, selection
from ratewell.plans.arena_plans import BUCKET, REF, _per_case
from ratewell.plans.score_plans import scored
from ratewell.plans.tables import table, with_sql

Q = {}
SQL = {}


def query(sql: str | None = None, *uses: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_sql(*uses) + sql
        return f

    return add


def means(spark, sf_dir) -> DataFrame:
    """Two scores of each model per domain, rounded so that equal ones are equal in any engine."""
    return scored(spark, sf_dir).groupBy("domain", "model").agg(F.round(F.avg("q_pair"), 6).alias("x"), F.round(F.avg("s_score"), 6).alias("y"))


MEANS = ", m AS (SELECT domain, model, round(avg(q_pair), 6) AS x, round(avg(s_score), 6) AS y FROM summaries GROUP BY domain, model)"
RANKS = ", r AS (SELECT domain, model, x, y, rank() OVER (PARTITION BY domain ORDER BY x) + (count(*) OVER (PARTITION BY domain, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY domain ORDER BY y) + (count(*) OVER (PARTITION BY domain, y) - 1) / 2.0 AS ry FROM m)"


@query(
    "SELECT case_id, model, rank() OVER (PARTITION BY domain ORDER BY s_score) + (count(*) OVER (PARTITION BY domain, s_score) - 1) / 2.0 AS midrank FROM (SELECT "
    "case_id, model, domain, round(s_score, 6) AS s_score FROM summaries) x", "summaries")
def midranks(spark, sf_dir):
    """Mean ranks of all records' scores in their domain."""
    rows = scored(spark, sf_dir).select("case_id", "model", "domain", F.round("s_score", 6).alias("s"))
    return rankstats.midranks(rows, ["domain"], "s", "midrank").select("case_id", "model", "midrank")


@query(MEANS + RANKS + " SELECT domain, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY domain", "summaries")
def spearman(spark, sf_dir):
    """Rank correlation of pair scores and S over models, per domain."""
    return rankstats.correlations(means(spark, sf_dir), ["domain"], "x", "y").select("domain", "n", "rho")


TAU = """, c AS (SELECT domain, x, y, count(*) AS w FROM {points} GROUP BY domain, x, y),
    p AS (SELECT a.domain, sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s, (sum(CASE WHEN a.x = b.x THEN a.w * b.w ELSE 0 END) - sum(CASE WHEN a.x = b.x AND a.y = b.y THEN a.w * b.w ELSE 0 END)) / 2 AS tx,
        (sum(CASE WHEN a.y = b.y THEN a.w * b.w ELSE 0 END) - sum(CASE WHEN a.x = b.x AND a.y = b.y THEN a.w * b.w ELSE 0 END)) / 2 AS ty FROM c a JOIN c b ON a.domain = b.domain GROUP BY a.domain),
    t AS (SELECT domain, sum(w) AS n FROM c GROUP BY domain)
    SELECT p.domain, {n}round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6) AS tau FROM p JOIN t ON p.domain = t.domain"""


@query(MEANS + TAU.format(points="m", n=""), "summaries")
def kendall(spark, sf_dir):
    """Kendall's tau of the same scores."""
    return selection.kendall(means(spark, sf_dir), ["domain"], "x", "y").select("domain", "tau")


RECORDS = ", v AS (SELECT domain, round(q_pair, 6) AS x, round(s_score, 6) AS y FROM summaries)"


@query(RECORDS + TAU.format(points="v", n="CAST(n AS BIGINT) AS n, "), "summaries")
def record_kendall(spark, sf_dir):
    """Kendall's tau of the pair score and S over all records of a domain."""
    rows = scored(spark, sf_dir).select("domain", F.round("q_pair", 6).alias("x"), F.round("s_score", 6).alias("y"))
    return selection.kendall(rows, ["domain"], "x", "y")


def _bucketed(spark, sf_dir) -> DataFrame:
    buckets = reports.with_bucket(table(spark, sf_dir, "cases")).where("bucket IS NOT NULL").select("case_id", "bucket")
    return _per_case(spark, sf_dir).join(buckets, "case_id").select("judge", "bucket", F.round("ref_score", 6).alias("v"))


CASES = f", v AS (SELECT r.judge, c.bucket, round(r.ref_score, 6) AS v FROM ({REF}) r JOIN (SELECT case_id, {BUCKET} AS bucket FROM cases) c ON r.case_id = c.case_id WHERE c.bucket IS NOT NULL)"


@query(
    CASES + """, r AS (SELECT judge, bucket, v, rank() OVER (PARTITION BY judge ORDER BY v) + (count(*) OVER (PARTITION BY judge, v) - 1) / 2.0 AS rk FROM v),
    s AS (SELECT judge, sum(CASE WHEN bucket = 'Accepted' THEN rk ELSE 0 END) AS rs, count(*) FILTER (WHERE bucket = 'Accepted') AS nx, count(*) FILTER (WHERE bucket = 'Rejected') AS ny FROM r GROUP BY judge)
    SELECT judge, nx AS n_first, ny AS n_second, CAST(rs - nx * (nx + 1) / 2.0 AS DOUBLE) AS u FROM s""",
    "scored", "cases",
)
def mann_whitney_u(spark, sf_dir):
    """U of accepted against rejected cases."""
    return rankstats.mann_whitney(_bucketed(spark, sf_dir), ["judge"], "bucket", "Accepted", "Rejected", "v").select("judge", "n_first", "n_second", "u")


@query()
def mann_whitney(spark, sf_dir):
    """U and its p values."""
    found = rankstats.mann_whitney(_bucketed(spark, sf_dir), ["judge"], "bucket", "Accepted", "Rejected", "v")
    return found.select("judge", "n_first", "n_second", "u", *[F.round(p, 6).alias(p) for p in ("p_two_sided", "p_greater", "p_less")])


def _ordered(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "sub").select("domain", (F.col("k") % 3).alias("g"), "q")


@query(
    """, c AS (SELECT domain, k % 3 AS g, q, count(*) AS c FROM sub GROUP BY 1, 2, 3)
    SELECT a.domain, CAST(sum(CASE WHEN a.q < b.q THEN 1.0 WHEN a.q = b.q THEN 0.5 ELSE 0 END * a.c * b.c) AS DOUBLE) AS j FROM c a JOIN c b ON a.domain = b.domain AND a.g < b.g GROUP BY a.domain""",
    "sub",
)
def jonckheere_j(spark, sf_dir):
    """J of quantities over three ordered groups."""
    return rankstats.jonckheere(_ordered(spark, sf_dir), ["domain"], "g", "q").select("domain", "j")


@query()
def jonckheere(spark, sf_dir):
    """J and its p values."""
    return rankstats.jonckheere(_ordered(spark, sf_dir), ["domain"], "g", "q").select("domain", "k", "n", "j", F.round("p_increasing", 6).alias("p_increasing"), F.round("p_two_sided", 6).alias("p_two_sided"))


REPLICATES = 2000
DRAW = "((((42 * 1103515 + b * 12345 + 97) % 1000003 * 1103515 + d * 12345 + 97) % 1000003 * 1103515 + (b + d) * 12345 + 97) % 1000003) % n"
DRAWN = MEANS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY model) - 1 AS place, count(*) OVER (PARTITION BY domain) AS n FROM m), g AS (SELECT DISTINCT domain, n FROM o),
    t AS (SELECT domain, b, {DRAW} AS place FROM g, range({REPLICATES}) x(b), range(100) y(d) WHERE d < n), e AS (SELECT t.domain, t.b, o.x, o.y FROM t JOIN o ON t.domain = o.domain AND t.place = o.place)"""
INTERVAL = " SELECT domain, len(e) AS n_estimates, round(e[CAST(floor(len(e) * 0.025) AS INTEGER) + 1], 6) AS low, round(e[CAST(floor(len(e) * 0.975) AS INTEGER) + 1], 6) AS high FROM (SELECT domain, list(v ORDER BY v) AS e FROM s WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY domain) z"


def _drawn(spark, sf_dir) -> DataFrame:
    rows = means(spark, sf_dir)
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy("model")) - 1)
    draws = rankstats.bootstrap_draws(rows, ["domain"], REPLICATES)
    return draws.join(placed, ["domain", "place"])


@query(DRAWN + ", s AS (SELECT domain, b, median(y) AS v FROM e GROUP BY domain, b)" + INTERVAL, "summaries")
def bootstrap_median(spark, sf_dir):
    """Interval of the median S over models, per domain."""
    estimates = _drawn(spark, sf_dir).groupBy("domain", "replicate").agg(F.percentile("y", 0.5, F.col("times")).alias("v"))
    return rankstats.percentile_interval(estimates, ["domain"], "v")


@query(
    DRAWN + """, k AS (SELECT domain, b, rank() OVER (PARTITION BY domain, b ORDER BY x) + (count(*) OVER (PARTITION BY domain, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY domain, b ORDER BY y) + (count(*) OVER (PARTITION BY domain, b, y) - 1) / 2.0 AS ry FROM e),
    s AS (SELECT domain, b, round(corr(rx, ry), 9) AS v FROM k GROUP BY domain, b)""" + INTERVAL,
    "summaries",
)
def bootstrap_spearman(spark, sf_dir):
    """Interval of the rank correlation, per domain."""
    keys = ["domain", "replicate"]
    ranked = rankstats.drawn_midranks(rankstats.drawn_midranks(_drawn(spark, sf_dir), keys, "x", "rx"), keys, "y", "ry")
    estimates = rankstats.weighted_correlation(ranked, keys, "rx", "ry", "times").withColumn("v", F.round("v", 9))
    return rankstats.percentile_interval(estimates, ["domain"], "v")


UNIT = "(CAST(concat('0x', substr(h, {at}, 13)) AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE"
#: Draws of distinct values: the quantile of a Poisson distribution at a hash, over 30 a rounded normal draw.
TIMES = f"""CASE WHEN c <= 30 THEN len(list_filter(cdf, lambda x: x < {UNIT.format(at=1)}))
    ELSE greatest(0, CAST(floor(c + sqrt(c) * (sqrt(ln({UNIT.format(at=1)}) * -2) * cos({UNIT.format(at=14)} * 6.283185307179586::DOUBLE)) + 0.5) AS BIGINT)) END"""


@query(
    CASES + f""", counts AS MATERIALIZED (SELECT judge, bucket, v, count(*) AS c FROM v GROUP BY judge, bucket, v),
    terms AS (SELECT c, k, exp(k * ln(c) - c - sum(CASE WHEN k > 0 THEN ln(greatest(k, 1)) ELSE 0 END) OVER (PARTITION BY c ORDER BY k)) AS p FROM range(1, 31) a(c), range(0, 91) b(k)),
    cdfs AS MATERIALIZED (SELECT c, list(s ORDER BY k) AS cdf FROM (SELECT c, k, sum(p) OVER (PARTITION BY c ORDER BY k) AS s FROM terms) x GROUP BY c),
    hashed AS (SELECT o.judge, o.bucket, b, o.v, o.c, cdf, md5(concat_ws(':', '42', o.judge, o.bucket, CAST(b AS VARCHAR), CAST(CAST(round(o.v * 1000000) AS BIGINT) AS VARCHAR))) AS h
        FROM counts o LEFT JOIN cdfs f ON o.c = f.c, range({REPLICATES}) x(b)),
    drawn AS (SELECT judge, bucket, b, v, {TIMES} AS w FROM hashed),
    placed AS (SELECT judge, bucket, b, v, sum(w) OVER (PARTITION BY judge, bucket, b ORDER BY v) AS upto, sum(w) OVER (PARTITION BY judge, bucket, b) AS n FROM drawn WHERE w > 0),
    s AS (SELECT judge, bucket, b, (min(v) FILTER (WHERE upto > (n - 1) // 2) + min(v) FILTER (WHERE upto > n // 2)) / 2 AS v FROM placed GROUP BY judge, bucket, b),
    e AS (SELECT judge, bucket, list(v ORDER BY v) AS e FROM s GROUP BY judge, bucket),
    m AS (SELECT judge, bucket, count(*) AS n, round(median(v), 6) AS median FROM v GROUP BY judge, bucket)
    SELECT m.judge, m.bucket, m.n, m.median, round(e[CAST(floor(len(e) * 0.025) AS INTEGER) + 1], 6) AS low, round(e[CAST(floor(len(e) * 0.975) AS INTEGER) + 1], 6) AS high
    FROM m JOIN e ON m.judge = e.judge AND m.bucket = e.bucket""",
    "scored", "cases",
)
def bootstrap_bucket_medians(spark, sf_dir):
    """Median of the reference's case scores by judge and bucket, with its bootstrap interval over cases."""
    keys = ["judge", "bucket"]
    rows = selection.settled(_bucketed(spark, sf_dir), "bucketed")
    middle = selection.medians(rows, keys, ["v"]).select(*keys, F.round("v", 6).alias("median"))
    drawn = selection.resampled(rows, keys, "v", REPLICATES)
    estimates = selection.medians(drawn, [*keys, "replicate"], ["v"], "times")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(middle, keys).join(rankstats.percentile_interval(estimates, keys, "v").drop("n_estimates"), keys, "left")
