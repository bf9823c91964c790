"""Queries that curate the benchmark and report on skills, tokens and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.functions.labels import mode_of
from ratewell.operators import curation, skills
from ratewell.plans.tables import DOMAINS, MULTI, table, tasks_of, with_sql

Q = {}
SQL = {}


def query(sql: str | None = None, *uses: str):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_sql(*uses) + sql
        return f

    return add


TRACKS = {d: "real" if d in MULTI else "research" for d in DOMAINS}
TRACK = "CASE WHEN domain IN " + str(MULTI) + " THEN 'real' ELSE 'research' END"


def nested(spark, sf_dir) -> DataFrame:
    """Cases with their hypotheses and metadata."""
    h = table(spark, sf_dir, "hypotheses")
    if parts := tasks_of(spark, sf_dir):
        h = h.repartition(parts, "o")  # serves the aggregate as well
    item = F.struct("n", "p", F.col("category"), F.concat(F.lit("part "), F.col("p").cast("string")).alias("hypothesis"), F.lit("line").alias("evidence"))
    grouped = h.groupBy("case_id", "domain", "o").agg(F.array_sort(F.collect_list(item)).alias("hypotheses"))
    meta = F.create_map(F.lit("report_id"), (F.col("o") % 50).cast("string"), F.lit("agency"), F.concat(F.lit("a"), (F.col("o") % 3).cast("string")))
    return grouped.withColumn("metadata", meta).withColumn("context", F.concat(F.lit("case "), "case_id"))


def allowed(spark, sf_dir) -> DataFrame:
    """The categories of each domain: names that begin with some letters, for four domains."""
    used = table(spark, sf_dir, "hypotheses").where("category IS NOT NULL").select("domain", "category").distinct()
    return used.where(F.col("domain").isin(*DOMAINS[2:]) & (F.length("category") % 2 == 0))


ALLOWED = ", allowed AS (SELECT DISTINCT domain, category FROM hypotheses WHERE category IS NOT NULL AND length(category) % 2 = 0 AND domain IN " + str(DOMAINS[2:]) + "), tail AS (SELECT h.domain, h.category, count(*) AS n FROM hypotheses h WHERE category IS NOT NULL AND h.domain IN (SELECT domain FROM allowed) AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.domain = h.domain AND a.category = h.category) GROUP BY h.domain, h.category), firsts AS (SELECT domain, min(category) AS canonical FROM allowed GROUP BY domain), remap AS (SELECT t.domain, t.category, CASE WHEN length(t.category) % 3 = 0 THEN 'no such' ELSE f.canonical END AS canonical FROM tail t JOIN firsts f ON t.domain = f.domain WHERE length(t.category) <> 5)"


def _remap(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    may = allowed(spark, sf_dir)
    tail = curation.long_tail(table(spark, sf_dir, "hypotheses"), may)
    first = may.groupBy("domain").agg(F.min("category").alias("canonical"))
    target = F.when(F.length("category") % 3 == 0, "no such").otherwise(F.col("canonical"))
    return may, tail, tail.join(first, "domain").where(F.length("category") != 5).select("domain", "category", target.alias("canonical"))


@query(
    f""", c AS (SELECT {TRACK} AS track, domain, case_id, count(*) AS h, count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END) AS c FROM hypotheses GROUP BY 1, 2, 3)
    SELECT coalesce(track, 'all') AS track, coalesce(domain, 'all') AS domain, count(*) AS n_cases, CAST(sum(h) AS BIGINT) AS n_hypotheses, round(avg(h), 6) AS mean_hypotheses, round(avg(c), 6) AS mean_categories FROM c GROUP BY ROLLUP (track, domain)""",
    "hypotheses",
)
def dataset_stats(spark, sf_dir):
    """Sizes of the benchmark by domain and track."""
    return curation.dataset_stats(nested(spark, sf_dir), TRACKS).withColumn("mean_hypotheses", F.round("mean_hypotheses", 6)).withColumn("mean_categories", F.round("mean_categories", 6))


@query(ALLOWED + " SELECT domain, category, n FROM tail", "hypotheses")
def category_longtail(spark, sf_dir):
    """Categories in use that are not allowed."""
    return curation.long_tail(table(spark, sf_dir, "hypotheses"), allowed(spark, sf_dir))


@query(
    ALLOWED + """ SELECT t.domain, CAST(sum(CASE WHEN a.category IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN r.canonical IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
    CAST(sum(CASE WHEN r.canonical IS NOT NULL AND a.category IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS invalid FROM tail t LEFT JOIN remap r ON t.domain = r.domain AND t.category = r.category
    LEFT JOIN allowed a ON a.domain = r.domain AND a.category = r.canonical GROUP BY t.domain""",
    "hypotheses",
)
def remap_coverage(spark, sf_dir):
    """How much of the long tail has a valid mapping."""
    may, tail, remap = _remap(spark, sf_dir)
    return curation.remap_coverage(tail, remap, may)


@query(ALLOWED +
    " SELECT h.case_id, h.n, h.p, coalesce(CASE WHEN a.category IS NOT NULL THEN r.canonical END, h.category) AS category FROM hypotheses h LEFT JOIN remap "
    "r ON h.domain = r.domain AND h.category = r.category LEFT JOIN allowed a ON a.domain = r.domain AND a.category = r.canonical", "hypotheses")
def apply_remap(spark, sf_dir):
    """Hypotheses with mapped categories."""
    may, _, remap = _remap(spark, sf_dir)
    done = curation.apply_remap(nested(spark, sf_dir), remap, may)
    return done.select("case_id", F.explode("hypotheses").alias("h")).select("case_id", "h.n", "h.p", "h.category")


@query(ALLOWED +
    " SELECT h.domain, CAST(sum(CASE WHEN a.category IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(DISTINCT CASE WHEN a.category IS NOT NULL "
    "THEN h.case_id END) AS cases FROM hypotheses h LEFT JOIN remap r ON h.domain = r.domain AND h.category = r.category LEFT JOIN allowed a ON a.domain = "
    "r.domain AND a.category = r.canonical GROUP BY h.domain", "hypotheses")
def remap_counts(spark, sf_dir):
    """Hypotheses that a mapping changes, and their cases."""
    may, _, remap = _remap(spark, sf_dir)
    done = curation.apply_remap(nested(spark, sf_dir), remap, may)
    return done.groupBy("domain").agg(F.sum("n_changed").cast("long").alias("changed"), F.count(F.when(F.col("n_changed") > 0, 1)).alias("cases"))


def _fingerprints(spark, sf_dir) -> DataFrame:
    """One for every eleventh case by id, and one by agency and number for every safety report number."""
    cases = table(spark, sf_dir, "cases")
    one = cases.where("o % 11 = 0").select(F.concat(F.lit("id "), "case_id").alias("fp"), F.create_map(F.lit("id"), F.col("case_id")).alias("keys"))
    number, agency = (F.col("o") % 50).cast("string"), F.concat(F.lit("a"), (F.col("o") % 3).cast("string"))
    many = cases.where("domain = 'safety_investigation'").select(F.concat_ws(" ", F.lit("report"), agency, number).alias("fp"), agency.alias("agency"), number.alias("number")).distinct()
    keys = F.create_map(F.lit("domain"), F.lit("safety_investigation"), F.lit("source"), F.col("agency"), F.lit("case_id"), F.col("number"))
    return one.union(many.select("fp", keys))


FOUND = ", fp AS (SELECT concat('id ', case_id) AS fp, case_id FROM cases WHERE o % 11 = 0 UNION ALL SELECT concat('report a', CAST(o % 3 AS STRING), ' ', CAST(o % 50 AS STRING)), case_id FROM cases WHERE domain = 'safety_investigation'), held AS (SELECT DISTINCT case_id FROM hypotheses), found AS (SELECT fp.fp, fp.case_id FROM fp JOIN held ON fp.case_id = held.case_id)"


@query(FOUND + " SELECT fp, case_id FROM found", "cases", "hypotheses")
def resolve_fingerprints(spark, sf_dir):
    """The cases that each fingerprint names."""
    return curation.resolve_fingerprints(_fingerprints(spark, sf_dir), nested(spark, sf_dir))


@query(FOUND +
    " SELECT f.fp, count(DISTINCT x.case_id) AS hits, CASE count(DISTINCT x.case_id) WHEN 1 THEN 'ok' WHEN 0 THEN 'missed' ELSE 'ambiguous' END AS state FROM "
    "(SELECT DISTINCT fp FROM fp) f LEFT JOIN found x ON f.fp = x.fp GROUP BY f.fp", "cases", "hypotheses")
def fingerprint_audit(spark, sf_dir):
    """Whether each fingerprint names one case."""
    fps = _fingerprints(spark, sf_dir)
    return curation.audit(fps, curation.resolve_fingerprints(fps, nested(spark, sf_dir)))


@query(
    """, bad AS (SELECT DISTINCT case_id FROM cases WHERE o % 11 = 0), t AS (SELECT 'cases' AS "table", case_id FROM cases UNION ALL SELECT 'submissions', case_id FROM sub UNION ALL SELECT 'matches', case_id FROM matches UNION ALL SELECT 'scores', case_id FROM records)
    SELECT t."table" AS "table", count(*) FILTER (WHERE bad.case_id IS NULL) AS kept, count(bad.case_id) AS dropped FROM t LEFT JOIN bad ON t.case_id = bad.case_id GROUP BY t."table" """,
    "cases", "sub", "matches", "records",
)
def prune_cascade(spark, sf_dir):
    """Rows that go with bad cases, table by table."""
    tables = {"cases": "cases", "submissions": "sub", "matches": "matches", "scores": "records"}
    bad = table(spark, sf_dir, "cases").where("o % 11 = 0").select("case_id")
    return curation.pruned_counts({k: table(spark, sf_dir, v) for k, v in tables.items()}, bad)


@query(
    "SELECT case_id AS id, domain, CASE WHEN domain = 'safety_investigation' THEN concat('a', CAST(o % 3 AS STRING)) END AS source, CASE WHEN domain IN ('it_operations', 'safety_investigation') THEN CAST(o % 50 AS STRING) END AS title, concat('case ', case_id) AS context, count(*) AS n_hypotheses, count(category) AS n_categories FROM hypotheses GROUP BY case_id, domain, o",
    "hypotheses",
)
def release_dataset(spark, sf_dir):
    """The published form of every case."""
    found = curation.release(nested(spark, sf_dir))
    return found.select("id", "domain", F.col("metadata")["source"].alias("source"), F.col("metadata")["title"].alias("title"), "context", F.size("hypotheses").cast("long").alias("n_hypotheses"), F.size(F.filter("hypotheses", lambda h: h["category"].isNotNull())).cast("long").alias("n_categories"))


NAMES = [f"s{i:02d}" for i in range(12)]


def used(spark, sf_dir) -> DataFrame:
    """Known skills of each agent submission, in line order."""
    name = F.concat(F.lit("s"), F.lpad(F.col("skill").cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "skills").where("skill < 12").groupBy("domain", "case_id", "label").agg(F.array_sort(F.collect_list(F.struct("n", name.alias("skill")))).alias("e"))
    return rows.select("domain", "case_id", "label", F.transform("e", lambda x: x["skill"]).alias("skills"))


def _names(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in [*NAMES, "s99"]], "skill string")


KNOWN = ", k AS (SELECT domain, case_id, label, n, concat('s', lpad(CAST(skill AS STRING), 2, '0')) AS skill FROM skills WHERE skill < 12), names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in [*NAMES, "s99"]) + "]) AS skill)"


@query(
    KNOWN + """, u AS (SELECT skill, count(*) AS uses, count(DISTINCT concat(case_id, label)) AS submissions FROM k GROUP BY skill), w AS (SELECT count(*) AS uses, count(DISTINCT concat(case_id, label)) AS submissions FROM k)
    SELECT n.skill, coalesce(u.uses, 0) AS uses, round(coalesce(u.uses, 0) / w.uses, 6) AS use_share, coalesce(u.submissions, 0) AS submissions, round(coalesce(u.submissions, 0) / w.submissions, 6) AS submission_share FROM names n LEFT JOIN u ON n.skill = u.skill CROSS JOIN w""",
    "skills",
)
def skill_totals(spark, sf_dir):
    """How often each skill is used; one is never picked."""
    return skills.totals(used(spark, sf_dir), _names(spark)).withColumn("use_share", F.round("use_share", 6)).withColumn("submission_share", F.round("submission_share", 6))


@query(KNOWN + ", s AS (SELECT case_id, label, count(*) AS length FROM k GROUP BY case_id, label) SELECT length, count(*) AS n FROM s GROUP BY length", "skills")
def skill_lengths(spark, sf_dir):
    """Submissions by the number of skills."""
    return skills.lengths(used(spark, sf_dir))


@query(KNOWN + " SELECT skill, " + ", ".join(f"round(count(*) FILTER (WHERE domain = '{d}') / nullif((SELECT count(*) FROM k WHERE domain = '{d}'), 0), 6) AS {d}" for d in DOMAINS) + " FROM k GROUP BY skill", "skills")
def skill_domain_matrix(spark, sf_dir):
    """Each skill's share of a domain's uses."""
    wide = skills.shares(used(spark, sf_dir), "domain", DOMAINS)
    return wide.select("skill", *[F.coalesce(d, F.lit(0.0)).alias(d) for d in DOMAINS])


PROFILES = [f"agent:m{i}" for i in range(1, 9)]


@query(KNOWN + " SELECT skill, " + ", ".join(f"coalesce(round(count(*) FILTER (WHERE label = '{p}') / nullif((SELECT count(*) FROM k WHERE label = '{p}'), 0), 6), 0) AS {p.replace('agent:', '')}" for p in PROFILES) + " FROM k GROUP BY skill", "skills")
def skill_profile_matrix(spark, sf_dir):
    """Each skill's share of a profile's uses."""
    wide = skills.shares(used(spark, sf_dir), "label", PROFILES)
    return wide.select("skill", *[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(p.replace("agent:", "")) for p in PROFILES])


@query(KNOWN +
    ", d AS (SELECT DISTINCT case_id, label, skill FROM k) SELECT a.skill AS first, b.skill AS second, count(*) AS n FROM d a JOIN d b ON a.case_id = b.case_id "
    "AND a.label = b.label AND a.skill < b.skill GROUP BY 1, 2 ORDER BY n DESC, first, second LIMIT 20", "skills")
def skill_pairs(spark, sf_dir):
    """The most frequent pairs of skills."""
    return skills.top(skills.together(used(spark, sf_dir), 2), 20)


@query(KNOWN +
    ", d AS (SELECT DISTINCT case_id, label, skill FROM k) SELECT a.skill AS first, b.skill AS second, c.skill AS third, count(*) AS n FROM d a JOIN d b ON "
    "a.case_id = b.case_id AND a.label = b.label AND a.skill < b.skill JOIN d c ON a.case_id = c.case_id AND a.label = c.label AND b.skill < c.skill GROUP "
    "BY 1, 2, 3 ORDER BY n DESC, first, second, third LIMIT 20", "skills")
def skill_triples(spark, sf_dir):
    """The most frequent triples of skills."""
    return skills.top(skills.together(used(spark, sf_dir), 3), 20)


@query(
    "SELECT domain, CASE WHEN label = 'reference' THEN 'reference' ELSE split_part(label, ':', 1) END AS mode, CAST(sum(n) AS BIGINT) AS cached_tokens, CAST(sum(q) "
    "AS BIGINT) AS input_tokens, CAST(sum(p) AS BIGINT) AS output_tokens, CAST(sum(d) AS BIGINT) AS reasoning_tokens, count(*) AS requests, CAST(sum(q) + sum(p) "
    "AS BIGINT) AS total_tokens FROM sub GROUP BY 1, 2", "sub")
def token_totals(spark, sf_dir):
    """Tokens spent per domain and mode."""
    tokens = F.struct(F.col("n").alias("cached_tokens"), F.col("q").alias("input_tokens"), F.col("p").alias("output_tokens"), F.col("d").alias("reasoning_tokens"), F.lit(1).cast("long").alias("requests"))
    return skills.token_totals(table(spark, sf_dir, "sub").select("domain", mode_of(F.col("label")).alias("mode"), tokens.alias("tokens")), ["domain", "mode"])


@query(
    """, c AS (SELECT domain, count(*) AS sources, count(*) FILTER (WHERE context_passed AND hypothesis_passed) AS cases FROM cases GROUP BY domain), s AS (SELECT domain, count(*) FILTER (WHERE label <> 'reference') AS submissions, count(*) AS scores FROM sub GROUP BY domain),
    m AS (SELECT domain, count(*) FILTER (WHERE judge = 'j0') AS matches FROM matches GROUP BY domain)
    SELECT coalesce(c.domain, 'all') AS domain, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(submissions) AS BIGINT) AS submissions, CAST(sum(sources) * 16 AS BIGINT) AS most_submissions, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(sources) * 136 AS BIGINT) AS most_matches, CAST(sum(scores) AS BIGINT) AS scores, CAST(sum(sources) * 17 AS BIGINT) AS most_scores
    FROM c JOIN s ON c.domain = s.domain JOIN m ON c.domain = m.domain GROUP BY ROLLUP (c.domain)""",
    "cases", "sub", "matches",
)
def progress_report(spark, sf_dir):
    """What is done of what sixteen profiles and modes and the reference could give, per domain and in all."""
    t = lambda n: table(spark, sf_dir, n)
    c = t("cases").groupBy("domain").agg(F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("context_passed") & F.col("hypothesis_passed"), 1)).alias("cases"))
    s = t("sub").groupBy("domain").agg(F.count(F.when(F.col("label") != "reference", 1)).alias("submissions"), F.count(F.lit(1)).alias("scores"))
    m = t("matches").where("judge = 'j0'").groupBy("domain").agg(F.count(F.lit(1)).alias("matches"))
    labels = 16 + 1
    out = c.join(s, "domain").join(m, "domain").rollup("domain").agg(*[F.sum(x).alias(x) for x in ("sources", "cases", "submissions", "matches", "scores")])
    ceiling = {"most_submissions": labels - 1, "most_matches": labels * (labels - 1) // 2, "most_scores": labels}
    return out.withColumns({k: F.col("sources") * v for k, v in ceiling.items()}).withColumn("domain", F.coalesce("domain", F.lit("all")))
