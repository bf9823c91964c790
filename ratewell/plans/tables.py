"""Evaluation tables derived from the star schema by whole-number arithmetic, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The six domains in order; the last three take several hypotheses.
DOMAINS = ("biomedical_science", "machine_learning", "social_science", "financial_analysis", "it_operations", "safety_investigation")
MULTI = DOMAINS[3:]
#: The profiles that reports show, and their labels where only one mode and the reference take part. m9 has no results.
SHOWN = ("m1", "m2", "m3", "m4", "m5", "m6", "m9")
ELIGIBLE = ("reference", *(f"baseline:{p}" for p in SHOWN))


def _domain(key: str) -> str:
    return f"CASE {key} % 6 " + " ".join(f"WHEN {k} THEN '{d}'" for k, d in enumerate(DOMAINS)) + " END"


def _case(key: str) -> str:
    return f"concat({_domain(key)}, ':', CAST({key} AS STRING))"


#: A case's domain and name from the order's key, o.
DOMAIN, CASE_ID = _domain("o"), _case("o")
_LEVEL = "CAST(CASE WHEN {d} >= {b} THEN 1.0 WHEN {d} > 0 THEN 0.75 WHEN {d} = 0 THEN 0.5 WHEN {d} <= -{b} THEN 0.0 ELSE 0.25 END AS DOUBLE)"

#: Each table with those before it that it reads. Names in braces are files of the star schema.
SQL = {
    "li": """SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS BIGINT) AS q,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t,
        l_suppkey % 17 AS k FROM {lineitem}""",
    "raw_sub": f"""SELECT o, p, s, n, q, c, d, t, k, {_domain('o')} AS domain, {_case('o')} AS case_id,
        CASE WHEN k = 0 THEN 'reference' WHEN k <= 8 THEN concat('baseline:m', CAST(k AS STRING)) ELSE concat('agent:m', CAST(k - 8 AS STRING)) END AS label FROM li""",
    "sub": """SELECT o, p, s, n, q, c, d, t, k, domain, case_id, label FROM
        (SELECT *, row_number() OVER (PARTITION BY o, k ORDER BY n, p, s, q, c, d, t) AS rn FROM raw_sub) x WHERE rn = 1""",
    "diffs": """SELECT 'j0' AS judge, a.domain AS domain, a.case_id AS case_id, a.o AS o, a.label AS model_a, b.label AS model_b, a.q - b.q AS fd, 25 AS fb, b.c - a.c AS rd, 4000000 AS rb
        FROM sub a JOIN sub b ON a.o = b.o AND a.label < b.label
        UNION ALL SELECT 'j1', a.domain, a.case_id, a.o, a.label, b.label, a.d - b.d, 5, b.t - a.t, 4 FROM sub a JOIN sub b ON a.o = b.o AND a.label < b.label""",
    "matches": f"""SELECT judge, domain, case_id, o, model_a, model_b, {_LEVEL.format(d='fd', b='fb')} AS forward, {_LEVEL.format(d='rd', b='rb')} AS reverse FROM diffs""",
    "scored": """SELECT judge, domain, case_id, o, model_a, model_b, forward, reverse, (forward + (1 - reverse)) / 2 AS score,
        (forward = 0.5 AND reverse = 0.5) OR (forward > 0.5 AND reverse < 0.5) OR (forward < 0.5 AND reverse > 0.5) AS consistent FROM matches""",
    "sides": """SELECT judge, domain, case_id, model_a AS model, score AS own FROM scored UNION ALL SELECT judge, domain, case_id, model_b, 1 - score FROM scored""",
    "cases": f"""SELECT o_orderkey AS o, {_domain('o_orderkey')} AS domain, {_case('o_orderkey')} AS case_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'oral' WHEN '2-HIGH' THEN 'poster' WHEN '3-MEDIUM' THEN 'rejected' WHEN '4-NOT SPECIFIED' THEN 'withdrawn' END AS venue,
        o_orderkey % 7 <> 0 AS context_passed, o_orderkey % 11 <> 0 AS hypothesis_passed, 1 + o_orderkey % 4 AS n_hypotheses FROM {{orders}}""",
    "records": """SELECT domain, 'j0' AS judge, case_id, o, label AS model, o % 6 >= 3 AS multi, CASE WHEN o % 6 >= 3 THEN 1 + o % 3 ELSE 1 END AS k, q, p, s, n,
        CASE s % 7 WHEN 0 THEN NULL WHEN 1 THEN 'n/a' WHEN 2 THEN concat(' ', CAST(p % 4 AS STRING), ' / 3') WHEN 3 THEN concat(CAST(p % 9 AS STRING), '/4') WHEN 4 THEN '2/0'
        ELSE concat(CAST(p % 6 AS STRING), '/5') END AS recall_text FROM sub""",
    "pairs": """SELECT domain, judge, case_id, model, multi, k, i, CAST(1 + (q + i) % 5 AS DOUBLE) AS grounding, CAST(1 + (p + 2 * i) % 5 AS DOUBLE) AS insight, CAST(1 + (s + n + i) % 5 AS DOUBLE) AS justification
        FROM records CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE i < k""",
    "sets": """SELECT domain, judge, case_id, model, CAST(1 + o % 5 AS DOUBLE) AS breadth, CASE WHEN k > 1 THEN CAST(1 + (o + p) % 5 AS DOUBLE) END AS distinctness, CAST(1 + (o + q) % 5 AS DOUBLE) AS utility FROM records WHERE multi""",
    "recalls": """SELECT domain, judge, case_id, model, CASE s % 7 WHEN 2 THEN least(p % 4, 3) WHEN 3 THEN least(p % 9, 4) WHEN 5 THEN least(p % 6, 5) WHEN 6 THEN least(p % 6, 5) END AS hits,
        CASE s % 7 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 5 END AS total FROM records""",
    "judged_recalls": """SELECT domain, judge, case_id, model, hits, total FROM recalls
        UNION ALL SELECT domain, 'j1', case_id, model, CASE WHEN p % 50 = s % 17 THEN least(q % 7, 5) END, CASE WHEN p % 50 = s % 17 THEN 5 END FROM records""",
    "q_pairs": """SELECT domain, judge, case_id, model, avg((grounding + insight + justification) / 3) AS q_pair FROM pairs GROUP BY domain, judge, case_id, model""",
    "q_sets": """SELECT domain, judge, case_id, model, CASE WHEN distinctness IS NULL THEN (breadth + utility) / 2 ELSE (breadth + distinctness + utility) / 3 END AS q_set FROM sets""",
    "summaries": """SELECT q.domain, q.judge, q.case_id, q.model, q.q_pair, z.q_set, CASE WHEN z.q_set IS NULL THEN q.q_pair ELSE (q.q_pair + z.q_set) / 2 END AS s_score
        FROM q_pairs q LEFT JOIN q_sets z ON q.domain = z.domain AND q.judge = z.judge AND q.case_id = z.case_id AND q.model = z.model""",
    "texts": """SELECT doc_id, text FROM {documents}""",
    "hypotheses": f"""SELECT {_domain('l_orderkey')} AS domain, {_case('l_orderkey')} AS case_id, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE p_type END AS category FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "skills": """SELECT DISTINCT domain, case_id, label, n, p % 14 AS skill FROM raw_sub WHERE k > 8 AND n <= 3""",
}

#: Lines that a task of the window and the join takes in, where they are more than the usual tasks share.
TASK_LINES = 1 << 19
#: The same rows as Spark makes them: lines are dealt out once by their order, which serves the window and the join, names
#: are made after that, and both judges and both sides come from one join. names has what names sub's rows, held their part
#: and supplier as well, which the line with the least n, p and s gives alone.
PLANS = {
    "sub": f"""SELECT o, p, s, n, q, c, d, t, k, {_domain('o')} AS domain, {_case('o')} AS case_id,
        CASE WHEN k = 0 THEN 'reference' WHEN k <= 8 THEN concat('baseline:m', CAST(k AS STRING)) ELSE concat('agent:m', CAST(k - 8 AS STRING)) END AS label FROM
        (SELECT *, row_number() OVER (PARTITION BY o, k ORDER BY n, p, s, q, c, d, t) AS rn FROM (SELECT /*+ REPARTITION({{dealt}}o) */ * FROM li) w) x WHERE rn = 1""",
    "names": f"""SELECT o, CASE WHEN k = 0 THEN 'reference' WHEN k <= 8 THEN concat('baseline:m', CAST(k AS STRING)) ELSE concat('agent:m', CAST(k - 8 AS STRING)) END AS label
        FROM (SELECT DISTINCT o, k FROM (SELECT /*+ REPARTITION({{dealt}}o) */ o, k FROM li) w) x""",
    "held": f"""SELECT o, {_case('o')} AS case_id, p, s,
        CASE WHEN k = 0 THEN 'reference' WHEN k <= 8 THEN concat('baseline:m', CAST(k AS STRING)) ELSE concat('agent:m', CAST(k - 8 AS STRING)) END AS label FROM
        (SELECT *, row_number() OVER (PARTITION BY o, k ORDER BY n, p, s) AS rn FROM (SELECT /*+ REPARTITION({{dealt}}o) */ o, k, n, p, s FROM li) w) x WHERE rn = 1""",
    "diffs": """SELECT judge, domain, case_id, o, model_a, model_b, fd, fb, rd, rb FROM (SELECT a.domain AS domain, a.case_id AS case_id, a.o AS o, a.label AS model_a, b.label AS model_b,
        inline(array(struct('j0' AS judge, a.q - b.q AS fd, 25 AS fb, b.c - a.c AS rd, 4000000 AS rb), struct('j1' AS judge, a.d - b.d AS fd, 5 AS fb, b.t - a.t AS rd, 4 AS rb)))
        FROM sub a JOIN sub b ON a.o = b.o AND a.label < b.label) x""",
    "hypotheses": f"""SELECT {_domain('l_orderkey')} AS domain, {_case('l_orderkey')} AS case_id, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_partkey AS p,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE p_type END AS category FROM (SELECT {{dealt_lines}}l_orderkey, l_linenumber, l_partkey FROM {{lineitem}}) l
        JOIN (SELECT {{dealt_parts}}p_partkey, p_type FROM {{part}}) p ON l_partkey = p_partkey""",
    "sides": """SELECT judge, domain, case_id, inline(array(struct(model_a AS model, score AS own), struct(model_b AS model, 1 - score AS own))) FROM scored""",
}


def _needed(name: str, sql: dict[str, str] = SQL) -> list[str]:
    """The table and those it reads, in order."""
    import re

    own = [t for t in sql if t != name and re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", sql[name])]
    found: list[str] = []
    for t in own:
        found += [x for x in _needed(t, sql) if x not in found]
    return [*found, name]


def with_sql(*names: str) -> str:
    """A WITH clause that defines tables and all that they read, for DuckDB."""
    order = [t for t in SQL if t in {x for n in names for x in _needed(n)}]
    files = {f: f for f in ("lineitem", "orders", "part", "documents", "events", "customer", "supplier")}
    return "WITH " + ",\n".join(f"{t} AS ({SQL[t].format(**files)})" for t in order) + "\n"


def tasks_of(spark: SparkSession, sf_dir: str) -> int:
    """So many tasks that none takes in more than TASK_LINES lines, or 0 where the usual number does."""
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // TASK_LINES)  # from the files' footers
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    files = {f: f"parquet.`{sf_dir}/{f}.parquet`" for f in ("lineitem", "orders", "part", "documents", "events", "customer", "supplier")}
    sql = SQL | PLANS
    needed = _needed(name, sql)
    if {"sub", "names", "held", "hypotheses"} & {*needed}:
        parts = tasks_of(spark, sf_dir)
        files["dealt"] = f"{parts}, " if parts else ""
        files |= {f"dealt_{k}": f"/*+ REPARTITION({parts}, {key}) */ " if parts else "" for k, key in (("lines", "l_partkey"), ("parts", "p_partkey"))}
    return spark.sql("WITH " + ",\n".join(f"{t} AS ({sql[t].format(**files)})" for t in needed) + f"\nSELECT * FROM {name}")
