"""Queries that write logs and documents and read them again, and streams over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ratewell.functions.labels import mode_of, profile_of
from ratewell.plans.arena_plans import GROUPS, IN_POOL, KEY, POOL_GROUPS, POOLS_SQL, WLT, board
from ratewell.plans.rating_sql import boards
from ratewell.plans.score_plans import scored as rubric_scored
from ratewell.plans.tables import table, with_sql
from ratewell.sources import logs
from ratewell.streaming import live

Q = {}
SQL = {}
MATCH = StructType([StructField(n, DoubleType() if n in ("forward", "reverse") else StringType()) for n in ("case_id", "model_a", "model_b", "forward", "reverse", "domain", "judge")])


def query(sql: str | None = None, *uses: str, matches: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = (with_sql(*uses) if matches is None else boards(with_sql(*uses), matches)) + sql
        return f

    return add


def _match_log(spark, sf_dir) -> str:
    path = logs.scratch(spark, "matches")
    logs.append(table(spark, sf_dir, "matches").select(*MATCH.names), path)
    return path


@query("SELECT domain, judge, case_id, model_a, model_b, forward, reverse FROM matches", "matches")
def read_strict(spark, sf_dir):
    """The log of matches, written and read with its schema."""
    return logs.read_strict(spark, _match_log(spark, sf_dir), MATCH).select("domain", "judge", "case_id", "model_a", "model_b", "forward", "reverse")


@query("SELECT count(*) FILTER (WHERE o % 10 <> 3) AS good, count(*) FILTER (WHERE o % 10 = 3) AS bad FROM sub", "sub")
def read_tolerant(spark, sf_dir):
    """A log in which each tenth line is cut off: what is read, and what is kept aside."""
    path = logs.scratch(spark, "tolerant")
    line = F.to_json(F.struct("case_id", "label"))
    table(spark, sf_dir, "sub").select(F.when(F.col("o") % 10 == 3, F.expr("left(" + "to_json(struct(case_id, label))" + ", 12)")).otherwise(line).alias("value")).write.text(path)
    good, bad = logs.read_tolerant(spark, path, StructType.fromDDL("case_id string, label string"))
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))  # one row each


@query(
    "SELECT 'cases' AS name, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM cases UNION ALL SELECT 'submissions', count(*), count(DISTINCT case_id) "
    "FROM sub UNION ALL SELECT 'scores', count(*), count(DISTINCT case_id) FROM records", "cases", "sub", "records")
def load_tables(spark, sf_dir):
    """Typed logs of several kinds, all domains in one read each."""
    out = None
    for name, source, ddl in (("cases", "cases", "case_id string, venue string"), ("submissions", "sub", "case_id string, label string"), ("scores", "records", "case_id string, model string")):
        path = logs.scratch(spark, name)
        schema = StructType.fromDDL(ddl)
        logs.append(table(spark, sf_dir, source).select("domain", *schema.names), path, ["domain"])
        one = logs.read_strict(spark, path, schema).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("n_cases")).select(F.lit(name).alias("name"), "n", "n_cases")
        out = one if out is None else out.union(one)
    return out


@query(
    "SELECT label, 'c1' AS config, CASE WHEN label = 'reference' THEN 'reference' ELSE split_part(label, ':', 1) END AS mode, count(*) AS n FROM sub WHERE "
    "label <> 'reference' GROUP BY label", "sub")
def submission_labels(spark, sf_dir):
    """Labels from the names of the files that hold the submissions."""
    path = logs.scratch(spark, "submissions")
    sub = table(spark, sf_dir, "sub").select("case_id", mode_of(F.col("label")).alias("mode"), profile_of(F.col("label")).alias("profile"))
    name = F.when(F.col("mode") == "reference", "reference").otherwise(F.concat(F.lit("c1+"), "profile"))
    sub.withColumn("folder", F.col("mode")).withColumn("file", name).select("case_id", "folder", "file").write.partitionBy("folder", "file").json(path)
    rows = spark.read.schema("case_id string").json(path).select("case_id", "_metadata.file_path")
    plain = rows.select("case_id", F.struct(F.regexp_replace(F.regexp_replace("file_path", "folder=", ""), "file=", "").alias("file_path")).alias("_metadata"))
    return logs.with_file_label(plain).groupBy("label", "config", "mode").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT domain, CASE WHEN o % 2 = 0 THEN 'v1' ELSE 'v1.5' END AS config, concat('judge.', CAST(o % 3 AS STRING)) AS judge FROM cases WHERE o % 7 <> 0", "cases")
def discover_runs(spark, sf_dir):
    """Runs from names whose config and judge both have dots; names of a config alone are none."""
    config = F.when(F.col("o") % 2 == 0, "v1").otherwise("v1.5")
    tail = F.when(F.col("o") % 7 == 0, "").otherwise(F.concat(F.lit(".judge."), (F.col("o") % 3).cast("string")))
    names = table(spark, sf_dir, "cases").select("domain", F.concat(config, tail, F.lit(".arena.jsonl")).alias("name"))
    return logs.discover_runs(names, spark.createDataFrame([("v1",), ("v1.5",), ("v2",)], "config string"), ".arena.jsonl")


@query("SELECT domain, judge, count(*) * 2 AS n FROM matches GROUP BY domain, judge", "matches")
def append_results(spark, sf_dir):
    """A log that the same results are added to twice."""
    path = _match_log(spark, sf_dir)
    logs.append(table(spark, sf_dir, "matches").select(*MATCH.names), path)
    return logs.read_strict(spark, path, MATCH).groupBy("domain", "judge").agg(F.count(F.lit(1)).alias("n"))


KEYS = ["domain", "judge"]


@query()
def leaderboard_document(spark, sf_dir):
    """Leaderboards as one document each, written by domain and judge, read again."""
    path = logs.scratch(spark, "boards")
    made = logs.document(board(spark, sf_dir).withColumn("rating", F.round("rating", 4)), KEYS, ["win", "loss", "tie"])
    made.write.partitionBy(*KEYS).json(path)
    return spark.read.schema(made.schema).json(path).select(*KEYS, "n_models", "n_observations", F.to_json("rankings").alias("rankings"))


@query(", w AS (SELECT domain, judge, model, " + WLT +
    " FROM sides GROUP BY domain, judge, model) SELECT domain, judge, model, CASE WHEN model = 'reference' THEN 'reference' ELSE split_part(model, ':', 1) "
    "END AS mode, win, loss, tie FROM w", "sides")
def leaderboard_rows(spark, sf_dir):
    """Documents back to rows, with the mode of each model."""
    made = logs.document(board(spark, sf_dir), KEYS, ["win", "loss", "tie"])
    return logs.rows_of(made, KEYS).select(*KEYS, "model", mode_of(F.col("model")).alias("mode"), "win", "loss", "tie")


@query(
    """, w AS (SELECT domain, judge, 1 AS version, model, own FROM sides UNION ALL SELECT domain, judge, 2, model, 1 - own FROM sides WHERE judge = 'j0')
    SELECT domain, judge, version, model, """ + WLT + """, count(*) AS n_observations FROM w WHERE version = CASE judge WHEN 'j0' THEN 2 ELSE 1 END GROUP BY domain, judge, version, model""",
    "sides",
)
def leaderboard_store(spark, sf_dir):
    """Leaderboards written as documents in two versions, the second of one judge only and with all results turned, read back from disk.

    What a failed writer left behind, documents without a manifest, is not read.
    """
    store = logs.scratch(spark, "store")
    sides_ = table(spark, sf_dir, "sides")
    for rows in (sides_, sides_.where("judge = 'j0'").withColumn("own", 1 - F.col("own"))):
        counts = rows.groupBy(*KEYS, "model").agg(*[F.sum(on.cast("long")).alias(n) for n, on in (("win", F.col("own") > 0.5), ("loss", F.col("own") < 0.5), ("tie", F.col("own") == 0.5))], F.count(F.lit(1)).alias("n_observations"))
        made = logs.document(counts.withColumns({"rank": F.lit(None).cast("int"), "rating": F.lit(None).cast("double")}), KEYS, ["win", "loss", "tie"])
        logs.put_documents(made, store, KEYS)
    made.write.partitionBy(*KEYS).json(f"{store}/documents/v3-unfinished")
    found = logs.read_documents(spark, store, made.schema, KEYS)
    return logs.rows_of(found, [*KEYS, "version"]).select(*KEYS, "version", "model", "win", "loss", "tie", "n_observations")


#: Rows of a file of a log at most.
FILE_ROWS = 1 << 20


def _write_log(spark, sf_dir, rows: DataFrame, path: str, source: str = "lineitem") -> None:
    """Rows as Parquet files of a log where the tasks made them: no shuffle, and several files for few rows as well."""
    made_of = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()  # from the files' footers
    rows.write.mode("append").option("maxRecordsPerFile", max(1, min(FILE_ROWS, made_of // 8))).parquet(path)


def _stream(spark, sf_dir, most: int = 4):
    """The matches as a log of Parquet files, and the stream of them in a few batches."""
    path = logs.scratch(spark, "log")
    _write_log(spark, sf_dir, table(spark, sf_dir, "matches").select(*MATCH.names), path)
    return path, live.batches(spark, path, MATCH, most)


@query("SELECT domain, judge, model, " + WLT + " FROM sides GROUP BY domain, judge, model", "sides")
def stream_wlt(spark, sf_dir):
    """Wins, losses and ties as a stream keeps them."""
    path, stream = _stream(spark, sf_dir)
    live.running_totals(stream, KEYS, f"{path}-out", f"{path}-checkpoint")
    return live.latest(spark, f"{path}-out", "state")


@query(f" SELECT {KEY}, model, round(rating, 4) AS rating, done AS converged FROM fit_board", "scored", matches=GROUPS)
def stream_leaderboard(spark, sf_dir):
    """Ratings that follow a stream of matches; a batch rates the groups anew that it touches."""
    path, stream = _stream(spark, sf_dir)
    live.follow_arena(stream, KEYS, f"{path}-out", f"{path}-checkpoint")
    return live.latest(spark, f"{path}-out", "board").select(*KEYS, "model", F.round("rating", 4).alias("rating"), "converged")


@query("SELECT domain, judge, model, round(avg(s_score), 6) AS rating, count(*) AS n_observations FROM summaries GROUP BY domain, judge, model", "summaries")
def stream_score_leaderboard(spark, sf_dir):
    """Mean scores that follow a stream of score records."""
    path = logs.scratch(spark, "log")
    rows = rubric_scored(spark, sf_dir).select(*KEYS, "model", "case_id", "s_score")
    _write_log(spark, sf_dir, rows, path)
    live.follow_scores(live.batches(spark, path, rows.schema, 3), KEYS, f"{path}-out", f"{path}-checkpoint")
    return live.latest(spark, f"{path}-out", "board").withColumn("rating", F.round("rating", 6))


@query(
    "SELECT domain, judge, model_a AS model_lo, model_b AS model_hi, sum(CASE WHEN score > 0.5 THEN (score - 0.5) * 2 ELSE 0 END) AS win_lo, sum(CASE WHEN "
    "score < 0.5 THEN (0.5 - score) * 2 ELSE 0 END) AS win_hi, sum(1 - abs(score - 0.5) * 2) AS ties, count(*) AS n FROM scored GROUP BY domain, judge, model_a, "
    "model_b", "scored")
def stream_pair_matrix(spark, sf_dir):
    """The pair matrix that a stream adds up."""
    path, stream = _stream(spark, sf_dir)
    live.follow_arena(stream, KEYS, f"{path}-out", f"{path}-checkpoint")
    return live.latest(spark, f"{path}-out", "total")


@query(
    "SELECT domain, judge, pool, model, " + WLT + f", count(*) AS n_observations FROM (SELECT s.domain, s.judge, z.pool, s.model, s.own FROM (SELECT domain, judge, model_a AS model, model_b AS other, score AS own FROM scored "
    f"UNION ALL SELECT domain, judge, model_b, model_a, 1 - score FROM scored) s CROSS JOIN {POOLS_SQL} z WHERE {IN_POOL.format('s.model')} AND {IN_POOL.format('s.other')}) y GROUP BY domain, judge, pool, model",
    "scored",
)
def stream_pool_standings(spark, sf_dir):
    """Wins, losses and ties on the boards of all pools that a stream's keyed state keeps."""
    return _boards(spark, sf_dir).select(*KEYS, "pool", "model", "win", "loss", "tie", "n_observations")


@query(
    f" SELECT {KEY}, split_part(g, '|', 3) AS pool, model, round(rating, 4) AS rating, rank, round(position_consistency, 6) AS position_consistency FROM fit_board", "scored", matches=POOL_GROUPS,
)
def stream_boards(spark, sf_dir):
    """Ratings and ranks on the same boards."""
    return _boards(spark, sf_dir).select(*KEYS, "pool", "model", F.round("rating", 4).alias("rating"), "rank", F.round("position_consistency", 6).alias("position_consistency"))


def _boards(spark, sf_dir) -> DataFrame:
    path, stream = _stream(spark, sf_dir)
    live.follow_boards(stream, KEYS, f"{path}-out", f"{path}-checkpoint")
    return live.boards(spark, f"{path}-out", KEYS)


def _dedup(spark, sf_dir) -> DataFrame:
    """Each match once, from a log that has all of them in one order and then, in later files, in the other."""
    path = logs.scratch(spark, "log")
    with live.tidy(spark):
        _write_log(spark, sf_dir, table(spark, sf_dir, "matches").select(*MATCH.names), path)
        first = spark.read.schema(MATCH).parquet(path)
        turned = first.withColumns({"model_a": F.col("model_b"), "model_b": F.col("model_a")}).select(*MATCH.names)
        _write_log(spark, sf_dir, turned, path)
    live.once(live.batches(spark, path, MATCH, 2), ["judge", "case_id"], f"{path}-out", f"{path}-checkpoint")
    return live.kept(spark, f"{path}-out").select("judge", "case_id", F.least("model_a", "model_b").alias("model_lo"), F.greatest("model_a", "model_b").alias("model_hi"))


@query("SELECT judge, case_id, model_a AS model_lo, model_b AS model_hi FROM matches", "matches")
def stream_dedup(spark, sf_dir):
    """A log that has every comparison in both orders, each kept once."""
    return _dedup(spark, sf_dir)


def _dated(spark, sf_dir, slices: int = 4):
    """Parts of a log in order of time, every comparison in both orders; of a third of the cases the second comes ten days later."""
    made, day = logs.scratch(spark, "dated"), 86_400
    at = F.col("o") * 977 % (30 * day) + F.lit(1_700_000_000)
    m = table(spark, sf_dir, "matches").select(*MATCH.names, at.alias("at"), (F.col("o") % 3 == 0).alias("late"))
    with live.tidy(spark):
        _write_log(spark, sf_dir, m, made)  # made once; the parts are read from it
    m = spark.read.schema(m.schema).parquet(made)
    turned = m.withColumns({"model_a": F.col("model_b"), "model_b": F.col("model_a"), "at": F.col("at") + F.when(F.col("late"), 10 * day).otherwise(60)})
    both = m.unionByName(turned).withColumn("created_at", F.timestamp_seconds("at"))
    ends = both.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    for k in range(slices):
        low, high = (ends["low"] + (ends["high"] + 1 - ends["low"]) * x // slices for x in (k, k + 1))
        yield both.where((F.col("at") >= low) & (F.col("at") < high)).drop("at", "late")


@query("SELECT judge, case_id, model_a AS model_lo, model_b AS model_hi FROM matches", "matches")
def stream_dedup_within(spark, sf_dir):
    """The same from a log with times, remembering two days; repeats after ten days are found in what was kept."""
    path = logs.scratch(spark, "log")
    for part in _dated(spark, sf_dir):  # the log grows, and the stream goes on from its checkpoint with all that is new
        with live.tidy(spark):
            _write_log(spark, sf_dir, part, path)
        live.once_within(live.batches(spark, path, part.schema, 1), ["judge", "case_id"], "created_at", "2 days", f"{path}-out", f"{path}-checkpoint")
    return live.kept(spark, f"{path}-out").select("judge", "case_id", F.least("model_a", "model_b").alias("model_lo"), F.greatest("model_a", "model_b").alias("model_hi"))


def _pending(spark, sf_dir):
    """Pairs from a log of all submissions in two batches, each with some of the labels."""
    made, path = logs.scratch(spark, "made"), logs.scratch(spark, "log")
    sub = table(spark, sf_dir, "sub").select("case_id", "label")
    _write_log(spark, sf_dir, sub, made)
    sub = spark.read.schema(sub.schema).parquet(made)
    for half in range(2):
        _write_log(spark, sf_dir, sub.where(F.pmod(F.xxhash64("label"), F.lit(2)) == half), path)
        live.new_pairs(live.batches(spark, path, sub.schema, 1), f"{path}-seen", f"{path}-out", f"{path}-checkpoint")
    return spark.read.parquet(f"{path}-out").select("case_id", "model_a", "model_b")


@query("SELECT a.case_id, a.label AS model_a, b.label AS model_b FROM sub a JOIN sub b ON a.case_id = b.case_id AND a.label < b.label", "sub")
def stream_pending(spark, sf_dir):
    """Pairs as submissions arrive, file by file."""
    return _pending(spark, sf_dir)
