"""What a query writes, shuffles and gives to one task stays small beside its input."""

from __future__ import annotations

import glob
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def test_logs_are_compressed(spark):
    from ratewell.sources import logs

    path = tempfile.mkdtemp(prefix="spark-tests-") + "/log"
    rows = spark.range(5000).select(F.lit("d").alias("domain"), F.lit("j").alias("judge"), F.concat(F.lit("case:"), F.col("id").cast("string")).alias("case_id"))
    for _ in range(2):
        logs.append(rows, path)
    files = glob.glob(f"{path}/*/*/part-*")
    assert files and all(f.endswith(".json.gz") for f in files) and sum(map(os.path.getsize, files)) < 100_000
    assert logs.read_strict(spark, path, StructType.fromDDL("case_id string, domain string, judge string")).count() == 10_000


def test_matches_come_from_one_shuffle_of_lines(spark, small):
    from ratewell.plans.tables import table

    plan = table(spark, small, "sides")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # both sides of one join, which are one exchange
    assert "Union" not in plan


def test_a_log_has_files_and_few_batches(spark, small):
    from ratewell.plans import log_plans
    from ratewell.streaming import live

    path, stream = log_plans._stream(spark, small)
    assert len(spark.read.parquet(path).inputFiles()) > 4  # files are cut by rows, however few tasks make them
    numbers = []
    live.run(stream, f"{path}-checkpoint", lambda df, n: numbers.append(n))
    assert numbers == [0, 1, 2, 3]


def test_a_mean_makes_its_values_once(spark):
    from ratewell.functions import rubric

    plan = spark.range(1).select(rubric._mean(F.transform(F.array(F.col("id").cast("double")), lambda x: x + 12345.5)).alias("m"))
    assert plan._jdf.queryExecution().analyzed().toString().count("12345.5") == 1
    kept = spark.createDataFrame([([1.0, 2.0],), ([],), (None,)], "v array<double>").select(rubric._mean(F.col("v")).alias("m"))
    assert [r["m"] for r in kept.collect()] == [1.5, None, None]


def _log_of(spark, run) -> str:
    """The folder of the log that a query makes."""
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    run()
    (found,) = [d for d in set(os.listdir(base)) - before if d.startswith("ratewell-log-") and d.count("-") == 2]
    return f"{base}/{found}"


def test_a_dated_log_is_made_by_many_tasks_and_its_state_lies_on_disk(spark, small):
    from ratewell.plans import registry

    kind = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(kind)
    path = _log_of(spark, lambda: registry.queries()["stream_dedup_within"](spark, small))
    assert len(glob.glob(f"{path}/part-*")) > 4  # before: a file of one task for each of four parts
    assert "RocksDB" in spark.conf.get(kind)


def test_pairs_of_a_large_batch_are_dealt_to_more_tasks(spark, monkeypatch):
    """Tasks take in a bounded number of rows, and repeats inside and across batches give no pair twice."""
    from ratewell.streaming import live

    monkeypatch.setattr(live, "TASK_ROWS", 16)
    base = tempfile.mkdtemp(prefix="spark-tests-")
    rows = [[(f"c{i}", label) for i in range(120) for label in labels] for labels in ("aabc", "adeb")]
    for part in rows:
        df = spark.createDataFrame(part, "case_id string, label string")
        df.coalesce(1).write.mode("append").parquet(f"{base}/log")
        live.new_pairs(live.read_log(spark, f"{base}/log", df.schema), f"{base}/seen", f"{base}/out", f"{base}/checkpoint")
    got = sorted(map(tuple, spark.read.parquet(f"{base}/out").select("case_id", "model_a", "model_b").collect()))
    assert got == sorted((f"c{i}", a, b) for i in range(120) for a in "abcde" for b in "abcde" if a < b)
    assert len(glob.glob(f"{base}/out/batch=1/part-*")) > 8  # the session's shuffle partitions


def test_a_task_sums_its_matches_before_they_are_shuffled(spark, small):
    """Boards get a row per pair of models and task, however many Arrow batches a task reads."""
    from ratewell.operators import arena
    from ratewell.plans.tables import table
    from ratewell.streaming import live

    keys, size = ["domain", "judge"], "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = arena.pair_rows(arena.with_scores(table(spark, small, "matches")), keys).select(*keys, "model_lo", "model_hi", *live._SUMS).coalesce(1)
    spark.conf.set(size, 100)
    try:
        got = sorted(map(tuple, rows.mapInArrow(live._pair_sums(keys), rows.schema).collect()))
    finally:
        spark.conf.unset(size)
    want = sorted(map(tuple, rows.groupBy(*keys, "model_lo", "model_hi").agg(*[F.sum(c) for c in live._SUMS]).collect()))
    assert got == want and len(got) < rows.count() / 4


def test_missing_labels_come_without_a_join_of_cases_and_labels(spark):
    from ratewell.operators import worklist

    cases = spark.createDataFrame([(f"c{i}", i) for i in range(20)], "case_id string, x int")
    registry = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    done = spark.createDataFrame([(f"c{i}", "abz"[k]) for i in range(15) for k in range(1 + i % 3)] * 2 + [(None, "a"), ("c1", None)], "case_id string, label string")
    held = {(r["case_id"], r["label"]) for r in done.collect()}
    want = sorted((f"c{i}", i, x) for i in range(20) for x in "abc" if (f"c{i}", x) not in held)
    for most in (10, 2):  # the second takes the registry as large
        assert sorted(map(tuple, worklist.missing(cases, registry, done, most).select("case_id", "x", "label").collect())) == want


def test_remapped_cases_are_dealt_by_case_in_bounded_tasks(spark, small, monkeypatch):
    from ratewell.plans import registry, tables

    run = registry.queries()["apply_remap"]
    want = sorted(map(str, run(spark, small).collect()))
    monkeypatch.setattr(tables, "TASK_LINES", 500)  # 12 tasks of 6,000 lines, more than the session's 8
    made = run(spark, small)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [o") == 1 and "rightHint=(strategy=broadcast)" in plan
    assert sorted(map(str, made.collect())) == want


def test_requests_shuffle_cases_and_no_pairs_or_texts(spark, small):
    from ratewell.plans import registry

    plan = registry.queries()["arena_requests"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert " Join Inner" not in plan  # pairs are made inside rows of cases
    assert plan.split("Join LeftOuter")[0].count("RepartitionByExpression") == 0  # nothing is shuffled once texts are there
    assert "length(prompt" not in plan and plan.count("length(") == 2  # of contexts and blocks


def test_meetings_give_all_pairs_of_hot_cases_and_mark_those_compared(spark, monkeypatch):
    """Cases with more labels than a row takes, log entries in either order, twice, of other labels and cases, and nulls."""
    from ratewell.operators import worklist

    monkeypatch.setattr(worklist, "ROW_LABELS", 4)
    labels = {"hot": [f"m{i:02}" for i in range(23)], "edge": list("abcd"), "one": ["a"], "two": ["b", "a"]}
    gathered = spark.createDataFrame([(c, x, f"{c}-{x}") for c, xs in labels.items() for x in xs] + [(None, "a", "x"), (None, "b", "x")], "case_id string, label string, block string")
    log = [("hot", "m03", "m01"), ("hot", "m01", "m03"), ("hot", "m20", "m22"), ("hot", "m00", "zz"), ("edge", "a", "b"), ("gone", "a", "b"), ("two", "a", "c"), ("two", None, "a"), (None, "a", "b")]
    done = spark.createDataFrame(log, "case_id string, model_a string, model_b string")
    known = {(c, *sorted(x)) for c, *x in log if None not in x}
    want = sorted((c, a, b, f"{c}-{a}", f"{c}-{b}", (c, a, b) in known) for c, xs in labels.items() for a in xs for b in xs if a < b)
    rows = worklist.meetings(gathered, done)
    assert rows.selectExpr("max(size(labels))").first()[0] < 23
    got = worklist.opened(rows).selectExpr("case_id", "a.label", "b.label", "a.block", "b.block", "compared").collect()
    assert sorted(map(tuple, got)) == want
    left = worklist.compared_pairs(gathered, done).collect()
    assert sorted(map(tuple, left)) == sorted(r[:3] for r in want if r[5])


def test_pending_report_counts_without_making_pairs(spark, small):
    from ratewell.plans import registry

    plan = registry.queries()["pending_report"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 2 and plan.count("Join LeftSemi") == 3  # scores and cases; both labels of compared pairs, labels met
    assert "row_number" not in plan  # submissions by name, without their values


def test_missing_counts_are_those_of_missing(spark):
    from ratewell.operators import worklist

    cases = spark.createDataFrame([(f"c{i}",) for i in range(20)], "case_id string")
    registry = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    done = spark.createDataFrame([(f"c{i}", "abcz"[k]) for i in range(15) for k in range(1 + i % 4)] * 2 + [(None, "a"), ("c1", None)], "case_id string, label string")
    want = {r["case_id"]: r["count"] for r in worklist.missing(cases, registry, done).groupBy("case_id").count().collect()}
    assert {r["case_id"]: r["n"] for r in worklist.missing_counts(cases, registry, done).collect()} == want


def test_blocks_of_any_number_of_hypotheses_have_one_form(spark):
    from ratewell.operators import worklist

    item = "struct<category:string,hypothesis:string,evidence:string>"
    rows = spark.createDataFrame([(n, [(("x", "", None)[k % 3], f"h{k}", f"e{k}") for k in range(n)]) for n in range(5)] + [(9, None)], f"n int, h array<{item}>")
    line = lambda k: f"{k + 1}. {('[x] ', '', '')[k % 3]}h{k}\nEvidence: e{k}"
    got = {r["n"]: r["b"] for r in rows.select("n", worklist.block(F.col("h")).alias("b")).collect()}
    assert got == {n: "\n".join(map(line, range(n))) or worklist.NO_HYPOTHESES for n in range(5)} | {9: worklist.NO_HYPOTHESES}


def test_shuffle_files_and_old_versions_of_state_go(spark):
    """A stream's batches leave no shuffle files behind, and of what a restart reads the last versions stay; settings are put back."""
    import time

    from ratewell.streaming import live

    base, how = tempfile.mkdtemp(prefix="spark-tests-"), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.streaming.minBatchesToRetain", "spark.sql.parquet.compression.codec")
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*")}
    before, settings = shuffled(), [spark.conf.get(k, None) for k in how]
    for k in range(3):
        rows = [("j", f"c{i}", *("ab" if k % 2 else "ba"), k * 300_000) for i in range(k * 50 + 100)]
        df = spark.createDataFrame(rows, "judge string, case_id string, model_a string, model_b string, s long").withColumn("created_at", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/log")
        live.once_within(live.read_log(spark, f"{base}/log", df.schema), ["judge", "case_id"], "created_at", "1 day", f"{base}/out", f"{base}/checkpoint")
    assert sorted(r["case_id"] for r in live.kept(spark, f"{base}/out").collect()) == sorted(f"c{i}" for i in range(200))
    end = time.time() + 30  # files are taken away beside the work
    while shuffled() - before and time.time() < end:
        time.sleep(0.5)
    assert not shuffled() - before
    assert len(glob.glob(f"{base}/checkpoint/offsets/[0-9]*")) <= live.KEPT + 1
    assert [spark.conf.get(k, None) for k in how] == settings
