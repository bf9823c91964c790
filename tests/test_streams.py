"""Boards that a stream keeps in keyed state equal those of the whole log, after a restart too."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ratewell.operators import arena
from ratewell.plans.tables import table
from ratewell.streaming import live

KEYS = ["domain", "judge"]
COLUMNS = ["case_id", "model_a", "model_b", "forward", "reverse", *KEYS]


def board_rows(df):
    return sorted((*r[:4], round(r[4], 6), *r[5:]) for r in df.select(*KEYS, "pool", "model", "rating", "rank", "win", "loss", "tie", "n_observations").collect())


def test_boards_follow_the_log(spark, small):
    base = tempfile.mkdtemp(prefix="spark-tests-")
    matches = table(spark, small, "matches").select(*COLUMNS).where("domain <> 'it_operations' OR judge = 'j0'").cache()
    early = (F.crc32(F.col("case_id").cast("binary")) % 3 == 0) & (F.col("domain") != "financial_analysis")
    for part in (early, ~early):
        matches.where(part).repartition(2, "case_id").write.mode("append").parquet(f"{base}/log")
        # a new query each time: the second goes on from the checkpoint
        live.follow_boards(live.read_log(spark, f"{base}/log", matches.schema), KEYS, f"{base}/out", f"{base}/checkpoint")
        got = board_rows(live.boards(spark, f"{base}/out", KEYS))
        want = board_rows(arena.leaderboard(arena.with_scores(spark.read.parquet(f"{base}/log")), KEYS, ("baseline", "agent", "full")))
        assert got == want and {r[2] for r in got} == {"baseline", "agent", "full"}
    models = {pool: {r[3] for r in got if r[2] == pool} for pool in ("baseline", "agent", "full")}
    assert all("reference" in m for m in models.values()) and not any(m.startswith("agent:") for m in models["baseline"]) and models["full"] == models["baseline"] | models["agent"]


def test_an_unfinished_version_is_not_read(spark, small):
    base = tempfile.mkdtemp(prefix="spark-tests-")
    table(spark, small, "matches").select(*COLUMNS).where("judge = 'j0'").coalesce(1).write.parquet(f"{base}/log")
    live.follow_boards(live.read_log(spark, f"{base}/log", spark.read.parquet(f"{base}/log").schema), KEYS, f"{base}/out", f"{base}/checkpoint")
    whole = board_rows(live.boards(spark, f"{base}/out", KEYS))
    live.boards(spark, f"{base}/out", KEYS).withColumn("rating", F.lit(0.0)).write.parquet(f"{base}/out/boards/v7")  # no mark
    assert board_rows(live.boards(spark, f"{base}/out", KEYS)) == whole


def test_what_is_remembered_falls(spark):
    """Old comparisons leave the state; repeats inside the delay, and long after it, are kept once."""
    base = tempfile.mkdtemp(prefix="spark-tests-")
    day = 86_400
    for k in range(5):
        rows = [("j", f"c{k}-{i}", "a", "b", k * 3 * day + i) for i in range(40)] + [("j", f"c{k}-{i}", "b", "a", k * 3 * day + 50) for i in range(40)]
        rows += [("j", f"c0-{i}", "b", "a", k * 3 * day + 60) for i in range(5)]
        df = spark.createDataFrame(rows, "judge string, case_id string, model_a string, model_b string, s long").withColumn("created_at", F.timestamp_seconds("s"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/log")
    job = live.once_within(live.read_log(spark, f"{base}/log", df.schema), ["judge", "case_id"], "created_at", "1 day", f"{base}/out", f"{base}/checkpoint")
    got = [r["case_id"] for r in live.kept(spark, f"{base}/out").collect()]
    assert sorted(got) == sorted(f"c{k}-{i}" for k in range(5) for i in range(40))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress if p["stateOperators"]]
    assert max(held) < 120 and held[-1] <= 45


def test_a_killed_writer_leaves_the_old_documents(spark):
    """Documents without a manifest count for nothing; keys that a version lacks keep their earlier documents."""
    import pytest

    from ratewell.sources import logs

    store = tempfile.mkdtemp(prefix="spark-tests-") + "/store"
    made = lambda rows: spark.createDataFrame(rows, "domain string, judge string, rankings array<struct<model:string,rating:double>>")
    first = made([("d", "j", [("a", 1.0), ("b", None)]), ("d", "k", [])])
    assert logs.read_documents(spark, store, first.schema, KEYS).count() == 0
    assert logs.put_documents(first, store, KEYS) == 1
    read = lambda: sorted(map(tuple, logs.read_documents(spark, store, first.schema, KEYS).collect()))
    old = read()
    assert old == [("d", "j", [("a", 1.0), ("b", None)], 1), ("d", "k", [], 1)]
    with pytest.raises(Exception, match="killed"):  # while documents are written
        logs.put_documents(made([("d", "j", [("z", 9.0)])]).withColumn("x", F.raise_error("killed")), store, KEYS)
    made([("d", "j", [("z", 9.0)])]).write.partitionBy(*KEYS).json(f"{store}/documents/v2-unfinished")  # after them, before the manifest
    assert read() == old
    assert logs.put_documents(made([("d", "j", [("c", 2.0)])]), store, KEYS) == 2
    assert read() == [("d", "j", [("c", 2.0)], 2), ("d", "k", [], 1)]


def test_repeats_are_found_in_what_was_written(spark, monkeypatch):
    """Each comparison once, inside a batch and across batches and runs, with nulls; nothing is held as state, and rows come as they were."""
    monkeypatch.setattr(live, "LOOKUP_ROWS", 50)  # several parts a batch
    monkeypatch.setattr(live, "TASK_ROWS", 16)
    base = tempfile.mkdtemp(prefix="spark-tests-")
    pairs = [("j", f"c{i}", "a", "b") for i in range(60)] + [(None, "j", "a", "b"), ("j", None, "a", "b"), ("j", "n", None, "b"), ("j", "n", "a", None), ("j", "n", None, None), ("j", "n", "b", "b"), ("j", "n", "a", "a"), ("k", "c0", "a", "b")]
    turned = [(j, c, b, a) for j, c, a, b in pairs]
    want = {(j, c, *sorted(x or "" for x in (a or b, b or a))) for j, c, a, b in pairs}
    for k, part in enumerate((pairs[:40] + turned[:50], turned + pairs, [*pairs, ("j", "new", "z", "a")])):
        df = spark.createDataFrame([(*r, float(n), k) for n, r in enumerate(part)], "judge string, case_id string, model_a string, model_b string, forward double, part int")
        df.coalesce(1).write.mode("append").parquet(f"{base}/log")
        live.once(live.read_log(spark, f"{base}/log", df.schema), ["judge", "case_id"], f"{base}/out", f"{base}/checkpoint")
    kept = live.kept(spark, f"{base}/out")
    got = [tuple(r) for r in kept.collect()]
    names = [(j, c, *sorted(x or "" for x in (a or b, b or a))) for j, c, a, b, *_ in got]
    assert kept.columns == df.columns and len(names) == len(set(names)) and set(names) == want | {("j", "new", "a", "z")}
    assert {r[5] for r in got if r[1] == "new"} == {2} and ("j", "new", "z", "a") in {r[:4] for r in got}
    assert {r for r in got} <= {tuple(r) for r in spark.read.parquet(f"{base}/log").collect()}
    assert not os.path.exists(f"{base}/checkpoint/state")  # before: every comparison, in the memory of the tasks


def test_a_batch_that_did_not_end_is_made_again(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="spark-tests-")
    monkeypatch.setattr(live, "LOOKUP_ROWS", 50)
    df = spark.createDataFrame([("j", f"c{i}", "a", "b") for i in range(200)], "judge string, case_id string, model_a string, model_b string")
    df.coalesce(1).write.parquet(f"{base}/log")
    df.where("case_id < 'c2'").withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{base}/out/kept/batch=0")
    live.once(live.read_log(spark, f"{base}/log", df.schema), ["judge", "case_id"], f"{base}/out", f"{base}/checkpoint")
    assert sorted(map(tuple, live.kept(spark, f"{base}/out").collect())) == sorted(map(tuple, df.collect()))
