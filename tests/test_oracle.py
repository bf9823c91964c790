"""Every query that SQL can state gives the rows that DuckDB gives over the same tables."""

from __future__ import annotations

import decimal
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from ratewell.plans import registry


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.reindex(sorted(frame.columns), axis=1)

    def value(x) -> str:
        """A nullable whole number is a float in one frame and whole in the other: both are written alike."""
        if pd.isna(x):
            return ""
        if isinstance(x, bool | np.bool_):
            return str(bool(x))
        if isinstance(x, int | float | decimal.Decimal | np.number):
            x = round(float(x), 5)
            return str(int(x)) if x == int(x) else str(x)
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, small, name):
    got = registry.queries()[name](spark, small).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


@pytest.mark.parametrize(("name", "source"), [("stream_dedup", "matches"), ("stream_pending", "sub")])
def test_streams_read_all_cases(spark, small, name, source):
    from ratewell.plans.tables import table

    pairs = table(spark, small, "matches").select("case_id") if source == "matches" else table(spark, small, "sub").groupBy("case_id").count().where("count > 1").select("case_id")
    want = {r["case_id"] for r in pairs.collect()}
    assert want and {r["case_id"] for r in registry.queries()[name](spark, small).select("case_id").collect()} == want


def test_requests_for_all_pending_pairs(spark, small):
    made = registry.queries()["arena_requests"](spark, small).groupBy("case_id", "model_a", "model_b").count().collect()
    pending = {(r["case_id"], r["model_a"], r["model_b"]) for r in registry.queries()["pending_matches"](spark, small).collect()}
    assert {r["count"] for r in made} == {2} and {tuple(r)[:3] for r in made} == pending


def test_flagship(spark):
    import __spark_entry__

    board = __spark_entry__.entry(spark).toPandas()
    assert {"domain", "judge", "pool", "model", "rating", "rank"} <= set(board.columns)
    assert (board.groupby(["domain", "judge", "pool"])["rating"].mean() - 1500).abs().max() < 1e-3


def test_names_need_no_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=root, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr[-500:]
