from __future__ import annotations

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ratewell.functions.parsing import repair, with_json
from ratewell.functions.rubric import pair_mean, recall_of, recall_ratio, set_mean, summary
from ratewell.operators import curation, rankstats, selection, skills, worklist


def test_rubric_vectors(spark):
    pairs = F.array(*[F.create_map(F.lit("grounding"), F.lit(float(x))) for x in (5, 2, 3)])
    three = F.create_map(F.lit("breadth"), F.lit(3.0), F.lit("utility"), F.lit(3.0))
    two = F.create_map(F.lit("breadth"), F.lit(4.0), F.lit("utility"), F.lit(2.0))
    row = spark.range(1).select(pair_mean(pairs), summary(pair_mean(pairs), set_mean(three), F.lit(True)), set_mean(two), set_mean(F.create_map().cast("map<string,double>")), pair_mean(F.array().cast("array<map<string,double>>"))).first()
    assert row[0] == pytest.approx(10 / 3) and row[1] == pytest.approx((10 / 3 + 3) / 2)
    assert tuple(row)[2:] == (3.0, None, 0.0)


@pytest.mark.parametrize(("text", "want"), [("3/5", (3, 5, 0.6)), (" 2 / 4 ", (2, 4, 0.5)), ("9/4", (4, 4, 1.0)), ("-1/4", (0, 4, 0.0)), ("1/0", None), ("x/2", None), ("1.5/2", None), (None, None), ("", None)])
def test_recall(spark, text, want):
    found = recall_of(F.lit(text).cast("string"))
    row = spark.range(1).select(found["hits"], found["total"], recall_ratio(found)).first()
    assert tuple(row) == (want or (None, None, None))


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('So: {"a": 1} done', '{"a": 1}'), ('{"a": 1,}', '{"a": 1}'), ('{"a": "\\p"}', '{"a": "\\\\p"}'), ('{"a": "x\ny"}', '{"a": "x\\ny"}'), ("none", None), ("", None), (None, None)],
)
def test_json_is_found(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_json(df, "t").first()["json"] == want


def test_repairs_leave_good_text_alone():
    assert repair('{"a": "b\\n"}') == '{"a": "b\\n"}'


@pytest.mark.parametrize(("values", "want"), [([10, 30, 20], [1, 3, 2]), ([4, 4, 1, 8], [2.5, 2.5, 1, 4])])
def test_midranks(spark, values, want):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    assert [r["r"] for r in rankstats.midranks(df, ["k"], "v", "r").orderBy("i").collect()] == want


def naive_tau(x, y):
    agree = tied_x = tied_y = 0
    for (a, b), (c, d) in itertools.combinations(list(zip(x, y, strict=True)), 2):
        dx, dy = a - c, b - d
        agree += (dx * dy > 0) - (dx * dy < 0)
        tied_x += dx == 0 != dy
        tied_y += dy == 0 != dx
    n = len(x) * (len(x) - 1) / 2
    under = math.sqrt((n - tied_x) * (n - tied_y))
    return agree / under if under else None


@pytest.mark.parametrize(("strip", "axis"), [(1 << 16, 256), (8, 4)])
def test_kendall(spark, monkeypatch, strip, axis):
    """Whole groups in a task, and groups cut into cells and strips again and again."""
    monkeypatch.setattr(selection, "STRIP", strip)
    monkeypatch.setattr(selection, "AXIS", axis)
    draw = random.Random(5)
    groups = {"a": [(1, 2), (2, 1), (3, 3)], "one": [(1, 1)], "tied": [(1, k) for k in range(9)], "same": [(2, 2)] * 5}
    groups |= {f"small{n}": [(draw.randrange(6), draw.randrange(6)) for _ in range(n)] for n in (2, 10, 57)}
    groups["wide"] = [(draw.random(), draw.random()) for _ in range(150)]
    groups["hot"] = [(0.5, draw.random()) for _ in range(60)] + [(draw.random(), draw.choice([0.1, draw.random()])) for _ in range(80)]
    rows = [(k, float(x), float(y)) for k, points in groups.items() for x, y in points] + [("a", None, 1.0), ("a", 2.0, None)]
    got = {r["k"]: (r["n"], r["tau"]) for r in selection.kendall(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == set(groups)
    for k, points in groups.items():
        want = naive_tau(*zip(*points, strict=True))
        assert got[k][0] == len(points) and (got[k][1] is None if want is None else got[k][1] == pytest.approx(want, abs=1e-6)), k


@pytest.mark.parametrize("few", [1 << 14, 3])
def test_medians(spark, monkeypatch, few):
    """Groups sorted in a task, and groups searched by histograms, equal the median."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "CELLS", 8)
    draw = random.Random(3)
    inf = float("inf")
    groups = {"odd": [3.0, 1.0, 2.0], "even": [4.0, 1.0, 2.0, 9.0], "one": [7.5], "same": [1.5] * 6, "far": [0.1, 0.2, 0.3, 0.4, 1e300, -1e300], "steps": [2.0**-k for k in range(60)], "inf": [-inf, 1.0, 2.0, inf, inf], "many": [draw.gauss(0, 1) for _ in range(501)]}
    rows = [(k, v, -v) for k, values in groups.items() for v in values] + [("odd", None, None), ("even", float("nan"), 5.0), ("none", None, None)]
    got = {r["k"]: r for r in selection.medians(spark.createDataFrame(rows, "k string, v double, u double"), ["k"], ["v", "u"]).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k]["v"] == statistics.median(values)
        assert got[k]["u"] == statistics.median([-v for v in values] + [5.0] * (k == "even"))


def test_weighted_places(spark):
    rows = [("k", float(v), w) for v, w in ((5, 1), (1, 3), (2, 0), (9, 2))]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    found = selection.selected(df, ["k"], "v", {"first": "0", "third": "3", "last": "n - 1", "beyond": "n"}, "w").first()
    assert tuple(found) == ("k", 6, 1.0, 5.0, 9.0, None)


def test_running_sums(spark):
    rows = [(k, v, (v * 7) % 5) for k in "ab" for v in range(200 if k == "a" else 3)]
    got = selection.running(spark.createDataFrame(rows, "k string, v int, c int").repartition(5), ["k"], "v", {"before": "c"}).collect()
    assert len(got) == len(rows) and all(r["before"] == sum(c for k, v, c in rows if k == r["k"] and v < r["v"]) for r in got)


def test_draws_of_distinct_values(spark):
    """As many draws as values on average, spread as a Poisson distribution is, for counts on both sides of the bound."""
    df = spark.createDataFrame([("k", 1.0)] * 3 + [("k", 2.0)] * 25 + [("k", 3.0)] * 400 + [("k", None), ("k", float("nan"))], "k string, v double")
    drawn = selection.resampled(df, ["k"], "v", 2000).toPandas()
    for value, count in ((1.0, 3), (2.0, 25), (3.0, 400)):
        times = drawn[drawn["v"] == value]["times"]
        mean, square = times.sum() / 2000, (times**2).sum() / 2000
        assert abs(mean - count) < 5 * math.sqrt(count / 2000) and abs((square - mean * mean) / count - 1) < 0.15
    assert abs(drawn.pivot(index="replicate", columns="v", values="times").fillna(0).corr().to_numpy()[[0, 0, 1], [1, 2, 2]]).max() < 0.1


def test_tests_of_two_and_more_groups(spark):
    draw = random.Random(9)
    rows = [("k", g, float(draw.randrange(8) + 2 * g)) for g in range(3) for _ in range(15)]
    df = spark.createDataFrame(rows, "part string, g int, v double")
    by = {g: [v for _, h, v in rows if h == g] for g in range(3)}
    half = lambda xs, ys: sum((x > y) + (x == y) / 2 for x in xs for y in ys)
    u = rankstats.mann_whitney(df.withColumn("g", F.col("g").cast("string")), ["part"], "g", "0", "1", "v").first()
    assert u["u"] == half(by[0], by[1]) and u["p_less"] < 0.5 < u["p_greater"]
    j = rankstats.jonckheere(df, ["part"], "g", "v").first()
    assert j["j"] == sum(half(by[b], by[a]) for a, b in ((0, 1), (0, 2), (1, 2))) and 0 <= j["p_increasing"] < 0.5


def test_equal_groups_have_no_p(spark):
    df = spark.createDataFrame([("k", g, 1.0) for g in "xy" for _ in range(3)], "k string, g string, v double")
    assert rankstats.mann_whitney(df, ["k"], "g", "x", "y", "v").first()["p_two_sided"] is None


def test_bootstrap_draws_as_many_as_rows(spark):
    df = spark.createDataFrame([("k", i) for i in range(7)], "k string, i int")
    draws = rankstats.bootstrap_draws(df, ["k"], 50).groupBy("replicate").agg(F.sum("times").alias("n"), F.max("place").alias("p")).collect()
    assert len(draws) == 50 and {r["n"] for r in draws} == {7} and max(r["p"] for r in draws) == 6


def test_pending_pairs_in_either_order(spark):
    found = spark.createDataFrame([("c", "a", "b"), ("c", "a", "d")], "case_id string, model_a string, model_b string")
    done = spark.createDataFrame([("c", "b", "a")], found.schema)
    assert [tuple(r) for r in worklist.pending_pairs(found, done).collect()] == [("c", "a", "d")]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 153])
def test_a_shuffle_puts_numbers_at_different_places(spark, size):
    got = [r[0] for r in spark.range(size).selectExpr("id", f"{size}L AS n").selectExpr(worklist.shuffled_place("id", "n", "'x'")).collect()]
    assert sorted(got) == list(range(size)) and (size < 100 or got != sorted(got))


def test_drawn_pairs_of_a_hot_case(spark):
    """100,000 labels of one case: as many pairs as asked for, all different, all over the triangle; a small case gives all it has."""
    labels = spark.range(100_000).selectExpr("'hot' AS case_id", "lpad(CAST(id AS STRING), 6, '0') AS label").union(spark.createDataFrame([("two", "a"), ("two", "b"), ("one", "a"), ("two", "a")], "case_id string, label string"))
    got = worklist.drawn_pairs(labels, 500).collect()
    hot = [(r["model_a"], r["model_b"]) for r in got if r["case_id"] == "hot"]
    assert len(set(hot)) == 500 and all(a < b for a, b in hot) and [tuple(r)[:3] for r in got if r["case_id"] != "hot"] == [("two", "a", "b")]
    assert abs(sum(int(b) for _, b in hot) / 500 - 66_667) < 6000 and 150 < sum(r["flipped"] for r in got) < 350
    assert len({r["model_a"] for r in got}) > 400


def test_pairs_of_cases_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(worklist, "HOT_LABELS", 5)
    rows = [("hot", f"m{k:02}") for k in range(23)] + [("small", "x"), ("small", "y"), ("one", "z")]
    got = sorted(map(tuple, worklist.pairs(spark.createDataFrame(rows, "case_id string, label string")).collect()))
    assert got == sorted((c, a, b) for c, a in rows for d, b in rows if c == d and a < b)


def test_labels_under_every_judge(spark):
    from ratewell.operators import reports

    rows = spark.createDataFrame([("j0", "a", 0.5, 1.0), ("j0", "b", 0.9, 3.0), ("j0", "c", 0.1, 2.0), ("j1", "a", 0.2, 9.0), ("j1", "c", 0.3, 8.0)], "judge string, model string, ratio double, rating double")
    found = reports.under_every_judge(reports._ranked(rows)).collect()
    assert {(r["judge"], r["model"]): (r["recall_rank"], r["arena_rank"], r["delta"]) for r in found} == {("j0", "a"): (1, 2, 1), ("j0", "c"): (2, 1, -1), ("j1", "a"): (2, 1, -1), ("j1", "c"): (1, 2, 1)}


def test_every_key_is_a_dimension(spark):
    from ratewell.operators import score

    rows = [("d", "j", "m", [{"grounding": 2.0, "extra": 5.0}, {"grounding": 4.0}], {"breadth": 1.0, "odd": 3.0}, None, True), ("d", "j", "m", [{"extra": 1.0, "none": None}], {"odd": 9.0}, (1, 2), False)]
    ddl = "domain string, judge string, model string, pair_scores array<map<string,double>>, set_scores map<string,double>, recall struct<hits:int,total:int>, multi boolean"
    found = score.dimension_means(score.rubric_scores(spark.createDataFrame(rows, ddl)), ["model"]).collect()
    assert {r["dimension"]: (r["mean"], r["n"]) for r in found if r["dimension"] != "S"} == {"grounding": (3.0, 2), "extra": (3.0, 2), "breadth": (1.0, 1), "odd": (3.0, 1), "recall": (0.5, 1)}


def test_record_keys(spark):
    df = spark.createDataFrame([("x", "y"), ("", "y"), (None, "y"), (None, None), ("", "")], "id string, case_id string")
    assert [r[0] for r in df.select(worklist.record_key(F.col("id"), F.col("case_id"))).collect()] == ["x", "y", "y", None, None]


def test_fingerprints(spark):
    cases = spark.createDataFrame([("1", "it_operations", {"report_id": "r1"}), ("2", "it_operations", {"report_id": "r1"}), ("3", "machine_learning", {"venue": "v"})], "case_id string, domain string, metadata map<string,string>")
    fps = spark.createDataFrame([("a", {"case_id": "r1"}), ("b", {"id": "3", "venue": "v"}), ("c", {"id": "9"}), ("d", {"venue": "v", "year": None}), ("e", {"id": "3", "venue": None})], "fp string, keys map<string,string>")
    found = curation.resolve_fingerprints(fps, cases)
    assert sorted(map(tuple, found.collect())) == [("a", "1"), ("a", "2"), ("b", "3"), ("d", "3")]
    assert {r["fp"]: r["state"] for r in curation.audit(fps, found).collect()} == {"a": "ambiguous", "b": "ok", "c": "missed", "d": "ok", "e": "missed"}


def test_an_empty_fingerprint_raises(spark):
    cases = spark.createDataFrame([("1", "d", {"x": "y"})], "case_id string, domain string, metadata map<string,string>")
    with pytest.raises(Exception, match="without keys"):
        curation.resolve_fingerprints(spark.createDataFrame([("a", {})], "fp string, keys map<string,string>"), cases).collect()


def test_skill_triples(spark):
    used = spark.createDataFrame([(["b", "a", "c", "a"],), (["a", "c"],)], "skills array<string>")
    assert sorted(map(tuple, skills.together(used, 2).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert list(map(tuple, skills.together(used, 3).collect())) == [("a", "b", "c", 1)]


def test_verdicts_of_awkward_forms(spark):
    from ratewell.operators import score

    one = '{"grounding": 1, "insight": 2.5, "justification": 3, "more": 9}'
    form = '{{"pair_scores": [{0}], "rationale": "r", "recall": null, "set_scores": {1}}}'
    sets = '{"breadth": 4, "distinctness": 5, "utility": 3}'
    rows = [
        (1, form.format(one, sets), 1, True), (2, form.format(f"{one}, {one}", sets), 3, True), (3, form.format(one, sets), 2, False), (4, form.format(one, "null"), 1, True),
        (5, form.format(one, "7"), 1, True), (6, form.format(one, '{"breadth": 4, "utility": 3}'), 1, True), (7, '{"pair_scores": [], "rationale": "r"}', 1, True), (8, None, 1, True), (9, form.format("", sets), 0, False),
    ]
    got = {r["id"]: r for r in score.parsed_verdicts(spark.createDataFrame(rows, "id int, answer string, k int, multi boolean"), "answer").collect()}
    assert [i for i in got if got[i]["valid"]] == [1, 2, 3, 4, 9] and [i for i in got if got[i]["k_mismatch"]] == [2, 3]
    assert got[1]["pair_scores"] == [{"grounding": 1.0, "insight": 2.5, "justification": 3.0}] and got[5]["pair_scores"] is None
    assert got[1]["set_scores"] == {"breadth": 4.0, "utility": 3.0} and got[2]["set_scores"] == {"breadth": 4.0, "distinctness": 5.0, "utility": 3.0}
    assert got[3]["set_scores"] == got[4]["set_scores"] == got[9]["set_scores"] == {}


def test_registries_of_any_size(spark):
    """More configs and labels than a broadcast would take: none is lost."""
    from ratewell.sources import logs

    n = 10_050
    configs = spark.range(n).select(F.concat(F.lit("c."), F.col("id").cast("string")).alias("config"))
    names = configs.select(F.lit("d").alias("domain"), F.concat("config", F.lit(".judge.x.jsonl")).alias("name")).union(configs.limit(1).select(F.lit("d"), F.concat("config", F.lit(".jsonl"))))
    assert logs.discover_runs(names, configs, ".jsonl").where("judge = 'judge.x'").count() == n
    labels = spark.range(n).select(F.col("id").cast("string").alias("label"))
    rows = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert worklist.every(rows, labels).distinct().count() == 2 * n == 2 * worklist.every(rows, labels, 1).where("case_id = 'a'").distinct().count()


def test_weighted_statistics(spark):
    draw = random.Random(3)
    rows = [(draw.randrange(5), draw.randrange(5), draw.randrange(1, 4)) for _ in range(20)]
    df = spark.createDataFrame([("k", float(x), float(y), t) for x, y, t in rows], "k string, x double, y double, times int")
    each = spark.createDataFrame([("k", float(x), float(y)) for x, y, t in rows for _ in range(t)], "k string, x double, y double")
    ranked = rankstats.drawn_midranks(rankstats.drawn_midranks(df, ["k"], "x", "rx"), ["k"], "y", "ry")
    want = rankstats.correlations(each, ["k"], "x", "y").first()["rho"]
    assert rankstats.weighted_correlation(ranked, ["k"], "rx", "ry", "times").first()["v"] == pytest.approx(want, abs=1e-6)
    plain = {(r["x"], r["r"]) for r in rankstats.midranks(each, ["k"], "x", "r").collect()}
    assert {(r["x"], r["r"]) for r in rankstats.midranks(df, ["k"], "x", "r", "times", 3).collect()} == plain


def test_hypothesis_blocks(spark):
    form = "array<struct<category:string,hypothesis:string,evidence:string>>"
    df = spark.createDataFrame([([("c", "h", "e"), ("", "i", "f"), (None, "j", "g")],), ([],), (None,)], f"h {form}")
    assert [r[0] for r in df.select(worklist.block(F.col("h"))).collect()] == ["1. [c] h\nEvidence: e\n2. i\nEvidence: f\n3. j\nEvidence: g", "(no hypotheses)", "(no hypotheses)"]


def test_absent_keys_alone(spark):
    cases = spark.createDataFrame([("1", "d", {"x": "1"}), ("2", "d", {"x": None}), ("3", "d", {"y": "1"})], "case_id string, domain string, metadata map<string,string>")
    fps = spark.createDataFrame([("a", {"x": None}), ("b", {"x": None, "y": None}), ("c", {"domain": None})], "fp string, keys map<string,string>")
    assert sorted(map(tuple, curation.resolve_fingerprints(fps, cases).collect())) == [("a", "2"), ("a", "3"), ("b", "2")]


def test_streams_touch_and_keep(spark, tmp_path):
    """Batches add up, untouched groups keep their board, a version in the making is not read, old ones go."""
    import os

    from ratewell.streaming import live

    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    form = "domain string, judge string, model string, s_score double"
    for k in range(6):
        spark.createDataFrame([("d" if k else "e", "j", "m", float(k)), ("d", "j", "n", 2.0)], form).coalesce(1).write.mode("append").parquet(log)
        live.follow_scores(live.read_log(spark, log, spark.createDataFrame([], form).schema), ["domain", "judge"], out, str(tmp_path / "check"))
    board = {(r["domain"], r["model"]): (r["rating"], r["n_observations"]) for r in live.latest(spark, out, "board").collect()}
    assert board == {("e", "m"): (0.0, 1), ("d", "m"): (3.0, 5), ("d", "n"): (2.0, 6)}
    assert sorted(os.listdir(out + "/board")) == ["v3", "v4", "v5"]
    os.makedirs(out + "/board/v6")
    assert live.latest(spark, out, "board").count() == 3
