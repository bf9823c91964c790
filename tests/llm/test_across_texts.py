"""Operators that compare texts, against brute force."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratewell.llm import components, decontamination, line_dedup, ngram_join, suffix_dedup
from tests_llm_help import components_of, shingles


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def check_join(df, rows, words, percent):
    got = collections.Counter(map(tuple, ngram_join.join(df, words=words, percent=percent).collect()))
    sets = [shingles(t, words) for _, t in rows]
    root = components_of(len(rows), ((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])))
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[k]] = min(least.get(root[k], doc_id), doc_id)
    assert got == collections.Counter((doc_id, len(sets[k]), least.get(root[k])) for k, (doc_id, _) in enumerate(rows))


def test_join_of_awkward_rows(docs, rows, empty):
    check_join(docs, [r[:2] for r in rows], 4, 85)
    assert ngram_join.join(empty).count() == 0


def test_join_of_documents(documents):
    check_join(documents, [(r["doc_id"], r["text"]) for r in documents.collect()], 5, 80)


def test_join_of_one_large_group(spark, monkeypatch):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(draw.randrange(4)):
            w[draw.randrange(60)] = f"x{draw.randrange(5)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    check_join(spark.createDataFrame(rows, "doc_id long, text string"), rows, 4, 85)


def passage_mixes(n, seed=3):
    """Documents of passages that many share: no two of them link, yet each shares whole passages with hundreds of others."""
    draw = random.Random(seed)
    passages = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    return [(k, " ".join(draw.sample(passages, 6))) for k in range(n)]


def test_documents_of_shared_passages(spark, monkeypatch):
    """With small blocks all of them fall into one large cluster: sketches take it apart, and near copies in it are still found."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 60)
    rows = passage_mixes(300)
    rows += [(1000 + k, t + " and a few words more") for k, t in rows[:60]] + [(2000 + k, f"x{k} " + rows[70][1]) for k in range(90)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 4, 85)


def test_copies_of_rows_grow_with_the_rows(spark, monkeypatch):
    """What the product's second round gets of passage mixes: no blobs at all, as no two come close."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 256)
    sent = []
    real = ngram_join._compared
    monkeypatch.setattr(ngram_join, "_compared", lambda rows, tasks, percent: (sent.append(tasks.agg({"tasks": "count"}).first()[0] and tasks.selectExpr("sum(size(tasks))").first()[0]), real(rows, tasks, percent))[1])
    for n in (1500, 3000):
        sent.clear()
        got = ngram_join.join(spark.createDataFrame(passage_mixes(n), "doc_id long, text string").repartition(4), words=4, percent=85)
        assert got.where("component_id <> doc_id").count() == 0
        assert sum(x or 0 for x in sent) <= 2 * n


def test_sketches_lose_no_link():
    draw = np.random.default_rng(6)
    sets = []
    for n in (1, 3, 40, 129, 400, 1500):
        base = draw.integers(0, 1 << 60, n).astype(np.uint64)
        for cut in (0, n // 20, n // 8, n // 3):
            sets.append(np.unique(np.concatenate([base[cut:], draw.integers(0, 1 << 60, cut // 3).astype(np.uint64)])))
    size = np.array([len(s) for s in sets])
    for percent in (40, 80, 85):
        group = ngram_join.candidate_groups([ngram_join.sketch(s) for s in sets], size, size, np.arange(len(sets)), percent)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j])):
                assert group[i] == group[j]
        assert percent == 40 or len(set(group)) > 4
    assert (ngram_join.candidate_groups([ngram_join.sketch(s) for s in sets], size, size, np.zeros(len(sets)), 80) == np.arange(len(sets))).all()


def test_product_blocks(monkeypatch):
    draw = np.random.default_rng(4)
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 16)
    sets = [np.unique(draw.integers(0, 60, 40).astype(np.uint64)) for _ in range(30)]
    links = [(i, j) for i, j in itertools.combinations(range(30), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 45 * len(np.union1d(sets[i], sets[j]))]
    root = components_of(30, links)
    for dense in (2, 20, 128):
        monkeypatch.setattr(ngram_join, "DENSE_ROWS", dense)
        got = ngram_join.linked_groups(sets, np.array([len(s) for s in sets]), 45)
        assert [root[i] == root[j] for i, j in itertools.combinations(range(30), 2)] == [got[i] == got[j] for i, j in itertools.combinations(range(30), 2)]


@pytest.mark.parametrize("percent", [80, 85])
def test_join_at_the_bound(spark, monkeypatch, percent):
    """Sets of every small size, at and just below the bound, in many column blocks and with hot columns."""
    monkeypatch.setattr(ngram_join, "COLUMN_BLOCK_GRAMS", 100)
    draw = random.Random(percent)
    rows = []
    for n in (1, 2, 4, 5, 6, 8, 9, 12, 17, 23, 40, 90):
        for _ in range(12):
            one = [f"a{draw.randrange(10**6)}" for _ in range(n)]
            rows.append(" ".join(one))
            for cut in range(min(n, 3 + n * (100 - percent) // 90)):
                rows.append(" ".join(one[cut:] + [f"b{draw.randrange(10**6)}" for _ in range(draw.randrange(cut + 1))]))
    rows = [(k, t + (" the same words in all of them" if k % 3 == 0 else "")) for k, t in enumerate(rows)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, 3, percent)


def test_keep_first(docs):
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    roots = {r["component_id"] for r in ngram_join.join(docs).collect() if r["doc_id"] is not None}
    assert roots <= {r["doc_id"] for r in kept.collect()}


def test_rows_without_ids_of_their_own(spark):
    draw = random.Random(5)
    a, b, c, d = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, a + " y", "x"), (2, c, "x"), (None, a, "x"), (None, d, "x"), (None, d, "x"), (5, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = collections.Counter(map(tuple, ngram_join.keep_first(df).collect()))
    assert kept == collections.Counter([(1, a, "x"), (1, b, "x"), (2, c, "x"), (None, d, "x"), (5, None, "x"), (5, None, "x")])
    clean = decontamination.clean(df, spark.createDataFrame([(1, a)], "item_id long, text string"))
    assert collections.Counter(map(tuple, clean.collect())) == collections.Counter(r for r in rows if not (r[1] or "").startswith(a))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def check_leaks(df, rows, items):
    want = {}
    for (doc_id, t), (item_id, x) in itertools.product(rows, items):
        a, b = shingles(t, 5), shingles(x, 5)
        if b and 100 * len(a & b) >= 80 * len(b):
            want[doc_id, item_id] = max(want.get((doc_id, item_id), 0), len(a & b) / len(b))
    got = {(r["doc_id"], r["item_id"]): r["n_matched"] / r["n_shingles"] for r in df.collect()}
    assert got == want


def test_leaks_in_documents(spark, small, documents):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    check_leaks(decontamination.search(documents, items), [(r["doc_id"], r["text"]) for r in documents.collect()], [(r["item_id"], r["text"]) for r in items.collect()])


def test_leaks_in_awkward_rows(spark, docs, rows, empty):
    texts = {r[0]: r[1] for r in rows}
    items = [(0, None), (1, ""), (2, "one two"), (3, " ".join(texts[9].split()[3:30]).upper()), (4, "not there at all in any of them"), (None, texts[10]), (3, "x y z")]
    table = spark.createDataFrame(items, "item_id long, text string")
    check_leaks(decontamination.search(docs, table), [r[:2] for r in rows], items)
    assert decontamination.search(empty, table).count() == 0 and decontamination.search(docs, table.limit(0)).count() == 0
    clean = decontamination.clean(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {r["doc_id"] for r in decontamination.search(docs, table).collect()}


def passages(rows, least=50):
    owners = collections.defaultdict(set)
    words = [(t or "").encode().split() for _, t in rows]
    for k, w in enumerate(words):
        for j in range(len(w) - least + 1):
            owners[tuple(w[j : j + least])].add(k)
    out = []
    for k, w in enumerate(words):
        found = []
        for j in range(len(w) - least + 1):
            if len(owners[tuple(w[j : j + least])]) > 1:
                if found and j <= found[-1][1]:
                    found[-1][1] = j + least
                else:
                    found.append([j, j + least])
        out += [(rows[k][0], a, b) for a, b in found]
    return sorted(out, key=str)


def different(rows):
    """Rows equal in id and text meet each other as often as there are pairs of them; brute force sees each once."""
    return [r[:2] for r in rows]


def test_repeats_in_documents(documents):
    got = sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeats(documents).collect()), key=str)
    assert got == passages([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_repeats_in_awkward_rows(docs, rows, empty):
    got = sorted(((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeats(docs).collect()), key=str)
    assert got == passages(different(rows))
    assert suffix_dedup.repeats(empty).count() == 0


def test_spans_are_taken_out(spark):
    df = spark.createDataFrame([(1, "a b\nc d", 5), (2, "x  y", 6), (None, "z", 7)], "doc_id long, text string, _spans int")
    spans = spark.createDataFrame([(1, 1, 3)], "doc_id long, start_word long, end_word long")
    assert sorted(map(str, suffix_dedup.without(df.drop("_spans"), spans).collect())) == sorted(["Row(doc_id=1, text='a d')", "Row(doc_id=2, text='x  y')", "Row(doc_id=None, text='z')"])


@pytest.mark.parametrize("tasks", [[[(0, 100), (0, 300)], [(1, 500)]], [[(0, 100), (1, 200)], [(0, 300)]], [[(1, 100), (2, 200)], [(2, 300)]], [[(0, 100)], [(1, 200)]]])
def test_places_at_task_edges(tasks):
    # one passage; each task has some of its places (row, place), whose words before it all differ
    around = np.arange(1, suffix_dedup.AROUND + 1)
    edges, told = [], set()
    for places in tasks:
        columns = {"row": [r for r, _ in places], "place": [p for _, p in places], "key": [7] * len(places), "after": [around.astype(">u4").tobytes()] * len(places)}
        columns["before"] = [(around + 1000 * p).astype(">u4").tobytes() for _, p in places]
        batch = pa.RecordBatch.from_pydict(columns, pa.schema([f for f in suffix_dedup._SUFFIX_PA if f.name in columns]))
        for out in suffix_dedup._neighbours(iter([batch])):
            for m in out.to_pylist():
                edges.append(m) if m["window"] is not None else told.add((m["row"], m["start"]))
    for _, same in itertools.groupby(sorted(edges, key=lambda m: m["window"]), key=lambda m: m["window"]):
        same = list(same)
        if len({m["row"] for m in same}) > 1:
            told |= {(m["row"], m["start"]) for m in same}
    assert told == {p for places in tasks for p in places}


def test_patience():
    assert line_dedup.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([5, 5], [5, 5]) == [(0, 0), (1, 1)]
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([draw.randrange(8) for _ in range(draw.randrange(14))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(got))


BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows, rare):
    """Deleted places with words per row, for rows that differ in id or text, from all pairs that share a rare line, and
    the earliest document of every line and of every common line with its neighbours."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    lines = [(t or "").split("\n") for _, t in rows]
    n, held, trio = collections.Counter(), collections.defaultdict(list), {}
    around = lambda k, i: (lines[k][i - 1] if i else None, lines[k][i], lines[k][i + 1] if i + 1 < len(lines[k]) else None)
    for k in order:
        for i, x in enumerate(lines[k]):
            if x.strip(BLANK):
                n[x] += 1
                trio.setdefault(around(k, i), k)
                if not held[x] or held[x][-1] != k:
                    held[x].append(k)
    out = {}
    for k in order:
        partners = set()
        for i, x in enumerate(lines[k]):
            if x.strip(BLANK):
                partners |= set(held[x][: held[x].index(k)]) if n[x] <= rare else {held[x][0], trio[around(k, i)]}
        gone = set()
        for p in partners - {k}:
            block, last = [], (-2, -2)
            for i, j in [*line_dedup.patience([hash(x) for x in lines[p]], [hash(x) for x in lines[k]]), (-9, -9)]:
                if (i, j) != (last[0] + 1, last[1] + 1):
                    gone |= {b for b in block if lines[k][b].strip(BLANK)}
                    block = []
                block.append(j)
                last = (i, j)
        out[rows[k][0]] = gone
    return out


def check_lines(df, rows, **options):
    texts = dict(rows)
    got = {r["doc_id"]: r for r in line_dedup.deduplicate(df, **options).collect()}
    words = {i: {p for p in r["deleted"] if (texts[i] or "").split("\n")[p].strip(BLANK)} for i, r in got.items()}
    assert words == brute_lines(rows, options.get("rare", line_dedup.COMMON))
    for i, r in got.items():
        assert r["text"] == (texts[i] if not r["deleted"] else "\n".join(x for p, x in enumerate(texts[i].split("\n")) if p not in set(r["deleted"])))


@pytest.mark.parametrize("rare", [2, 100])
def test_lines_of_documents(documents, rare):
    check_lines(documents, [(r["doc_id"], r["text"]) for r in documents.collect()], rare=rare)


def test_lines_in_other_orders(spark):
    """Lines that the earliest documents have in orders that do not align are deleted through later partners."""
    draw = random.Random(8)
    rows = [(k, "\n".join(draw.sample([f"line {i}" for i in range(9)], draw.randrange(2, 8)))) for k in range(60)]
    for rare in (10, 100):
        check_lines(spark.createDataFrame(rows, "doc_id long, text string"), rows, rare=rare)


def test_lines_of_awkward_rows(docs, rows, empty):
    got = line_dedup.deduplicate(docs).collect()
    assert len(got) == len(rows) and all(r["n_deleted"] == len(r["deleted"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[13]["n_deleted"] == by[13]["n_lines"] and by[0]["text"] is None and by[7]["n_deleted"] == 0
    assert line_dedup.deduplicate(empty).count() == 0


def test_common_lines_between_other_neighbours(spark, monkeypatch):
    # one line in 150 places, each time between other lines, and one in 40: all but the first of each go
    rows = [(k, f"a{k}\nAll rights reserved.\nb{k}" + (f"\nMIT\nc{k}" if k % 4 == 1 else "")) for k in range(150)]
    monkeypatch.setattr(line_dedup, "DEAL", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_lines(df, rows)
    assert {r["doc_id"] for r in line_dedup.deduplicate(df).collect() if 1 in r["deleted"]} == set(range(1, 150))


def test_pipeline_stages_against_brute_force(spark, small, monkeypatch):
    import corpus_pipeline
    from ratewell.llm import quality_rules

    documents, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "token-ID output"]
    good = stages["quality rules"](spark, documents, small)
    kept = {r["doc_id"] for r in quality_rules.judge(documents, labels).where("kept").collect()}
    assert good.columns == documents.columns and {r["doc_id"] for r in good.collect()} == kept
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    sets = [shingles(t, 5) for _, t in rows]
    root = components_of(len(rows), ((i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])))
    one = stages["n-gram Jaccard join"](spark, good, small)
    assert {r["doc_id"] for r in one.collect()} == {rows[k][0] for k in range(len(rows)) if root[k] == k}
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"](spark, one, small)
    bad = {r["doc_id"] for r in one.collect() for x in items if 100 * len(shingles(r["text"], 5) & shingles(x, 5)) >= 80 * len(shingles(x, 5))}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - bad
    mixed = stages["mixing sources"](spark, clean, small)
    assert mixed.columns == documents.columns
    out = stages["token-ID output"](spark, mixed, small)
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(r["doc_id"] for r in mixed.collect())


def test_repeats_of_equal_rows(spark):
    """Rows equal in id and text are told apart, and their number costs no square."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(None, passage, k % 3) for k in range(2000)] + [(1, "x " + passage, 0), (2, "y z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int").repartition(4)
    got = collections.Counter((r["doc_id"], r["start_word"], r["end_word"]) for r in suffix_dedup.repeats(df).collect())
    assert got == {(None, 0, 60): 2000, (1, 1, 61): 1}
    left = suffix_dedup.without(df, spark.createDataFrame([(1, 1, 61)], "doc_id long, start_word long, end_word long"))
    assert left.columns == df.columns and {r["text"] for r in left.where("doc_id = 1").collect()} == {"x"} and left.where("_spans = 2").count() == 666


def test_clean_keeps_columns_of_any_name(spark, docs):
    odd = docs.withColumns({n: F.lit(n) for n in ("_found_key", "_found_hash", "band", "hash", "doc_key", "item_key")})
    clean = decontamination.clean(odd, spark.createDataFrame([(1, "not there at all in any of them")], "item_id long, text string"))
    assert clean.columns == odd.columns and clean.count() == odd.count() and {r["_found_key"] for r in clean.collect()} == {"_found_key"}


def test_leaks_of_items_of_all_sizes(spark):
    """Items of one shingle up to hundreds, in texts that hold them whole, in part, or are too short for them."""
    draw = random.Random(12)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate((1, 3, 5, 6, 7, 9, 14, 20, 40, 90, 250))]
    rows = []
    for k, text in items:
        w = text.split()
        for _ in range(6):
            cut = draw.randrange(len(w) + 1)
            rows.append((len(rows), " ".join(["n"] * draw.randrange(9) + w[cut // 4 :][: draw.randrange(len(w) + 2)] + ["m"] * draw.randrange(9))))
        rows.append((len(rows), text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_leaks(decontamination.search(df, spark.createDataFrame(items, "item_id long, text string")), rows, items)


def test_pipeline_stages_with_awkward_rows(spark, small, docs, rows, empty):
    """Nulls, empty and very long texts, repeated rows and ids, columns of clashing names, and an empty table."""
    import corpus_pipeline

    texts = collections.Counter(r[1] for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, docs, small), stage(spark, empty, small)
        assert none.count() == 0
        kept = [r.asDict() for r in got.collect()]
        if name == "token-ID output":
            assert collections.Counter(r["doc_id"] for r in kept) == collections.Counter(r[0] for r in rows)
            continue
        assert got.columns == docs.columns == none.columns
        assert all((r["key"], r["size"], r["row"], r["_spans"]) == ("k", 1, 2, "w") for r in kept)
        now = collections.Counter(r["text"] for r in kept)
        if name == "mixing sources":
            assert all(now[t] <= 2 * texts[t] for t in now)
        else:
            assert all(now[t] <= texts[t] for t in now)
        if name == "benchmark decontamination":
            assert now == texts
        if name == "n-gram Jaccard join":
            long = [t for t in texts if t and len(t.split()) > 1000]
            assert now[None] == texts[None] and now[""] == texts[""] and all(now[t] == 1 for t in long)
        if name == "quality rules":
            assert not now[None] and not now[""]
