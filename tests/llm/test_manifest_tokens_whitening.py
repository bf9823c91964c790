"""The manifest against trees built by hand, token counts against the library, whitening against a dense decomposition."""

from __future__ import annotations

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratewell.llm import embedding_whitening, merkle_manifest, oracles, queries, token_counts


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], n, r[1])])


def tree(nodes, fanout):
    """The root, and for each node what stands left and right of it at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            b = p // fanout * fanout
            paths[k].append(("".join(nodes[b:p]), "".join(nodes[p + 1 : b + fanout])))
            at[k] = p // fanout
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def by_hand(rows, fanout, tampered):
    out, subroots, groups = [], [], collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for k, lang in enumerate(langs):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroot, paths = tree([leaf(r) for r in own], fanout)
        subroots.append(subroot)
        out += [(r, subroot, path, k) for r, path in zip(own, paths, strict=True)]
    root, above = tree(subroots, fanout)
    found = []
    for r, subroot, path, k in out:
        h = leaf(r, int(tampered(r)))
        for left, right in path + above[k]:
            h = digest(left, h, right)
        found.append((r[0], leaf(r), subroot, root, digest(*[a + b for a, b in path + above[k]]), h, h == root))
    return collections.Counter(found)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest(docs, rows, fanout):
    got = merkle_manifest.verified(docs, fanout, F.col("doc_id") % 5 == 0).select(*NAMES).collect()
    assert collections.Counter(map(tuple, got)) == by_hand(rows, fanout, lambda r: r[0] is not None and r[0] % 5 == 0 and r[4] is not None)


def test_manifest_of_many_batches(spark, monkeypatch):
    """Subtrees of four nodes, so that 700 rows take several batches; a lang of one row, one of two, and equal rows."""
    monkeypatch.setattr(merkle_manifest, "SUBTREE", 4)
    rows = [(k // 3, f"text {k // 2}", ("en", "en", "en", "fr")[k % 4], None, k // 2) for k in range(700)] + [(1, "x", "de", "s", 1), (2, "y", None, "s", None), (3, "", None, "s", 0)]
    rows += [rows[5]] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle_manifest.verified(df, 2, F.col("doc_id") == 7).select(*NAMES).collect()
    assert collections.Counter(map(tuple, got)) == by_hand(rows, 2, lambda r: r[0] == 7 and r[4] is not None)
    assert sum(not r["verified"] for r in got) == sum(r[0] == 7 for r in rows)


def test_manifest_of_few_rows(spark, empty, docs):
    assert merkle_manifest.verified(empty).count() == 0
    one = docs.where("doc_id = 13").limit(1)
    (r,) = merkle_manifest.verified(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == digest() and r["verified"]


def test_manifest_in_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = queries.op11_merkle_manifest(spark, small)
    want = con.sql(oracles.MANIFEST)
    assert sorted(got.columns) == sorted(want.columns)
    names = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.selectExpr(*sorted(got.columns)).collect())) == sorted(con.sql(f"SELECT {names} FROM ({oracles.MANIFEST})").fetchall())


def test_no_manifest_task_is_large(spark, small):
    """Leaves are dealt by subtree: one shuffle and one sort serve all levels of a batch."""
    plan = merkle_manifest.manifest(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 7 and plan.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan


@pytest.fixture(scope="session")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def expected(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(docs, rows, empty, library):
    got = collections.Counter(map(tuple, token_counts.count(docs, limit=100).collect()))
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n := expected(library, r[1] or ""), n > 100) for r in rows)
    assert token_counts.count(empty).count() == 0


def fuzzed(n, seed=5):
    """Texts over control characters, white space of all kinds, marks, digits, letters that change when lower-cased, and special strings."""
    draw = random.Random(seed)
    signs = [chr(c) for c in range(128)] + list("'’\"éÉßẞİıſŒœÞµªº²½¼\x85\xa0\xaḏ́ͅΣςσÅåKKẞ中文한가\U0001f600‍ 　ǅɐɏ‐…")
    words = ["Don't", "it's", "we'LL", "'s", "''s", "ẖ", "H̱", "<|endoftext|>", "<|startoftext|>", "<|", "ΌΣΟΣ", "x" * 70, "9" * 40, "___", "a_b", "Å", "́x"]
    return ["".join(draw.choice(words) if draw.random() < 0.08 else draw.choice(signs) if draw.random() < 0.6 else draw.choice("abcXYZ 19.,'") for _ in range(draw.randrange(1, 40))) for _ in range(n)]


def test_pieces_count_as_the_library_does(library):
    texts = fuzzed(20_000)
    table = (b"a b don 't x 19", bytes([1, 1, 1, 1, 1, 2]))
    lengths = token_counts.Lengths("word_bpe_49k.json", (table[0][:-3], table[1][:-1]))
    wrong = [t for t in texts if lengths.count(t.encode()) != expected(library, t)]
    assert not wrong, wrong[:5]


def test_table_has_what_the_texts_have_most(spark):
    texts = ["the cat and the dog"] * 40 + ["The end", "rare words here", None, ""]
    words, lengths = token_counts.frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "word_bpe_49k.json")
    assert words.split()[0] == b"the" and set(b"cat and dog end rare".split()) <= set(words.split()) and len(lengths) == len(words.split())


def test_summaries_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(token_counts, "SUMMARY", 50)
    draw = random.Random(2)
    seen = collections.Counter()
    counts = collections.Counter()
    for _ in range(400):
        part = [f"hot{draw.randrange(10)}" for _ in range(30)] + [f"cold{draw.randrange(10**6)}" for _ in range(70)]
        seen.update(part)
        counts.update(part)
        counts = collections.Counter(token_counts._pruned(counts))
    for k in range(10):
        assert 0 <= seen[f"hot{k}"] - counts[f"hot{k}"] <= sum(seen.values()) / 51


def dense(x, k=16):
    """What whitening gives, by a dense decomposition of the different vectors."""
    u = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(u.T, bias=True).reshape(x.shape[1], -1))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-10 * values[0]).sum()))
    return len(u), (x - u.mean(0)) @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), [int(v) for v in u.astype(int).sum(0)]


def compare(spark, vectors):
    df = spark.createDataFrame([(k, v, 0, 1.5) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int, n double").repartition(3)
    got = embedding_whitening.whiten(df).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * np.array(vectors, np.float32).astype(float))
    n, want, explained, sums = dense(x)
    k = want.shape[1]
    assert len(got) == len(vectors) * k and (got["n"] == n).all() and (got["identity_error"] < 1e-9).all()
    white = got["whitened"].to_numpy().reshape(-1, k)
    sign = np.sign((white * want).sum(0))
    assert np.abs(white * sign - want).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy()[:k], explained, rtol=1e-9)
    assert got["deviation"].to_numpy()[::k].tolist() == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_whitening(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(300, 24)) * np.linspace(0.1, 2, 24)
    compare(spark, [row.tolist() for row in np.vstack([base, base[:40], np.repeat(base[:1], 200, 0)])])
    compare(spark, [[float(a), float(a * 2), float(b), 7.0] for a, b in draw.normal(size=(50, 2))])  # zero and tied directions
    compare(spark, [[float(a)] for a in range(20)])


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [[0.5, 1.0, 2.0], [1.5, -1.0, 0.25], [0.1, 0.2, 0.3], [9.0, 1.0, 1.0], None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [1.0, inf, 2.0], [1.0, 3e38, 2.0], [1.0, 2.0], [0.5, 1.0, 2.0]]
    df = spark.createDataFrame([(None if k == 3 else k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = embedding_whitening.whiten(df).collect()
    assert {r["vec_id"] for r in got} == {0, 1, 2, None, 11} and {r["n"] for r in got} == {4} and len(got) == 15
    same = {(r["component"], r["whitened"]) for r in got if r["vec_id"] in (0, 11)}
    assert len(same) == 3
    assert embedding_whitening.whiten(df.limit(0)).count() == 0
    assert embedding_whitening.whiten(df.where("vec_id IN (0, 11)")).count() == 0


def test_deviation_of_large_entries(spark):
    df = spark.createDataFrame([(k, [v, -v, 1.0]) for k, v in enumerate([1e3, 2e7, 3e7, 1e12])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in embedding_whitening.whiten(df).where("component = 1").collect()}
    x = [[int(64 * v), int(-64 * v), 64] for v in (1e3, 2e7, 3e7, 1e12)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert got == {k: v if v < 1 << 63 else None for k, v in enumerate(want)}


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_spectra_by_rank_one_updates(size):
    draw = np.random.default_rng(size)
    x = np.floor(40 * draw.normal(size=(120, size)))
    x[::5] = x[0]
    parts = [embedding_whitening.Spectrum(size) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k % 2].add(row)
    for other in parts[1:]:
        parts[0].merge(other)
    away = x - x.mean(0)
    scatter, got = away.T @ away, parts[0]
    assert got.n == 120 and np.allclose(got.mean, x.mean(0))
    assert np.abs(got.vectors * got.values @ got.vectors.T - scatter).max() < 1e-10 * np.abs(scatter).max()
    assert np.abs(got.vectors.T @ got.vectors - np.eye(size)).max() < 1e-11


def test_secular_roots():
    draw = np.random.default_rng(8)
    for n in (1, 2, 9, 50):
        d, z = np.sort(draw.normal(size=n)), draw.normal(size=n) * 10 ** draw.uniform(-6, 1, n)
        near, x = embedding_whitening.secular_roots(d, z)
        assert np.allclose(d[near] + x, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), atol=1e-12 * (1 + z @ z))
