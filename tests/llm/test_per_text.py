"""Operators that judge one text at a time, against plain statements of what they count."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from ratewell.llm import mixing, quality_classifier, quality_rules, secret_scan, sharding, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans(t):
    t = t or ""
    kinds = (
        [m.span() for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12],
        [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18],
        [m.span() for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16],
    )
    every = sorted((a, k, b) for k, found in enumerate(kinds) for a, b in found)
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in every]


def test_secret_spans(docs, empty, rows):
    base = F.concat("assign", "access", "hex")
    got = secret_scan.scan(docs).select("doc_id", secret_scan.listed(base)).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(r[0], ",".join(spans(r[1])))) for r in rows) or collections.Counter((r[0], r[1]) for r in got) == collections.Counter((r[0], ",".join(spans(r[1]))) for r in rows)
    assert secret_scan.scan(empty).count() == 0


def test_many_and_nested_secrets(spark):
    texts = ["token: secret: abcdefghijklmnop", "api_key='" + "a" * 12 + "' " * 3 + "\U0001f600 password=0123456789ab", "token=abcdefabcdef01234 " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in secret_scan.scan(df).select("doc_id", secret_scan.listed(F.concat("assign", "access", "hex"))).collect()}
    assert got == {k: ",".join(spans(t)) for k, t in enumerate(texts)}


def test_weak_parts_count_together_only(spark):
    part = "user=maria"
    run = "Zx81" + "kQ7w" * 6
    far = " word" * 100
    df = spark.createDataFrame([(0, part), (1, run), (2, f"{part} then {run}"), (3, part + far + " " + run), (4, f"https://x.example/a {run}")], "doc_id long, text string")
    got = {r["doc_id"]: sorted(s["kind"] for s in r["linked"]) for r in secret_scan.scan(df).collect()}
    assert got == {0: [], 1: [], 2: ["identifier", "random"], 3: [], 4: ["endpoint", "random"]}


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_statistics(docs, rows):
    got = collections.Counter((r[0], tuple(r)[1:]) for r in quality_rules.statistics(docs).select("doc_id", *NAMES).collect())
    assert got == collections.Counter((r[0], statistics(r[1])) for r in rows)


def test_rules_find_a_threshold(spark, empty):
    data = [(k, " ".join(f"w{(k * 7 + i * i) % 211}{'#' if k % 5 == 0 and i % 3 == 0 else ''}" for i in range(90 + k % 40)), k % 5 != 0) for k in range(400)]
    df = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(g), 0) for k, _, g in data] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(df, labels).collect()}
    assert sum(kept[k] == g for k, _, g in data) >= 0.98 * len(data)
    good = quality_rules.keep_good(df.withColumn("row", F.lit(1)), labels)
    assert good.columns == ["doc_id", "text", "row"] and {r["doc_id"] for r in good.collect()} == {k for k, v in kept.items() if v}
    assert quality_rules.judge(empty, labels).count() == 0
    assert quality_rules.judge(df, labels.limit(0)).where("rule IS NOT NULL").count() == 0


def test_classifier_holds_out_and_ranks(spark, small, docs, empty):
    documents, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality_classifier.score(documents, labels).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)).all()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    both = got.merge(labels.toPandas(), on="doc_id")
    good, bad = (both[both["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    odd = quality_classifier.score(docs, labels.withColumn("text", F.lit("x"))).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.score(empty, labels).count() == 0


def test_temperature_does_not_change_the_order():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 97))
    y = (x[:, 0] + draw.normal(size=600) > 0).astype(float)
    net = quality_classifier.train(x, y, epochs=8)
    assert (np.argsort(net.logits(x)) == np.argsort(net.scores(x))).mean() > 0.99
    assert quality_classifier.train(x[:4], np.ones(4)).scores(x[:1])[0] == 5 / 6


def test_mix_reaches_its_targets(spark, small, docs, rows, empty):
    docs_ = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.allotment(docs_).toPandas().merge(docs_.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (got["size"] == got["text"].map(lambda t: len(WORD.findall(t)))).all() and (got["taken"] <= 2 * got["size"]).all()
    size = got.groupby("source")["size"].sum()
    left, want = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size.index))}, {}
    while True:
        level = (1.5 * size.sum() - sum(want.values())) / sum(left.values())
        full = [s for s, w in left.items() if level * w > 2 * size[s]]
        for s in full:
            want[s] = 2.0 * size[s]
            del left[s]
        if not full:
            break
    want |= {s: level * w for s, w in left.items()}
    for s, part in got.groupby("source"):
        assert abs(part["target"].iloc[0] - want[s]) < 1e-6
        assert abs(part["taken"].sum() - want[s]) <= part["size"].max()
    again = mixing.allotment(docs_.repartition(5)).toPandas().set_index("doc_id")["taken"]
    assert (again.sort_index() == got.set_index("doc_id")["taken"].sort_index()).all()
    odd = mixing.allotment(docs).collect()
    assert len(odd) == len(rows) and mixing.allotment(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert sum(times.values()) == sum(r["taken"] // r["size"] for r in odd if r["size"]) + sum(times[r["doc_id"]] // sum(x["doc_id"] == r["doc_id"] for x in odd) for r in odd if not r["size"])


def test_shards(docs, rows, empty):
    got = sharding.interleave(docs, shards=4).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    per = collections.Counter((r["shard"], r["source"]) for r in got)
    for source, n in collections.Counter(r[3] for r in rows).items():
        assert all(abs(per[s, source] - n / 4) <= 2 for s in range(4))
    assert sharding.interleave(empty).count() == 0


def test_token_files(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", "a \x1c b", "d .\x1c\n1b e", "it's  they'll 'tis", "one\ttwo \n three", "né. 中文 b", " lead", "trail "]
    rows = [*rows, *((100 + k, t) for k, t in enumerate(more))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in rows[-len(more) :]], "doc_id long, text string"))
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 0]
    files = token_files.write(docs, docs_per_file=16)
    got = token_files.read_digests(files).collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((r[0], len(ids(r[1])), crc(ids(r[1]))) for r in rows)
    place = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == place
        place += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    wanted = spark.createDataFrame([(9,), (12,), (None,)], "doc_id long")
    found = {r["doc_id"]: r["ids"] for r in token_files.lookup(files, wanted).collect()}
    assert found == {k: ids(dict((r[0], r[1]) for r in rows)[k]) for k in (9, 12)}
    assert token_files.read_digests(token_files.write(empty)).count() == 0


def test_words_of_all_characters():
    """Words with control characters, marks and letters anywhere encode to what the library gives."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = token_files.Encoder("byte_bpe_50k.json")
    draw = random.Random(12)
    low = [chr(c) for c in range(128)]
    more = low + list("éßñŒ\x85\xa0\xad中\u2009\u0301\U0001f600")
    signs = [low] * 3 + [more, list("abcXYZ019 .,'")]
    texts = [" ^\x00", "'x;J #\x00lA7", "a\x7fb", *("".join(draw.choices(draw.choice(signs), k=draw.randrange(1, 12))) + draw.choice(["", " x", "\x00y z"]) for _ in range(100_000))]
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u2").tolist() for k in range(0, len(texts), 500) for x in encoder.encode(texts[k : k + 500])]
    wrong = [t for t, a, b in zip(texts, got, want, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:5])


def test_a_damaged_frame_is_noticed(docs):
    import pytest
    import zstandard

    path = token_files.write(docs.where("doc_id > 8"), docs_per_file=1000).first()["path"]
    raw = bytearray(open(path, "rb").read())
    assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(raw))
    raw[12] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(path).ids(0)


def test_many_rows_of_one_id(spark):
    """Rows that share an id, or have none, are told apart: files, shards and the mix share them out."""
    n = 3000
    texts = [None if k % 3 else 7 for k in range(n)]
    df = spark.createDataFrame([(i, f"w{k % 5} " * 10, "s") for k, i in enumerate(texts)], "doc_id long, text string, source string").repartition(3)
    files = token_files.write(df, docs_per_file=500)
    assert files.agg(F.max("n_docs")).first()[0] < 1500 and token_files.read_digests(files).count() == n
    assert token_files.lookup(files, spark.createDataFrame([(7,)], "doc_id long")).count() == n // 3
    taken = mixing.allotment(df, share=0.5).toPandas()
    assert abs(taken["taken"].sum() - taken["target"].iloc[0]) <= 10 and taken["target"].iloc[0] == n * 5
    shards = sharding.interleave(df, shards=4).groupBy("shard").count().collect()
    assert {r["count"] for r in shards} == {n // 4}


def test_columns_of_any_name(spark, docs):
    """Names that the operators use within are a user's own columns too."""
    names = ["_mix_key", "key", "identity", "copy", "cut", "whole", "one", "_one", "_key", "_identity", "_copy", "h", "row", "cell"]
    odd = docs.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert all(r[n] == f"{n}{'-' if r['doc_id'] is None else r['doc_id']}" for r in mixed.collect() for n in names)


def brute_links(text, scope=200):
    """Weak spans that have a complementary part, apart from them and at most scope away, and overlap no base span."""
    spans = []
    for kind, pattern in (("assign", secret_scan.ASSIGN), ("access", secret_scan.ACCESS), ("hex", secret_scan.HEX), ("identifier", secret_scan.IDENTIFIER), ("endpoint", secret_scan.ENDPOINT)):
        spans += [(*m.span(), kind) for m in re.finditer(pattern, text, re.ASCII) if kind != "assign" or len(m[2]) >= secret_scan.ASSIGN_LEAST]
    at = 0
    while at < len(text):  # endpoints are stepped over, so nothing inside one is a run
        m = re.compile(secret_scan.ENDPOINT).match(text, at) or re.compile(secret_scan.RANDOM).match(text, at)
        if m and "://" not in m[0] and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]")):
            spans.append((*m.span(), "random"))
        at = m.end() if m else at + 1
    role = secret_scan.KINDS
    base = [x for x in spans if x[2] in secret_scan.BASE]
    apart = lambda x, y: y[0] - x[1] if x[1] <= y[0] else x[0] - y[1] if y[1] <= x[0] else scope + 1
    near = lambda x: any(role[y[2]] in secret_scan.NEEDS[role[x[2]]] and apart(x, y) <= scope for y in spans)
    return {x for x in spans if x[2] not in secret_scan.BASE and near(x) and not any(b[0] < x[1] and x[0] < b[1] for b in base)}


def test_one_thing_is_no_pair(spark):
    """A part and what is written inside it are one thing; what stands beyond the scope of its end is not near."""
    run = "Xy9" + "aB3" * 7
    texts = [f"see login={run} here", "docs at https://example.com/Path/To/Some/Doc2024/page.html", f"login={run} and {run}", f"https://a.example/{run}/x {run}", "user=" + "q" * 300 + " " * 150 + run, "user=bob" + " " * 201 + run, "user=bob" + " " * 200 + run]
    got = {r["doc_id"]: sorted((s["kind"], s["start"]) for s in r["linked"]) for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[5] == []
    assert got[2] == [("identifier", 0), ("random", 35)]
    assert [k for k, _ in got[3]] == ["endpoint", "random"] and [k for k, _ in got[4]] == ["identifier", "random"] == [k for k, _ in got[6]]
    assert all({(s, k) for k, s in got[i]} == {(a, k) for a, _, k in brute_links(t)} for i, t in enumerate(texts))


def test_links_against_all_pairs(spark):
    draw = random.Random(21)
    pieces = ["user=bob7", "client_id: abc123", "Xy9" + "aB3" * 9, "https://db.example.org/x?u=1", "password=abcdefghijkl", "AKIA" + "B2" * 8, "0f" * 12, "token: short", "s3://bucket/key", "login = Ab0" + "Cd1" * 8]
    rows = [(k, "".join(draw.choice(pieces) + draw.choice([" ", "\n", " é" * draw.randrange(90), ";" + "x " * draw.randrange(120)]) for _ in range(draw.randrange(14)))) for k in range(120)]
    rows += [(200, "user=bob7 " + "Xy9" + "aB3" * 100 + " password=" + "q" * 900 + " https://a.b/c"), (201, " ".join(f"user=u{i}aB3" + "aB3" * 7 for i in range(4000)))]
    got = {r["doc_id"]: {(s["start"], s["stop"], s["kind"]) for s in r["linked"]} for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows[:-1]:
        assert got[doc_id] == brute_links(text), text
    assert any(got.values()) and not all(got.values())


def test_repeated_words_of_long_texts(spark, monkeypatch):
    """The way for long texts gives what the way for short ones gives, and both what the contract says."""
    draw = random.Random(6)
    rows = [(k, " ".join(f"w{draw.randrange(1 + 9 * k)}" for _ in range(draw.randrange(0, 300)))) for k in range(60)] + [(99, " ".join(f"w{draw.randrange(300)}" for _ in range(20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: statistics(t) for k, t in rows}
    for long_ in (10, quality_rules.LONG):
        monkeypatch.setattr(quality_rules, "LONG", long_)
        assert {r[0]: tuple(r)[1:] for r in quality_rules.statistics(df).select("doc_id", *NAMES).collect()} == want


def test_pooling_against_a_plain_sum(spark):
    """Word vectors are the sums of index vectors around all occurrences, whatever tasks and levels add them."""
    draw = random.Random(4)
    rows = [(k, " ".join(draw.choice(["aa", "Bb.", "cc!", "DD", "7"]) for _ in range(draw.randrange(40)))) for k in range(90)] + [(None, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(70)
    index, total = quality_classifier.index_vectors().astype(int), np.zeros((quality_classifier.ROWS, quality_classifier.WIDTH))
    for _, text in rows:
        word, form, mark, _ = (x.astype(int) for x in quality_classifier._rows([text]))
        for i in range(1, len(word) - 1):
            near = index[word[i - 1]] + index[form[i - 1]] + index[mark[i - 1]] + index[word[i + 1]] + index[form[i + 1]] + index[mark[i + 1]] + index[form[i]] + index[mark[i]]
            for row in (word[i], form[i], mark[i]):
                total[row] += near
    got = quality_classifier.word_vectors(df)[: quality_classifier.ROWS]
    assert np.allclose(got, total / np.maximum(1, np.sqrt((total**2).sum(1, keepdims=True))), atol=1e-5)


def test_learned_list_against_counts(spark, small):
    """On the given tables each learned rule reaches its precision and support among the rows that earlier ones leave."""
    documents, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality_rules.judge(documents, labels).toPandas()
    both = got[~got["base_failed"]].merge(labels.toPandas(), on="doc_id")
    assert (got["kept"] == (~got["base_failed"] & got["rule"].isna())).all()
    for _, part in both[both["rule"].notna()].groupby("rule"):
        assert len(part) >= 10 and (part["quality"] == 0).mean() >= 0.85
