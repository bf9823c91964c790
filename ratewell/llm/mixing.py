"""Mixing sources to target weights with hash-threshold histograms.

Word counts are summed by source and hash bucket; the bucket in which a source's budget ends is the only one that
is counted again, ten bits deeper, until it holds one document. Every document below the threshold is taken, so
nothing is sorted and each decision depends on the document and the threshold of its source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.llm.common import fresh, key_of, numbered, settle, small_side, text_of, unit_hash, words_of

HASH_BITS = 60


def source_targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: key, source_size, target, whole (times all is taken), rest (words still due).

    Sources in code point order, null last, take the weights in turn. The budget is share * all sizes. A target stops
    at cap * the source's size; what is cut off goes to the others by weight. In the order of cap / weight the sources
    that reach their cap come first, so two running sums give the level at which the rest is filled.
    """
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    weighed = sums.withColumn("place", F.row_number().over(W.orderBy("key"))).withColumn("weight", turn.cast("double"))
    weighed = weighed.withColumn("top", F.col("source_size") * F.lit(float(cap)))
    filled = W.orderBy(F.col("top") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("top").over(filled), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))).alias("open"),
    ).withColumn("level", F.col("left") / F.col("open"))
    first = F.min(F.when(F.col("top") > F.col("level") * F.col("weight"), F.struct(F.col("top") / F.col("weight"), "place", "level"))).over(everyone)
    target = F.least("top", F.coalesce(first["level"] * F.col("weight"), F.col("top")))
    size = F.col("source_size")
    return (
        level.withColumn("target", target)
        .withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
        .select("key", "source_size", "target", "whole", (F.col("target") - F.col("whole") * size).alias("rest"))
    )


def thresholds(sized: DataFrame, targets: DataFrame, bits: int = 10) -> DataFrame:
    """Adds to each source the hash below which its documents are taken once more.

    sized: key, size, h. Each round counts the documents of the boundary buckets only. It ends when each holds one
    document, or when the hash has no bits left: documents with equal hashes are taken or left together.
    """
    cuts = targets.select("key", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("need"))
    for used in range(bits, HASH_BITS + 1, bits):
        open_ = cuts.select("key", "need", F.col("prefix").alias("above"))
        inside = sized.withColumn("above", F.shiftright("h", HASH_BITS - used + bits)).join(open_, ["key", "above"])
        counted = inside.groupBy("key", "need", F.shiftright("h", HASH_BITS - used).alias("prefix")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")
        )
        before = F.sum("size").over(W.partitionBy("key").orderBy("prefix")) - F.col("size")
        cuts = settle(
            counted.withColumn("before", before)
            .where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("size")))
            .select("key", "prefix", (F.col("need") - F.col("before")).alias("need"), "size", "rows"),
            "cuts",
        )
        if (cuts.agg(F.max("rows")).first()[0] or 0) <= 1:
            break
    past = (F.col("need") * 2 >= F.col("size")).cast("long")
    ends = cuts.select("key", ((F.col("prefix") + past) * (1 << (HASH_BITS - used))).alias("cut"))
    return targets.join(ends, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


def _identity(others: list[str]) -> Column:
    """What tells a row apart: doc_id, source, the text's hash and the other columns."""
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.md5(text_of().cast("binary"))]
    return F.md5(F.concat_ws(":", *own, *([F.md5(F.to_json(F.struct(*others)).cast("binary"))] if others else [])).cast("binary"))


def plan(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", others: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(one row per document, with size, identity, copy, source_size, target and times; the thresholds, one row per source).

    The hash of a row depends on its doc_id, source, text and others; rows that are equal in these are numbered (copy).
    """
    sized = settle(docs.select("doc_id", key_of("source").alias("key"), F.size(words_of()).cast("long").alias("size"), _identity(list(others)).alias("identity")), "sized")
    sized = settle(numbered(sized, ["identity"], "copy").withColumn("h", unit_hash(seed, "identity", "copy")), "hashed")
    found = settle(thresholds(sized, settle(source_targets(sized, share, cap, weights), "targets")), "thresholds")
    times = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return sized.join(small_side(found), "key").withColumn("times", times), found


def allotment(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size (words), source_size, target (its source's) and taken (words, repeats counted).

    A null text has size 0, a null source is a source of its own. Rows with equal or null doc_id are decided one by one;
    of rows that are equal in doc_id, source and text reruns take equally many. Sources without words have target 0. An
    empty table gives no rows. Other columns of docs are not read.
    """
    found, _ = plan(docs, **options)
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The mixture itself: every column of docs, each row as often as the mix takes it (0 to cap times).

    Nulls, repeats and empty tables as in allotment, but rows are told apart by all columns. Columns of any name keep
    their values. Texts are not shuffled unless rows repeat in all columns; only these are numbered.
    """
    names = docs.columns
    identity, copy, key, whole, cut, one = (fresh(docs, k) for k in ("identity", "copy", "key", "whole", "cut", "one"))
    others = tuple(n for n in names if n.lower() not in ("doc_id", "source", "text"))
    sized, found = plan(docs, seed=seed, others=others, **options)
    rows = docs.withColumns({identity: _identity(list(others)), key: key_of("source")})
    again = settle(sized.where("copy = 2").select(F.col("identity").alias(identity)), "again")
    if again.limit(1).count():
        twice = settle(rows.join(small_side(again), identity), "twice")
        rows = rows.join(small_side(again), identity, "left_anti").withColumn(copy, F.lit(1)).unionByName(numbered(twice, [identity], copy))
    else:
        rows = rows.withColumn(copy, F.lit(1))
    ends = found.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("cut").alias(cut))
    times = F.col(whole) + (unit_hash(seed, identity, copy) < F.col(cut)).cast("long")
    return rows.join(small_side(ends), key).withColumn(one, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col(f"`{n}`") for n in names])
