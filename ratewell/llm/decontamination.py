"""Benchmark decontamination: MinHash containment search, partitioned by item size, then exact containment.

An item's sketch is its smallest shingle hashes: one more than it may lack at the wanted containment, so a document
that contains the item has one of them for certain. Items are partitioned by size, since that number grows with it. A
document asks a partition only if it has shingles enough for its smallest item, and with its hashes up to the largest
sketch value of that partition; these meet the partition's sketches. Pairs that meet are compared by whole shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import fresh, key_of, settle, small_side, text_of, words_of


def _bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shingle_hashes(words: int, column: str = "text") -> Column:
    """Hashes of a text's word shingles, a-z for A-Z, repeats kept; the whole of a shorter text is its one shingle."""
    lower = F.transform(words_of(column), lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    def hashes(w: Column) -> Column:
        long_ = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(F.size(w) >= words, long_).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _bind(lower, hashes)


def item_sketches(items: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(item_key, item_id, shingles, size, band; the sketch entries: band, hash, item_key)."""
    sets = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(words))).alias("shingles")).where(F.size("shingles") > 0)
    sets = sets.withColumn("item_key", F.monotonically_increasing_id()).withColumn("size", F.size("shingles"))
    # sizes from 2^band to 2^(band+1) - 1 share a partition and its sketch length
    sets = settle(sets.withColumn("band", F.floor(F.log2("size")).cast("int")), "items")
    largest = F.call_function("shiftleft", F.lit(1), F.col("band") + 1) - 1
    length = F.least(F.col("size"), F.floor(largest * (100 - percent) / 100).cast("int") + 1)
    entries = sets.select("band", "item_key", F.explode(F.slice("shingles", F.lit(1), length)).alias("hash"))
    return sets, settle(entries, "sketches")


def _asked(found: Column, band: int, most: int, least: int) -> Column:
    """Of a document (n shingles; low: hashes up to the largest limit) what it asks a partition: (band, hash)."""
    low = F.transform(F.filter(found["low"], lambda x: x <= most), lambda x: F.struct(F.lit(band).alias("band"), x.alias("hash")))
    return F.when(found["n"] >= least, low).otherwise(F.array().cast("array<struct<band:int,hash:bigint>>"))


def search(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of documents and the items that they contain: doc_id, item_id, n_matched, n_shingles (the item's).

    A document contains an item if it has percent of 100 of the item's distinct shingles or more. Items without words
    are in no document; an item of fewer than `words` words is one shingle, which only an equally short equal text has.
    Null texts contain nothing. Rows with equal doc_id or item_id give one pair, the best; a null id is an id. An empty
    table on either side gives no pairs. Other columns are not read.
    """
    found = _contained(docs, items, words, percent, ["doc_key"])
    best = F.max(F.struct((F.col("n_matched") / F.col("n_shingles")).alias("part"), "n_matched", "n_shingles")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_matched", "best.n_shingles")


def _contained(docs: DataFrame, items: DataFrame, words: int, percent: int, keys: list[str]) -> DataFrame:
    """search before repeated ids are put together, with doc_key and text_hash; keys of these tell rows apart on the way."""
    texts = docs.select("doc_id", key_of("doc_id").alias("doc_key"), F.xxhash64(text_of()).alias("text_hash"), "text")
    sets, entries = item_sketches(items, words, percent)
    bands = sets.groupBy("band").agg(F.min("size").alias("least")).join(entries.groupBy("band").agg(F.max("hash").alias("top")), "band")
    limits = sorted((r["band"], r["top"], -(-r["least"] * percent // 100)) for r in bands.collect())  # one row per power of two
    if not limits:
        return texts.limit(0).select("doc_id", "doc_key", "text_hash", F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_matched"), F.lit(0).alias("n_shingles"))
    top = max(x for _, x, _ in limits)
    asks = _bind(shingle_hashes(words), lambda h: _bind(F.struct(F.size(h).alias("n"), F.filter(h, lambda x: x <= top).alias("low")), lambda x: F.flatten(F.array(*[_asked(x, *limit) for limit in limits]))))
    kept = texts.select(*keys, F.explode(asks).alias("ask")).select(*keys, "ask.*")
    pairs = settle(kept.join(small_side(entries), ["band", "hash"]).select(*keys, "item_key").distinct(), "candidates")
    asked = settle(pairs.groupBy(*keys).agg(F.collect_set("item_key").alias("item_keys")), "asked")
    wanted = texts.join(small_side(asked, weight=F.size("item_keys") * 8 + 128), keys)
    sketch = wanted.select("doc_id", "doc_key", "text_hash", F.array_distinct(shingle_hashes(words)).alias("own"), F.explode("item_keys").alias("item_key"))
    both = sketch.join(small_side(sets.select("item_key", "item_id", "shingles", "size"), weight=F.col("size") * 8 + 64), "item_key")
    counted = both.select("doc_id", "doc_key", "text_hash", "item_id", F.size(F.array_intersect("own", "shingles")).alias("n_matched"), F.col("size").alias("n_shingles"))
    return counted.where(F.col("n_matched") * 100 >= F.col("n_shingles") * percent)


def clean(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no item, with all their columns; rows that share an id, or have none, count each alone.

    Null and empty texts contain nothing and stay; repeated rows stay or go together. Without items all rows stay; an
    empty table gives no rows. Columns of any name keep their values.
    """
    keys = [fresh(docs, "found_key"), fresh(docs, "found_hash")]
    found = _contained(docs, items, words, percent, ["doc_key", "text_hash"])
    found = settle(found.select(F.col("doc_key").alias(keys[0]), F.col("text_hash").alias(keys[1])).distinct(), "found")
    marked = docs.withColumns({keys[0]: key_of("doc_id"), keys[1]: F.xxhash64(text_of())})
    return marked.join(small_side(found), keys, "left_anti").select(*[F.col(f"`{n}`") for n in docs.columns])
