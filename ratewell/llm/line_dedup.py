"""Line dedup by pairwise alignment.

Documents that share a rare line are aligned by patience diff over line hashes, and the lines of aligned blocks are
deleted from the later one. No group of documents meets in pairs: every line first leads to the earliest document that
has it, a common line to the earliest with the same neighbours as well. Only what stands after that goes on: a rare line
that stands is tried with all earlier documents that have it, and a document in which a common line stands with all that
share a rare line with it. So the deleted lines are those that all pairs with shared rare lines would give. Only hashes
are shuffled until texts are rewritten.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import key_of, settle, small_side, text_of

_BLANK = r"^[\x20\x09-\x0D]*$"
#: A line in more places is common.
COMMON = 100
#: Documents of one partner that are aligned in one task.
DEAL = 1000


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b): common ends of a stretch, then the longest rising run of lines that are unique in
    both stretches, then the stretches between these in turn."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, int] = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        twice: dict[int, int] = {}
        for j in range(b0, b1):
            if a[i := once.get(b[j], -1)] == b[j] and i >= 0:
                twice[b[j]] = -1 if b[j] in twice else j
        pairs = sorted((once[x], j) for x, j in twice.items() if j >= 0)
        # longest run of pairs that also rises in b
        ends, at, before = [], [], [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            p = bisect_left(ends, j)
            before[k] = at[p - 1] if p else -1
            ends[p : p + 1] = [j]
            at[p : p + 1] = [k]
        run, k = [], at[-1] if at else -1
        while k >= 0:
            run.append(pairs[k])
            k = before[k]
        if not run:
            continue
        i0, j0 = a0, b0
        for i, j in reversed(run):
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def _aligned(least: int):
    """Rows sorted by task, the earlier document (no row) before the later ones, in; rows and deleted places out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, theirs = None, []
        for batch in batches:
            rows, places = [], []
            for first, part, row, ours, blank in zip(*(batch[c].to_pylist() for c in ("first", "part", "row", "lines", "blank")), strict=True):
                if row is None:
                    task, theirs = (first, part), ours
                    continue
                if task != (first, part):
                    raise ValueError(f"no lines of document {first}")
                block: list[int] = []
                gone: list[int] = []
                last = (-2, -2)
                void = set(blank)
                for i, j in [*patience(theirs, ours), (-9, -9)]:
                    if (i, j) != (last[0] + 1, last[1] + 1):
                        if sum(k not in void for k in block) >= least:
                            gone += block
                        block = []
                    block.append(j)
                    last = (i, j)
                if gone:
                    rows.append(row)
                    places.append(gone)
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "places": pa.array(places, pa.list_(pa.int32()))})

    return run


def _documents(docs: DataFrame) -> DataFrame:
    """row, doc_id, doc_key, text_hash, lines (hashes) and blank (places of lines without words) of different documents."""
    lines = F.split(text_of(), "\n")
    hashed = docs.select("doc_id", key_of("doc_id").alias("doc_key"), F.xxhash64(text_of()).alias("text_hash"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"), F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_BLANK), i)), lambda i: i.isNotNull()).alias("blank"))
    once = settle(hashed, "lines").groupBy("doc_key", "text_hash").agg(*[F.first(c).alias(c) for c in ("doc_id", "lines", "blank")])
    return settle(once.withColumn("row", F.monotonically_increasing_id()), "line_rows")


def shared_lines(found: DataFrame) -> DataFrame:
    """at (doc_id and row), place, line, three (hash of the line and its neighbours), n and first of every line that two
    documents have: in how many places it stands, and the earliest document that has it."""
    around = F.arrays_zip("lines", F.concat(F.array(F.lit(0).cast("long")), "lines").alias("before"), F.concat(F.slice("lines", 2, F.size("lines")), F.array(F.lit(0).cast("long"))).alias("after"))
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("at")
    places = found.select(at, "blank", F.posexplode(F.slice(around, F.lit(1), F.size("lines"))).alias("place", "line")).where(~F.array_contains("blank", F.col("place")))
    places = settle(places.select("at", "place", F.col("line.lines").alias("line"), F.xxhash64("line.before", "line.lines", "line.after").alias("three")), "places")
    return settle(places.join(settle(_firsts(places, "line"), "firsts"), "line"), "shared")


def _firsts(places: DataFrame, key: str) -> DataFrame:
    return places.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").select(key, "n", "first")


def first_pairs(shared: DataFrame, rare: int = COMMON) -> DataFrame:
    """Pairs (row, first) of documents with the earliest that has one of their lines, a common one between the same two."""
    common = shared.where(F.col("n") > rare).select("at", "three")
    pairs = shared.select("at", "first").union(common.join(_firsts(common, "three"), "three").select("at", "first"))
    return pairs.where("at <> first").select("at.row", F.col("first.row").alias("first")).distinct()


def further_pairs(shared: DataFrame, tried: DataFrame, gone: DataFrame, rare: int = COMMON) -> DataFrame:
    """Pairs (row, first) that were not tried, for lines that stand: gone has the deleted places of each row.

    A rare line has at most `rare` places, so a line that stands asks for less than that many.
    """
    deleted = gone.select(F.col("row").alias("_row"), "deleted")
    stands = settle(shared.where("at <> first").join(deleted.hint("merge"), F.col("at.row") == F.col("_row"), "left").where(~F.coalesce(F.array_contains("deleted", F.col("place")), F.lit(False))).select("at", "line", "n"), "stands")
    few = shared.where(F.col("n") <= rare).select("at", "line")
    whole = few.join(stands.where(F.col("n") > rare).select("at").distinct(), "at", "left_semi")
    asks = stands.where(F.col("n") <= rare).select("at", "line").union(whole).distinct()
    met = asks.join(few.select("line", F.col("at").alias("first")).distinct(), "line").where("first < at")
    return met.select("at.row", F.col("first.row").alias("first")).distinct().join(tried, ["row", "first"], "left_anti")


def _compared(found: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """row and places that the alignment of each pair deletes. The earlier document goes once to each of its tasks."""
    hot = settle(pairs.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("parts")), "firsts")
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(small_side(hot.where("parts > 1")), "first", "left").select("row", "first", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
    ours = found.select("row", "lines", "blank").join(dealt.hint("merge"), "row").select("first", "part", "row", "lines", "blank")
    theirs = found.select(F.col("row").alias("first"), "lines").join(hot.hint("merge"), "first")
    theirs = theirs.select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("row"), "lines", F.array().cast("array<int>").alias("blank"))
    tasks = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = ours.union(theirs).repartition(tasks, "first", "part").sortWithinPartitions("first", "part", F.asc_nulls_first("row"))
    return both.mapInArrow(_aligned(least), "row long, places array<int>")


def deduplicate(docs: DataFrame, rare: int = COMMON, least: int = 1) -> DataFrame:
    """Per row of docs: doc_id, text without deleted lines, n_lines, n_deleted and deleted (places of lines, from 0).

    rare: in how many places a line may stand to be rare. least: lines with words in a block that is deleted. Texts are
    split at \\n; a line is compared as written, white space included. Of two documents that with the greater doc_id is
    the later one, null last; rows with equal doc_id count in an order that is fixed within a run, and rows equal in
    doc_id and text are one document, treated alike. A null text is empty: one blank line, never deleted. An empty table
    gives no rows. Other columns of docs are not read.
    """
    found = _documents(docs)
    shared = shared_lines(found)
    tried = settle(first_pairs(shared, rare), "pairs")
    united = lambda rows: rows.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("deleted"))
    gone = settle(united(_compared(found, tried, least)), "deleted")
    more = settle(further_pairs(shared, tried, gone, rare), "further_pairs")
    gone = united(gone.select("row", F.col("deleted").alias("places")).union(_compared(found, more, least)))
    gone = settle(gone.join(found.select("row", "doc_key", "text_hash"), "row").select("doc_key", "text_hash", "deleted"), "gone")
    texts = docs.select("doc_id", "text", key_of("doc_id").alias("doc_key"), F.xxhash64(text_of()).alias("text_hash"))
    # a merge join at every size: neither side has a bound that would allow a broadcast
    joined = texts.join(gone.hint("merge"), ["doc_key", "text_hash"], "left")
    lines = F.split(text_of(), "\n")
    # deleted places in order: the lines between them are kept
    cuts = F.concat(F.array(F.lit(-1)), F.col("deleted"))
    stretch = F.zip_with(cuts, F.concat(F.col("deleted"), F.array(F.size(lines))), lambda a, b: F.struct((a + 1).alias("from"), (b - a - 1).alias("n")))
    kept = F.transform(F.array(lines), lambda x: F.flatten(F.transform(stretch, lambda s: F.slice(x, s["from"] + 1, s["n"]))))[0]
    return joined.select(
        "doc_id", F.when(F.col("deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size(lines).alias("n_lines"), F.coalesce(F.size("deleted"), F.lit(0)).alias("n_deleted"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
    )
