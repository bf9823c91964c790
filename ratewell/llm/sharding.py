"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; the fractional rank (rank - 1/2) / n puts the
sources into one order in which every stretch has the mixture of the whole; cutting that order into equal stretches
gives shards with the mixture. Ranks and places come from counts of hash buckets and rank cells plus a row number
inside each, so neither a large source nor the whole table is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.llm.common import key_of, numbered, settle, small_side, text_of, unit_hash

HASH_BITS = 60


def _placed(rows: DataFrame, group: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """Adds name: the place of a row, from 1, in its group's order, in which cells come first.

    Group and cell deal out the rows. The running sum over a group's cells sees one row per cell.
    """
    cells = rows.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*group).orderBy(cell)) - F.col("_rows")
    inner = F.row_number().over(W.partitionBy(*group, cell).orderBy(*order))
    return rows.withColumn("_inner", inner).join(cells.withColumn("_before", before).drop("_rows"), [*group, cell]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_before", "_inner")


def interleave(docs: DataFrame, shards: int = 16, seed: str = "shards", cells: int = 4096, cell_rows: int = 100_000) -> DataFrame:
    """Per row of docs: doc_id, source, size (UTF-8 bytes + 1), text_crc32, place (from 0), shard and slot.

    Shards differ by one row at most; slots run from 0 without gaps. A null text has size 1 and crc 0, a null source is a
    source of its own, rows that are equal in doc_id, source and text are interchangeable; equal or null doc_ids are no
    matter, as texts and the numbers of equal rows count in the seeded order too. cells, more where a cell would have
    over cell_rows rows, bounds a histogram. An empty table gives no rows. Other columns of docs are not read.
    """
    rows = settle(
        docs.select(
            "doc_id", "source", key_of("source").alias("key"), (F.octet_length(text_of()) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"), F.md5(F.concat_ws(":", key_of("doc_id"), key_of("source"), F.md5(text_of().cast("binary"))).cast("binary")).alias("identity"),
        ),
        "rows",
    )
    rows = settle(numbered(rows, ["identity"], "copy").withColumn("h", unit_hash(seed, "identity", "copy")).drop("identity"), "numbered")
    whole = rows.count()
    cells = max(cells, 1 << (whole // cell_rows).bit_length())
    bits = HASH_BITS - (cells - 1).bit_length()
    order = ["h", "doc_id", "text_crc32", "size", "copy"]
    ranked = _placed(rows.withColumn("bucket", F.shiftright("h", bits)), ["key"], "bucket", order, "rank")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    part = ((F.col("rank") - 0.5) / F.col("n")).alias("part")
    spread = settle(ranked.join(small_side(settle(sizes, "sizes")), "key").select("doc_id", "source", "key", "size", "text_crc32", "copy", "h", part), "spread")
    spread = spread.withColumn("cell", F.floor(F.col("part") * cells)).withColumn("all", F.lit(0))
    placed = _placed(spread, ["all"], "cell", ["part", "key", *order], "at").withColumn("place", F.col("at") - 1)
    shard = F.expr(f"place * {shards} div {max(whole, 1)}")
    start = F.expr(f"(shard * {whole} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("place") - start).select("doc_id", "source", "size", "text_crc32", "place", "shard", "slot")
