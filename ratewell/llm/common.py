"""What the operators share: column expressions, the shared folder, and size-checked join sides."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: White space between words, as a regular expression class.
SPACES = r"[\x20\x09-\x0D]+"

#: Rows up to which a table of one row per source, item or rule is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 20_000
#: Bytes of such a table where its rows hold arrays.
BROADCAST_BYTES = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster must name a folder that its machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/ratewell-{kind}-{uuid.uuid4().hex}"


def settle(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(settled: DataFrame) -> None:
    """Drops a settled table that nothing will read again."""
    spark, at = settled.sparkSession, settled.sparkSession._jvm.org.apache.hadoop.fs.Path(settled._settled)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(column: str = "text") -> Column:
    """The words of a text, as an array; empty for null."""
    return F.array_remove(F.split(text_of(column), SPACES), "")


def unit_hash(seed: str, *columns: str) -> Column:
    """60 bits that depend on the seed and the columns only, the same in every run and engine that has md5."""
    parts = [F.lit(seed)] + [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a settled table for broadcast if it has few rows; a larger one is left to a shuffle join.

    weight: about the bytes of a row, where rows may be long; they must not sum to more than most.
    """
    few = df.limit(rows + 1).count() <= rows and (weight is None or (df.agg(F.sum(weight)).first()[0] or 0) <= most)
    return F.broadcast(df) if few else df


def key_of(column: str) -> Column:
    """A string key that keeps null apart from every value and sorts null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))


def fresh(docs: DataFrame, kind: str) -> str:
    """A column name that docs has not, whatever its case. Columns of docs keep their names and values beside it."""
    taken, name = {c.lower() for c in docs.columns}, f"_{kind}"
    while name in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, group: list[str], name: str, cells: int = 256) -> DataFrame:
    """Adds name: numbers from 1 for rows that are equal in group, whose columns hold no nulls, and stand for each other.

    A group is dealt out to cells by the row's place in the table, which must be settled; the running sum over a group's
    cells sees one row per cell. So no task gets a large group whole.
    """
    cell, held, before = (fresh(rows, k) for k in ("cell", "held", "before"))
    dealt = rows.withColumn(cell, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)))
    sums = dealt.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(held))
    sums = sums.withColumn(before, F.sum(held).over(W.partitionBy(*group).orderBy(cell)) - F.col(held)).drop(held)
    inner = F.row_number().over(W.partitionBy(*group, cell).orderBy(F.lit(0)))
    return dealt.withColumn(name, inner).join(sums, [*group, cell]).withColumn(name, F.col(name) + F.col(before)).select(*rows.columns, name)


def gathered(parts: DataFrame, merge: Callable, ddl: str, fan: int = 16) -> DataFrame:
    """Merges a settled table of partial results, one per task with the task's number in `part`, to one row.

    Only fan of them meet in a task, and what they give is as large as one; so nothing grows with the number of tasks.
    Every task must have given a row, so that the numbers have no gaps.
    """
    left = parts.count()
    while left > 1:
        groups = -(-left // fan)
        parts = settle(parts.withColumn("part", F.pmod("part", F.lit(groups)).cast("int")).groupBy("part").applyInArrow(merge, ddl), "merged")
        left = parts.count()
    return parts
