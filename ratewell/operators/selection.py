"""Order statistics and pair counts of groups of any size: histograms of cells, refined only where the answer lies.

No task takes in a large group. Order statistics shuffle counts of cells and never values; running sums see one row per
task of a range sort and the rows inside a task; signs of pairs come from a matrix of cell counts, and only the pairs
inside a strip of cells are counted row by row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.sources.logs import scratch

#: Cells of a histogram round, and of an axis of a pair matrix.
CELLS, AXIS = 1024, 256
#: Different points of a strip that one task counts, and rows of a group that one task sorts.
STRIP, FEW = 1 << 16, 1 << 14


def settled(df: DataFrame, kind: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected(rows: DataFrame, keys: Sequence[str], value: str, places: Mapping[str, str], times: str | None = None) -> DataFrame:
    """Per keys: n, and for every name in places the value at that place, from 0, of the sorted values.

    places: names and SQL of n, such as {"low": "(n - 1) div 2"}. times: how often each row counts. Groups of up to FEW
    rows are sorted and summed; in larger ones each round deals what lies between two bounds to cells of equal width and keeps the least and greatest value of the cell that holds the
    place as the next bounds, so an outlier costs one round. Null and NaN values are left out, and rows that count less
    than once; places beyond the values give null; a key without values has no row.
    """
    keys = list(keys)
    weight = F.lit(1).cast("long") if times is None else F.col(times).cast("long")
    rows = settled(rows.select(*keys, F.col(value).cast("double").alias("_v"), weight.alias("_w")).where("_v IS NOT NULL AND NOT isnan(_v) AND _w > 0"), "values")
    sizes = settled(rows.groupBy(*keys).agg(F.sum("_w").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_rows")), "sizes")
    picked = {name: F.expr(f"CAST({at} AS BIGINT)") for name, at in places.items()}
    few = rows.join(sizes.where(F.col("_rows") <= FEW).select(*keys, "n"), keys).withColumn("_upto", F.sum("_w").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    few = few.groupBy(*keys).agg(*[F.max(F.when((at >= F.col("_upto") - F.col("_w")) & (at < F.col("_upto")), F.col("_v"))).alias(name) for name, at in picked.items()])
    large = sizes.where(F.col("_rows") > FEW)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at.alias("at")) for name, at in picked.items()]))
    state = settled(large.withColumn("_p", each).where("_p.at BETWEEN 0 AND n - 1").select(*keys, F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at"), "_low", "_high"), "bounds")
    done = state.where("_low = _high")
    while state.where("_low < _high").limit(1).count():
        state = state.where("_low < _high")
        inside = rows.join(state, keys).where("_v BETWEEN _low AND _high")
        # halves, so that no difference is beyond a double; infinite bounds leave the middle in one cell
        part = F.nanvl((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2), F.lit(0.5))
        cell = F.when(F.col("_v") == F.col("_high"), CELLS - 1).when(F.col("_v") == F.col("_low"), 0).otherwise(F.least(F.greatest(F.floor(part * CELLS), F.lit(0)), F.lit(CELLS - 1)))
        counted = inside.groupBy(*keys, "_name", "_at", cell.cast("int").alias("_cell")).agg(F.sum("_w").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = F.sum("_c").over(W.partitionBy(*keys, "_name").orderBy("_cell")) - F.col("_c")
        held = counted.withColumn("_before", before).where("_before <= _at AND _at < _before + _c")
        state = settled(held.select(*keys, "_name", (F.col("_at") - F.col("_before")).alias("_at"), "_low", "_high"), "bounds")
        done = done.unionByName(state.where("_low = _high"))
    found = done.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in places])
    return sizes.select(*keys, "n").join(few.unionByName(found), keys, "left")


def medians(rows: DataFrame, keys: Sequence[str], values: Sequence[str], times: str | None = None) -> DataFrame:
    """Per keys the exact median of each column of values, null where it has none."""
    keys = list(keys)
    long_ = rows.select(*keys, *([times] if times else []), F.explode(F.array(*[F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("v")) for v in values])).alias("_x"))
    long_ = long_.select(*keys, *([times] if times else []), F.col("_x.of").alias("_of"), F.col("_x.v").alias("_value"))
    found = selected(long_, [*keys, "_of"], "_value", {"_a": "(n - 1) div 2", "_b": "n div 2"}, times)
    middle = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_of") == v, middle)).alias(v) for v in values])


def running(rows: DataFrame, keys: Sequence[str], value: str, amounts: Mapping[str, str]) -> DataFrame:
    """Adds for each name the sum of a column over the rows of the same keys with a smaller value; a value has one row.

    The tasks of a range sort are the cells: sums over a group's cells see a row per task, those inside a cell its rows.
    """
    keys = list(keys)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = settled(rows.repartitionByRange(parts, *keys, value).withColumn("_cell", F.spark_partition_id()), "cells")
    sums = dealt.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_{n}") for n, c in amounts.items()])
    sums = sums.select(*keys, "_cell", *[(F.sum(f"_{n}").over(W.partitionBy(*keys).orderBy("_cell")) - F.col(f"_{n}")).alias(f"_{n}") for n in amounts])
    inner = W.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(sums, [*keys, "_cell"]).withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in amounts.items()})
    return out.drop("_cell", *[f"_{n}" for n in amounts])


def signs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over pairs of points, w times each, of the sign of how x and y differ together: bit by bit of x's rank.

    At each bit the points whose ranks first differ there are those of a run of equal upper bits, in which the ones with
    the bit stand after those without; y's order and running sums of w count them.
    """
    _, rank = np.unique(x, return_inverse=True)
    _, y = np.unique(y, return_inverse=True)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        run = rank >> (bit + 1)
        order = np.lexsort((y, run))
        r, v, a, one = run[order], y[order], w[order], (rank[order] >> bit & 1).astype(bool)
        zero = np.where(one, 0, a)
        upto = np.append(0, np.cumsum(zero))
        new = np.append(True, (r[1:] != r[:-1]) | (v[1:] != v[:-1]))
        tie = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(r))
        begins = np.append(True, r[1:] != r[:-1])
        start = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        end = np.append(np.flatnonzero(begins)[1:], len(r))[np.cumsum(begins) - 1]
        less, more = upto[first][tie] - upto[start], upto[end] - upto[last][tie]
        total += int(sum((a[one] * (less - more)[one]).tolist()))
    return total


def _matrix_signs(pdf: pd.DataFrame) -> int:
    """The same over the cells of a matrix: only cells that differ in both axes."""
    x, i = np.unique(pdf["_cx"].to_numpy(), return_inverse=True)
    y, j = np.unique(pdf["_cy"].to_numpy(), return_inverse=True)
    held = np.zeros((len(x), len(y)), np.int64)
    np.add.at(held, (i, j), pdf["_w"].to_numpy(np.int64))
    above = np.vstack([np.zeros((1, len(y)), np.int64), held.cumsum(0)[:-1]])  # points of smaller x
    upto = above.cumsum(1)
    less, more = upto - above, upto[:, -1:] - upto
    return int(sum((held * (less - more)).ravel().tolist()))


def _cells_of(points: DataFrame, keys: list[str], axis: str, name: str) -> DataFrame:
    """Cells of about equally many points along an axis, in its order; a value that fills one by itself has it alone (odd)."""
    counts = points.groupBy(*keys, axis).agg(F.sum("_w").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.ceil(F.sum("_n") / AXIS).alias("_size"))
    placed = running(counts, keys, axis, {"_before": "_n"}).join(sizes, keys)
    heavy = F.when(F.col("_n") > F.col("_size"), 1).otherwise(0)
    return placed.select(*keys, axis, (F.expr("_before div _size") * 2 + heavy).cast("long").alias(name))


def signed_pairs(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per keys: s, concordant less discordant pairs of (x, y). Rows without either are left out.

    Groups of up to STRIP different points are counted in one task each. Larger ones are cut into cells along both axes.
    Pairs in cells that differ in both come from the matrix of cell counts; what is left, pairs inside one cell of x,
    and pairs inside one cell of y with x taken by its cell, are groups of their own in the next round, smaller by AXIS.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    ddl = ", ".join([*(f"{k} {types[k]}" for k in keys), "s decimal(38,0)"])
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_w"))
    points = settled(points.withColumn("_path", F.lit("")), "points")
    one = lambda pdf, s: pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"s": [Decimal(s)]})
    by = [*keys, "_path"]
    found = []
    while points.limit(1).count():
        sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_points"))
        small = points.join(sizes.where(F.col("_points") <= STRIP).select(*by), by, "left_semi")
        found.append(settled(small.groupBy(*by).applyInPandas(lambda pdf: one(pdf, signs(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), pdf["_w"].to_numpy(np.int64))), ddl), "signs"))
        large = settled(points.join(sizes.where(F.col("_points") > STRIP).select(*by), by, "left_semi"), "large")
        if not large.limit(1).count():
            break
        placed = large.join(_cells_of(large, by, "_x", "_cx"), [*by, "_x"]).join(_cells_of(large, by, "_y", "_cy"), [*by, "_y"])
        placed = settled(placed, "placed")
        matrix = placed.groupBy(*by, "_cx", "_cy").agg(F.sum("_w").alias("_w"))
        found.append(settled(matrix.groupBy(*by).applyInPandas(lambda pdf: one(pdf, _matrix_signs(pdf)), ddl), "signs"))
        inside = lambda name, cell: F.concat("_path", F.lit(f"/{name}"), F.col(cell).cast("string")).alias("_path")
        # in a cell of one value all pairs are tied
        strips = placed.where("_cx % 2 = 0").select(*keys, inside("x", "_cx"), "_x", "_y", "_w")
        across = placed.where("_cy % 2 = 0").groupBy(*keys, inside("y", "_cy"), F.col("_cx").cast("double").alias("_x"), "_y").agg(F.sum("_w").alias("_w"))
        points = settled(strips.unionByName(across), "points")
    every = found[0] if found else rows.sparkSession.createDataFrame([], ddl)
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys).agg(F.sum("s").alias("s"))


def tied_pairs(rows: DataFrame, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Per keys: how many pairs are equal in all of by."""
    counts = rows.groupBy(*keys, *by).agg(F.count(F.lit(1)).cast("decimal(19,0)").alias("_c"))
    return counts.groupBy(*keys).agg(F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias(name))


def kendall(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Per keys: n and tau-b, in which pairs tied in both stay in the total and in neither count of ties; null without variance."""
    keys = list(keys)
    rows = settled(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), "pairs")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    for name, by in (("_tx", [x]), ("_ty", [y]), ("_both", [x, y])):
        out = out.join(tied_pairs(rows, keys, by, name), keys)
    out = out.join(signed_pairs(rows, keys, x, y), keys)
    n, d = F.col("n").cast("double"), lambda c: F.col(c).cast("double")
    all_ = n * (n - 1) / 2
    under = F.sqrt((all_ - (d("_tx") - d("_both"))) * (all_ - (d("_ty") - d("_both"))))
    return out.select(*keys, "n", F.round(F.try_divide(d("s"), under), 6).alias("tau"))


#: Counts up to which draws are exact, and the terms of their distribution that are kept.
EXACT, TERMS = 30, 90


def resampled(rows: DataFrame, keys: Sequence[str], value: str, replicates: int, seed: int = 42, digits: int = 6) -> DataFrame:
    """Bootstrap samples of each group's values as keys, replicate, value and times; a value that is not drawn has no row.

    A value that stands c times is drawn a Poisson number of times of mean c, by a seeded hash of its group, the
    replicate and itself: replicates times different values of work, however many rows there are. Up to EXACT that is
    the distribution's quantile at the hash, over it the nearest whole number to a normal draw of the same mean and
    variance. Values count as rounded to digits; null and NaN values are left out.
    """
    keys, spark = list(keys), rows.sparkSession
    rounded = F.round(F.col(value).cast("double"), digits)
    counts = rows.select(*keys, rounded.alias(value)).where(f"`{value}` IS NOT NULL AND NOT isnan(`{value}`)").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    logs = spark.range(1, EXACT + 1).crossJoin(spark.range(TERMS + 1).withColumnRenamed("id", "k")).select(F.col("id").alias("_c"), "k", F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0).alias("ln"))
    upto = W.partitionBy("_c").orderBy("k")
    terms = logs.withColumn("p", F.exp(F.col("k") * F.ln("_c") - F.col("_c") - F.sum("ln").over(upto))).withColumn("cdf", F.sum("p").over(upto))
    table = terms.groupBy("_c").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("_cdf"))
    drawn = counts.join(F.broadcast(table), "_c", "left").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    whole = F.round(F.col(value) * 10**digits).cast("long").cast("string")
    hashed = drawn.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("replicate").cast("string"), whole).cast("binary")))
    unit = lambda at: (F.conv(F.substring("_h", at, 13), 16, 10).cast("long") + F.lit(0.5)) / 2.0**52
    normal = F.sqrt(F.ln(unit(1)) * -2) * F.cos(unit(14) * 6.283185307179586)
    few = F.transform(F.array(unit(1)), lambda u: F.size(F.filter("_cdf", lambda x: x < u)))[0]
    times = F.when(F.col("_c") <= EXACT, few).otherwise(F.greatest(F.lit(0), F.floor(F.col("_c") + F.sqrt("_c") * normal + 0.5))).cast("long")
    return hashed.select(*keys, "replicate", value, times.alias("times")).where("times > 0")
