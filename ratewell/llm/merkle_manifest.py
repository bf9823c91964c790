"""Merkle manifest of a dataset: a root hash for all rows, and for every row the siblings that prove it.

Rows are placed by a range sort, whose tasks number their own rows, so no group is sorted in one task. A level of a tree
is a slot pivot: conditional aggregates spread the children of each parent into one column a slot, the columns joined
in order are hashed to the parent, and the columns without a child's own are its siblings. Levels go in batches: the
nodes of a subtree of some levels are dealt to one task, where one sort serves all of them, as each ancestor's number is
a prefix of the order. So a batch costs one shuffle, and paths come down from subtree roots to nodes by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.llm.common import settle, small_side

#: Nodes of a subtree that is dealt to one task, at most.
SUBTREE = 256
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 length and itself, `-` for null."""
    as_text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The hash of a row of documents; changed: columns to be taken as something else."""
    return digest(*[field(changed.get(c, F.col(c))) for c in ("doc_id", "source", "lang", "n_chars", "text")])


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row from 0 in its group's order, and n, the rows of its group.

    Each task of a range sort numbers its rows; what joins them is one row per task and group. rows must be settled;
    ties are settled by the place of a row in it, so a much repeated row is dealt to many tasks too.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    dealt = settle(dealt.drop("_row").withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    held = dealt.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = W.partitionBy(group)
    before = F.sum("_rows").over(own.orderBy("_task")) - F.col("_rows") - F.col("_first")
    held = settle(held.select(group, "_task", before.alias("_shift"), F.sum("_rows").over(own).alias("n")), "held")
    return dealt.join(small_side(held), [group, "_task"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_shift")


def _depth(most: int, fanout: int) -> int:
    """Levels of the subtrees of a batch whose groups have `most` nodes at most: up to SUBTREE nodes, or all."""
    found = 1
    while fanout ** (found + 1) <= max(SUBTREE, fanout) and fanout**found < most:
        found += 1
    return found


def _dealt(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Nodes with the numbers of their ancestors, up1 (parent) and on, in the tasks of their subtrees."""
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ups = [f"pos div {fanout**k} AS up{k}" for k in range(1, depth + 1)]
    return nodes.selectExpr("*", *ups).repartition(parts, "key", f"up{depth}")


def _left(fanout: int, level: int) -> str:
    """How many nodes a group still has below a level's parents."""
    return f"(n + {fanout ** (level - 1) - 1}) div {fanout ** (level - 1)}"


def _cells(fanout: int, level: int, node: str, over: str = "") -> list[str]:
    """The slot pivot: a parent's children, one column a slot."""
    slot = f"{'pos' if level == 1 else f'up{level - 1}'} % {fanout}"
    return [f"max(CASE WHEN {slot} = {j} THEN {node} END){over} AS cell{j}" for j in range(fanout)]


def _joined(slots) -> str:
    found = [f"coalesce(cell{j}, '')" for j in slots]
    return f"concat({', '.join(found)})" if found else "''"


def _hashed(fanout: int, level: int) -> str:
    """A parent's hash; where one node was left below, that node itself."""
    return f"CASE WHEN {_left(fanout, level)} > 1 THEN sha2({_joined(range(fanout))}, 256) ELSE cell0 END"


def _tops(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The roots of all subtrees, as nodes: key, n, pos, hash."""
    found = _dealt(nodes.select("key", "n", "pos", "hash"), fanout, depth)
    for level in range(1, depth + 1):
        by = ["key", "n", *[f"up{k}" for k in range(depth, level - 1, -1)]]
        found = found.groupBy(*by).agg(*map(F.expr, _cells(fanout, level, "hash"))).selectExpr(*by, f"{_hashed(fanout, level)} AS hash")
    return found.selectExpr("key", f"{_left(fanout, depth + 1)} AS n", f"up{depth} AS pos", "hash")


def _paths(nodes: DataFrame, tops: DataFrame, fanout: int, depth: int, keep: list[str]) -> DataFrame:
    """keep of all nodes, and their siblings up to where the path of their subtree's root, in tops, ends."""
    above = tops.selectExpr("key", f"pos AS up{depth}", "path", "subroot", "root")
    found = _dealt(nodes, fanout, depth).join(above.hint("merge"), ["key", f"up{depth}"])
    names = found.columns
    found = found.selectExpr("*", f"CAST(array() AS {_PATH}) AS _steps", "hash AS _now")
    for level in range(1, depth + 1):
        family = " OVER (PARTITION BY " + ", ".join(["key", *[f"up{k}" for k in range(depth, level - 1, -1)]]) + ")"
        slot = f"{'pos' if level == 1 else f'up{level - 1}'} % {fanout}"
        siblings = lambda side, slot=slot: f"CASE {' '.join(f'WHEN {slot} = {j} THEN {_joined(side(j))}' for j in range(fanout))} END"
        step = f"array(named_struct('left', {siblings(lambda j: range(j))}, 'right', {siblings(lambda j: range(j + 1, fanout))}))"
        found = found.selectExpr("*", *_cells(fanout, level, "_now", family))
        found = found.selectExpr(*names, f"CASE WHEN {_left(fanout, level)} > 1 THEN concat(_steps, {step}) ELSE _steps END AS _steps", f"{_hashed(fanout, level)} AS _now")
    return found.selectExpr(*keep, "concat(_steps, path) AS path", "subroot", "root")


def _climbed(nodes: DataFrame, fanout: int) -> list[tuple[DataFrame, int]]:
    """Nodes and depth of every batch of levels; the last, of depth 0, has a single node in each group."""
    found = []
    while (most := nodes.agg(F.max("n")).first()[0] or 0) > 1:
        depth = _depth(most, fanout)
        found.append((nodes, depth))
        nodes = settle(_tops(nodes, fanout, depth), "nodes")
    return [*found, (nodes, 0)]


def _descended(batches: list[tuple[DataFrame, int]], paths: DataFrame, fanout: int, keep: list[str]) -> DataFrame:
    """keep of the nodes of the first batch, and their paths; paths: those of the last batch, by key and pos."""
    if len(batches) == 1:
        return batches[0][0].join(paths.drop("pos").hint("merge"), "key").selectExpr(*keep, "path", "subroot", "root")
    for nodes, depth in reversed(batches[1:-1]):
        paths = settle(_paths(nodes, paths, fanout, depth, ["key", "pos"]), "paths")
    return _paths(batches[0][0], paths, fanout, batches[0][1], keep)


def manifest(docs: DataFrame, fanout: int = 2, tampered: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, key (of its lang), place, leaf, seen, path, subroot and root.

    A leaf hashes doc_id, source, lang, n_chars and text. Per lang the leaves stand by doc_id, null first, then by their
    hash; each `fanout` consecutive nodes make a parent until one is left, and so do the subroots, by lang, null first.
    path: the siblings of each level, those left of the row's own node and those right of it. seen: the hash under which
    a row is found, its leaf, or with n_chars one more where `tampered` holds. Rows equal in all these columns have
    places of their own. Null and empty texts and nulls in any column differ. An empty table gives no rows. Other
    columns of docs are not read.
    """
    seen = leaf() if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)).otherwise(leaf())
    key = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    leaves = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf().alias("hash"), seen.alias("seen")), "leaves")
    nodes = settle(placed(leaves, "key", ["doc_id", "hash"]), "leaves_placed")
    batches = _climbed(nodes, fanout)

    # the subroots are the leaves of one more tree
    roots = settle(batches[-1][0].select(F.lit("").alias("key"), F.col("key").alias("lang"), "hash"), "subroots")
    over = _climbed(settle(placed(roots, "key", ["lang"]), "subroots_placed"), fanout)
    top = over[-1][0].select("key", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    told = _descended(over, top, fanout, ["lang", "hash"])
    told = settle(told.select(F.col("lang").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root"), "lang_paths")
    return _descended(batches, told, fanout, ["doc_id", "key", "pos AS place", "hash AS leaf", "seen"])


def folded(start: Column, path: Column) -> Column:
    """The root that a hash and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda h, step: digest(step["left"], h, step["right"]))


def proof(path: Column) -> Column:
    """The hash of all siblings, from the leaf's level to the root's."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def verified(docs: DataFrame, fanout: int = 2, tampered: Column | None = None) -> DataFrame:
    """Per row of docs: doc_id, place, leaf, subroot, root, proof_sha256, folded_root and verified.

    folded_root comes from the row as it is seen and the siblings of its path; a row that was changed does not verify.
    """
    found = manifest(docs, fanout, tampered).withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "place")
