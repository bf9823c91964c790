"""Work still to be done: pairs to compare, records to grade, cases to build, and the requests for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ratewell.operators.selection import running

#: Labels of a case that meet in one task.
HOT_LABELS = 1024
#: Labels of a case that meet in one row.
ROW_LABELS = 64
#: What stands for a submission without hypotheses.
NO_HYPOTHESES = "(no hypotheses)"


def last_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in an order that must be total to be the same in every run."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def gather(cases: DataFrame, submissions: DataFrame, order: Sequence[str], labels: DataFrame | None = None) -> DataFrame:
    """Submissions of the given cases, one per case and label, the last of repeats."""
    found = submissions.join(cases.select("case_id"), "case_id", "left_semi")
    if labels is not None:
        found = found.join(labels.select("label"), "label", "left_semi")
    return last_of(found, ["case_id", "label"], order)


def pairs(gathered: DataFrame) -> DataFrame:
    """Unordered pairs of labels of each case, each once: model_a < model_b. Both sides share one partitioning.

    The labels of a case with more than HOT_LABELS are dealt to blocks by their hash, and each pair of blocks is a key of
    its own, so no task has more than that many labels squared.
    """
    hot = gathered.groupBy("case_id").agg(F.ceil(F.count(F.lit(1)) / HOT_LABELS).cast("int").alias("_blocks")).where("_blocks > 1")
    cut = gathered.select("case_id", "label").join(hot, "case_id", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    own, every = F.pmod(F.xxhash64("label"), F.col("_blocks")).cast("int"), F.sequence(F.lit(0), F.col("_blocks") - 1)
    left = cut.select("case_id", F.col("label").alias("model_a"), own.alias("_a"), F.explode(every).alias("_b"))
    right = cut.select("case_id", F.col("label").alias("model_b"), F.explode(every).alias("_a"), own.alias("_b"))
    return left.join(right, ["case_id", "_a", "_b"]).where("model_a < model_b").select("case_id", "model_a", "model_b")


def drawn_points(size: str, seed: str, rounds: int = 12) -> str:
    """SQL: the points about which the rounds of a seeded shuffle of the whole numbers below size mirror them."""
    return f"transform(sequence(1, {rounds}), r -> CAST(conv(substring(md5(concat_ws(':', {seed}, r)), 1, 13), 16, 10) AS BIGINT) % {size})"


def shuffled_place(place: str, size: str, seed: str, rounds: int = 12, points: str | None = None) -> str:
    """SQL: where a seeded shuffle of the whole numbers below size puts one of them; others go elsewhere.

    In each round a number and its mirror image about a drawn point are swapped if a bit that the larger one draws says so.
    points: a column of drawn_points, which all numbers of a shuffle share.
    """
    mirror = f"pmod(z.p - x, {size})"
    bit = f"ascii(md5(concat_ws(':', {seed}, z.r, greatest(x, {mirror})))) % 2 = 1"
    turns = f"transform({points or drawn_points(size, seed, rounds)}, (p, i) -> struct(p, i + 1 AS r))"
    return f"aggregate({turns}, {place}, (x, z) -> CASE WHEN {bit} THEN {mirror} ELSE x END)"


def drawn_pairs(gathered: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most so many different pairs of each case's labels, and flipped, whether the later label is shown first.

    A case of L labels has L (L - 1) / 2 pairs, numbered row by row of a triangle. A seeded shuffle of the numbers gives
    the first `most` places, which are decoded to two places among the sorted labels and joined to these: work of labels
    plus drawn pairs, however many pairs there are.
    """
    placed = running(gathered.select("case_id", "label").distinct().withColumn("_one", F.lit(1)), ["case_id"], "label", {"_place": "_one"})
    sizes = placed.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").selectExpr("case_id", "_n * (_n - 1) div 2 AS _size")
    numbers = sizes.selectExpr("case_id", "_size", drawn_points("_size", f"'{seed}', case_id") + " AS _points")
    numbers = numbers.selectExpr("case_id", "_size", "_points", f"explode(sequence(0L, least(_size, {most}L) - 1)) AS _k")
    numbers = numbers.selectExpr("case_id", "_k", shuffled_place("_k", "_size", f"'{seed}', case_id", points="_points") + " AS _t")
    # row j of the triangle begins at j (j - 1) / 2; the root is put right by one where it is rounded
    row = numbers.selectExpr("case_id", "_k", "_t", "CAST(floor((1 + sqrt(1 + 8.0D * _t)) / 2) AS BIGINT) AS _j")
    row = row.selectExpr("case_id", "_k", "_t", "_j + CASE WHEN _j * (_j - 1) div 2 > _t THEN -1 WHEN _j * (_j + 1) div 2 <= _t THEN 1 ELSE 0 END AS _j")
    ends = row.selectExpr("case_id", "_t - _j * (_j - 1) div 2 AS _i", "_j", f"ascii(md5(concat_ws(':', '{seed}', case_id, 'side', _k))) % 2 = 1 AS flipped")
    at = lambda name, place: placed.select("case_id", F.col("_place").alias(place), F.col("label").alias(name))
    return ends.join(at("model_a", "_i"), ["case_id", "_i"]).join(at("model_b", "_j"), ["case_id", "_j"]).select("case_id", "model_a", "model_b", "flipped")


def mixed_hash(seed: int, *columns: Column) -> Column:
    """A seeded hash of whole numbers by modular arithmetic, the same in any SQL engine."""
    found = F.lit(seed).cast("long")
    for c in columns:
        found = (found * 1103515 + c * 12345 + 97) % 1000003
    return found


def sample_pairs(gathered: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """drawn_pairs with the two labels in the order in which they are shown."""
    turned = lambda a, b: F.when(F.col("flipped"), F.col(b)).otherwise(F.col(a))
    return drawn_pairs(gathered, most, seed).select("case_id", turned("model_a", "model_b").alias("model_a"), turned("model_b", "model_a").alias("model_b"))


def pending_pairs(found: DataFrame, done: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Pairs that have been compared in neither order."""
    ends = lambda df: df.withColumn("_lo", F.least("model_a", "model_b")).withColumn("_hi", F.greatest("model_a", "model_b"))
    on = [*keys, "_lo", "_hi"]
    return ends(found).join(ends(done).select(*on), on, "left_anti").drop("_lo", "_hi")


def compared_pairs(gathered: DataFrame, done: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Pairs of a case's labels that have been compared, each once: keys, lo, hi. What is pending can be counted from these without making all pairs."""
    ends = done.select(*keys, F.least("model_a", "model_b").alias("lo"), F.greatest("model_a", "model_b").alias("hi")).where("lo < hi").distinct()
    for end in ("lo", "hi"):
        ends = ends.join(gathered.select(*keys, F.col("label").alias(end)), [*keys, end], "left_semi")
    return ends.select(*keys, "lo", "hi")


def meetings(gathered: DataFrame, done: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """A row per case that has its labels, with all other columns, and its compared pairs: keys, _a, _b, labels, met.

    Rows take the place of pairs in shuffles, and labels and compared pairs are dealt to cases together. The labels of a
    case with more than ROW_LABELS go to blocks by their hash, and each pair of blocks is a row of its own, so no row has
    more than twice that many labels, or pairs than their square.
    """
    more = [c for c in gathered.columns if c not in keys]
    label = gathered.select(*keys, F.struct(*more).alias("m"), F.lit(None).cast("struct<lo:string,hi:string>").alias("d"))
    pair = done.select(*keys, F.lit(None).cast(label.schema["m"].dataType).alias("m"), F.struct(F.least("model_a", "model_b").alias("lo"), F.greatest("model_a", "model_b").alias("hi")).alias("d"))
    rows = label.unionByName(pair).dropna(subset=list(keys))
    rows = rows.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.count("m").over(W.partitionBy(*keys)) / ROW_LABELS)).cast("int"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("_blocks")).cast("int")
    others = F.when(F.col("d").isNull(), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(own("d.hi")))
    rows = rows.select(*keys, "m", "d", F.when(F.col("d").isNull(), own("m.label")).otherwise(own("d.lo")).alias("_own"), F.explode(others).alias("_other"))
    rows = rows.select(*keys, "m", "d", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    # as windows over rows that lie in this order: aggregates would sort them twice, and write each list between
    each = W.partitionBy(*keys, "_a", "_b").orderBy(keys[0])
    whole = each.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = [F.collect_list(F.when(F.col("d").isNull(), F.struct("_own", "m.*"))).over(whole).alias("labels"), F.collect_set("d").over(whole).alias("met"), F.row_number().over(each).alias("_place")]
    return rows.select(*keys, "_a", "_b", *found).where("_place = 1").where(F.size("labels") > 1).drop("_place").repartition(*keys, "_a", "_b")


def opened(meetings: DataFrame) -> DataFrame:
    """The pairs of the rows' labels, each once, as columns a and b with a.label < b.label; compared: in either order. The rows' other columns stay."""
    both = meetings.withColumn("a", F.explode("labels")).withColumn("b", F.explode("labels"))
    both = both.where(F.expr("a.label < b.label AND (_a = _b OR a._own <> b._own)"))
    return both.withColumn("compared", F.array_contains("met", F.struct(F.col("a.label").alias("lo"), F.col("b.label").alias("hi")))).drop("labels", "met", "_a", "_b")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def record_key(id_: Column, case_id: Column) -> Column:
    """id, or case_id where id is missing or empty; null where both are."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(id_), some(case_id))


def every(rows: DataFrame, registry: DataFrame, most: int = 10_000) -> DataFrame:
    """Each row with each entry of a registry. A registry of up to `most` entries goes to every task; a larger one is dealt out."""
    if registry.limit(most + 1).count() <= most:
        return rows.crossJoin(F.broadcast(registry))  # the product is what is asked for
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    return dealt.join(registry.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), "_part").drop("_part")


def missing(rows: DataFrame, registry: DataFrame, done: DataFrame, most: int = 10_000, key: str = "case_id") -> DataFrame:
    """Each row (the key of a case and others) with each label of a registry that its case has no row of in done.

    Labels met are gathered by case, at most as many as the registry has, so pairs of cases and labels are not shuffled;
    a registry of more than `most` entries meets the cases by joins.
    """
    if registry.limit(most + 1).count() > most:
        return pending(every(rows, registry, most), done, [key, "label"])
    met = done.select(key, "label").join(F.broadcast(registry.select("label").distinct()), "label", "left_semi")
    have = met.groupBy(key).agg(F.collect_set("label").alias("_have"))
    wanted = rows.join(have, key, "left").crossJoin(F.broadcast(registry.agg(F.collect_set("label").alias("_labels"))))
    left = F.array_except("_labels", F.coalesce("_have", F.array().cast("array<string>")))
    return wanted.withColumn("label", F.explode(left)).drop("_have", "_labels")


def missing_counts(rows: DataFrame, registry: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    """How many rows missing gives for each row, as n, where there are any."""
    names = registry.select("label").distinct()
    met = done.select(key, "label").distinct().join(names, "label", "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_met"))
    wanted = rows.join(met, key, "left").crossJoin(F.broadcast(names.agg(F.count("label").alias("_all"))))  # one row
    return wanted.withColumn("n", F.col("_all") - F.coalesce("_met", F.lit(0))).where("n > 0").drop("_met", "_all")


def block(hypotheses: Column) -> Column:
    """Numbered hypotheses (category, hypothesis, evidence) as one text, the category where there is one."""

    def one(h: Column, i: Column) -> Column:
        category = F.when(F.coalesce(h["category"], F.lit("")) != "", F.concat(F.lit("["), h["category"], F.lit("] "))).otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), category, h["hypothesis"], F.lit("\nEvidence: "), h["evidence"])

    # one or two, as most have, without a lambda, which is slow
    few = [F.concat_ws("\n", *[one(F.get(hypotheses, F.lit(i)), F.lit(i)) for i in range(n)]) for n in (1, 2)]
    n = F.size(hypotheses)
    return F.when(n == 1, few[0]).when(n == 2, few[1]).when(n > 2, F.array_join(F.transform(hypotheses, one), "\n")).otherwise(NO_HYPOTHESES)


def _context() -> Column:
    return F.concat(F.lit("Context:\n"), "context")


def _chars(*parts: Column | str) -> Column:
    """How long the text of these parts is, from lengths that were counted where the parts were made once."""
    return sum((F.lit(len(x)) if isinstance(x, str) else x for x in parts), F.lit(len("Context:\n")) + F.col("context_chars")).cast("long")


def with_chars(texts: DataFrame, name: str) -> DataFrame:
    """Counts the characters of a text, which takes longer than to copy it, before it is joined to rows that share it."""
    return texts.withColumn(f"{name}_chars", F.length(name))


def with_context(rows: DataFrame, texts: DataFrame, on: str) -> DataFrame:
    """Rows with the context that they name, empty where there is none, and its characters."""
    return rows.join(with_chars(texts, "context"), on, "left").na.fill({"context": "", "context_chars": 0})


def arena_requests(meetings: DataFrame, keys: Sequence[str] = ("case_id",)) -> DataFrame:
    """Two requests per pair that has not been compared, one for each order, with context and both blocks, and their characters.

    Rows of meetings have a context, and their labels a block, both with_chars. Pairs are made where texts have been joined,
    so that neither pairs nor texts of cases are shuffled.
    """
    first, second = "\n\nA:\n", "\n\nB:\n"
    text = lambda a, b: F.concat(_context(), F.lit(first), F.col(f"{a}.block"), F.lit(second), F.col(f"{b}.block")).alias("prompt")
    ways = F.array(*[F.struct(F.lit(way).alias("direction"), text(a, b)) for way, a, b in (("forward", "a", "b"), ("reverse", "b", "a"))])
    names = [*keys, F.col("a.label").alias("model_a"), F.col("b.label").alias("model_b"), _chars(first, F.col("a.block_chars"), second, F.col("b.block_chars")).alias("n_chars")]
    return opened(meetings).where("NOT compared").select(*names, F.explode(ways).alias("w")).select(*keys, "model_a", "model_b", "w.*", "n_chars")


def score_requests(found: DataFrame, texts: DataFrame, blocks: DataFrame, shown: Column, reference: str = "reference", key: str = "case_id", on: str = "case_id") -> DataFrame:
    """A request per submission (key, label, on), and its characters; where shown holds, with the reference's block, unless that has no hypotheses. Blocks are with_chars."""
    own = blocks.where(F.col("label") == reference).where(F.col("block") != NO_HYPOTHESES).select(key, F.col("block").alias("reference_block"), F.col("block_chars").alias("reference_chars"))
    rows = with_context(found.join(blocks, [key, "label"]).join(own, key, "left"), texts, on)
    first, second, last = "\n\nSubmission:\n", "\n\nReference:\n", shown & F.col("reference_block").isNotNull()
    prompt = F.concat(_context(), F.lit(first), "block", F.when(last, F.concat(F.lit(second), "reference_block")).otherwise(""))
    return rows.select(key, "label", prompt.alias("prompt"), _chars(first, F.col("block_chars"), F.when(last, F.col("reference_chars") + len(second)).otherwise(0)).alias("n_chars"))


def generation_prompts(contexts: DataFrame) -> DataFrame:
    """The request for each context, with the other columns: it is the same for all labels, so it is made once."""
    return contexts.withColumn("prompt", F.concat(F.lit("Write hypotheses with evidence for the context.\n\n"), _context())).drop("context")


def generation_requests(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """A request per case and label that has no submission."""
    return found.join(generation_prompts(contexts), "case_id").select("case_id", "label", "prompt")


def assemble(directions: DataFrame) -> DataFrame:
    """Matches from verdicts per direction; pairs with one direction only are not complete and stay out."""
    one = lambda d: directions.where(F.col("direction") == d).select("case_id", "model_a", "model_b", F.col("score").alias(d))
    return one("forward").join(one("reverse"), ["case_id", "model_a", "model_b"])
