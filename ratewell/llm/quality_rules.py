"""Quality rules: text statistics and a decision list learned from labelled rows by sequential covering.

Each rule is a conjunction of thresholds on statistics. A rule grows one condition at a time by information gain on the
growing rows, is pruned on the others, and is kept if it is precise there; the rows that it covers then leave and the
next rule is learned. The list becomes one ordered conditional expression, so applying it is a projection. Counts come
from Spark: a growth step reads one histogram of (statistic, bin) and nothing larger reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratewell.llm.common import settle, text_of, words_of

#: Statistics that rules may use, all but the first relative to the text's size.
STATISTICS = ("n_words", "mean_word", "symbol_part", "dup_line_part", "repeat_part", "capital_part", "mark_part", "digit_part")


#: Words of a text up to which its windows are sorted as single numbers.
LONG = 4096


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.limit) if self.above else F.col(self.name) < F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.above else '<'} {self.limit:.6g}"


Rule = tuple[Condition, ...]


def holds(rule: Rule) -> Column:
    found = F.lit(True)
    for condition in rule:
        found = found & condition.column()
    return found


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, also inside nested functions."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three words that the text has twice or more.

    A window is 64 bits: the upper ones of its hash over as many lower ones as its position needs. Sorted, equal
    windows are neighbours; the positions of those, sorted again, give the length of the union of their windows. In
    texts of over LONG words, where too few bits of the hash would be left, whole hashes and positions are sorted.
    """

    def count(w: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(w) + 1)).cast("int")) - 1
        window = lambda i, mask: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

        def neighbours(s: Column, mask: Column) -> Column:
            upper = lambda x: x.bitwiseAND(F.bitwise_not(mask))
            twice = lambda x, i: ((i > 0) & (upper(F.get(s, i - 1)) == upper(x))) | F.coalesce(upper(F.get(s, i + 1)) == upper(x), F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x.bitwiseAND(mask)))

        def covered(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]

        def with_mask(mask: Column) -> Column:
            windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(i, mask)))
            return _bind(windows, lambda s: _bind(neighbours(s, mask), covered))

        def whole(n: Column) -> Column:
            windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("at"))))
            same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            again = lambda s: F.filter(s, lambda x, i: ((i > 0) & same(s, x, F.greatest(i - 1, F.lit(0)))) | same(s, x, i + 1))
            return _bind(windows, lambda s: _bind(F.sort_array(F.transform(again(s), lambda x: x["at"])), covered))

        return F.when(F.size(w) > LONG, _bind(F.size(w), whole)).when(F.size(w) >= 3, _bind(low, with_mask)).otherwise(F.lit(0).cast("long"))

    return _bind(words, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and STATISTICS of every text."""
    text = text_of()
    without = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    counted = docs.select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        _bind(words_of(), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))).alias("by_word"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("by_line"),
        without(r"\p{Lu}+").alias("n_capitals"),
        without(r"[!?]+").alias("n_marks"),
        without(r"[0-9]+").alias("n_digits"),
    ).select("*", "by_word.*", "by_line.*").drop("by_word", "by_line")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        part("word_chars", "n_words").alias("mean_word"), part("n_symbols", "n_chars").alias("symbol_part"), part("n_dup_lines", "n_lines").alias("dup_line_part"),
        part("n_repeat_words", "n_words").alias("repeat_part"), part("n_capitals", "n_chars").alias("capital_part"), part("n_marks", "n_chars").alias("mark_part"), part("n_digits", "n_chars").alias("digit_part"),
    )


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(rows: DataFrame, limits: dict[str, list[float]], p0: int, n0: int) -> tuple[float, Condition] | None:
    """The condition with the most gain among all statistics and limits."""
    bins = F.array(*[F.struct(F.lit(name).alias("name"), sum(((F.col(name) >= x).cast("int") for x in at), F.lit(0)).alias("bin")) for name, at in limits.items()])
    cells = rows.select("bad", F.explode(bins).alias("cell")).groupBy("cell.name", "cell.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    counts = {(r["name"], r["bin"]): (r["p"], r["n"]) for r in cells.collect()}  # at most statistics x bins rows
    found = []
    for name, at in limits.items():
        for j, limit in enumerate(at):
            p = sum(counts.get((name, b), (0, 0))[0] for b in range(j + 1))
            n = sum(counts.get((name, b), (0, 0))[1] for b in range(j + 1))
            found += [(_gain(p, n, p0, n0), Condition(name, False, limit)), (_gain(p0 - p, n0 - n, p0, n0), Condition(name, True, limit))]
    best = max(found, key=lambda x: (x[0], x[1].name, x[1].above, -x[1].limit), default=None)
    return best if best and best[0] > 0 else None


def _counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
    """For each conjunction: bad rows and good rows that it covers."""
    cells = [F.sum(F.when(holds(r), x).otherwise(0)) for r in rules for x in (F.col("bad"), 1 - F.col("bad"))]
    got = [int(x or 0) for x in rows.agg(*cells).first()]
    return list(zip(got[::2], got[1::2], strict=True))


def learn(stats: DataFrame, labels: DataFrame, *, bins: int = 24, longest: int = 3, most: int = 8, precision: float = 0.9, support: int = 10) -> list[Rule]:
    """The rules, in order, each of which rejects a document.

    stats is settled; labels has doc_id and quality (1 good, 0 bad, null ignored; 0 wins where a document has both).
    Rows that the base rules reject are left out. Two thirds of the rows, by hash, grow rules and the rest prune them.
    A rule must reach the precision and the support on both. Without labels, or without bad rows, there are no rules.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    rows = stats.where(~F.col("base_failed")).join(marked, "doc_id").withColumn("grows", F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2)
    rows = settle(rows.select("bad", "grows", *STATISTICS), "labelled")
    parts = [i / bins for i in range(1, bins)]
    # limits between the classes matter most, so those of the bad rows are added to those of all
    cuts = rows.agg(*[F.percentile_approx(x, parts).alias(f"{s}_{k}") for s in STATISTICS for k, x in (("all", F.col(s)), ("bad", F.when(F.col("bad") == 1, F.col(s))))]).first()
    limits = {s: sorted({*(cuts[f"{s}_all"] or ()), *(cuts[f"{s}_bad"] or ())}) for s in STATISTICS}
    rules: list[Rule] = []
    left = rows
    while len(rules) < most:
        growing, others = left.where("grows"), left.where("not grows")
        (p, n), rule = _counts(growing, [()])[0], ()
        if p < support:
            break
        while len(rule) < longest and n:
            step = _best(growing.where(holds(rule)), limits, p, n)
            if not step:
                break
            rule = (*rule, step[1])
            p, n = _counts(growing, [rule])[0]
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        if not shorter:
            break
        scored = list(zip(_counts(others, shorter), _counts(growing, shorter), shorter, strict=True))
        (p, n), (gp, gn), rule = max(scored, key=lambda x: ((x[0][0] - x[0][1]) / max(1, sum(x[0])), -len(x[2])))
        if gp < support or gp < precision * (gp + gn) or p < precision * (p + n) or p == 0:
            break
        rules.append(rule)
        left = left.where(~holds(rule))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number, from 1, of the first rule that holds; null where none does."""
    if not rules:
        return F.lit(None).cast("int")
    found = F.when(holds(rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        found = found.when(holds(rule), k)
    return found


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of docs: the statistics, base_failed, the rule that rejects it (null: none) and kept.

    A null or empty text has no words and so fails the base rules; a null doc_id is judged like any other; repeated rows
    are judged alike; an empty table gives no rows. Other columns of docs are not read.
    """
    stats = settle(statistics(docs), "statistics")
    rule = verdict(learn(stats, labels, **options))
    return stats.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that neither the base rules nor the learned list reject, with all their columns."""
    names = docs.columns
    rules = learn(settle(statistics(docs), "statistics"), labels, **options)
    kept = docs.withColumn("_text_statistics", F.struct("*"))
    # the statistics again, in one pass over the rows instead of a join that moves the texts
    judged = statistics_beside(kept, "_text_statistics").withColumn("_rule", verdict(rules)).where(~F.col("base_failed") & F.col("_rule").isNull())
    return judged.select(*[F.col("_text_statistics")[n].alias(n) for n in names])


def statistics_beside(docs: DataFrame, beside: str) -> DataFrame:
    """statistics() with one more column of docs carried along."""
    carried = docs.select(F.struct(F.col(beside).alias("row"), F.col("doc_id").alias("id")).alias("doc_id"), "text")
    return statistics(carried).withColumn(beside, F.col("doc_id.row")).withColumn("doc_id", F.col("doc_id.id"))
