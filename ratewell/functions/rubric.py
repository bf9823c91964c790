"""Scores of rubric records: pair_scores is an array of maps, set_scores a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rubric's dimensions.
PAIR_KEYS = ("grounding", "insight", "justification")
SET_KEYS = ("breadth", "distinctness", "utility")


def _mean(values: Column) -> Column:
    """Null for an empty array. The array is made once, for its sum and its size."""
    held = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(values, held, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))


def _of(scores: Column, keys: tuple[str, ...]) -> Column:
    return F.filter(F.array(*[scores[k] for k in keys]), lambda x: x.isNotNull())


def pair_mean(pairs: Column, keys: tuple[str, ...] | None = PAIR_KEYS) -> Column:
    """The mean over pairs that are not empty of each pair's mean, which is 0 without known keys; 0 without pairs.

    keys=None takes all keys that a pair has.
    """
    some = F.filter(pairs, lambda p: F.size(p) > 0)
    each = F.transform(some, lambda p: F.coalesce(_mean(F.map_values(p) if keys is None else _of(p, keys)), F.lit(0.0)))
    return F.coalesce(_mean(each), F.lit(0.0))


def set_mean(scores: Column, keys: tuple[str, ...] | None = SET_KEYS) -> Column:
    return _mean(F.map_values(scores) if keys is None else _of(scores, keys))


def summary(q_pair: Column, q_set: Column, multi: Column) -> Column:
    return F.when(multi & q_set.isNotNull(), (q_pair + q_set) / 2).otherwise(q_pair)


def recall_of(text: Column) -> Column:
    """hits and total of "hits/total"; null unless both are whole numbers and total is positive; hits within total."""
    whole = r"^\s*([+-]?\d{1,9})\s*/\s*([+-]?\d{1,9})\s*$"
    number = lambda k: F.try_to_number(F.regexp_replace(F.regexp_extract(text, whole, k), r"^\+", ""), F.lit("S999999999")).cast("int")
    total, hits = number(2), number(1)
    return F.when(text.rlike(whole) & (total > 0), F.struct(F.greatest(F.lit(0), F.least(hits, total)).alias("hits"), total.alias("total")))


def recall_mismatch(recall: Column, expected: Column) -> Column:
    """Whether a recall counts other hypotheses than the reference has; its own number holds all the same."""
    return F.coalesce(recall["total"] != expected, F.lit(False))


def recall_ratio(recall: Column) -> Column:
    return F.when(recall["total"] > 0, recall["hits"] / recall["total"]).when(recall.isNotNull(), 0.0)
