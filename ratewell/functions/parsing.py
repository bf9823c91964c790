"""JSON out of model text: what built-in functions can read stays with them, and only the rest meets a repairing helper."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = r"(?s)```(?:json)?\s*(.*?)```"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_ESCAPE = re.compile(r'\\(["\\/bfnrtu])|\\')


def with_candidate(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the body of a code fence if there is one, from the first brace to the last. Each step is a column, made once."""
    found = rows.withColumn("_inside", F.when(F.col(text).rlike(_FENCE), F.regexp_extract(text, _FENCE, 1)).otherwise(F.col(text)))
    found = found.withColumn("_braces", F.regexp_extract("_inside", r"(?s)\{.*\}", 0))
    return found.withColumn(name, F.when(F.col("_braces") != "", F.col("_braces")).otherwise(F.trim("_inside"))).drop("_inside", "_braces")


def _escapes(t: str) -> str:
    """Doubles each backslash that begins no escape."""
    return _ESCAPE.sub(lambda m: m[0] if m[1] else "\\\\", t)


def _newlines(t: str) -> str:
    return _STRING.sub(lambda m: m[0].replace("\n", "\\n").replace("\r", "\\r"), t)


def _commas(t: str) -> str:
    return re.sub(r",(\s*[}\]])", r"\1", t)


#: In this order: the gentlest repair that makes the text JSON is used; what follows the first value is ignored.
_REPAIRS = ((), (_escapes,), (_newlines,), (_commas,), (_escapes, _commas), (_escapes, _newlines))


def repair(text: str | None) -> str | None:
    """The first JSON value of a text as JSON, after the first repair that works; null if none does."""
    for steps in _REPAIRS if text else ():
        fixed = text
        for step in steps:
            fixed = step(fixed)
        try:
            return json.dumps(json.JSONDecoder().raw_decode(fixed)[0])
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair, na_action="ignore")


def with_json(rows: DataFrame, text: str, name: str = "json") -> DataFrame:
    """Adds a column with the JSON of each text, null where there is none.

    The helper gets null for texts that parse as they are, so it works on the others only.
    """
    found = with_candidate(rows, text, "_cut")
    found = found.withColumn("_clean", F.try_parse_json("_cut").isNotNull())
    mended = _repaired(F.when(~F.col("_clean"), F.col("_cut")))
    return found.withColumn("_mended", mended).withColumn(name, F.when(F.col("_clean"), F.col("_cut")).otherwise(F.col("_mended"))).drop("_cut", "_clean", "_mended")


def names_of(text: Column, known: list[str], most: int = 3) -> Column:
    """Known names from a JSON array, or from the key skills of an object: trimmed, in order, without repeats, cut; null if none."""
    listed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(text, "skills array<string>")["skills"])
    kept = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isin(known))
    return F.when(F.size(kept) > 0, F.slice(F.array_distinct(kept), 1, most))


def hypotheses_of(text: Column) -> Column:
    """Hypotheses from an object with a list of them, or from one that is itself a hypothesis; null if it is neither.

    All need a hypothesis and evidence; those of a list a category too, which one by itself has not.
    """
    item = "struct<category:string,evidence:string,hypothesis:string>"
    many = F.from_json(text, f"hypotheses array<{item}>")["hypotheses"]
    one = F.from_json(text, "evidence string, hypothesis string")
    whole = F.forall(many, lambda h: F.coalesce((F.length(h["category"]) > 0) & h["evidence"].isNotNull() & h["hypothesis"].isNotNull(), F.lit(False)))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("category"), one["evidence"].alias("evidence"), one["hypothesis"].alias("hypothesis")))
    return F.when(many.isNotNull(), F.when(whole, many)).when(one["hypothesis"].isNotNull() & one["evidence"].isNotNull(), alone)
