"""A corpus pipeline over documents: each stage's rows are written as Parquet and read again by the next.

Every stage takes an empty table and returns one. All but the last return the columns of docs, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratewell.llm import decontamination, mixing, ngram_join, quality_rules, token_files
from ratewell.llm.common import settle


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    Null and empty texts have no words and go. Rows with a null or repeated doc_id are judged by their own texts, and
    repeated rows alike. Documents without a label are judged like the others; without labels only the base rules count.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 over five-word shingles hold together, the one with the least doc_id.

    A null doc_id comes last; ties go by text hash and then by the other columns, so repeated rows leave one. Texts
    without words are linked with nothing and stay.
    """
    return ngram_join.keep_first(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: four fifths or more of its five-word shingles.

    Rows are decided one by one, whatever ids they share or lack; repeated rows stay or go together. Null texts contain
    nothing; items without words are in nothing.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them, none to twice.

    A null source is a source of its own, a null text has no words. Rows that are equal in all columns are decided one by
    one, and reruns take equally many.
    """
    return mixing.mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token-ID files and returns what is read back from them, a row per row of docs.

    A null text is its end alone; null ids come first; rows with equal ids are all written.
    """
    return token_files.read_digests(token_files.write(docs))


STAGES = [
    ("quality rules", reject_by_rules),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("token-ID output", write_token_ids),
]

#: SQL states neither the learned rules nor token ids; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "_"))
    return docs
