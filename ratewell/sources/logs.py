"""Append-only logs of JSON lines, one file tree for all domains, and leaderboards as documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_CORRUPT = "_corrupt"


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster must name a folder that its machines share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ratewell-{kind}-{uuid.uuid4().hex}"


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of a schema; unknown fields are left out and blank lines skipped, a bad line raises, no file is no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are none): a line that can't be read is kept aside."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    kept = StructType([*schema.fields, StructField(_CORRUPT, StringType())])
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", kept, how).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    return lines.where(~bad).select(*[F.col(f"r.`{n}`").alias(n) for n in schema.names]), lines.where(bad).select(F.col("value").alias("line"))


def with_file_label(rows: DataFrame) -> DataFrame:
    """Adds config and profile from file names like .../{config}+{profile}.jsonl, mode from the folder, and the label.

    A name is cut at its first plus; rows of files without one are left out.
    """
    place = F.regexp_replace(F.col("_metadata.file_path"), r"/part-[^/]*$", "")  # a folder of parts stands for a file
    last = lambda k: F.url_decode(F.replace(F.element_at(F.split(place, "/"), -k), F.lit("+"), F.lit("%2B")))
    mode, stem = last(2), F.regexp_replace(last(1), r"\.jsonl$", "")
    out = rows.select("*", stem.alias("_stem"), mode.alias("mode")).where(F.instr("_stem", "+") > 0)
    out = out.withColumn("config", F.substring_index("_stem", "+", 1)).withColumn("profile", F.regexp_replace("_stem", r"^[^+]*\+", ""))
    return out.withColumn("label", F.concat_ws(":", "mode", "profile")).drop("_stem")


def discover_runs(names: DataFrame, configs: DataFrame, suffix: str) -> DataFrame:
    """domain, config and judge of result files called {config}.{judge}{suffix}.

    Both parts may have dots: the longest known config that begins the name is taken. A name that is a config alone,
    or that begins with none, is no run.
    """
    stems = names.where(F.col("name").endswith(suffix)).withColumn("prefix", F.expr(f"left(name, length(name) - {len(suffix)})"))
    # each beginning of a name that ends before a dot or with it, to be met by equal configs
    parts = F.split("prefix", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    met = stems.withColumn("config", F.explode(begins)).join(configs.select("config").distinct(), "config")
    best = F.row_number().over(W.partitionBy("domain", "name").orderBy(F.desc(F.length("config"))))
    found = met.withColumn("_best", best).where("_best = 1 AND prefix <> config")
    return found.select("domain", "config", F.expr("substring(prefix, length(config) + 2)").alias("judge")).distinct()


def append(rows: DataFrame, path: str, by: Sequence[str] = ("domain", "judge")) -> None:
    """Adds rows to a log, in folders by key, as gzip files that readers of the log open by their names; a job that fails leaves nothing behind."""
    rows.write.mode("append").partitionBy(*by).option("compression", "gzip").json(path)


def document(board: DataFrame, keys: Sequence[str], breakdown: Sequence[str]) -> DataFrame:
    """One row per leaderboard: its keys, sizes and the ranked entries as an array."""
    entry = F.struct("rank", "model", "rating", "n_observations", F.struct(*breakdown).alias("breakdown"))
    return board.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), F.sum("n_observations").alias("n_observations"), F.array_sort(F.collect_list(entry)).alias("rankings"))


def rows_of(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents back to a row per entry."""
    return documents.select(*keys, F.explode("rankings").alias("e")).select(*keys, "e.rank", "e.model", "e.rating", "e.n_observations", "e.breakdown.*")


#: What a manifest says of a version: its number and the folder of its documents.
_MANIFEST = "version long, folder string"


def _committed(spark: SparkSession, store: str) -> DataFrame:
    if not _exists(spark, f"{store}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")


def put_documents(documents: DataFrame, store: str, keys: Sequence[str]) -> int:
    """Writes one JSON document per row under a new version, and commits it by a manifest; returns the version.

    A version may have some keys only: of the others the documents of earlier versions stay. Its folder has a name of its
    own and counts for nothing until the manifest names it, so a writer that fails, at whatever point, leaves what was
    there readable; of two writers of one version the second raises.
    """
    spark = documents.sparkSession
    version = int(_committed(spark, store).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]) + 1
    folder = f"{store}/documents/v{version}-{uuid.uuid4().hex}"
    documents.write.partitionBy(*keys).json(folder)
    spark.createDataFrame([(version, folder)], _MANIFEST).coalesce(1).write.parquet(f"{store}/manifest/number={version}")
    return version


def read_documents(spark: SparkSession, store: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """The newest committed document of every key, nested as written, with its version; no store is no rows."""
    versions = sorted((r["version"], r["folder"]) for r in _committed(spark, store).collect())  # a row a version
    out = spark.createDataFrame([], StructType([*schema.fields])).withColumn("version", F.lit(0).cast("long"))
    for version, folder in versions:
        new = spark.read.schema(schema).json(folder).select(*schema.names).withColumn("version", F.lit(version).cast("long"))
        out = out.unionByName(new)
    newest = out.groupBy(*keys).agg(F.max("version").alias("version"))
    return out.join(newest, [*keys, "version"]).select(*schema.names, "version")
