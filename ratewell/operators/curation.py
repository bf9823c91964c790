"""Keeping the benchmark's tables in order: fingerprints, pruning, categories and the release."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def projected(domain: Column, metadata: Column) -> Column:
    """Metadata as released: two domains show a case number only, one of them with the agency as source."""
    text = lambda k: F.coalesce(metadata[k], F.lit(""))
    incident = F.create_map(F.lit("case_id"), text("report_id"), F.lit("title"), text("report_id"))
    safety = F.map_concat(F.create_map(F.lit("source"), text("agency")), incident)
    return F.when(domain == "it_operations", incident).when(domain == "safety_investigation", safety).otherwise(metadata)


def resolve_fingerprints(fingerprints: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs (fp, case_id) of fingerprints and the cases that have every one of their keys.

    fingerprints: fp, keys (map); cases: case_id, domain, metadata. A key is id, domain or one of the released metadata;
    a null value asks for a key that is absent or null. An empty fingerprint raises.
    """
    checked = fingerprints.select("fp", F.when(F.size("keys") == 0, F.raise_error(F.lit("a fingerprint without keys"))).otherwise(F.col("keys")).alias("keys"))
    fields = F.map_concat(F.create_map(F.lit("id"), F.col("case_id"), F.lit("domain"), F.col("domain")), F.map_filter(projected(F.col("domain"), F.col("metadata")), lambda k, _: ~k.isin("id", "domain")))
    held = cases.select("case_id", F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"))
    known = held.select("case_id", F.explode("fields").alias("key", "value"))
    # candidates by the rarest key that a fingerprint gives a value for: common ones, domain for instance, list too many cases
    rows = known.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    asked = checked.select("fp", F.explode("keys").alias("key", "value")).where("value IS NOT NULL")
    rarest = asked.join(rows, ["key", "value"]).groupBy("fp").agg(F.min(F.struct("n", "key", "value")).alias("at")).select("fp", "at.key", "at.value")
    candidates = rarest.join(known, ["key", "value"]).select("fp", "case_id")
    # a fingerprint that asks for absence alone meets the kinds of cases, by the names of their fields, and then their cases
    absent = checked.where(F.forall(F.map_values("keys"), lambda v: v.isNull())).select("fp", F.array_sort(F.map_keys("keys")).alias("absent"))
    shape = F.array_sort(F.map_keys("fields")).alias("shape")
    kinds = held.select(shape).distinct().join(absent.select("absent").distinct(), ~F.arrays_overlap("shape", "absent"))
    without = absent.join(kinds, "absent").select("fp", "shape").join(held.select("case_id", shape), "shape").select("fp", "case_id")
    met = candidates.join(checked, "fp").join(held, "case_id").where(F.forall(F.map_entries("keys"), lambda e: F.col("fields")[e["key"]].eqNullSafe(e["value"])))
    return met.select("fp", "case_id").union(without)


def audit(fingerprints: DataFrame, found: DataFrame) -> DataFrame:
    """Cases per fingerprint: one is ok, none is missed, more are ambiguous."""
    hits = found.groupBy("fp").agg(F.countDistinct("case_id").alias("hits"))
    out = fingerprints.select("fp").join(hits, "fp", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return out.withColumn("state", F.when(F.col("hits") == 1, "ok").when(F.col("hits") == 0, "missed").otherwise("ambiguous"))


def prune(tables: Mapping[str, DataFrame], bad: DataFrame, key: str = "case_id") -> dict[str, DataFrame]:
    """Each table without the rows of bad cases."""
    return {name: t.join(bad.select(key).distinct(), key, "left_anti") for name, t in tables.items()}


def pruned_counts(tables: Mapping[str, DataFrame], bad: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows kept and dropped per table, in one pass over each."""
    marks = bad.select(key).distinct().withColumn("_bad", F.lit(1))
    out = None
    for name, t in tables.items():
        one = t.select(key).join(marks, key, "left").agg(F.count(F.when(F.col("_bad").isNull(), 1)).alias("kept"), F.count("_bad").alias("dropped")).select(F.lit(name).alias("table"), "kept", "dropped")
        out = one if out is None else out.union(one)
    return out


def long_tail(hypotheses: DataFrame, allowed: DataFrame) -> DataFrame:
    """Categories in use that their domain does not allow, in domains that have a list."""
    listed = allowed.select("domain").distinct()
    used = hypotheses.where("category <> ''").join(listed, "domain", "left_semi").groupBy("domain", "category").agg(F.count(F.lit(1)).alias("n"))
    return used.join(allowed, ["domain", "category"], "left_anti")


def remap_coverage(tail: DataFrame, remap: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per domain: categories mapped, those without a mapping, and mappings to a category that is not allowed."""
    targets = allowed.select("domain", F.col("category").alias("canonical"), F.lit(1).alias("_ok"))
    rows = tail.join(remap, ["domain", "category"], "left").join(targets, ["domain", "canonical"], "left")
    return rows.groupBy("domain").agg(F.count("_ok").alias("kept"), F.count(F.when(F.col("canonical").isNull(), 1)).alias("missing"), F.count(F.when(F.col("canonical").isNotNull() & F.col("_ok").isNull(), 1)).alias("invalid"))


def apply_remap(cases: DataFrame, remap: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cases (domain, hypotheses: array of structs with category) with mapped categories and how many changed.

    Only mappings to another, allowed category count. A domain's mappings are one map beside its cases.
    """
    valid = remap.where("canonical <> category").join(allowed.select("domain", F.col("category").alias("canonical")), ["domain", "canonical"], "left_semi")
    maps = valid.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("category", "canonical"))).alias("_map"))
    out = cases.join(F.broadcast(maps), "domain", "left")  # few domains: cases would all go to as many tasks
    new = lambda h: F.coalesce(F.col("_map")[h["category"]], h["category"])
    changed = F.size(F.filter("hypotheses", lambda h: F.coalesce(F.col("_map")[h["category"]].isNotNull(), F.lit(False))))
    return out.withColumn("n_changed", F.when(F.col("_map").isNull(), 0).otherwise(changed)).withColumn("hypotheses", F.transform("hypotheses", lambda h: h.withField("category", new(h)))).drop("_map")


def release(cases: DataFrame) -> DataFrame:
    """What is published of each case, in order of domain and case."""
    hypothesis = lambda h: F.struct(F.coalesce(h["hypothesis"], F.lit("")).alias("hypothesis"), F.coalesce(h["evidence"], F.lit("")).alias("evidence"), h["category"].alias("category"))
    return cases.select(F.col("case_id").alias("id"), "domain", projected(F.col("domain"), F.col("metadata")).alias("metadata"), F.coalesce("context", F.lit("")).alias("context"), F.transform("hypotheses", hypothesis).alias("hypotheses")).orderBy("domain", "id")


def dataset_stats(cases: DataFrame, tracks: Mapping[str, str]) -> DataFrame:
    """Cases, hypotheses and mean categories per case by domain, track and in all; an unnamed category counts as one."""
    track = F.create_map(*[F.lit(x) for kv in tracks.items() for x in kv])[F.col("domain")]
    rows = cases.select(track.alias("track"), "domain", F.size("hypotheses").alias("h"), F.size(F.array_distinct(F.transform("hypotheses", lambda x: x["category"]))).alias("c"))
    out = rows.rollup("track", "domain").agg(F.count(F.lit(1)).alias("n_cases"), F.sum("h").alias("n_hypotheses"), F.avg("h").alias("mean_hypotheses"), F.avg("c").alias("mean_categories"))
    return out.withColumn("track", F.coalesce("track", F.lit("all"))).withColumn("domain", F.coalesce("domain", F.lit("all")))
