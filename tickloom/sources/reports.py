"""The source registry, and reports and metrics as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.findings import report

DEFAULT_RANGES = [(1, 1023)]


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """lo, hi of a registry file {"spec_revision": ..., "ranges": [{"lo": ..., "hi": ...}]}."""
    r = spark.read.option("multiLine", True).schema("spec_revision string, ranges array<struct<lo:int,hi:int>>").json(path)
    return r.select(F.explode("ranges").alias("r")).select("r.lo", "r.hi")


def in_registry(rows: DataFrame, ranges: DataFrame, source: str = "source") -> DataFrame:
    """``rows`` with in_registry. The ranges are a handful of rows of a registry file; 0 is never in it."""
    r = ranges.select("lo", "hi").distinct()
    hit = rows.select(source).distinct().join(F.broadcast(r), F.col(source).between(F.col("lo"), F.col("hi")), "left_semi").where(f"{source} <> 0")
    return rows.join(hit.withColumn("__in", F.lit(True)), source, "left").withColumn("in_registry", F.coalesce("__in", F.lit(False))).drop("__in")


def write_report(findings: DataFrame, path: str, feed: str) -> None:
    """One JSON object with a row per rule; there are at most as many rows as rules."""
    rows = [{"rule_id": r["rule_id"], "counts": r["counts"]} | ({"unverifiable_by_reason": r["unverifiable_by_reason"]} if r["unverifiable_by_reason"] else {}) for r in report(findings).collect()]
    spark = findings.sparkSession
    spark.createDataFrame([(json.dumps({"feed": feed, "rules": rows}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def metrics(graded_findings: DataFrame) -> DataFrame:
    """Lines of the Prometheus text format: findings by feed, rule, severity and status, and unverifiable by reason."""
    label = lambda *names: F.concat(*(x for k, n in enumerate(names) for x in (F.lit(("," if k else "") + f'{n}="'), F.coalesce(F.col(n), F.lit("")), F.lit('"'))))
    a = graded_findings.groupBy("feed", "rule_id", "severity", "status").count()
    a = a.select(F.concat(F.lit("feed_findings_total{"), label("feed", "rule_id", "severity", "status"), F.lit("} "), F.col("count").cast("string")).alias("value"))
    b = graded_findings.where("status = 'unverifiable'").groupBy("feed", "rule_id", F.coalesce("reason", F.lit("unspecified")).alias("reason")).count()
    return a.unionByName(b.select(F.concat(F.lit("feed_unverifiable_total{"), label("feed", "rule_id", "reason"), F.lit("} "), F.col("count").cast("string")).alias("value")))


def fan_out(batch: DataFrame, batch_id: int, folder: str) -> None:
    """foreachBatch target: findings, transport events and counts of a micro-batch, each to its own folder.

    Writing under the batch's number makes a repeated batch replace itself."""
    for name, rows in (("findings", batch.where("not transport")), ("transport", batch.where("transport")), ("counts", batch.groupBy("rule_id", "status").count())):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
