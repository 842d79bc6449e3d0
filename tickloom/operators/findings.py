"""Findings: severity, counts, reports, exit code, throttled logs, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import ENVELOPE, rules_table


def graded(findings: DataFrame, configured: tuple[str, ...] = (), future: Column | None = None) -> DataFrame:
    """``findings`` with severity. A conditional rule that is not configured, or a rule outside the envelope on a frame
    of a newer schema, is for information only, and its violations don't apply."""
    f = findings.join(F.broadcast(rules_table(findings.sparkSession).select("rule_id", "severity", "conditional")), "rule_id")
    weak = F.col("conditional") & ~F.col("rule_id").isin(*configured, "")
    if future is not None:
        weak = weak | (future & ~F.col("rule_id").isin(*ENVELOPE))
    severity, status = F.when(weak, "info").otherwise(F.col("severity")), F.when(weak & (F.col("status") == "violation"), "na").otherwise(F.col("status"))
    return f.withColumn("severity", severity).withColumn("status", status).drop("conditional")


def by_status(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "status").agg(F.count("*").alias("n"))


def by_reason(findings: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unspecified"))
    return findings.where("status = 'unverifiable'").groupBy("rule_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def totals(graded_findings: DataFrame) -> DataFrame:
    v = F.col("status") == "violation"
    return graded_findings.agg(F.count_if(v & (F.col("severity") == "must")).alias("must"), F.count_if(v & (F.col("severity") == "should")).alias("should"))


def exit_code(graded_findings: DataFrame, strict: bool = False) -> DataFrame:
    """exit_code: 1 on a must violation, or if ``strict`` a should violation; else 0."""
    bad = (F.col("must") > 0) | (F.lit(strict) & (F.col("should") > 0))
    return totals(graded_findings).select(F.when(bad, 1).otherwise(0).alias("exit_code"))


def coverage(findings: DataFrame) -> DataFrame:
    """rule_id, decided (pass or violation), opportunities (those and unverifiable), and their ratio."""
    decided = F.count_if(F.col("status").isin("pass", "violation"))
    chances = F.count_if(F.col("status").isin("pass", "violation", "unverifiable"))
    return findings.groupBy("rule_id").agg(decided.alias("decided"), chances.alias("opportunities")).withColumn("coverage", F.when(F.col("opportunities") > 0, F.col("decided") / F.col("opportunities")))


def report(findings: DataFrame) -> DataFrame:
    """rule_id, counts (status to number), unverifiable_by_reason (null if there are none), by rule."""
    counts = by_status(findings).groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    why = by_reason(findings).groupBy("rule_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("unverifiable_by_reason"))
    return counts.join(why, "rule_id", "left").orderBy("rule_id")


def throttled(findings: DataFrame, ts: str, interval: int) -> DataFrame:
    """A row per (rule, status) and interval of ``ts``: the first, with how many of the interval it stands for."""
    w = Window.partitionBy("rule_id", "status", "slot")
    f = findings.withColumn("slot", F.floor(F.col(ts) / interval).cast("bigint"))
    f = f.withColumn("suppressed", F.count("*").over(w) - 1).withColumn("__n", F.row_number().over(w.orderBy(ts, "pos")))
    return f.where("__n = 1").drop("__n")


def alert_increase(findings: DataFrame, ts: str, when: Column, span: int, slide: int, above: int = 0, by: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Sliding windows [start, start + span) in which more than ``above`` findings hold ``when``."""
    starts = F.sequence(F.floor((F.col(ts) - span) / slide) + 1, F.floor(F.col(ts) / slide))
    f = findings.where(when).withColumn("start", F.explode(F.transform(starts, lambda s: s * slide)))
    return f.groupBy(*by, "start").agg(F.count("*").alias("n")).where(F.col("n") > above)


def alert_unless(findings: DataFrame, ts: str, span: int, above: int = 10) -> DataFrame:
    """Tumbling windows in which a rule had more than ``above`` opportunities, unless any of them passed."""
    f = findings.withColumn("start", F.floor(F.col(ts) / span) * span)
    chances = f.where("status in ('pass', 'violation', 'unverifiable')").groupBy("rule_id", "start").agg(F.count("*").alias("n")).where(F.col("n") > above)
    return chances.join(f.where("status = 'pass'").select("rule_id", "start").distinct(), ["rule_id", "start"], "left_anti")


def held_for(alerts: DataFrame, by: list[str], slide: int, windows: int) -> DataFrame:
    """Alerts that have stood for ``windows`` windows in a row."""
    w = Window.partitionBy(*by).orderBy("start")
    a = alerts.withColumn("__island", F.col("start") / slide - F.row_number().over(w))
    return a.withColumn("held", F.row_number().over(Window.partitionBy(*by, "__island").orderBy("start"))).where(F.col("held") >= windows).drop("__island")


def checklist(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Every rule with its violations and passes, those without any included."""
    c = counts.groupBy("rule_id").agg(F.sum(F.when(F.col("status") == "violation", F.col("n"))).alias("violations"), F.sum(F.when(F.col("status") == "pass", F.col("n"))).alias("passes"))
    return rules.join(c, "rule_id", "left").na.fill(0, ["violations", "passes"])
