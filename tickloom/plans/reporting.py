"""Queries on findings, reports, alerts and derived values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import rules_table
from ..operators import derived as dv
from ..operators import findings as fd
from . import feeds
from .feeds import with_ctes
from .registry import query

_SEVERITY = "case rule_id when 'FRAME.MAGIC_MISMATCH' then 'must' when 'REF.EXEC_OVERFILL' then 'must' when 'BATCH.ID_MONOTONIC' then 'should' else 'info' end"


@query("findings_by_rule_status", with_ctes("findings", "select rule_id, status, count(*) as n from findings group by all"))
def findings_by_rule_status(spark, sf):
    return fd.by_status(feeds.findings(spark, sf))


@query("unverifiable_by_reason", with_ctes("findings", "select rule_id, case when reason = '' then 'unspecified' else reason end as reason, count(*) as n from findings where status = 'unverifiable' group by all"))
def unverifiable_by_reason(spark, sf):
    return fd.by_reason(feeds.findings(spark, sf))


@query("graded_findings", with_ctes("findings", f"select rule_id, {_SEVERITY} as severity, case when rule_id = 'HEARTBEAT.CADENCE' and status = 'violation' then 'na' else status end as status, count(*) as n from findings group by all"))
def graded_findings(spark, sf):
    return fd.graded(feeds.findings(spark, sf)).groupBy("rule_id", "severity", "status").agg(F.count("*").alias("n"))


@query("coverage_ratio", with_ctes("findings", """
select rule_id, count(*) filter (status in ('pass', 'violation')) as decided, count(*) filter (status in ('pass', 'violation', 'unverifiable')) as opportunities,
  count(*) filter (status in ('pass', 'violation')) / count(*) filter (status in ('pass', 'violation', 'unverifiable')) as coverage from findings group by 1"""))
def coverage_ratio(spark, sf):
    return fd.coverage(feeds.findings(spark, sf))


@query("exit_code", with_ctes("findings", "select case when count(*) filter (status = 'violation' and rule_id in ('FRAME.MAGIC_MISMATCH', 'REF.EXEC_OVERFILL')) > 0 then 1 else 0 end as exit_code from findings"))
def exit_code(spark, sf):
    return fd.exit_code(fd.graded(feeds.findings(spark, sf)))


@query("report_json_rows", with_ctes("findings", """
with c as (select rule_id, status, count(*) as n from findings group by all),
u as (select rule_id, case when reason = '' then 'unspecified' else reason end as reason, count(*) as n from findings where status = 'unverifiable' group by all)
select rule_id, '{' || string_agg('"' || status || '":' || n, ',' order by status) || '}' as counts,
  (select '{' || string_agg('"' || reason || '":' || n, ',' order by reason) || '}' from u where u.rule_id = c.rule_id) as unverifiable_by_reason from c group by rule_id"""))
def report_json_rows(spark, sf):
    return fd.report(feeds.findings(spark, sf)).select("rule_id", F.to_json("counts").alias("counts"), F.to_json("unverifiable_by_reason").alias("unverifiable_by_reason"))


@query("log_throttle_first_per_interval", with_ctes("findings", """
select rule_id, status, at_s // 3600 as slot, min(pos) as pos, count(*) - 1 as suppressed from findings group by all"""))
def log_throttle_first_per_interval(spark, sf):
    return fd.throttled(feeds.findings(spark, sf), "at_s", 3600).select("rule_id", "status", "slot", "pos", "suppressed")


@query("alert_must_violation_5m", with_ctes("findings", """
select rule_id, start::bigint as start, count(*) as n from (
  select rule_id, unnest(range((at_s - 300) // 60 + 1, at_s // 60 + 1)) * 60 as start from findings where status = 'violation' and rule_id in ('FRAME.MAGIC_MISMATCH', 'REF.EXEC_OVERFILL')) group by all"""))
def alert_must_violation_5m(spark, sf):
    f = fd.graded(feeds.findings(spark, sf))
    return fd.alert_increase(f, "at_s", F.expr("status = 'violation' and severity = 'must'"), 300, 60).select("rule_id", F.col("start").cast("bigint").alias("start"), "n")


@query("alert_coverage_loss", with_ctes("findings", """
with w as (select start, count(*) as n from (
  select unnest(range((at_s - 14400) // 3600 + 1, at_s // 3600 + 1)) * 3600 as start from findings where status = 'unverifiable' and reason = 'loss') group by 1 having count(*) > 5),
g as (select *, start // 3600 - row_number() over (order by start) as island from w),
h as (select *, row_number() over (partition by island order by start) as held from g)
select start::bigint as start, n from h where held >= 2"""))
def alert_coverage_loss(spark, sf):
    f = feeds.findings(spark, sf).withColumn("all", F.lit(1))
    a = fd.alert_increase(f, "at_s", F.expr("status = 'unverifiable' and reason = 'loss'"), 14400, 3600, 5, ("all",))
    return fd.held_for(a, ["all"], 3600, 2).select(F.col("start").cast("bigint").alias("start"), "n")


@query("alert_rule_not_verifying_unless", with_ctes("findings", """
with s as (select *, at_s // 14400 * 14400 as start from findings)
select rule_id, start, count(*) filter (status in ('pass', 'violation', 'unverifiable')) as n from s group by all
having count(*) filter (status in ('pass', 'violation', 'unverifiable')) > 3 and count(*) filter (status = 'pass') = 0"""))
def alert_rule_not_verifying_unless(spark, sf):
    return fd.alert_unless(feeds.findings(spark, sf), "at_s", 14400, 3)


@query("transport_loss_windows", with_ctes("ticks", "select channel_id, ts_ns // 3600000000000 as slot, count(*) as n from ticks where seq % 97 = 0 group by all"))
def transport_loss_windows(spark, sf):
    lost = feeds.ticks(spark, sf).where("seq % 97 = 0").withColumn("slot", F.expr("ts_ns div 3600000000000"))
    return lost.groupBy("channel_id", "slot").agg(F.count("*").alias("n"))


@query("rule_checklist", with_ctes("findings", "select rule_id, count(*) filter (status = 'violation') as violations, count(*) filter (status = 'pass') as passes from findings group by 1"))
def rule_checklist(spark, sf):
    f = feeds.findings(spark, sf)
    c = fd.checklist(rules_table(spark), fd.by_status(f))
    return c.where("violations + passes > 0").select("rule_id", "violations", "passes")


@query("rule_catalogue", "select * from (values ('must', 49), ('should', 26), ('info', 13)) as t(severity, n)")
def rule_catalogue(spark, sf):
    return rules_table(spark).groupBy("severity").agg(F.count("*").alias("n"))


@query("bandwidth_windows", with_ctes("ticks", "select channel_id, ts_ns // 86400000000000 as slot, (sum(52) )::bigint as bytes, count(*) as messages from ticks group by all"))
def bandwidth_windows(spark, sf):
    return dv.bandwidth(feeds.ticks(spark, sf), ["channel_id"], "ts_ns", 86_400_000_000_000, F.lit(52))


@query("bbo_mid", with_ctes("ticks", "select seq, (price + price + seq % 5)::double / 2 as mid from ticks"))
def bbo_mid(spark, sf):
    return feeds.ticks(spark, sf).select("seq", dv.bbo_mid(F.col("price"), F.expr("price + seq % 5")).alias("mid"))


@query("micro_price", with_ctes("ticks", "select seq, case when qty + seq % 3 > 0 then (price * (seq % 3) + (price + 2) * qty)::double / (qty + seq % 3) end as micro from ticks"))
def micro_price(spark, sf):
    return feeds.ticks(spark, sf).select("seq", dv.micro_price(F.col("price"), F.col("qty"), F.expr("price + 2"), F.expr("seq % 3")).alias("micro"))


@query("price_scaling", with_ctes("ticks", "select seq, (price * [1000000, 100000, 10000, 1000, 100, 10, 1][seq % 7 + 1])::varchar as micros from ticks"))
def price_scaling(spark, sf):
    scaled = dv.scaled(F.col("price"), F.expr("-(seq % 7)"))
    return feeds.ticks(spark, sf).select("seq", (scaled * 1000000).cast("bigint").cast("string").alias("micros"))


@query("enum_labels", with_ctes("ticks", "select case seq % 5 when 0 then 'bid' when 1 then 'ask' else 'unknown' end as label, count(*) as n from ticks group by 1"))
def enum_labels(spark, sf):
    return feeds.ticks(spark, sf).groupBy(dv.labelled(F.expr("seq % 5"), {0: "bid", 1: "ask"}).alias("label")).agg(F.count("*").alias("n"))


@query("quality_flags", with_ctes("ticks", "select ((case when seq % 2 = 0 then 1 else 0 end) + (case when seq % 3 = 0 then 2 else 0 end) + (case when seq % 5 = 0 then 4 else 0 end) + (case when seq % 7 = 0 then 8 else 0 end)) as flags, count(*) as n from ticks group by 1"))
def quality_flags(spark, sf):
    flags = dv.quality_flags(*(F.expr(f"seq % {k} = 0") for k in (2, 3, 5, 7)))
    return feeds.ticks(spark, sf).groupBy(flags.alias("flags")).agg(F.count("*").alias("n"))


@query("modify_target", with_ctes("ticks", "select seq, case when seq % 128 & 64 = 0 then seq end as target, case when seq % 128 & 64 <> 0 then 'c' || seq end as client from ticks"))
def modify_target(spark, sf):
    a, b = dv.modify_target(F.expr("seq % 128"), F.col("seq"), F.expr("concat('c', seq)"))
    return feeds.ticks(spark, sf).select("seq", a.alias("target"), b.alias("client"))


@query("latency_parts", with_ctes("ticks", "select seq, seq % 500 as compute_lag, seq % 300 as send_lag, seq % 200 as wire_lag from ticks"))
def latency_parts(spark, sf):
    t = feeds.ticks(spark, sf).selectExpr("seq", "ts_ns as book", "ts_ns + seq % 500 as compute", "ts_ns + seq % 500 + seq % 300 as send", "ts_ns + seq % 500 + seq % 300 + seq % 200 as got")
    return dv.latencies(t, "book", "compute", "send", "got").select("seq", "compute_lag", "send_lag", "wire_lag")


@query("perp_latest_pass", with_ctes("ticks", "select instrument, seq, price from ticks qualify row_number() over (partition by instrument order by ts_ns desc, seq desc) = 1"))
def perp_latest_pass(spark, sf):
    return dv.latest(feeds.ticks(spark, sf).select("instrument", "seq", "price", "ts_ns"), ["instrument"], ["ts_ns", "seq"]).select("instrument", "seq", "price")


@query("perp_forward_fill", with_ctes("ticks", "select instrument, seq, last_value(case when seq % 4 = 0 then price end ignore nulls) over (partition by instrument order by seq) as predicted from ticks"))
def perp_forward_fill(spark, sf):
    t = feeds.ticks(spark, sf).selectExpr("instrument", "seq", "if(seq % 4 = 0, price, null) as predicted")
    return dv.forward_filled(t, ["instrument"], ["seq"], "predicted")


@query("intent_dedupe", with_ctes("ticks", "select distinct instrument % 10 as source, seq // 3 as action_tag, seq % 3 % 2 as batch_index from ticks"))
def intent_dedupe(spark, sf):
    t = feeds.ticks(spark, sf).selectExpr("instrument % 10 as source", "seq div 3 as action_tag", "seq % 3 % 2 as batch_index")
    return t.dropDuplicates(["source", "action_tag", "batch_index"])


@query("batch_completeness", with_ctes("ticks", "select action_tag, 3 as batch_count, count(distinct i) as received from (select seq // 3 as action_tag, seq % 3 as i from ticks where seq % 10 <> 0) group by 1 having count(distinct i) < 3"))
def batch_completeness(spark, sf):
    t = feeds.ticks(spark, sf).where("seq % 10 <> 0").selectExpr("seq div 3 as action_tag", "seq % 3 as batch_index", "3 as batch_count")
    return dv.incomplete_batches(t, ["action_tag"])


@query("batch_visibility", with_ctes("ticks", "select channel_id, batch_no, count(*) as n from (select *, count(*) filter (event_type = 'purchase') over (partition by channel_id order by seq rows between unbounded preceding and 1 preceding) as batch_no from ticks) group by all"))
def batch_visibility(spark, sf):
    b = dv.with_batch_no(feeds.ticks(spark, sf), ["channel_id"], ["seq"], F.col("event_type") == "purchase")
    return b.groupBy("channel_id", "batch_no").agg(F.count("*").alias("n"))


@query("liquidation_companion", with_ctes("ticks", "select a.seq, b.seq as companion from ticks a left join ticks b on b.seq = a.seq + 1 and b.event_type = 'purchase' where a.event_type = 'click'"))
def liquidation_companion(spark, sf):
    t = feeds.ticks(spark, sf)
    b = t.where("event_type = 'purchase'").selectExpr("seq - 1 as seq", "seq as companion")
    return t.where("event_type = 'click'").join(b, "seq", "left").select("seq", "companion")
