"""Queries on reference data: manifests, definitions, readiness, bounds and the source registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refdata as rd
from ..operators.ordered import asof
from ..sources.reports import DEFAULT_RANGES, in_registry
from . import feeds
from .feeds import with_ctes
from .registry import query

KEYS = ["channel_id"]


@query("manifest_acceptance", with_ctes("manifests", """
with n as (select *, row_number() over (partition by channel_id order by pos) as i from manifests),
r as (
  select channel_id, i, pos, valid = 1 and manifest_seq <> 0 and count <> 0 as accepted,
    case when valid > 1 then 'MANIFEST.STATE_MACHINE' when valid = 1 and (manifest_seq = 0 or count = 0) then 'REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID' else '' end as rules,
    case when valid = 1 and manifest_seq <> 0 and count <> 0 then manifest_seq end as s, case when valid = 1 and manifest_seq <> 0 and count <> 0 then count end as c from n where i = 1
  union all
  select channel_id, i, pos, takes, case when valid > 1 then 'MANIFEST.STATE_MACHINE' when valid = 0 then '' when zero then 'REFDATA.MANIFEST_SEQ_NONZERO_WHEN_VALID' when older then 'REFDATA.SEQ_MONOTONIC_NO_REGRESS'
    when s is not null and manifest_seq > s + 1 then 'REFDATA.SEQ_BUMP_NOT_BY_ONE' when s is not null and manifest_seq = s and count <> c then 'REFDATA.COUNT_CHANGE_NO_SEQ_BUMP' else '' end,
    case when takes then manifest_seq else s end, case when takes then count else c end
  from (
    select n.channel_id, n.i, n.pos, n.valid, n.manifest_seq, n.count, r.s, r.c, coalesce(n.manifest_seq < r.s, false) as older,
      coalesce(n.manifest_seq <> r.s, true) and not coalesce(n.manifest_seq < r.s, false) and (n.manifest_seq = 0 or n.count = 0) as zero,
      n.valid = 1 and not (coalesce(n.manifest_seq <> r.s, true) and not coalesce(n.manifest_seq < r.s, false) and (n.manifest_seq = 0 or n.count = 0)) and not coalesce(n.manifest_seq < r.s, false) as takes
    from r join n on n.channel_id = r.channel_id and n.i = r.i + 1))
select channel_id, pos, accepted, rules from r""", recursive=True))
def manifest_acceptance(spark, sf):
    got = rd.accepted_manifests(feeds.manifests(spark, sf), KEYS)
    return got.select("channel_id", "pos", "accepted", F.array_join("rules", ",").alias("rules"))


@query("manifest_cadence", with_ctes("manifests", "select channel_id, pos, send_ts - p as gap from (select *, lag(send_ts) over (partition by channel_id order by pos) as p from manifests where valid = 1) where send_ts - p > 7200000000000"))
def manifest_cadence(spark, sf):
    valid = feeds.manifests(spark, sf).where("valid = 1")
    return rd.cadence(valid, KEYS, "pos", "send_ts", 7_200_000_000_000).select("channel_id", "pos", "gap")


_TAGGED = """with d as (
  select *, (select max(m.manifest_seq) from plain_manifests m where m.channel_id = d0.channel_id and m.pos <= d0.pos) as current_seq from definitions d0)"""


def _tagged(spark, sf):
    return rd.tagged(feeds.definitions(spark, sf), feeds.plain_manifests(spark, sf), KEYS)


@query("definitions_stale_tag", with_ctes("definitions plain_manifests", _TAGGED + " select channel_id, pos, manifest_seq, current_seq from d where manifest_seq <> current_seq"))
def definitions_stale_tag(spark, sf):
    return _tagged(spark, sf).where("stale").select("channel_id", "pos", "manifest_seq", "current_seq")


_SEEN = _TAGGED + """,
g as (select *, not exists (select 1 from d e where e.channel_id = d.channel_id and e.manifest_seq = d.manifest_seq and e.instrument = d.instrument and e.pos < d.pos and e.manifest_seq = e.current_seq) as first_seen
  from d where manifest_seq = current_seq),
c as (select *, count(*) filter (first_seen) over (partition by channel_id, manifest_seq order by pos) as n_distinct from g)"""


def _seen(spark, sf):
    return rd.with_distinct_so_far(_tagged(spark, sf).where("not stale"), KEYS)


@query("count_vs_distinct", with_ctes("definitions plain_manifests", _SEEN + " select channel_id, pos, instrument, n_distinct from c where first_seen and n_distinct > 20"))
def count_vs_distinct(spark, sf):
    return _seen(spark, sf).where("first_seen and n_distinct > current_count").select("channel_id", "pos", "instrument", "n_distinct")


@query("refdata_ready_at", with_ctes("definitions plain_manifests", _SEEN + " select channel_id, manifest_seq, min(pos) as ready_pos, 20 as n_defs from c where first_seen and n_distinct = 20 group by all"))
def refdata_ready_at(spark, sf):
    got = rd.ready_at(_tagged(spark, sf).where("not stale"), KEYS)
    return got.select("channel_id", "manifest_seq", "ready_pos", F.col("n_defs").cast("int").alias("n_defs"))


@query("set_change_no_bump", with_ctes("definitions plain_manifests", _SEEN + """,
r as (select channel_id, manifest_seq, min(pos) as ready_pos from c where first_seen and n_distinct = 20 group by all)
select c.channel_id, c.pos, c.instrument from c join r using (channel_id, manifest_seq) where c.first_seen and c.pos > r.ready_pos"""))
def set_change_no_bump(spark, sf):
    ready = rd.ready_at(_tagged(spark, sf).where("not stale"), KEYS)
    return _seen(spark, sf).where("first_seen").join(ready, ["channel_id", "manifest_seq"]).where("pos > ready_pos").select("channel_id", "pos", "instrument")


_DAY = 86_400_000_000_000


@query("definition_cycle_coverage", with_ctes("definitions", f"""
with o as (select channel_id, min(send_ts) as origin from definitions group by 1),
e as (select channel_id, count(distinct instrument) as n_expected from definitions group by 1),
c as (select channel_id, floor((send_ts - origin) / {_DAY})::bigint as cycle, count(distinct instrument) as n_seen, count(distinct send_ts) as n_times from definitions join o using (channel_id) group by all)
select channel_id, cycle, n_seen, n_times, n_expected, n_expected - n_seen as missing from c join e using (channel_id)"""))
def definition_cycle_coverage(spark, sf):
    d = feeds.definitions(spark, sf)
    expected = d.select("channel_id", "instrument").distinct().join(d.groupBy("channel_id").agg(F.min("send_ts").alias("origin")), "channel_id")
    return rd.cycles(d, expected, KEYS, "send_ts", "origin", _DAY).select("channel_id", "cycle", "n_seen", "n_times", "n_expected", "missing")


@query("no_burst_definitions", with_ctes("definitions", f"""
with o as (select channel_id, min(send_ts) as origin from definitions group by 1)
select channel_id, floor((send_ts - origin) / {_DAY})::bigint as cycle from definitions join o using (channel_id) group by all having count(distinct send_ts) = 1"""))
def no_burst_definitions(spark, sf):
    d = feeds.definitions(spark, sf)
    expected = d.select("channel_id", "instrument").distinct().join(d.groupBy("channel_id").agg(F.min("send_ts").alias("origin")), "channel_id")
    return rd.cycles(d, expected, KEYS, "send_ts", "origin", _DAY).where("n_times = 1").select("channel_id", "cycle")


_BOUND = """with f as (
  select t.channel_id, t.instrument, t.seq as pos, t.price - 5000 as price, (select arg_max(price_bound, d.pos) from definitions d where d.channel_id = t.channel_id and d.instrument = t.instrument and d.pos <= t.seq) as b
  from ticks t where t.event_type = 'click')"""


def _bounded(spark, sf):
    facts = feeds.ticks(spark, sf).where("event_type = 'click'").selectExpr("channel_id", "instrument", "seq as pos", "price - 5000 as price")
    return asof(facts, feeds.definitions(spark, sf), ["channel_id", "instrument"], "pos", ["price_bound"])


@query("price_bound_asof", with_ctes("ticks definitions", _BOUND + " select instrument, pos, case when b is null then 'unverifiable' when b not in (1, 2) then 'na' when price < 0 then 'violation' else 'pass' end as status from f"))
def price_bound_asof(spark, sf):
    return rd.price_bound(_bounded(spark, sf), "price").select("instrument", "pos", "status")


@query("quotes_unknown_instrument", with_ctes("ticks definitions", _BOUND + " select instrument, pos from f where b is null"))
def quotes_unknown_instrument(spark, sf):
    return _bounded(spark, sf).where("price_bound is null").select("instrument", "pos")


@query("round_robin_coverage", with_ctes("ticks", """
with s as (select channel_id, instrument from ticks where event_type = 'purchase' and instrument % 7 <> 0),
i as (select distinct channel_id, instrument from ticks)
select channel_id, instrument from i where not exists (select 1 from s where s.channel_id = i.channel_id and s.instrument = i.instrument)
and exists (select 1 from s where s.channel_id = i.channel_id group by s.instrument having count(*) >= 2)"""))
def round_robin_coverage(spark, sf):
    t = feeds.ticks(spark, sf)
    snaps = t.where("event_type = 'purchase' and instrument % 7 <> 0").select("channel_id", "instrument")
    return rd.uncovered(t.select("channel_id", "instrument").distinct(), snaps, KEYS).select("channel_id", "instrument")


@query("source_registry_range_join", with_ctes("ticks", "select seq, seq % 1100 as source, seq % 1100 between 1 and 1023 as in_registry from ticks"))
def source_registry_range_join(spark, sf):
    t = feeds.ticks(spark, sf).selectExpr("seq", "seq % 1100 as source")
    return in_registry(t, spark.createDataFrame(DEFAULT_RANGES, "lo int, hi int")).select("seq", "source", "in_registry")
