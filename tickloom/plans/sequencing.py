"""Queries on sequencing: frames, eras, duplicates, per-instrument numbers, cadence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as o
from ..operators.refdata import cadence
from . import feeds
from .feeds import with_ctes
from .registry import query

INSTANCE = ["channel_id", "reset_count"]
_FIRST = "with f as (select * from tape qualify row_number() over (partition by channel_id, reset_count, seq order by arrival) = 1)"


def _firsts(spark, sf):
    return o.with_duplicates(feeds.tape(spark, sf), [*INSTANCE, "seq"], "payload").where("copy_no = 0")


@query("seq_gaps", with_ctes("tape", _FIRST + """
select channel_id, reset_count, seq, (seq - p - 1)::bigint as missing
from (select *, lag(seq) over (partition by channel_id, reset_count order by seq) as p from f) where seq - p > 1"""))
def seq_gaps(spark, sf):
    g = o.with_gaps(_firsts(spark, sf), INSTANCE, "seq", ["seq"])
    return g.where("missing > 0").select("channel_id", "reset_count", "seq", "missing")


@query("seq_backward", with_ctes("tape", """
select a.channel_id, a.reset_count, a.arrival, a.seq from tape a
where exists (select 1 from tape b where b.channel_id = a.channel_id and b.reset_count = a.reset_count and b.arrival < a.arrival and b.arrival > a.arrival - 60 and b.seq > a.seq)"""))
def seq_backward(spark, sf):
    g = o.with_gaps(feeds.tape(spark, sf), INSTANCE, "seq", ["arrival"])
    return g.where("backward").select("channel_id", "reset_count", "arrival", "seq")


_DUPS = """
select channel_id, reset_count, seq, arrival from tape t
where exists (select 1 from tape b where b.channel_id = t.channel_id and b.reset_count = t.reset_count and b.seq = t.seq and b.arrival < t.arrival and b.payload {} t.payload)"""


@query("seq_dup_identical", with_ctes("tape", _DUPS.format("=")))
def seq_dup_identical(spark, sf):
    d = o.with_duplicates(feeds.tape(spark, sf), [*INSTANCE, "seq"], "payload")
    return d.where("copy_no > 0 and not divergent").select("channel_id", "reset_count", "seq", "arrival")


@query("seq_dup_divergent", with_ctes("tape", _DUPS.format("<>")))
def seq_dup_divergent(spark, sf):
    d = o.with_duplicates(feeds.tape(spark, sf), [*INSTANCE, "seq"], "payload")
    return d.where("divergent").select("channel_id", "reset_count", "seq", "arrival")


@query("send_ts_monotonic", with_ctes("tape", _FIRST + """
select channel_id, reset_count, seq, send_ts from (select *, lag(send_ts) over (partition by channel_id, reset_count order by seq) as p from f) where send_ts < p"""))
def send_ts_monotonic(spark, sf):
    p = o.with_previous(_firsts(spark, sf), INSTANCE, ["seq"], before="send_ts")
    return p.where("send_ts < before").select("channel_id", "reset_count", "seq", "send_ts")


@query("era_numbering", with_ctes("tape", """
with m as (select *, max(reset_count) over (partition by channel_id order by arrival rows between unbounded preceding and 1 preceding) as p,
  first_value(reset_count) over (partition by channel_id order by arrival) as z from tape)
select channel_id, greatest(reset_count, coalesce(p, 0)) - z as era_no, case when p is null or reset_count = p then 'same' when reset_count > p then 'newer' else 'older' end as era_state, count(*) as n
from m group by all"""))
def era_numbering(spark, sf):
    e = o.with_eras(feeds.tape(spark, sf), ["channel_id"])
    return e.groupBy("channel_id", "era_no", "era_state").agg(F.count("*").alias("n"))


@query("dirty_window_sticky", with_ctes("tape", _FIRST + """,
g as (select *, seq - lag(seq) over (partition by channel_id, reset_count order by seq) > 1 as gap from f),
d as (select *, coalesce(bool_or(gap) over (partition by channel_id, reset_count order by seq), false) as dirty from g)
select channel_id, reset_count, dirty, count(*) as n, min(seq) as first_seq from d group by all"""))
def dirty_window_sticky(spark, sf):
    g = o.with_gaps(_firsts(spark, sf), INSTANCE, "seq", ["seq"])
    d = o.with_sticky(g, INSTANCE, F.col("missing") > 0, ["seq"])
    return d.groupBy("channel_id", "reset_count", "dirty").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("reorder_emit_order", with_ctes("tape", _FIRST + """,
r as (select *, row_number() over (partition by channel_id, reset_count order by seq, arrival) as i, row_number() over (partition by channel_id, reset_count order by arrival) as n from f)
select a.channel_id, a.reset_count, a.seq, coalesce(b.arrival, 1152921504606846976) as emit_pos
from r a left join r b on a.channel_id = b.channel_id and a.reset_count = b.reset_count and b.n = a.i + 8"""))
def reorder_emit_order(spark, sf):
    return o.with_emit_position(_firsts(spark, sf), INSTANCE, window=8).select("channel_id", "reset_count", "seq", "emit_pos")


@query("heartbeat_cadence", with_ctes("ticks", """
select channel_id, seq, ts_ns - p as gap from (select *, lag(ts_ns) over (partition by channel_id order by seq) as p from ticks where event_type = 'view')
where ts_ns - p > 14400000000000"""))
def heartbeat_cadence(spark, sf):
    beats = feeds.ticks(spark, sf).where("event_type = 'view'")
    return cadence(beats, ["channel_id"], "seq", "ts_ns", 14_400_000_000_000).select("channel_id", "seq", "gap")


@query("perinstr_density", with_ctes("deltas", """
select instrument, seq, per_seq, p as prev_max from (select *, lag(per_seq) over (partition by instrument order by seq) as p from deltas) where per_seq > p + 1"""))
def perinstr_density(spark, sf):
    g = o.with_gaps(feeds.deltas(spark, sf), ["instrument"], "per_seq", ["seq"])
    return g.where("missing > 0").select("instrument", "seq", "per_seq", "prev_max")


@query("perinstr_first_value", with_ctes("deltas", """
select instrument, per_seq as first_value, case when per_seq = 1 then 'pass' else 'unverifiable' end as status
from deltas d where seq = (select min(seq) from deltas e where e.instrument = d.instrument)"""))
def perinstr_first_value(spark, sf):
    first = feeds.deltas(spark, sf).groupBy("instrument").agg(F.min_by("per_seq", "seq").alias("first_value"))
    return first.withColumn("status", F.when(F.col("first_value") == 1, "pass").otherwise("unverifiable"))


@query("perinstr_restart", with_ctes("deltas", """
select instrument, seq from (select *, max(short_seq) over (partition by instrument order by seq rows between unbounded preceding and 1 preceding) as m from deltas) where short_seq = 1 and m > 1"""))
def perinstr_restart(spark, sf):
    g = o.with_gaps(feeds.deltas(spark, sf), ["instrument"], "short_seq", ["seq"])
    return g.where("short_seq = 1 and prev_max > 1").select("instrument", "seq")


@query("perinstr_dup_divergent", with_ctes("deltas", """
select a.instrument, a.seq from deltas a where exists (select 1 from deltas b where b.instrument = a.instrument and b.short_seq = a.short_seq and b.seq < a.seq)
and a.price <> (select arg_min(price, seq) from deltas b where b.instrument = a.instrument and b.short_seq = a.short_seq)"""))
def perinstr_dup_divergent(spark, sf):
    d = o.with_duplicates(feeds.deltas(spark, sf), ["instrument", "short_seq"], "price", "seq")
    return d.where("divergent").select("instrument", "seq")


@query("batch_id_monotonic", with_ctes("deltas", """
select channel_id, seq, batch_id, p as prev_id from (select *, lag(batch_id) over (partition by channel_id order by seq) as p from deltas) where batch_id < p"""))
def batch_id_monotonic(spark, sf):
    b = o.with_previous(feeds.deltas(spark, sf), ["channel_id"], ["seq"], prev_id="batch_id")
    return b.where("batch_id < prev_id").select("channel_id", "seq", "batch_id", "prev_id")


@query("lifecycle_islands", with_ctes("deltas", """
select instrument, island, count(*) as n, min(seq) as first_seq from (
  select *, count(*) filter (short_seq = 1) over (partition by instrument order by seq) as island from deltas) group by all"""))
def lifecycle_islands(spark, sf):
    i = o.with_islands(feeds.deltas(spark, sf), ["instrument"], F.col("short_seq") == 1, ["seq"])
    return i.groupBy("instrument", "island").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("replay_findings")
def replay_findings(spark, sf):
    from ..streaming.replay import replay_batch

    frames = feeds.tape(spark, sf).selectExpr("'tape' as capture_id", "channel_id", "'mktdata' as port", "arrival", "seq", "reset_count", "send_ts", "payload")
    return replay_batch(frames).groupBy("channel_id", "rule_id", "status", "transport").agg(F.count("*").alias("n"))
