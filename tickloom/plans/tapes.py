"""Queries through the whole engine: books encoded as frames, with lives, lost changes and wrong snapshots planted, whose
verdicts SQL works out from the rows they were made of; and operators on roll-ups, late definitions and instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wire as w
from ..functions.layout import message
from ..functions.rules import spec_links
from ..functions.storage import cut
from ..operators import orders as od
from ..operators import refdata as rd
from ..operators.derived import mid_or_trade
from ..operators.ordered import numbered, slices
from . import feeds
from .feeds import with_ctes
from .registry import query

#: Changes of 20 books in two lives each; number 7 of the first life is lost where the instrument leaves 3 by 5.
_CHANGES = """
select *, row_number() over (partition by instrument, life order by event_id) as per_seq from (
  select event_id, user_id % 20 as instrument, event_id {div} 2 % 2 as life, event_id % 2 as side, cast(floor(value) as bigint) % 25 as price,
    case when event_type = 'error' then 0 else 1 + event_id % 90 end as qty from events) as e"""
_LOST = "instrument % 5 = 3 and life = 0 and per_seq = 7"


def _frames(rows: DataFrame, feed: str, channels: int = 4) -> DataFrame:
    """Datagrams of one message for rows (instrument, port, place, body, reset, ts, lost) in order of place, without the
    lost ones; a channel has every ``channels``-th instrument, and numbers begin anew with each reset count."""
    rows = rows.withColumn("channel_id", F.col("instrument") % channels)
    keys = ["channel_id", "port", "reset"]
    (cuts,) = slices(rows, keys, "place")
    rows = numbered(rows, keys, ["place"], "seq", cuts).withColumn("seq", F.col("seq") - 1).where("not lost")
    raw = w.frame(feed, F.col("channel_id"), F.col("seq"), F.col("ts"), F.col("reset"), F.col("body"), F.lit(1))
    return rows.select(F.lit("tape").alias("capture_id"), F.col("place").alias("arrival"), "port", raw.alias("raw"))


def _message(rows: DataFrame, feed: str, name: str, port: str, place: str, flags: int = 0, reset: str = "0", ts: str | None = None, lost: str = "false", **values: str) -> DataFrame:
    body = w.write(message(feed, name), {k: F.expr(v) for k, v in values.items()}, flags=flags)
    more = [f"cast({reset} as bigint) as reset", f"cast({ts or place} as bigint) as ts", f"{lost} as lost"]
    return rows.select("instrument", F.lit(port).alias("port"), F.expr(f"cast({place} as bigint)").alias("place"), body.alias("body"), *map(F.expr, more))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PHASE = 1_000_000_000_000


def _groups(ends: DataFrame, levels: DataFrame, feed: str, row: str, phase: str, number: int, reset: str = "0", anchor: str = "0", **values: str) -> list[DataFrame]:
    """A snapshot group for each of ``ends`` (instrument, life, k) with the rows ``levels`` (instrument, life, n from 1)."""
    flags = 1 if feed == "mbp" else 0
    total = levels.groupBy("instrument", "life").agg(F.count("*").alias("total"))
    e = ends.join(total, ["instrument", "life"], "left").na.fill(0, ["total"]).withColumn("id", F.expr(f"life * 10 + {number}"))
    base = f"({phase}) * {_PHASE} + instrument * 10000000"
    r = levels.withColumn("id", F.expr(f"life * 10 + {number}"))
    return [
        _message(e, feed, "snapshot_begin", "snapshot", base, flags, reset, instrument="instrument", anchor=anchor, total="total", snapshot_id="id", last_seq="k"),
        _message(r, feed, row, "snapshot", f"{base} + n", flags, reset, snapshot_id="id", **values),
        _message(e, feed, "snapshot_end", "snapshot", f"{base} + 9999999", flags, reset, instrument="instrument", anchor=anchor, snapshot_id="id"),
    ]


def _verdicts(grams: DataFrame, feed: str, rules: list[str], **settings: int | None) -> DataFrame:
    from ..engine import Settings, check

    found = check(grams, feed, Settings(window=0, empty_start=True, **settings), rules).where(F.col("rule_id").isin(*rules))
    return found.groupBy("rule_id", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def _sql(body: str) -> str:
    return f"with c as ({_CHANGES.format(div='//')})," + body


@query("book_after_reset_mbp", _sql("""
e as (select instrument, life, max(per_seq) as k from c group by all),
l as (select instrument, life, count(*) as levels from (select instrument, life, side, price, arg_max(qty, per_seq) as qty from c group by all) where qty > 0 group by all),
v as (
  select 'MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT' as rule_id, 'pass' as status, '' as reason from e
  union all select 'MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT',
    case when instrument % 5 = 3 and life = 0 and k >= 7 then 'unverifiable' when instrument % 5 = 2 and life = 1 and coalesce(levels, 0) > 0 then 'violation' else 'pass' end,
    case when instrument % 5 = 3 and life = 0 and k > 7 then 'loss' when instrument % 5 = 3 and life = 0 and k = 7 then 'pending' else '' end from e left join l using (instrument, life)
  union all select 'MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT', 'pass', '' from e
  union all select 'MBP.DELTA.PERINSTR_DENSITY', 'violation', '' from e where instrument % 5 = 3 and life = 0 and k > 7)
select rule_id, status, reason, count(*) as n from v group by all"""))
def book_after_reset_mbp(spark, sf):
    """Each life: an empty group, the changes, a group (wrong in every fifth second life), and the same group again, which
    its own base confirms. The second life's numbers start at 1 after an instrument reset. The subscriber keeps every change
    of a life, however many come between two groups."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("tape_events")
    c = cut(spark.sql(_CHANGES.format(div="div").replace("from events", "from tape_events")))
    ends = c.groupBy("instrument", "life").agg(F.max("per_seq").alias("k"))
    last = c.groupBy("instrument", "life", "side", "price").agg(F.max_by("qty", "per_seq").alias("qty")).where("qty > 0")
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("instrument", "life").orderBy("side", "price")))
    last = last.withColumn("qty", F.expr("qty + if(instrument % 5 = 2 and life = 1, 1, 0)"))
    values = {"price": "price", "qty": "qty", "side": "side"}
    parts = _groups(ends.withColumn("k", F.lit(0)), last.where("false"), "mbp", "snapshot_level", "10 * life + 1", 1, **values)
    parts.append(_message(c.where(f"not ({_LOST})"), "mbp", "level_update", "mktdata", f"(10 * life + 2) * {_PHASE} + event_id", instrument="instrument", source="1", side="side", action="if(qty = 0, 2, 0)", per_seq="per_seq", price="price", qty="qty"))
    for k in (3, 4):
        parts += _groups(ends, last, "mbp", "snapshot_level", f"10 * life + {k}", k, **values)
    parts.append(_message(ends.where("life = 1"), "mbp", "instrument_reset", "mktdata", f"10 * {_PHASE} + instrument", instrument="instrument", anchor="0"))
    return _verdicts(_frames(_union(parts), "mbp"), "mbp", ["MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "MBP.DELTA.PERINSTR_DENSITY"], journal=None)


@query("book_after_reset_mbo", _sql("""
e as (select instrument, life, max(per_seq) as k, count(*) as orders from c group by all),
v as (
  select 'SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT' as rule_id,
    case when instrument % 5 = 3 and life = 0 and k >= 7 then 'unverifiable' when instrument % 5 = 2 and life = 1 then case time when 1 then 'suspected' else 'violation' end else 'pass' end as status,
    case when instrument % 5 = 3 and life = 0 and k > 7 then 'untrusted' when instrument % 5 = 3 and life = 0 and k = 7 then 'pending' else '' end as reason from e, (select unnest([1, 2]) as time)
  union all select 'DELTA.PERINSTR_DENSITY', 'violation', '' from e where instrument % 5 = 3 and life = 0 and k > 7)
select rule_id, status, reason, count(*) as n from v group by all"""))
def book_after_reset_mbo(spark, sf):
    """Each life: orders, and two equal groups of all of them (with another quantity in every fifth second life, which is
    suspected first and a violation when it comes again)."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("tape_events")
    c = cut(spark.sql(_CHANGES.format(div="div").replace("from events", "from tape_events"))).withColumn("qty", F.col("qty") + 1)
    ends = c.groupBy("instrument", "life").agg(F.max("per_seq").alias("k"))
    parts = [_message(c.where(f"not ({_LOST})"), "mbo", "order_add", "mktdata", f"(10 * life + 2) * {_PHASE} + event_id", instrument="instrument", source="1", side="side", per_seq="per_seq", order_id="event_id", price="price", qty="qty")]
    held = c.withColumn("n", F.col("per_seq")).withColumn("qty", F.expr("qty + if(instrument % 5 = 2 and life = 1, 1, 0)"))
    for k in (3, 4):
        parts += _groups(ends, held, "mbo", "snapshot_order", f"10 * life + {k}", k, order_id="event_id", side="side", price="price", qty="qty")
    parts.append(_message(ends.where("life = 1"), "mbo", "instrument_reset", "mktdata", f"10 * {_PHASE} + instrument", instrument="instrument", anchor="0"))
    known = ends.select("instrument").distinct()
    count = known.groupBy((F.col("instrument") % 4).alias("instrument")).agg(F.count("*").alias("count"))
    parts.append(_message(count, "mbo", "manifest", "refdata", "instrument", channel="instrument", valid="1", manifest_seq="1", count="count"))
    parts.append(_message(known, "mbo", "definition", "refdata", "100 + instrument", instrument="instrument", manifest_seq="1"))
    return _verdicts(_frames(_union(parts), "mbo"), "mbo", ["SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "DELTA.PERINSTR_DENSITY"])


@query("trade_executions_rollup", with_ctes("ofeed", """
with t as (select instrument, order_id as trade_id, qty from ofeed where kind = 'add' and pos % 100 = 0),
x as (select instrument, order_id as trade_id, count(*) as n, sum(qty) as q from ofeed where kind = 'execute' group by all)
select t.instrument, t.trade_id, coalesce(n, 0) as n_executions, coalesce(q, 0)::bigint as executed, coalesce(q, 0) = t.qty as agrees from t left join x using (instrument, trade_id)"""))
def trade_executions_rollup(spark, sf):
    o = feeds.orders(spark, sf).withColumnRenamed("order_id", "trade_id")
    trades = o.where("kind = 'add' and pos % 100 = 0").select("instrument", "trade_id", "qty")
    return od.rolled_up(trades, o.where("kind = 'execute'"), ["instrument"]).select("instrument", "trade_id", "n_executions", "executed", "agrees")


@query("intent_definition_tolerance", with_ctes("ticks definitions", """
with f as (select seq as pos, channel_id, instrument from ticks where event_type = 'click'),
g as (select f.*, (select max(d.pos) from definitions d where d.channel_id = f.channel_id and d.instrument = f.instrument and d.pos <= f.pos) as b,
  (select min(d.pos) from definitions d where d.channel_id = f.channel_id and d.instrument = f.instrument and d.pos > f.pos) as a from f)
select pos, instrument, case when b is not null then 'before' when a <= pos + 400 then 'after' end as defined,
  (select max(manifest_seq) from definitions d where d.pos = case when b is not null then b when a <= g.pos + 400 then a end) as manifest_seq from g"""))
def intent_definition_tolerance(spark, sf):
    facts = feeds.ticks(spark, sf).where("event_type = 'click'").selectExpr("seq as pos", "channel_id", "instrument")
    got = rd.with_definition(facts, feeds.definitions(spark, sf), ["channel_id", "instrument"], "pos", ["manifest_seq"], 400)
    return got.select("pos", "instrument", "defined", "manifest_seq")


@query("instance_arbitration", with_ctes("ticks", """
with r as (select instrument, 'host' || seq % 3 as host, count(*) as n from ticks where not (instrument % 4 = 1 and seq % 3 = 2) group by all),
b as (select instrument, min(case host when 'host2' then 1 when 'host0' then 2 end) as best from r where host <> 'host1' group by all)
select instrument, host, n from r join b using (instrument) where host = case best when 1 then 'host2' else 'host0' end"""))
def instance_arbitration(spark, sf):
    r = feeds.ticks(spark, sf).where("not (instrument % 4 = 1 and seq % 3 = 2)").selectExpr("instrument", "concat('host', seq % 3) as host")
    return od.arbitrated(r, ["instrument"], "host", ["host2", "host0"]).groupBy("instrument", "host").agg(F.count("*").alias("n"))


@query("surviving_trackers", with_ctes("ticks", """
select distinct channel_id, instrument from ticks where channel_id = 3 or (channel_id, instrument) in (select (channel_id, instrument) from ticks where event_type = 'view' and seq % 5 = 0)"""))
def surviving_trackers(spark, sf):
    t = feeds.ticks(spark, sf)
    current = t.where("event_type = 'view' and seq % 5 = 0 and channel_id <> 3").select("channel_id", "instrument")
    return rd.surviving(t.select("channel_id", "instrument").distinct(), current, ["channel_id"])


@query("rule_spec_links")
def rule_spec_links(spark, sf):
    return spec_links(spark)


_TWO_HOURS = 7_200_000_000_000


@query("burst_definition_cycles", with_ctes("definitions", f"""
with d as (select channel_id, instrument, send_ts // 3600000000000 * 3600000000000 as send_ts from definitions),
o as (select channel_id, min(send_ts) as origin from d group by 1)
select channel_id, (send_ts - origin) // {_TWO_HOURS} as cycle, count(distinct instrument) as n_seen from d join o using (channel_id) group by all having count(distinct send_ts) = 1"""))
def burst_definition_cycles(spark, sf):
    """Cycles of two hours whose definitions, sent on the hour, all came at one time."""
    d = feeds.definitions(spark, sf).withColumn("send_ts", F.expr("send_ts div 3600000000000 * 3600000000000"))
    expected = d.select("channel_id", "instrument").distinct().join(d.groupBy("channel_id").agg(F.min("send_ts").alias("origin")), "channel_id")
    return rd.cycles(d, expected, ["channel_id"], "send_ts", "origin", _TWO_HOURS).where("n_times = 1").select("channel_id", "cycle", "n_seen")


@query("mid_or_last_trade", with_ctes("ticks", """
with q as (select seq, instrument, case when qty % 5 > 0 then price + 1 end as mid from ticks where event_type = 'view'),
t as (select seq, instrument, price from ticks where event_type = 'purchase')
select q.seq, q.instrument, coalesce(q.mid, t.price) as mid, case when q.mid is not null then 'quotes' when t.price is not null then 'trade' end as origin
from q asof left join t on q.instrument = t.instrument and t.seq <= q.seq"""))
def mid_or_last_trade(spark, sf):
    t = feeds.ticks(spark, sf)
    quotes = t.where("event_type = 'view'").selectExpr("seq", "instrument", "if(qty % 5 > 0, price + 1, null) as mid")
    trades = t.where("event_type = 'purchase'").select("seq", "instrument", "price")
    return mid_or_trade(quotes, trades, ["instrument"], "seq").select("seq", "instrument", "mid", "origin")


#: Changes of 20 books in three eras, numbered anew in each; in era 0, number 7 is lost where the instrument leaves 3 by 5.
_ERAS = """
select *, row_number() over (partition by instrument, life order by event_id) as per_seq from (
  select event_id, user_id % 20 as instrument, event_id {div} 2 % 3 as life, event_id % 2 as side, cast(floor(value) as bigint) % 25 as price,
    case when event_type = 'error' then 0 else 1 + event_id % 90 end as qty from events) as e"""


@query("book_with_skipped_eras", f"with c as ({_ERAS.format(div='//')})," + """
e as (select instrument, life, max(per_seq) as k from c where life <> 1 group by all),
l as (select instrument, life, count(*) as levels from (select instrument, life, side, price, arg_max(qty, per_seq) as qty from c group by all) where qty > 0 group by all),
v as (
  select 'MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT' as rule_id, 'pass' as status, '' as reason from e
  union all select 'MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT',
    case when instrument % 5 = 3 and life = 0 and k >= 7 then 'unverifiable' when instrument % 5 = 2 and life = 2 and coalesce(levels, 0) > 0 then 'violation' else 'pass' end,
    case when instrument % 5 = 3 and life = 0 and k > 7 then 'loss' when instrument % 5 = 3 and life = 0 and k = 7 then 'pending' else '' end from e left join l using (instrument, life)
  union all select 'MBP.DELTA.PERINSTR_DENSITY', 'violation', '' from e where instrument % 5 = 3 and life = 0 and k > 7)
select rule_id, status, reason, count(*) as n from v group by all""")
def book_with_skipped_eras(spark, sf):
    """Changes come in the eras of reset counts 0, 1 and 2, snapshot groups in 0 and 2 only: those of era 2, wrong in every
    fifth book, are held to the changes of era 2. The subscriber keeps every change of an era."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("tape_events")
    c = cut(spark.sql(_ERAS.format(div="div").replace("from events", "from tape_events")))
    ends = c.where("life <> 1").groupBy("instrument", "life").agg(F.max("per_seq").alias("k"))
    last = c.where("life <> 1").groupBy("instrument", "life", "side", "price").agg(F.max_by("qty", "per_seq").alias("qty")).where("qty > 0")
    last = last.withColumn("n", F.row_number().over(Window.partitionBy("instrument", "life").orderBy("side", "price")))
    last = last.withColumn("qty", F.expr("qty + if(instrument % 5 = 2 and life = 2, 1, 0)"))
    values = {"price": "price", "qty": "qty", "side": "side"}
    parts = _groups(ends.withColumn("k", F.lit(0)), last.where("false"), "mbp", "snapshot_level", "10 * life + 1", 1, "life", **values)
    parts.append(_message(c.where(f"not ({_LOST})"), "mbp", "level_update", "mktdata", f"(10 * life + 2) * {_PHASE} + event_id", reset="life", instrument="instrument", source="1", side="side", action="if(qty = 0, 2, 0)", per_seq="per_seq", price="price", qty="qty"))
    parts += _groups(ends, last, "mbp", "snapshot_level", "10 * life + 3", 3, "life", **values)
    return _verdicts(_frames(_union(parts), "mbp"), "mbp", ["MBP.SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "MBP.DELTA.PERINSTR_DENSITY"], journal=None)


_LIMIT = 60_000_000_000


@query("rules_under_loss", f"""
with f as (
  select user_id % 16 as channel, event_type = 'click' as beat, event_id, epoch_us(ts) * 1000 as ts,
    row_number() over (partition by user_id % 16, event_type = 'click' order by event_id) as i from events where event_type in ('click', 'view')),
k as (select * from f where not (channel % 4 = 1 and i = 20)),
g as (select *, ts - lag(ts) over (partition by channel, beat order by event_id) as gap from k)
select case when beat then 'HEARTBEAT.CADENCE' else 'REFDATA.MANIFEST_CADENCE' end as rule_id,
  case when channel % 4 = 1 and i > 20 then 'unverifiable' else 'violation' end as status, case when channel % 4 = 1 and i > 20 then 'loss' else '' end as reason, count(*) as n
from g where gap > {_LIMIT} group by all""")
def rules_under_loss(spark, sf):
    """Heartbeats and manifests at the times of clicks and views: every channel is late at times, and one in four has lost
    its twentieth frame of either port, after which lateness can't be told from loss."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('click', 'view')")
    e = e.selectExpr("user_id % 16 as instrument", "event_type", "event_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000 as sent")
    e = e.withColumn("i", F.expr("row_number() over (partition by instrument, event_type order by event_id)"))
    more = {"ts": "sent", "lost": "instrument % 4 = 1 and i = 20"}
    beats = _message(e.where("event_type = 'click'"), "tob", "heartbeat", "mktdata", "event_id", channel="instrument", **more)
    manifests = _message(e.where("event_type = 'view'"), "tob", "manifest", "refdata", "event_id", channel="instrument", valid="1", manifest_seq="1", count="1", **more)
    grams = _frames(beats.unionByName(manifests), "tob", 16)
    return _verdicts(grams, "tob", ["HEARTBEAT.CADENCE", "REFDATA.MANIFEST_CADENCE"], heartbeat=_LIMIT, manifest_cadence=_LIMIT)


#: Orders of 80 books on eight channels. By the book's number over 8: nothing more, a reset that a group and a change
#: follow, a reset that a change follows at once, a reset that nothing follows.
_OPPORTUNITIES = """
select *, row_number() over (partition by instrument order by event_id) as per_seq, instrument {div} 8 % 4 as kind, instrument % 5 <> 4 as grouped, instrument % 8 % 4 = 3 as torn from (
  select event_id, user_id % 80 as instrument, cast(floor(value) as bigint) % 25 - 3 as price, 1 + event_id % 90 as qty from events where event_type = 'view') as e"""


@query("opportunities_by_rule", f"with c as ({_OPPORTUNITIES.format(div='//')})," + """
e as (select instrument, any_value(kind) as kind, any_value(grouped) as grouped, any_value(torn) as torn, count(*) as k from c group by all),
v as (
  select 'SNAP.ROUND_ROBIN_COVERS_MANIFEST' as rule_id, case when grouped or kind = 1 then 'pass' when torn then 'unverifiable' else 'violation' end as status, case when torn and not (grouped or kind = 1) then 'loss' else '' end as reason from e
  union all select 'RESET.SNAPSHOT_FOLLOWS', case when kind = 1 then 'pass' when torn then 'unverifiable' else 'violation' end, case when torn and kind <> 1 then 'loss' else '' end from e where kind > 0
  union all select r, 'pass', '' from e, (select unnest(['RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET', 'RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR']) as r) where kind = 1
  union all select r, case when i = 1 then 'unverifiable' else 'pass' end, case when i = 1 then 'cold_start' else '' end
    from (select unnest(range(1, 1 + case when grouped then 2 else 0 end + case when kind = 1 then 1 else 0 end)) as i from e), (select unnest(['SNAP.ANCHOR_MONOTONIC_PER_INSTRUMENT', 'SNAP.SNAPSHOT_ID_MONOTONIC']) as r)
  union all select 'SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT', 'pass', '' from e, (select unnest([1, 2])) where grouped
  union all select 'SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT', 'unverifiable', 'untrusted' from e where kind = 1
  union all select 'FIELD.ORDERADD_PRICE_BOUND', case when instrument % 3 = 0 then 'na' when price < 0 then 'violation' else 'pass' end, '' from c
  union all select 'FIELD.ORDERADD_PRICE_BOUND', case when instrument % 3 = 0 then 'na' else 'pass' end, '' from e where kind in (1, 2)
  union all select 'SNAP.ORDER_PRICE_BOUND', case when instrument % 3 = 0 then 'na' when price < 0 then 'violation' else 'pass' end, '' from c, (select unnest([1, 2])) where grouped)
select rule_id, status, reason, count(*) as n from v group by all""")
def opportunities_by_rule(spark, sf):
    """Every opportunity of the order feed's rules that owe one, whether taken or not: orders under price bounds, two equal
    groups of most books, and what follows a reset, where every fourth channel lost a frame of its snapshot port."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("tape_events")
    c = cut(spark.sql(_OPPORTUNITIES.format(div="div").replace("from events", "from tape_events"))).withColumn("life", F.lit(0))
    e = c.groupBy("instrument", "life", "kind", "grouped", "torn").agg(F.count("*").alias("k"))
    known = e.select("instrument").distinct()
    count = known.groupBy((F.col("instrument") % 8).alias("instrument")).agg(F.count("*").alias("count"))
    parts = [
        _message(count, "mbo", "manifest", "refdata", "instrument", channel="instrument", valid="1", manifest_seq="1", count="count"),
        _message(known, "mbo", "definition", "refdata", "100 + instrument", instrument="instrument", manifest_seq="1", price_bound="instrument % 3"),
        _message(c, "mbo", "order_add", "mktdata", f"{_PHASE} + event_id", instrument="instrument", source="1", side="0", per_seq="per_seq", order_id="event_id", price="price", qty="qty"),
        _message(e.where("torn"), "mbo", "heartbeat", "snapshot", f"4 * {_PHASE} + instrument", lost="true"),
        _message(e.where("kind > 0"), "mbo", "instrument_reset", "mktdata", f"5 * {_PHASE} + instrument", instrument="instrument", anchor="5"),
    ]
    held = c.where("grouped").withColumn("n", F.col("per_seq"))
    values = {"order_id": "event_id", "side": "0", "price": "price", "qty": "qty"}
    for k in (2, 3):
        parts += _groups(e.where("grouped").select("instrument", "life", "k"), held, "mbo", "snapshot_order", str(k), k, **values)
    parts += _groups(e.where("kind = 1").selectExpr("instrument", "life", "0 as k"), held.where("false"), "mbo", "snapshot_order", "6", 6, anchor="5", **values)
    parts.append(_message(e.where("kind in (1, 2)"), "mbo", "order_add", "mktdata", f"7 * {_PHASE} + instrument", instrument="instrument", source="1", side="0", per_seq="1", order_id="1000000000 + instrument", price="1", qty="1"))
    # A frame at the end of every snapshot port tells that the one before it was lost.
    parts.append(_message(count, "mbo", "heartbeat", "snapshot", f"4 * {_PHASE} + 1000000 + instrument"))
    rules = ["SNAP.ROUND_ROBIN_COVERS_MANIFEST", "RESET.SNAPSHOT_FOLLOWS", "RESET.RECOVERY_SNAPSHOT_ANCHOR_MATCHES_RESET", "RESET.NO_DANGLING_DELTAS_AT_OR_BELOW_ANCHOR", "SNAP.ANCHOR_MONOTONIC_PER_INSTRUMENT", "SNAP.SNAPSHOT_ID_MONOTONIC",
             "SNAP.RECONSTRUCTED_BOOK_MATCHES_SNAPSHOT", "FIELD.ORDERADD_PRICE_BOUND", "SNAP.ORDER_PRICE_BOUND"]
    return _verdicts(_frames(_union(parts), "mbo", 8), "mbo", rules)
