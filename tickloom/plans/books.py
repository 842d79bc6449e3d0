"""Queries on order books, price ladders and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as lv
from ..operators import orders as od
from ..operators import snapshots as sn
from ..operators.ordered import asof
from . import feeds
from .feeds import with_ctes
from .registry import query

KEYS = ["instrument"]


def _rows(spark, sf):
    """About how many rows the feeds of orders and of snapshots have: two of an order and one of a line."""
    return 2 * spark.read.parquet(f"{sf}/orders.parquet").count() + spark.read.parquet(f"{sf}/lineitem.parquet").count()


def _tasks(spark, sf):
    return feeds.tasks(spark, _rows(spark, sf))


def _lives(spark, sf):
    n = _rows(spark, sf)
    return od.with_lifecycle(feeds.spread(feeds.orders(spark, sf), n, *KEYS, "order_id"), KEYS)


_DANGLING = """
select instrument, order_id, pos from ofeed x where kind = '{}' and not exists (select 1 from ofeed a where a.kind = 'add' and a.order_id = x.order_id and a.pos < x.pos)"""


@query("exec_dangling_anti", with_ctes("ofeed", _DANGLING.format("execute")))
def exec_dangling_anti(spark, sf):
    return od.dangling(_lives(spark, sf), "execute").select("instrument", "order_id", "pos")


@query("cancel_dangling_anti", with_ctes("ofeed", _DANGLING.format("cancel")))
def cancel_dangling_anti(spark, sf):
    return od.dangling(_lives(spark, sf), "cancel").select("instrument", "order_id", "pos")


#: Each operation with the last add before it, and whether something ended that life in between.
_LIFE = """
with op as (select x.*, a.pos as added, a.qty as entry_qty, a.side as entry_side, a.source as entry_source, a.price as entry_price
  from ofeed x asof join (select * from ofeed where kind = 'add') a on a.order_id = x.order_id and a.pos <= x.pos where x.kind <> 'add'),
ends as (select order_id, pos from ofeed where kind = 'cancel' or full_fill),
life as (select op.*, exists (select 1 from ends e where e.order_id = op.order_id and e.pos > op.added and e.pos < op.pos) as removed,
  coalesce((select sum(qty) from ofeed e where e.kind = 'execute' and e.order_id = op.order_id and e.pos > op.added and e.pos < op.pos), 0)::bigint as filled from op)
"""


@query("operation_after_removal", with_ctes("ofeed", _LIFE + "select instrument, order_id, pos, kind from life where removed"))
def operation_after_removal(spark, sf):
    return od.after_removal(_lives(spark, sf)).select("instrument", "order_id", "pos", "kind")


@query("duplicate_live_add", with_ctes("ofeed", """
select b.instrument, b.order_id, b.pos from ofeed b where b.kind = 'add' and exists (select 1 from ofeed a where a.kind = 'add' and a.order_id = b.order_id and a.pos < b.pos)
and not exists (select 1 from ofeed e where e.order_id = b.order_id and (e.kind = 'cancel' or e.full_fill) and e.pos < b.pos)"""))
def duplicate_live_add(spark, sf):
    return od.duplicate_adds(_lives(spark, sf), KEYS).select("instrument", "order_id", "pos")


@query("exec_overfill", with_ctes("ofeed", _LIFE + "select order_id, pos, qty, entry_qty - filled as remaining from life where kind = 'execute' and not removed and qty > entry_qty - filled"))
def exec_overfill(spark, sf):
    return od.quantities(_lives(spark, sf)).where("overfill").select("order_id", "pos", "qty", "remaining")


@query("fullfill_disagreement", with_ctes("ofeed", _LIFE + "select order_id, pos from life where kind = 'execute' and not removed and full_fill and qty < entry_qty - filled"))
def fullfill_disagreement(spark, sf):
    return od.quantities(_lives(spark, sf)).where("disagree").select("order_id", "pos")


@query("remaining_qty_running", with_ctes("ofeed", _LIFE + "select order_id, pos, entry_qty - filled as remaining from life where kind = 'execute' and not removed"))
def remaining_qty_running(spark, sf):
    return od.quantities(_lives(spark, sf)).select("order_id", "pos", "remaining")


@query("side_consistency", with_ctes("ofeed", _LIFE + "select order_id, pos, aggressor from life where kind = 'execute' and ((aggressor = 1 and entry_side <> 1) or (aggressor = 2 and entry_side <> 0))"))
def side_consistency(spark, sf):
    return od.wrong_side(_lives(spark, sf)).select("order_id", "pos", "aggressor")


@query("source_consistency", with_ctes("ofeed", _LIFE + "select order_id, pos, source, entry_source from life where source <> entry_source"))
def source_consistency(spark, sf):
    return od.other_source(_lives(spark, sf)).select("order_id", "pos", "source", "entry_source")


@query("exec_asof_add", with_ctes("ofeed", _LIFE + "select order_id, pos, entry_price, entry_qty from life where kind = 'execute'"))
def exec_asof_add(spark, sf):
    f = feeds.orders(spark, sf)
    adds = f.where("kind = 'add'").select("instrument", "order_id", "pos", F.col("price").alias("entry_price"), F.col("qty").alias("entry_qty"))
    got = asof(f.where("kind = 'execute'").select("instrument", "order_id", "pos"), adds, ["instrument", "order_id"], "pos", ["entry_price", "entry_qty"])
    return got.where("entry_qty is not null").select("order_id", "pos", "entry_price", "entry_qty")


@query("trade_exec_grouping_anti", with_ctes("ofeed", """
with t as (select l_orderkey * 100 + 2 + 2 * l_linenumber as trade_id, l_orderkey * 100 + l_linenumber * 3 as pos from lineitem),
x as (select pos as trade_id, pos from ofeed where kind = 'execute')
select trade_id, pos from t where not exists (select 1 from x where x.trade_id = t.trade_id and x.pos < t.pos)"""))
def trade_exec_grouping_anti(spark, sf):
    trades = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey % 4 as channel_id", "l_orderkey * 100 + 2 + 2 * l_linenumber as trade_id", "l_orderkey * 100 + l_linenumber * 3 as pos")
    x = feeds.orders(spark, sf).where("kind = 'execute'").selectExpr("order_id % 4 as channel_id", "pos as trade_id", "pos")
    return od.ungrouped_trades(trades.where("trade_id <> 0"), x, ["channel_id"]).select("trade_id", "pos")


_LIVE = """
with e as (select * from ofeed where pos <= (select max(pos) // 2 from ofeed)),
a as (select * from e where kind = 'add' qualify row_number() over (partition by order_id order by pos desc) = 1),
live as (select a.instrument, a.order_id, a.side, a.price, a.qty - coalesce((select sum(qty) from e x where x.kind = 'execute' and x.order_id = a.order_id and x.pos > a.pos), 0) as remaining
  from a where not exists (select 1 from e x where x.order_id = a.order_id and x.pos > a.pos and (x.kind = 'cancel' or x.full_fill)))
"""


def _live(spark, sf):
    f = feeds.orders(spark, sf)
    half = f.agg(F.expr("max(pos) div 2")).first()[0]
    return od.live_at(f, KEYS, F.lit(half))


@query("live_orders_asof", with_ctes("ofeed", _LIVE + "select instrument, order_id, side, price, remaining::bigint as remaining from live where remaining > 0"))
def live_orders_asof(spark, sf):
    return _live(spark, sf)


@query("l3_to_l2_projection", with_ctes("ofeed", _LIVE + "select instrument, side, price, sum(remaining)::bigint as qty, count(*) as orders from live where remaining > 0 group by all"))
def l3_to_l2_projection(spark, sf):
    return od.to_levels(_live(spark, sf), KEYS)


@query("ladder_last_value", with_ctes("updates", """
select instrument, side, price, qty, per_seq from updates qualify row_number() over (partition by instrument, side, price order by per_seq desc) = 1 and qty > 0"""))
def ladder_last_value(spark, sf):
    return lv.ladder(feeds.updates(spark, sf), KEYS)


_COVER = "(c.clear_side = 2 or c.clear_side = u.side) and (c.scope = 0 or (u.side = 0 and u.price <= c.from_price) or (u.side = 1 and u.price >= c.from_price))"
_CLEARED = f"""
select instrument, side, price, qty, per_seq from updates u where qty > 0
and not exists (select 1 from updates v where v.instrument = u.instrument and v.side = u.side and v.price = u.price and v.per_seq > u.per_seq)
and not exists (select 1 from clears c where c.instrument = u.instrument and c.per_seq > u.per_seq and {_COVER})"""


@query("ladder_after_book_clear", with_ctes("updates clears", _CLEARED))
def ladder_after_book_clear(spark, sf):
    return lv.ladder(feeds.updates(spark, sf), KEYS, feeds.clears(spark, sf))


_POINTS = "(values (100), (200), (300), (400)) as points(k)"
_ASOF = f"""
select u.instrument, k::bigint as k, u.side, u.price, u.qty from updates u, {_POINTS} where u.qty > 0 and u.per_seq <= k
and not exists (select 1 from updates v where v.instrument = u.instrument and v.side = u.side and v.price = u.price and v.per_seq > u.per_seq and v.per_seq <= k)
and not exists (select 1 from clears c where c.instrument = u.instrument and c.per_seq > u.per_seq and c.per_seq <= k and {_COVER})"""


def _points(spark, sf):
    return feeds.updates(spark, sf).select("instrument").distinct().withColumn("k", F.explode(F.array(*(F.lit(k).cast("bigint") for k in (100, 200, 300, 400)))))


def _asof_ladders(spark, sf):
    return lv.ladder_asof(feeds.updates(spark, sf), _points(spark, sf), KEYS, feeds.clears(spark, sf))


@query("ladder_asof_k", with_ctes("updates clears", _ASOF))
def ladder_asof_k(spark, sf):
    return _asof_ladders(spark, sf)


_INSIDE = f"with l as ({_ASOF}), b as (select instrument, k, max(price) filter (side = 0) as best_bid, min(price) filter (side = 1) as best_ask from l group by all)"


@query("inside_market", with_ctes("updates clears", _INSIDE + " select *, coalesce(best_bid > best_ask, false) as crossed from b"))
def inside_market(spark, sf):
    return lv.inside(_asof_ladders(spark, sf), ["instrument", "k"])


@query("crossed_books", with_ctes("updates clears", _INSIDE + " select k, count(*) as n from b where best_bid > best_ask group by k"))
def crossed_books(spark, sf):
    return lv.inside(_asof_ladders(spark, sf), ["instrument", "k"]).where("crossed").groupBy("k").agg(F.count("*").alias("n"))


@query("depth_topk", with_ctes("updates clears", f"""
with l as ({_ASOF})
select instrument, k, side, price, qty, (row_number() over (partition by instrument, k, side order by case when side = 0 then -price else price end))::integer as level_no from l
qualify level_no <= 3"""))
def depth_topk(spark, sf):
    return lv.ranked(_asof_ladders(spark, sf), ["instrument", "k"], 3)


@query("action_divergence", with_ctes("updates", """
with p as (select *, coalesce((select arg_max(qty, v.per_seq) from updates v where v.instrument = u.instrument and v.side = u.side and v.price = u.price and v.per_seq < u.per_seq), 0) > 0 as present from updates u)
select instrument, per_seq, case when action = 0 then 'new_on_present' else 'change_on_absent' end as divergence from p where (action = 0 and present) or (action = 1 and not present)"""))
def action_divergence(spark, sf):
    return lv.action_divergence(feeds.updates(spark, sf), KEYS).where("divergence is not null").select("instrument", "per_seq", "divergence")


@query("absolute_apply", with_ctes("updates", "select instrument, per_seq, qty, action from updates where (qty = 0) <> (action = 2)"))
def absolute_apply(spark, sf):
    return lv.absolute_apply(feeds.updates(spark, sf)).select("instrument", "per_seq", F.col("qty").cast("bigint").alias("qty"), "action")


@query("malformed_clears", with_ctes("clears", "select instrument, per_seq from clears where scope = 1 and clear_side = 2"))
def malformed_clears(spark, sf):
    return lv.malformed_clears(feeds.clears(spark, sf)).select("instrument", "per_seq")


#: The snapshot's ladder: one level changed, one left out and one added at every other point.
_SNAP = f"""
with l as ({_ASOF}),
s as (select instrument, k, side, price, qty + case when (instrument + k // 100) % 2 = 0 and price = 3 then 1 else 0 end as qty from l where not ((instrument + k // 100) % 2 = 0 and price = 5)
  union all select distinct instrument, k, 0, 99, 7 from l where (instrument + k // 100) % 2 = 0)
"""


def _snapshot(spark, sf):
    book = _asof_ladders(spark, sf)
    odd = F.expr("(instrument + k div 100) % 2 = 0")
    kept = book.where(~(odd & (F.col("price") == 5))).withColumn("qty", F.col("qty") + F.when(odd & (F.col("price") == 3), 1).otherwise(0))
    more = book.where(odd).select("instrument", "k").distinct().selectExpr("instrument", "k", "cast(0 as bigint) as side", "cast(99 as bigint) as price", "cast(7 as bigint) as qty")
    return kept.unionByName(more), book


_DIFF = _SNAP + """, d as (
  select coalesce(s.instrument, l.instrument) as instrument, coalesce(s.k, l.k) as k, coalesce(s.side, l.side) as side, coalesce(s.price, l.price) as price,
    case when l.k is null then 'missing' when s.k is null then 'extra' else 'qty' end as field, s.qty::varchar as snapshot_value, l.qty::varchar as book_value
  from s full join l on s.instrument = l.instrument and s.k = l.k and s.side = l.side and s.price = l.price where s.qty is distinct from l.qty)
"""


@query("book_vs_snapshot_full_outer", with_ctes("updates clears", _DIFF + "select * from d"))
def book_vs_snapshot_full_outer(spark, sf):
    snap, book = _snapshot(spark, sf)
    return sn.book_diff(snap, book, ["instrument", "k"], ["side", "price"], ["qty"])


@query("diff_signatures", with_ctes("updates clears", _DIFF + """,
g as (select instrument, k, count(*) as n_diffs, list_sort(list(side || ':' || price || ':' || field)) as a from d group by all)
select instrument, k, n_diffs, array_to_string(a, ',') as signature, array_to_string(a[:3], ',') || case when len(a) > 3 then ' +' || (len(a) - 3) || ' more' else '' end as shown from g"""))
def diff_signatures(spark, sf):
    snap, book = _snapshot(spark, sf)
    return sn.signatures(sn.book_diff(snap, book, ["instrument", "k"], ["side", "price"], ["qty"]), ["instrument", "k"], ["side", "price"])


@query("oracle_confirm_runs", with_ctes("ticks", """
with a as (select instrument, seq, case seq % 11 when 0 then null when 1 then '' when 2 then '' else case when seq // 3000 % 2 = 0 then 'x' else 'y' end end as signature from ticks),
n as (select *, row_number() over (partition by instrument order by seq) as i from a),
r as (select *, i - row_number() over (partition by instrument, coalesce(signature, '?') order by i) as run from n),
l as (select *, row_number() over (partition by instrument, coalesce(signature, '?'), run order by i) as len from r)
select instrument, seq, case when signature is null then 'unverifiable' when signature = '' then 'pass' when len >= 2 then 'violation' else 'suspected' end as status from l"""))
def oracle_confirm_runs(spark, sf):
    a = feeds.ticks(spark, sf).selectExpr("instrument", "seq", "case when seq % 11 = 0 then null when seq % 11 in (1, 2) then '' else if(seq div 3000 % 2 = 0, 'x', 'y') end as signature")
    return sn.oracle_status(a, KEYS, "seq").select("instrument", "seq", "status")


_GROUPS = """
with b as (select * from srows where kind = 'begin'), e as (select * from srows where kind = 'end'),
r as (select channel_id, g, count(*) as received, count(*) - count(distinct key) as duplicates from srows where kind = 'row' group by all),
w as (select r.channel_id, r.g, count(*) as n from srows r join b using (channel_id, g) where r.kind = 'row' and r.snapshot_id <> b.snapshot_id group by all)
select b.channel_id, b.snapshot_id, b.instrument, b.total, coalesce(received, 0) as received, coalesce(duplicates, 0) as duplicates, coalesce(w.n, 0) as wrong_id,
  e.g is not null as ended, coalesce(e.anchor <> b.anchor, false) as end_differs, 0 as orphans
from b left join e using (channel_id, g) left join r using (channel_id, g) left join w using (channel_id, g)"""


def _groups(spark, sf):
    return sn.groups(feeds.snapshot_rows(spark, sf), ["channel_id"], at=F.col("pos"), tasks=_tasks(spark, sf))


@query("snapshot_islands", with_ctes("srows", _GROUPS))
def snapshot_islands(spark, sf):
    return _groups(spark, sf).select("channel_id", "snapshot_id", "instrument", "total", "received", "duplicates", "wrong_id", "ended", "end_differs", F.col("orphans").cast("int").alias("orphans"))


@query("snapshot_count_match", with_ctes("srows", f"with g as ({_GROUPS}) select channel_id, snapshot_id, total, received, case when not ended then 'unverifiable' when total = received then 'pass' else 'violation' end as status from g"))
def snapshot_count_match(spark, sf):
    verdict = sn.verdict([(~F.col("ended"), "unverifiable", "truncated"), (F.col("total") != F.col("received"), "violation", None)])
    return _groups(spark, sf).withColumn("v", verdict).select("channel_id", "snapshot_id", "total", "received", "v.status")


@query("snapshot_dup_keys", with_ctes("srows", "select channel_id, snapshot_id, key, n from (select s.channel_id, s.g, b.snapshot_id, s.key, count(*) as n from srows s join srows b on s.channel_id = b.channel_id and s.g = b.g and b.kind = 'begin' where s.kind = 'row' group by all having count(*) > 1)"))
def snapshot_dup_keys(spark, sf):
    r = sn.repeated_keys(feeds.snapshot_rows(spark, sf), ["channel_id"], at=F.col("pos"), tasks=_tasks(spark, sf))
    return r.select("channel_id", "snapshot_id", "key", "n")


@query("snapshot_anchor_monotonic", with_ctes("srows", """
with p as (select channel_id, instrument, pos, anchor, snapshot_id, lag(anchor) over w as pa, lag(snapshot_id) over w as pi from srows where kind = 'begin' window w as (partition by channel_id, instrument order by pos))
select channel_id, instrument, pos, case when pa is null then 'unverifiable' when anchor < pa then 'violation' else 'pass' end as anchor_status,
  case when pa is null then 'unverifiable' when snapshot_id <= pi then 'violation' else 'pass' end as id_status from p"""))
def snapshot_anchor_monotonic(spark, sf):
    b = feeds.snapshot_rows(spark, sf).where("kind = 'begin'")
    return sn.with_anchor_checks(b, ["channel_id", "instrument"]).select("channel_id", "instrument", "pos", "anchor_status", "id_status")


@query("reset_recovery", with_ctes("srows", """
with r as (select channel_id, instrument, pos, anchor from srows where kind = 'begin' and g % 37 = 0),
e as (select channel_id, instrument, pos, anchor from srows where kind = 'end')
select r.channel_id, r.instrument, r.pos, n.pos as group_pos, case when n.pos is null then 'violation' when n.anchor = r.anchor then 'pass' else 'violation' end as status
from r left join lateral (select pos, anchor from e where e.channel_id = r.channel_id and e.instrument = r.instrument and e.pos > r.pos order by pos limit 1) n on true"""))
def reset_recovery(spark, sf):
    s = feeds.snapshot_rows(spark, sf)
    resets = s.where("kind = 'begin' and pos div 40 % 37 = 0").select("channel_id", "instrument", "pos", "anchor")
    done = s.where("kind = 'end'").select("channel_id", "instrument", "pos", "anchor")
    return sn.recovery(resets, done, ["channel_id", "instrument"]).select("channel_id", "instrument", "pos", "group_pos", "status")
