"""The test tables as feeds: frames, deltas, orders, levels, manifests, snapshots and findings with planted faults.

Every relation is a function of (spark, folder) and has its SQL as a WITH clause of the same name in CTES.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _sql(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").selectExpr(*columns)


#: Rows of a task where a feed is sorted: tasks get more, not larger, as the tables grow.
TASK_ROWS = 500_000


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with k, their number within the order."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return spread(lines, lines.count(), "l_orderkey").selectExpr("*", "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k")


def tasks(spark: SparkSession, n: int) -> int | None:
    """How many tasks of ``TASK_ROWS`` have ``n`` rows, if that is more than the cores or the session's number of shuffle
    partitions. Many partitions are no reason to leave it to these: adaptive execution joins them, by bytes, to few."""
    most = -(-n // TASK_ROWS)
    return most if most > min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) else None


def spread(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, some ``n`` in all, by keys in tasks of ``TASK_ROWS``; as they are where there are too few for that."""
    most = tasks(rows.sparkSession, n)
    return rows.repartition(most, *keys) if most else rows


def dealt(rows: DataFrame, size: int = 250_000) -> DataFrame:
    """``rows`` in tasks of ``size`` or less, however few files and row groups they are read from; as they are if few."""
    n = -(-rows.count() // size)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism)) if n > 1 else rows


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(
        spark, sf, "events", "event_id as seq", "user_id as instrument", "user_id % 4 as channel_id", "unix_micros(cast(ts as timestamp)) * 1000 as ts_ns",
        "cast(round(value * 100) as bigint) as price", "event_id % 37 as qty", "event_id % 2 as side", "event_type",
    )


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of three channel instances: lost, late, repeated (identical or not), with clocks set back; eras of 2500."""
    t = ticks(spark, sf).selectExpr("seq", "seq % 3 as channel_id", "seq div 2500 as era", "(seq - seq div 2500 * 2500) div 3 as no", "ts_ns - if(seq % 89 = 0, 10000000000000, 0) as send_ts")
    first = t.where("seq % 97 <> 0").selectExpr("channel_id", "seq * 2 + if(seq % 131 = 0, 13, 0) as arrival", "no as seq", "era as reset_count", "send_ts", "seq as payload")
    again = t.where("seq % 101 = 0").selectExpr("channel_id", "seq * 2 + 9 as arrival", "no as seq", "era as reset_count", "send_ts", "seq + if(seq % 202 = 0, 1000000, 0) as payload")
    return first.unionByName(again)


def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Per-instrument sequences, dense but for lost rows, and a second numbering that starts again every 40."""
    t = ticks(spark, sf).selectExpr("*", "row_number() over (partition by instrument order by seq) as per_seq")
    return t.selectExpr("*", "(per_seq - 1) % 40 + 1 as short_seq", "seq div 10 - if(seq % 53 = 0, 5, 0) as batch_id").where("seq % 97 <> 0")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Adds, executions and cancels of an order feed; some adds are missing and some come twice."""
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey as order_id", "o_custkey % 50 as instrument", "o_orderstatus as st", "cast(round(o_totalprice * 100) as bigint) as price")
    head = ["instrument", "order_id", "order_id % 2 as side", "price", "cast(60 + order_id % 90 as bigint) as qty", "1 + order_id % 3 as source", "0 as aggressor", "false as full_fill"]
    adds = o.where("order_id % 101 <> 0").selectExpr("order_id * 100 as pos", "'add' as kind", *head)
    twice = o.where("order_id % 113 = 0").selectExpr("order_id * 100 + 3 as pos", "'add' as kind", *head)
    cancels = o.where("st = 'F' and order_id % 2 = 0").selectExpr("order_id * 100 + 5 as pos", "'cancel' as kind", *head)
    lines = lineitem(spark, sf)
    x = lines.join(o, lines.l_orderkey == o.order_id).selectExpr(
        "order_id * 100 + 2 + 2 * k as pos", "'execute' as kind", "instrument", "order_id", "order_id % 2 as side", "cast(round(l_extendedprice * 100) as bigint) as price",
        "cast(l_quantity as bigint) as qty", "1 + (order_id + if(l_suppkey % 7 = 0, 1, 0)) % 3 as source", "l_linenumber % 3 as aggressor", "l_returnflag = 'R' and l_linenumber >= 5 as full_fill",
    )
    return adds.unionByName(twice).unionByName(cancels).unionByName(x)


def level_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(
        spark, sf, "events", "user_id % 20 as instrument", "cast(row_number() over (partition by user_id % 20 order by event_id) as bigint) as per_seq", "event_id", "event_id % 2 as side",
        "cast(floor(value) as bigint) % 25 as price", "if(event_type = 'error' and event_id % 79 <> 0, 0, 1 + event_id % 90) as qty", "if(event_type = 'error' or event_id % 83 = 0, 2, if(event_type = 'click', 0, 1)) as action",
        "event_type = 'signup' and event_id % 5 = 0 as is_clear", "event_id % 3 as clear_side", "event_id div 3 % 2 as scope", "cast(floor(value) as bigint) % 25 as from_price",
    )


def updates(spark: SparkSession, sf: str) -> DataFrame:
    return level_rows(spark, sf).where("not is_clear").select("instrument", "per_seq", "side", "price", "qty", "action")


def clears(spark: SparkSession, sf: str) -> DataFrame:
    return level_rows(spark, sf).where("is_clear").select("instrument", "per_seq", "clear_side", "scope", "from_price")


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of four channels, some out of range, cleared, recounted, ahead or behind."""
    t = ticks(spark, sf).where("event_type = 'signup'")
    return t.selectExpr(
        "channel_id", "seq as pos", "ts_ns as send_ts", "case when seq % 71 = 0 then 0 when seq % 73 = 0 then 2 else 1 end as valid",
        "greatest(seq div 500 + case when seq % 41 = 0 then 3 when seq % 43 = 0 then -1 else 0 end, 0) as manifest_seq", "30 + seq div 500 % 3 + if(seq % 29 = 0, 1, 0) as count",
    )


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    t = ticks(spark, sf).where("event_type = 'view'")
    return t.selectExpr("channel_id", "seq as pos", "ts_ns as send_ts", "instrument", "greatest(seq div 500 - if(seq % 37 = 0, 1, 0), 0) as manifest_seq", "instrument % 4 as price_bound")


def plain_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest for each channel at the start of every 500 rows."""
    t = ticks(spark, sf).selectExpr("channel_id", "seq div 500 as manifest_seq").distinct()
    return t.selectExpr("channel_id", "manifest_seq * 500 as pos", "manifest_seq", "cast(20 as bigint) as count")


def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot groups of eight channels: one for each order, a row for each of its lines."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    lines = lineitem(spark, sf)
    total = lines.groupBy("l_orderkey").count()
    b = o.join(total, o.o_orderkey == total.l_orderkey, "left").selectExpr(
        "o_orderkey % 8 as channel_id", "o_orderkey * 40 as pos", "'begin' as kind", "o_orderkey div 8 - if(o_orderkey % 31 = 0, 2, 0) as snapshot_id", "o_custkey % 50 as instrument",
        "o_orderkey * 3 - if(o_orderkey % 17 = 0, 300, 0) as anchor", "coalesce(count, 0) + if(o_orderkey % 19 = 0, 1, 0) as total", "cast(null as bigint) as key",
    )
    e = o.where("o_orderkey % 23 <> 0").selectExpr(
        "o_orderkey % 8 as channel_id", "o_orderkey * 40 + 39 as pos", "'end' as kind", "o_orderkey div 8 - if(o_orderkey % 31 = 0, 2, 0) as snapshot_id", "o_custkey % 50 as instrument",
        "o_orderkey * 3 - if(o_orderkey % 17 = 0, 300, 0) + if(o_orderkey % 29 = 0, 1, 0) as anchor", "cast(null as bigint) as total", "cast(null as bigint) as key",
    )
    r = lines.join(o, lines.l_orderkey == o.o_orderkey).selectExpr(
        "o_orderkey % 8 as channel_id", "o_orderkey * 40 + k as pos", "'row' as kind", "o_orderkey div 8 - if(o_orderkey % 31 = 0, 2, 0) + if(l_suppkey % 97 = 0, 1, 0) as snapshot_id",
        "cast(null as bigint) as instrument", "cast(null as bigint) as anchor", "cast(null as bigint) as total", "l_partkey % 50 as key",
    )
    return b.unionByName(e).unionByName(r)


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(
        spark, sf, "events", "event_id as pos", "unix_micros(cast(ts as timestamp)) div 1000000 as at_s", "case event_type when 'error' then 'FRAME.MAGIC_MISMATCH' when 'click' then 'BATCH.ID_MONOTONIC' when 'view' then 'HEARTBEAT.CADENCE' when 'signup' then 'FRAME.SCHEMA_VERSION' else 'REF.EXEC_OVERFILL' end as rule_id",
        "case when event_id % 7 = 0 then 'violation' when event_id % 7 = 1 then 'unverifiable' when event_id % 7 = 2 then 'na' when event_id % 70 = 3 then 'suspected' when user_id % 5 = 0 then 'unverifiable' else 'pass' end as status",
        "case event_id % 3 when 0 then 'loss' when 1 then 'cold_start' else '' end as reason",
    )


CTES = {
    "ticks": """ticks as (
  select event_id as seq, user_id as instrument, user_id % 4 as channel_id, epoch_us(ts) * 1000 as ts_ns, cast(round(value * 100) as bigint) as price,
    event_id % 37 as qty, event_id % 2 as side, event_type from events)""",
    "tape": """tape as (
  with t as (select seq, seq % 3 as channel_id, seq // 2500 as era, (seq - seq // 2500 * 2500) // 3 as no,
    ts_ns - case when seq % 89 = 0 then 10000000000000 else 0 end as send_ts from ticks)
  select channel_id, seq * 2 + case when seq % 131 = 0 then 13 else 0 end as arrival, no as seq, era as reset_count, send_ts, seq as payload from t where seq % 97 <> 0
  union all select channel_id, seq * 2 + 9, no, era, send_ts, seq + case when seq % 202 = 0 then 1000000 else 0 end from t where seq % 101 = 0)""",
    "deltas": """deltas as (
  select *, (per_seq - 1) % 40 + 1 as short_seq, seq // 10 - case when seq % 53 = 0 then 5 else 0 end as batch_id
  from (select *, row_number() over (partition by instrument order by seq) as per_seq from ticks) where seq % 97 <> 0)""",
    "ofeed": """ofeed as (
  with o as (select o_orderkey as order_id, o_custkey % 50 as instrument, o_orderstatus as st, cast(round(o_totalprice * 100) as bigint) as price from orders),
  h as (select order_id, instrument, st, order_id % 2 as side, price, 60 + order_id % 90 as qty, 1 + order_id % 3 as source from o),
  l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem)
  select order_id * 100 as pos, 'add' as kind, instrument, order_id, side, price, qty, source, 0 as aggressor, false as full_fill from h where order_id % 101 <> 0
  union all select order_id * 100 + 3, 'add', instrument, order_id, side, price, qty, source, 0, false from h where order_id % 113 = 0
  union all select order_id * 100 + 5, 'cancel', instrument, order_id, side, price, qty, source, 0, false from h where st = 'F' and order_id % 2 = 0
  union all select order_id * 100 + 2 + 2 * k, 'execute', instrument, order_id, order_id % 2, cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as bigint),
    1 + (order_id + case when l_suppkey % 7 = 0 then 1 else 0 end) % 3, l_linenumber % 3, l_returnflag = 'R' and l_linenumber >= 5 from l join o on l_orderkey = order_id)""",
    "lrows": """lrows as (
  select user_id % 20 as instrument, row_number() over (partition by user_id % 20 order by event_id) as per_seq, event_id, event_id % 2 as side, cast(floor(value) as bigint) % 25 as price,
    case when event_type = 'error' and event_id % 79 <> 0 then 0 else 1 + event_id % 90 end as qty,
    case when event_type = 'error' or event_id % 83 = 0 then 2 when event_type = 'click' then 0 else 1 end as action,
    event_type = 'signup' and event_id % 5 = 0 as is_clear, event_id % 3 as clear_side, event_id // 3 % 2 as scope, cast(floor(value) as bigint) % 25 as from_price from events)""",
    "updates": "updates as (select instrument, per_seq, side, price, qty, action from lrows where not is_clear)",
    "clears": "clears as (select instrument, per_seq, clear_side, scope, from_price from lrows where is_clear)",
    "manifests": """manifests as (
  select channel_id, seq as pos, ts_ns as send_ts, case when seq % 71 = 0 then 0 when seq % 73 = 0 then 2 else 1 end as valid,
    greatest(seq // 500 + case when seq % 41 = 0 then 3 when seq % 43 = 0 then -1 else 0 end, 0) as manifest_seq,
    30 + seq // 500 % 3 + case when seq % 29 = 0 then 1 else 0 end as count from ticks where event_type = 'signup')""",
    "definitions": """definitions as (
  select channel_id, seq as pos, ts_ns as send_ts, instrument, greatest(seq // 500 - case when seq % 37 = 0 then 1 else 0 end, 0) as manifest_seq, instrument % 4 as price_bound
  from ticks where event_type = 'view')""",
    "plain_manifests": "plain_manifests as (select distinct channel_id, seq // 500 * 500 as pos, seq // 500 as manifest_seq, 20 as count from ticks)",
    "srows": """srows as (
  with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem),
  t as (select l_orderkey, count(*) as n from lineitem group by 1)
  select o_orderkey % 8 as channel_id, o_orderkey as g, o_orderkey * 40 as pos, 'begin' as kind, o_orderkey // 8 - case when o_orderkey % 31 = 0 then 2 else 0 end as snapshot_id,
    o_custkey % 50 as instrument, o_orderkey * 3 - case when o_orderkey % 17 = 0 then 300 else 0 end as anchor, coalesce(n, 0) + case when o_orderkey % 19 = 0 then 1 else 0 end as total, null::bigint as key
  from orders left join t on o_orderkey = l_orderkey
  union all select o_orderkey % 8, o_orderkey, o_orderkey * 40 + 39, 'end', o_orderkey // 8 - case when o_orderkey % 31 = 0 then 2 else 0 end, o_custkey % 50,
    o_orderkey * 3 - case when o_orderkey % 17 = 0 then 300 else 0 end + case when o_orderkey % 29 = 0 then 1 else 0 end, null, null from orders where o_orderkey % 23 <> 0
  union all select o_orderkey % 8, o_orderkey, o_orderkey * 40 + k, 'row', o_orderkey // 8 - case when o_orderkey % 31 = 0 then 2 else 0 end + case when l_suppkey % 97 = 0 then 1 else 0 end,
    null, null, null, l_partkey % 50 from l join orders on l_orderkey = o_orderkey)""",
    "findings": """findings as (
  select event_id as pos, epoch_us(ts) // 1000000 as at_s, case event_type when 'error' then 'FRAME.MAGIC_MISMATCH' when 'click' then 'BATCH.ID_MONOTONIC' when 'view' then 'HEARTBEAT.CADENCE'
    when 'signup' then 'FRAME.SCHEMA_VERSION' else 'REF.EXEC_OVERFILL' end as rule_id,
    case when event_id % 7 = 0 then 'violation' when event_id % 7 = 1 then 'unverifiable' when event_id % 7 = 2 then 'na' when event_id % 70 = 3 then 'suspected' when user_id % 5 = 0 then 'unverifiable' else 'pass' end as status,
    case event_id % 3 when 0 then 'loss' when 1 then 'cold_start' else '' end as reason from events)""",
}
_NEEDS = {"tape": ["ticks"], "deltas": ["ticks"], "updates": ["lrows"], "clears": ["lrows"], "manifests": ["ticks"], "definitions": ["ticks"], "plain_manifests": ["ticks"]}


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the WITH clauses named, and those they need, before ``body`` (which may go on with its own)."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    more = body.lstrip()
    own = more.startswith("with ")
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(CTES[n] for n in order) + (",\n" + more[5:] if own else "\n" + more)
