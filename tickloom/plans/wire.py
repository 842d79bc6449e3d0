"""Queries on the wire: rows are encoded as frames, and read back by the walk, the decoders and the structural rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wire as w
from ..functions.layout import MESSAGES, message
from ..operators import frames as fr
from . import feeds
from .feeds import with_ctes
from .registry import query


def _c(text: str) -> F.Column:
    return F.expr(text)


def datagrams(rows: DataFrame, feed: str, body: F.Column, port: F.Column | str = "mktdata", channel: F.Column | None = None, **forged: F.Column) -> DataFrame:
    """A frame of one message for each row of ticks; ``forged`` overrides header fields."""
    raw = w.frame(feed, channel if channel is not None else F.col("channel_id"), F.col("seq"), F.col("ts_ns"), _c("seq div 2500"), body, forged.pop("count", F.lit(1)), **forged)
    return rows.select(F.lit("ticks").alias("capture_id"), F.col("seq").alias("arrival"), (port if isinstance(port, F.Column) else F.lit(port)).alias("port"), raw.alias("raw"))


def _messages(grams: DataFrame, feed: str) -> DataFrame:
    return fr.messages_of(fr.decode_frames(grams, feed))


_ADD = {"instrument": "instrument", "source": "1 + seq % 3", "side": "seq % 4", "flags": "if(seq % 31 = 0, 32, 1)", "per_seq": "seq", "order_id": "seq * 7", "enter_ts": "ts_ns", "price": "price - 5000", "qty": "qty"}
_QUOTE = {"instrument": "instrument", "source": "seq % 1100", "update_flags": "seq % 16", "source_ts": "ts_ns", "bid_price": "price", "bid_qty": "qty", "ask_price": "price + seq % 5 - 2", "ask_qty": "qty + 1", "bid_count": "seq % 3", "ask_count": "seq % 2"}
_LEVEL = {"instrument": "instrument", "source": "1", "side": "side", "action": "seq % 3", "per_seq": "seq", "price": "price", "qty": "qty", "ts": "ts_ns", "order_count": "if(seq % 10 = 0, 65535, seq % 100)", "level_index": "65535", "reason": "0", "level_flags": "0"}
_MID = {"instrument": "instrument", "source": "1", "method": "seq % 260 % 256", "quality": "seq % 20", "book_ts": "ts_ns", "compute_ts": "ts_ns + 500 - seq % 1000", "mid_price": "price"}
_EXEC = {"instrument": "instrument", "source": "1", "aggressor": "seq % 5", "exec_flags": "seq % 6", "per_seq": "seq", "order_id": "seq", "trade_id": "seq", "ts": "ts_ns", "price": "price", "qty": "qty"}
_TRADE = {"instrument": "instrument", "source": "seq % 1100", "aggressor": "seq % 4", "flags": "if(seq % 13 = 0, 8, 0)", "source_ts": "ts_ns", "price": "price", "qty": "qty", "trade_id": "seq", "volume": "seq"}


def _body(feed: str, name: str, values: dict[str, str], **options) -> F.Column:
    return w.write(message(feed, name), {k: _c(v) for k, v in values.items()}, **options)


@query("wire_roundtrip_order_add", with_ctes("ticks", """
select channel_id, seq, instrument, 1 + seq % 3 as source, seq % 4 as side, seq as per_seq, seq * 7 as order_id, ts_ns as enter_ts, price - 5000 as price, qty from ticks"""))
def wire_roundtrip_order_add(spark, sf):
    m = _messages(datagrams(feeds.ticks(spark, sf), "mbo", _body("mbo", "order_add", _ADD)), "mbo")
    d = w.decode(m, message("mbo", "order_add"), ("channel_id", "seq"))
    big = {c: F.col(c).cast("bigint") for c in ("order_id", "enter_ts", "qty")}
    return d.withColumns(big).select("channel_id", "seq", "instrument", "source", "side", "per_seq", "order_id", "enter_ts", "price", "qty")


@query("wire_roundtrip_quote", with_ctes("ticks", "select seq, instrument, seq % 16 as update_flags, price as bid_price, price + seq % 5 - 2 as ask_price, seq % 3 as bid_count, seq % 2 as ask_count from ticks"))
def wire_roundtrip_quote(spark, sf):
    m = _messages(datagrams(feeds.ticks(spark, sf), "tob", _body("tob", "quote", _QUOTE)), "tob")
    return w.decode(m, message("tob", "quote"), ("seq",)).select("seq", "instrument", "update_flags", "bid_price", "ask_price", "bid_count", "ask_count")


@query("wire_roundtrip_level_update", with_ctes("ticks", "select seq, instrument, side, seq % 3 as action, price, qty, case when seq % 10 = 0 then null else seq % 100 end as order_count, null::bigint as level_index from ticks"))
def wire_roundtrip_level_update(spark, sf):
    from ..operators.derived import provided

    m = _messages(datagrams(feeds.ticks(spark, sf), "mbp", _body("mbp", "level_update", _LEVEL)), "mbp")
    d = w.decode(m, message("mbp", "level_update"), ("seq",))
    return d.select("seq", "instrument", "side", "action", "price", F.col("qty").cast("bigint").alias("qty"), provided(F.col("order_count")).alias("order_count"), provided(F.col("level_index")).alias("level_index"))


@query("wire_roundtrip_definition", with_ctes("ticks", "select seq, instrument, 'SYM-' || instrument as symbol, -(seq % 9) as price_exp, seq % 3 as price_bound, seq % 65536 as manifest_seq from ticks"))
def wire_roundtrip_definition(spark, sf):
    values = {"instrument": "instrument", "symbol": "concat('SYM-', instrument)", "price_exp": "-(seq % 9)", "price_bound": "seq % 3", "manifest_seq": "seq % 65536"}
    m = _messages(datagrams(feeds.ticks(spark, sf), "mbo", _body("mbo", "definition", values), "refdata"), "mbo")
    return w.decode(m, message("mbo", "definition"), ("seq",)).select("seq", "instrument", "symbol", "price_exp", "price_bound", "manifest_seq")


@query("wire_roundtrip_perp", with_ctes("ticks", "select seq, price - 9000 as funding, price as mark, seq as open_interest from ticks"))
def wire_roundtrip_perp(spark, sf):
    m = _messages(datagrams(feeds.ticks(spark, sf), "perp", _body("perp", "perp_stats", {"instrument": "instrument", "mark": "price", "funding": "price - 9000", "open_interest": "seq"})), "perp")
    d = w.decode(m, message("perp", "perp_stats"), ("seq",))
    return d.select("seq", "funding", "mark", F.col("open_interest").cast("bigint").alias("open_interest"))


@query("wire_roundtrip_intent", with_ctes("ticks", "select seq, seq % 8 as batch_index, 8 as batch_count, seq * 3 as action_tag, lower(hex(encode('s' || instrument))) as signer from ticks"))
def wire_roundtrip_intent(spark, sf):
    values = {"instrument": "instrument", "batch_index": "seq % 8", "batch_count": "8", "action_tag": "seq * 3", "signer": "encode(concat('s', instrument), 'UTF-8')"}
    m = _messages(datagrams(feeds.ticks(spark, sf), "intent", _body("intent", "order_new", values)), "intent")
    d = w.decode(m, message("intent", "order_new"), ("seq",))
    signer = F.lower(F.regexp_replace(F.hex("signer"), "(00)+$", ""))
    return d.select("seq", "batch_index", F.col("batch_count"), F.col("action_tag").cast("bigint").alias("action_tag"), signer.alias("signer"))


@query("le_u64_extremes", "select * from (values (0, '0', 0::bigint), (1, '18446744073709551615', -1), (2, '9223372036854775808', -9223372036854775808), (3, '9223372036854775807', 9223372036854775807)) as t(k, as_u64, as_i64)")
def le_u64_extremes(spark, sf):
    from ..functions.layout import Field

    rows = spark.createDataFrame([(0, "00" * 8), (1, "FF" * 8), (2, "00" * 7 + "80"), (3, "FF" * 7 + "7F")], "k int, digits string").withColumn("body", F.unhex("digits"))
    return rows.select("k", w.read("body", Field("x", 0, "u64"), 0).cast("string").alias("as_u64"), w.read("body", Field("x", 0, "i64"), 0).alias("as_i64"))


def _several(spark, sf) -> DataFrame:
    """Frames of seq % 4 heartbeats; some declare another count or length, some are cut or lengthened."""
    beat = w.write(message("mbo", "heartbeat"), {"channel": F.col("channel_id"), "ts": F.col("ts_ns")})
    body = F.when(_c("seq % 4 = 0"), F.unhex(F.lit(""))).when(_c("seq % 4 = 1"), beat).when(_c("seq % 4 = 2"), F.concat(beat, beat)).otherwise(F.concat(beat, beat, beat))
    count = _c("seq % 4 + if(seq % 17 = 0, 1, 0)")
    length = _c("cast(24 + seq % 4 * 16 + if(seq % 19 = 0, 5, 0) as bigint)")
    g = datagrams(feeds.ticks(spark, sf), "mbo", body, count=count, length=length)
    cut = F.when(_c("arrival % 23 = 0"), F.substring("raw", 1, 20)).when(_c("arrival % 29 = 0"), F.concat("raw", F.unhex(F.lit("AABB")))).otherwise(F.col("raw"))
    return g.withColumn("raw", cut)


@query("frame_walk_message_counts", with_ctes("ticks", "select seq % 4 as n_messages, count(*) as n from ticks where seq % 23 <> 0 group by 1"))
def frame_walk_message_counts(spark, sf):
    f = fr.decode_frames(_several(spark, sf), "mbo").where("octet_length(raw) >= 24")
    return f.groupBy(F.size("starts").cast("bigint").alias("n_messages")).agg(F.count("*").alias("n"))


@query("frame_length_findings", with_ctes("ticks", """
with k as (select seq, seq % 4 as m, seq % 17 = 0 as c, seq % 19 = 0 as l, seq % 23 = 0 as runt, seq % 29 = 0 as longer from ticks),
f as (
  select 'FRAME.LENGTH_CONSISTENCY' as rule_id, true as transport from k where runt
  union all select 'FRAME.LENGTH_CONSISTENCY', true from k where not runt and l
  union all select 'FRAME.LENGTH_CONSISTENCY', false from k where not runt and not l and longer
  union all select 'FRAME.LENGTH_CONSISTENCY', true from k where not runt and l and longer
  union all select 'FRAME.MSG_COUNT_RANGE', false from k where not runt and m = 0 and not c
  union all select 'FRAME.MSG_COUNT_RANGE', false from k where not runt and not l and c)
select rule_id, transport, count(*) as n from f group by all"""))
def frame_length_findings(spark, sf):
    found = fr.frame_findings(fr.decode_frames(_several(spark, sf), "mbo"))
    return found.groupBy("rule_id", "transport").agg(F.count("*").alias("n"))


@query("frame_magic_mismatch", with_ctes("ticks", "select seq from ticks where seq % 7 = 0"))
def frame_magic_mismatch(spark, sf):
    g = datagrams(feeds.ticks(spark, sf), "mbo", _body("mbo", "order_add", _ADD))
    g = g.withColumn("raw", F.when(_c("arrival % 7 = 0"), F.concat(F.unhex(F.lit("5A44")), F.expr("substring(raw, 3)"))).otherwise(F.col("raw")))
    return fr.frame_findings(fr.decode_frames(g, "mbo")).where("rule_id = 'FRAME.MAGIC_MISMATCH'").select("seq")


def _rules(name: str, sql: str, feed: str, kind: str, values: dict[str, str], rules: tuple[str, ...], **options) -> None:
    """A query that lists (rule_id, status, seq) of the structural rules on a feed of one kind of message."""

    @query(name, with_ctes("ticks", sql))
    def run(spark, sf):
        grams = datagrams(feeds.ticks(spark, sf), feed, _body(feed, kind, values, **options.get("write", {})), options.get("port", "mktdata"), options.get("channel"))
        return fr.structural(_messages(grams, feed), feed).where(F.col("rule_id").isin(*rules)).select("rule_id", "status", "seq")


_rules("rule_side_enum", "select 'FIELD.SIDE_ENUM' as rule_id, 'violation' as status, seq from ticks where seq % 4 > 1", "mbo", "order_add", _ADD, ("FIELD.SIDE_ENUM",))
_rules("rule_qty_positive", "select 'FIELD.QTY_POSITIVE' as rule_id, 'violation' as status, seq from ticks where qty = 0", "mbo", "order_add", _ADD, ("FIELD.QTY_POSITIVE",))
_rules("rule_reserved_bits", "select 'RESERVED.FIELD_BITS_ZERO' as rule_id, 'violation' as status, seq from ticks where seq % 31 = 0", "mbo", "order_add", _ADD, ("RESERVED.FIELD_BITS_ZERO",))
_rules("rule_aggressor_enum", """
select 'FIELD.AGGRESSOR_SIDE_ENUM' as rule_id, 'violation' as status, seq from ticks where seq % 5 > 2
union all select 'RESERVED.FIELD_BITS_ZERO', 'violation', seq from ticks where seq % 6 >= 4""", "mbo", "order_execute", _EXEC, ("FIELD.AGGRESSOR_SIDE_ENUM", "RESERVED.FIELD_BITS_ZERO"))
_rules("rule_gone_zero_price", """
select 'TOB.QUOTE.GONE_VS_ZERO_PRICE' as rule_id, 'violation' as status, seq from ticks where seq % 16 & 4 <> 0 and price <> 0
union all select 'TOB.QUOTE.GONE_VS_ZERO_PRICE', 'violation', seq from ticks where seq % 16 & 8 <> 0 and price + seq % 5 - 2 <> 0""", "tob", "quote", _QUOTE, ("TOB.QUOTE.GONE_VS_ZERO_PRICE",))
_rules("rule_crossed_locked", "select 'TOB.QUOTE.CROSSED_LOCKED' as rule_id, 'violation' as status, seq from ticks where seq % 16 & 12 = 0 and seq % 5 - 2 <= 0", "tob", "quote", _QUOTE, ("TOB.QUOTE.CROSSED_LOCKED",))
_rules("rule_update_flags", "select 'TOB.QUOTE.UPDATE_FLAGS_COHERENCE' as rule_id, 'violation' as status, seq from ticks where seq % 16 = 0", "tob", "quote", _QUOTE, ("TOB.QUOTE.UPDATE_FLAGS_COHERENCE",))
_rules("rule_source_registry", "select 'TOB.QUOTE.SOURCE_ID_REGISTRY' as rule_id, 'violation' as status, seq from ticks where seq % 1100 = 0 or seq % 1100 > 1023", "tob", "quote", _QUOTE, ("TOB.QUOTE.SOURCE_ID_REGISTRY",))
_rules("rule_source_count", """
select 'TOB.QUOTE.SOURCE_COUNT' as rule_id, 'pass' as status, seq from ticks where seq % 16 & 4 = 0 and price <> 0 and seq % 3 = 0
union all select 'TOB.QUOTE.SOURCE_COUNT', 'pass', seq from ticks where seq % 16 & 8 = 0 and price + seq % 5 - 2 <> 0 and seq % 2 = 0""", "tob", "quote", _QUOTE, ("TOB.QUOTE.SOURCE_COUNT",))
_rules("rule_trade_fields", """
select 'TOB.TRADE.FIELDS' as rule_id, 'violation' as status, seq from ticks where seq % 4 = 3
union all select 'TOB.TRADE.FIELDS', 'violation', seq from ticks where seq % 13 = 0
union all select 'TOB.TRADE.FIELDS', 'violation', seq from ticks where seq % 1100 = 0 or seq % 1100 > 1023""", "tob", "trade", _TRADE, ("TOB.TRADE.FIELDS",))
_rules("rule_mid_fields", """
select 'MID.TIMESTAMP_ORDERING' as rule_id, 'violation' as status, seq from ticks where 500 - seq % 1000 < 0
union all select 'MID.QUALITY_FLAGS', 'violation', seq from ticks where seq % 20 >= 16
union all select 'MID.METHOD_RANGE', 'pass', seq from ticks where seq % 260 % 256 > 4 and seq % 260 % 256 <> 255""", "midpoint", "midpoint", _MID, ("MID.TIMESTAMP_ORDERING", "MID.QUALITY_FLAGS", "MID.METHOD_RANGE"))


@query("rule_flag_matches_port", with_ctes("ticks", "select 'MSG.SNAPSHOT_FLAG_MATCHES_PORT' as rule_id, 'violation' as status, seq from ticks where seq % 9 = 0"))
def rule_flag_matches_port(spark, sf):
    g = datagrams(feeds.ticks(spark, sf), "mbp", _body("mbp", "level_update", _LEVEL, flags=_c("if(seq % 9 = 0, 1, 0)")))
    return fr.structural(_messages(g, "mbp"), "mbp").where("rule_id = 'MSG.SNAPSHOT_FLAG_MATCHES_PORT'").select("rule_id", "status", "seq")


@query("rule_wrong_port", with_ctes("ticks", "select 'MSG.WRONG_PORT_PLACEMENT' as rule_id, 'violation' as status, seq from ticks where seq % 6 <> 0"))
def rule_wrong_port(spark, sf):
    port = _c("case seq % 6 when 0 then 'mktdata' when 1 then 'snapshot' else 'refdata' end")
    g = datagrams(feeds.ticks(spark, sf), "mbo", _body("mbo", "order_add", _ADD), port)
    return fr.structural(_messages(g, "mbo"), "mbo").where("rule_id = 'MSG.WRONG_PORT_PLACEMENT'").select("rule_id", "status", "seq")


@query("rule_types_and_lengths", with_ctes("ticks", """
select case seq % 5 when 0 then 'MSG.RESERVED_TYPE_0X03_0X05' when 1 then 'MSG.UNKNOWN_TYPE_SKIPPED' else 'MSG.LENGTH_PER_TYPE' end as rule_id,
  case seq % 5 when 1 then 'pass' else 'violation' end as status, seq from ticks where seq % 5 <= 2"""))
def rule_types_and_lengths(spark, sf):
    kind = _c("case seq % 5 when 0 then 3 when 1 then 200 when 2 then 16 else 1 end")
    body = F.concat(w.little(kind, 1), w.little(F.lit(16), 1), w.little(F.lit(0), 2), w.little(F.col("channel_id"), 1), F.unhex(F.lit("00" * 11)))
    return fr.structural(_messages(datagrams(feeds.ticks(spark, sf), "mbo", body), "mbo"), "mbo").select("rule_id", "status", "seq")


@query("rule_heartbeat_channel", with_ctes("ticks", "select seq from ticks where seq % 11 = 0"))
def rule_heartbeat_channel(spark, sf):
    body = w.write(message("mbo", "heartbeat"), {"channel": _c("channel_id + if(seq % 11 = 0, 1, 0)"), "ts": F.col("ts_ns")})
    return fr.structural(_messages(datagrams(feeds.ticks(spark, sf), "mbo", body), "mbo"), "mbo").where("rule_id = 'HEARTBEAT.CHANNEL_ID_MATCH'").select("seq")


@query("rule_reset_anchor", with_ctes("ticks", "select seq from ticks where seq % 12 = 0"))
def rule_reset_anchor(spark, sf):
    body = w.write(message("mbp", "instrument_reset"), {"instrument": F.col("instrument"), "anchor": _c("seq + if(seq % 12 = 0, 1, 0)")})
    return fr.structural(_messages(datagrams(feeds.ticks(spark, sf), "mbp", body), "mbp"), "mbp").where("rule_id = 'RESET.ANCHOR_SEQ_IS_CURRENT_FRAME'").select("seq")


@query("rule_snapshot_order_fields", with_ctes("ticks", """
select seq, (case when seq % 4 > 1 then 1 else 0 end + case when seq % 31 = 0 then 1 else 0 end + case when qty = 0 then 1 else 0 end)::bigint as n from ticks where seq % 4 > 1 or seq % 31 = 0 or qty = 0"""))
def rule_snapshot_order_fields(spark, sf):
    values = {"snapshot_id": "1", "order_id": "seq", "side": "seq % 4", "flags": "if(seq % 31 = 0, 64, 0)", "price": "price", "qty": "qty"}
    m = _messages(datagrams(feeds.ticks(spark, sf), "mbo", _body("mbo", "snapshot_order", values), "snapshot"), "mbo")
    return fr.structural(m, "mbo").where("rule_id = 'SNAP.ORDER_STRUCT_VALID'").groupBy("seq").agg(F.count("*").alias("n"))


@query("layout_of_messages")
def layout_of_messages(spark, sf):
    return spark.createDataFrame([(m.feed, m.type, m.name, m.length, m.port, len(m.fields)) for m in MESSAGES.values()], "feed string, type int, name string, length int, port string, n_fields int")


@query("feed_check_top_of_book")
def feed_check_top_of_book(spark, sf):
    """The whole engine over a top-of-book feed: quotes of all ticks, and definitions of two thirds of the instruments."""
    from ..engine import Settings, check

    t = feeds.ticks(spark, sf)
    quotes = datagrams(feeds.dealt(t), "tob", _body("tob", "quote", _QUOTE))
    d = t.selectExpr("channel_id", "instrument").where("instrument % 3 > 0").distinct()
    d = d.selectExpr("channel_id", "instrument", "cast(row_number() over (partition by channel_id order by instrument) as bigint) as seq").withColumn("ts_ns", F.lit(0).cast("bigint"))
    n = d.groupBy("channel_id").agg(F.count("*").alias("n")).withColumns({"seq": F.lit(0).cast("bigint"), "ts_ns": F.lit(0).cast("bigint")})
    manifest = datagrams(n, "tob", _body("tob", "manifest", {"channel": "channel_id", "valid": "1", "manifest_seq": "1", "count": "n"}), "refdata")
    definition = datagrams(d, "tob", _body("tob", "definition", {"instrument": "instrument", "source": "1", "manifest_seq": "1"}), "refdata")
    found = check(quotes.unionByName(manifest).unionByName(definition), "tob", Settings(window=8))
    return found.groupBy("rule_id", "severity", "status").agg(F.count("*").alias("n"))
