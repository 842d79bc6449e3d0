"""Datagrams to frames to messages, and the structural rules on them. Everything here is row-local: no shuffle.

datagrams: capture_id, arrival, port, raw. Where the messages of a frame begin is found in Arrow batches, for all frames
of a batch at once; the header, all message fields and every rule are column expressions.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.layout import FRAME_HEADER, MAGIC, MAX_FRAME, MESSAGE_HEADER, SCHEMA_VERSION, Field, message, of_feed
from ..functions.wire import backward, read

_HEADER = (
    Field("magic", 0, "u16"), Field("schema_version", 2, "u8"), Field("channel_id", 3, "u8"), Field("seq", 4, "u64"), Field("send_ts", 12, "u64"),
    Field("msg_count", 20, "u8"), Field("reset_count", 21, "u8"), Field("frame_length", 22, "u16"),
)


def starts_of(raw: pa.Array) -> pa.Array:
    """Offsets of the messages that lie whole inside each datagram and inside its declared length, as int32 lists.

    All datagrams advance together, one message a turn; a turn costs what the datagrams still under way cost."""
    raw = raw.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
    size = np.diff(bounds)
    rows = np.flatnonzero(size >= FRAME_HEADER)
    base = bounds[rows]
    end = np.minimum(size[rows], data[base + 22] + data[base + 23].astype(np.int64) * 256)
    at = np.full(len(rows), FRAME_HEADER, np.int64)
    whose, where = [], []
    while len(rows):
        fits = at + MESSAGE_HEADER <= end
        rows, base, end, at = rows[fits], base[fits], end[fits], at[fits]
        length = data[base + at + 1].astype(np.int64)
        fits = (length >= MESSAGE_HEADER) & (at + length <= end)
        rows, base, end, at, length = rows[fits], base[fits], end[fits], at[fits], length[fits]
        whose.append(rows)
        where.append(at)
        at = at + length
    whose, where = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (whose, where))
    order = np.argsort(whose, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(raw)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(where[order], pa.int32()))


@F.arrow_udf(ArrayType(IntegerType()))
def _starts(raw: pa.Array) -> pa.Array:
    return starts_of(raw)


def _byte(at: Column | int) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.hex(F.substring(F.col("raw"), at + 1, F.lit(1))), 16, 10).cast("int")


#: The rules of ``_frame_rules``.
WALKED = ("FRAME.LENGTH_CONSISTENCY", "FRAME.MAGIC_MISMATCH", "FRAME.SCHEMA_VERSION", "MSG.LENGTH_PER_TYPE", "FRAME.MSG_COUNT_RANGE")


def _frame_rules(feed: str) -> Column:
    """The findings of a datagram: each rule is a predicate on its header, its size and the end of its last message.

    What a cut on the way can explain is transport; a publisher's own contradiction is not. Counts, and the end of the
    messages, are judged only where nothing was cut."""
    size, declared, count, n = F.octet_length("raw"), F.col("frame_length"), F.col("msg_count"), F.size("starts")
    own = (size >= FRAME_HEADER) & (F.col("magic") == MAGIC[feed])
    legal = declared.between(FRAME_HEADER, MAX_FRAME)
    cut = legal & (declared > size)
    stop, next_length = F.col("__stop"), F.col("__next")
    left = F.least(declared, size) - stop
    beyond = next_length >= MESSAGE_HEADER

    def say(rule: str, when: Column, at: Column | int, detail: list, transport: Column | bool = False) -> Column:
        parts = [x.cast("string") if isinstance(x, Column) else F.lit(x) for x in detail]
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(when, F.struct(F.lit(rule).alias("rule_id"), as_column(at).cast("int").alias("at"), F.concat(*parts).alias("detail"), as_column(transport).alias("transport")))

    return F.array_compact(
        F.array(
            say("FRAME.LENGTH_CONSISTENCY", size < FRAME_HEADER, 0, [size, " bytes are no header"], True),
            say("FRAME.MAGIC_MISMATCH", (size >= FRAME_HEADER) & ~own, 0, ["magic ", F.col("magic")]),
            say("FRAME.SCHEMA_VERSION", own & (F.col("schema_version") != SCHEMA_VERSION[feed]), 2, ["version ", F.col("schema_version")]),
            say("FRAME.LENGTH_CONSISTENCY", own & ~legal, 22, ["frame length ", declared]),
            say("FRAME.LENGTH_CONSISTENCY", own & legal & (declared != size), 22, ["frame length ", declared, " of ", size], declared > size),
            say("FRAME.LENGTH_CONSISTENCY", own & left.between(1, MESSAGE_HEADER - 1), stop, ["rest is no message header"], cut),
            say("MSG.LENGTH_PER_TYPE", own & (next_length < MESSAGE_HEADER), stop, ["message length ", next_length]),
            say("FRAME.LENGTH_CONSISTENCY", own & beyond & (stop + next_length > declared), stop, ["message beyond the frame"]),
            say("FRAME.LENGTH_CONSISTENCY", own & beyond & (stop + next_length <= declared), stop, ["message beyond the datagram"], legal),
            say("FRAME.MSG_COUNT_RANGE", own & (count == 0), 20, ["message count 0"]),
            say("FRAME.MSG_COUNT_RANGE", own & ~cut & (count > 0) & (count != n), 20, ["message count ", count, " of ", n]),
            say("FRAME.LENGTH_CONSISTENCY", own & ~cut & legal & (stop != declared), stop, ["messages end at ", stop, " of ", declared]),
        )
    )


def decode_frames(datagrams: DataFrame, feed: str) -> DataFrame:
    """``datagrams`` with the header's fields, ``starts`` (offsets of the messages; none in a foreign frame) and
    ``findings``. Short datagrams have an all-zero header; null ones are empty."""
    raw = F.coalesce("raw", F.lit(b""))
    whole = F.octet_length("raw") >= FRAME_HEADER
    header = {f.name: F.when(whole, read("raw", f, 0, "__back")).otherwise(F.lit(0)).cast("bigint") for f in _HEADER}
    back = F.expr(backward(f"substring(raw, 1, {FRAME_HEADER})"))
    out = datagrams.withColumn("raw", raw).withColumn("starts", _starts("raw")).withColumn("__back", back).withColumns({"feed": F.lit(feed), **header})
    none = F.array().cast("array<int>")
    out = out.withColumn("starts", F.when(F.col("magic") == MAGIC[feed], F.col("starts")).otherwise(none))
    # Where the messages end, and the length that stands there, are worked out once for all rules.
    last = F.element_at("starts", -1)
    out = out.withColumn("__stop", F.when(F.size("starts") > 0, last + _byte(last + 1)).otherwise(FRAME_HEADER))
    left = F.least("frame_length", F.octet_length("raw")) - F.col("__stop")
    out = out.withColumn("__next", F.when(left >= MESSAGE_HEADER, _byte(F.col("__stop") + 1)))
    return out.withColumn("findings", _frame_rules(feed)).drop("__back", "__stop", "__next")


def frame_findings(frames: DataFrame) -> DataFrame:
    """rule_id, status, transport, detail and the frame's place, a row for each finding of the walk."""
    f = frames.select("capture_id", "arrival", "feed", "port", "channel_id", "seq", F.explode_outer("findings").alias("f")).where("f is not null")
    return f.select("capture_id", "arrival", "feed", "port", "channel_id", "seq", "f.rule_id", F.lit("violation").alias("status"), "f.transport", "f.detail")


def messages_of(frames: DataFrame) -> DataFrame:
    """A row for each message, with the frame's header."""
    own = ("raw", "findings", "starts", "flags", "type", "length")
    keep = [c for c in frames.columns if c not in own]
    # Outer, as a plain explode has the planner ask for the list's size below, where the whole header is worked out again.
    m = frames.select(*keep, "raw", F.posexplode_outer("starts").alias("msg_index", "at")).where("at is not null")
    length = _byte(F.col("at") + 1)
    body = F.substring(F.col("raw"), F.col("at") + MESSAGE_HEADER + 1, length - MESSAGE_HEADER)
    return m.select(*keep, "msg_index", _byte(F.col("at")).alias("type"), length.alias("length"), (_byte(F.col("at") + 2) + 256 * _byte(F.col("at") + 3)).alias("flags"), body.alias("body"))


def registered(source: Column, ranges: list[tuple[int, int]] | None) -> Column:
    """Whether a source id is in one of the inclusive ranges; 0 never is. Without ranges every other id is."""
    if ranges is None:
        return source != 0
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | source.between(low, high)
    return (source != 0) & inside


def structural(messages: DataFrame, feed: str, ranges: list[tuple[int, int]] | None = ((1, 1023),), rules: Collection[str] | None = None) -> DataFrame:
    """Findings of the structural rules on messages: one projection that lists a message's findings, then explodes. With
    ``rules``, of these alone.

    Reserved types come before unknown ones and both end a message's checks. Field rules need the canonical length."""
    kinds = of_feed(feed)
    kind = F.col("type")
    known = kind.isin([m.type for m in kinds])
    reserved = kind.isin(3, 5) if feed == "mbo" else F.lit(False)
    length = F.lit(0)
    placed = F.lit(False)
    for m in kinds:
        length = F.when(kind == m.type, m.length).otherwise(length)
        placed = placed | ((kind == m.type) & (F.col("port") == m.port))
    rows: list[Column] = []
    asked = lambda rule: rules is None or rule in rules
    fields: dict[str, Column] = {}  # of a message of the kind, worked out once for all rules

    def say(rule: str, when: Column, status: str = "violation", names: str | None = None, any_length: bool = False) -> None:
        """``when`` is asked of known messages, of the kind ``names`` and canonical length if given."""
        if not asked(rule):
            return
        if names:
            m = message(feed, names)
            when = (kind == m.type) & when if any_length else (kind == m.type) & (F.col("length") == m.length) & when
        rows.append(F.when(known & ~reserved & when, F.struct(F.lit(rule).alias("rule_id"), F.lit(status).alias("status"))))

    def field(names: str, name: str) -> Column:
        m = message(feed, names)
        fields[f"__{names}_{name}"] = F.when(kind == m.type, read("body", next(f for f in m.fields if f.name == name), back="__back"))
        return F.col(f"__{names}_{name}")

    def bits(names: str, name: str, mask: int) -> Column:
        return field(names, name).bitwiseAND(F.lit(mask).cast("bigint"))

    for rule, when, status in (("MSG.RESERVED_TYPE_0X03_0X05", reserved, "violation"), ("MSG.UNKNOWN_TYPE_SKIPPED", ~reserved & ~known, "pass")):
        if asked(rule):
            rows.append(F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(status).alias("status"))))
    say("MSG.LENGTH_PER_TYPE", F.col("length") != length)
    say("MSG.WRONG_PORT_PLACEMENT", ~placed)
    say("HEARTBEAT.CHANNEL_ID_MATCH", field("heartbeat", "channel") != F.col("channel_id"), names="heartbeat")
    if feed == "mbp":
        say("MSG.SNAPSHOT_FLAG_MATCHES_PORT", (F.col("flags").bitwiseAND(F.lit(1)) == 1) != (F.col("port") == "snapshot"))
    if feed in ("mbo", "mbp"):
        say("RESET.ANCHOR_SEQ_IS_CURRENT_FRAME", field("instrument_reset", "anchor") != F.col("seq"), names="instrument_reset")
    if feed == "mbo":
        say("FIELD.SIDE_ENUM", field("order_add", "side") > 1, names="order_add")
        say("FIELD.QTY_POSITIVE", field("order_add", "qty") == 0, names="order_add")
        say("RESERVED.FIELD_BITS_ZERO", bits("order_add", "flags", 0xE0) != 0, names="order_add")
        say("FIELD.AGGRESSOR_SIDE_ENUM", field("order_execute", "aggressor") > 2, names="order_execute")
        say("RESERVED.FIELD_BITS_ZERO", bits("order_execute", "exec_flags", 0xFC) != 0, names="order_execute")
        say("FIELD.AGGRESSOR_SIDE_ENUM", field("trade", "aggressor") > 2, names="trade")
        say("SNAP.ORDER_STRUCT_VALID", field("snapshot_order", "side") > 1, names="snapshot_order")
        say("SNAP.ORDER_STRUCT_VALID", bits("snapshot_order", "flags", 0xE0) != 0, names="snapshot_order")
        say("SNAP.ORDER_STRUCT_VALID", field("snapshot_order", "qty") == 0, names="snapshot_order")
    if feed == "tob":
        gone_bid, gone_ask = bits("quote", "update_flags", 4) != 0, bits("quote", "update_flags", 8) != 0
        bid, ask = field("quote", "bid_price"), field("quote", "ask_price")
        say("TOB.QUOTE.STRUCT_LEN_TYPE", F.col("length") != message(feed, "quote").length, names="quote", any_length=True)
        say("TOB.QUOTE.GONE_VS_ZERO_PRICE", gone_bid & (bid != 0), names="quote")
        say("TOB.QUOTE.GONE_VS_ZERO_PRICE", gone_ask & (ask != 0), names="quote")
        say("TOB.QUOTE.CROSSED_LOCKED", ~gone_bid & ~gone_ask & (bid >= ask), names="quote")
        say("TOB.QUOTE.UPDATE_FLAGS_COHERENCE", bits("quote", "update_flags", 15) == 0, names="quote")
        say("TOB.QUOTE.SOURCE_ID_REGISTRY", ~registered(field("quote", "source"), ranges), names="quote")
        say("TOB.QUOTE.SOURCE_COUNT", ~gone_bid & (bid != 0) & (field("quote", "bid_count") == 0), "pass", "quote")
        say("TOB.QUOTE.SOURCE_COUNT", ~gone_ask & (ask != 0) & (field("quote", "ask_count") == 0), "pass", "quote")
        say("TOB.TRADE.FIELDS", field("trade", "aggressor") > 2, names="trade")
        say("TOB.TRADE.FIELDS", bits("trade", "flags", 0xF8) != 0, names="trade")
        say("TOB.TRADE.FIELDS", ~registered(field("trade", "source"), ranges), names="trade")
    if feed == "midpoint":
        method = field("midpoint", "method")
        say("MID.STRUCT_LEN_TYPE", F.col("length") != message(feed, "midpoint").length, names="midpoint", any_length=True)
        say("MID.METHOD_RANGE", (method > 4) & (method != 255), "pass", "midpoint")
        say("MID.QUALITY_FLAGS", bits("midpoint", "quality", 0xF0) != 0, names="midpoint")
        say("MID.TIMESTAMP_ORDERING", field("midpoint", "compute_ts") < field("midpoint", "book_ts"), names="midpoint")
    keep = [c for c in messages.columns if c not in ("body", "rule_id", "status")]
    if not rows:
        return messages.where("false").select(*keep, F.lit("").alias("rule_id"), F.lit("").alias("status"))
    found = messages.withColumn("__back", F.expr(backward("body"))).withColumns(fields).withColumn("f", F.explode_outer(F.array_compact(F.array(*rows)))).where("f is not null")
    return found.select(*keep, "f.rule_id", "f.status")
