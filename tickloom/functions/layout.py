"""Wire layouts: every message of a feed with its length, ports and fields."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the wire formats.
FRAME_HEADER, MESSAGE_HEADER, MAX_FRAME = 24, 4, 1232
MAGIC = {"tob": 0x445A, "midpoint": 0x4D44, "mbo": 0x4444, "mbp": 0x4442, "intent": 0x494F, "perp": 0x4450}
SCHEMA_VERSION = {"tob": 3, "midpoint": 1, "mbo": 3, "mbp": 3, "intent": 3, "perp": 3}
PORTS = ("mktdata", "refdata", "snapshot")

_DEFINITION = (
    "instrument 4 u32, source 8 u16, symbol 10 c64, leg1 74 c8, leg2 82 c8, asset_class 90 u8, price_exp 91 i8, qty_exp 92 i8, market_model 93 u8, "
    "tick 94 i64, lot 102 u64, contract_value 110 u64, expiry 118 u64, settle 126 u8, price_bound 127 u8, manifest_seq 128 u16"
)
_SHORT_DEFINITION = (
    "instrument 4 u32, symbol 8 c16, leg1 24 c8, leg2 32 c8, asset_class 40 u8, price_exp 41 i8, default_method 42 u8, price_bound 43 u8, "
    "tick 44 i64, expiry 52 u64, manifest_seq 60 u16"
)
_BEGIN = "instrument 4 u32, anchor 8 u64, total 16 u32, snapshot_id 20 u32, last_seq 24 u32, ts 28 u64"
_INTENT = "instrument 4 u32, source 8 u16, event_flags 10 u8, batch_index 12 u16, batch_count 14 u16, action_tag 16 u64, nonce 24 u64, source_ts 32 u64"

# feeds | type | name | length | port | fields
_TABLE = f"""
tob midpoint mbo mbp perp intent | 1 | heartbeat | 16 | mktdata | channel 4 u8, ts 8 u64
tob mbo mbp perp intent | 2 | definition | 130 | refdata | {_DEFINITION}
midpoint | 2 | definition | 64 | refdata | {_SHORT_DEFINITION}
tob | 3 | quote | 60 | mktdata | instrument 4 u32, source 8 u16, update_flags 10 u8, source_ts 12 u64, bid_price 20 i64, bid_qty 28 u64, ask_price 36 i64, ask_qty 44 u64, bid_count 52 u16, ask_count 54 u16
midpoint | 3 | midpoint | 40 | mktdata | instrument 4 u32, source 8 u16, method 10 u8, quality 11 u8, book_ts 12 u64, compute_ts 20 u64, mid_price 28 i64
tob mbo mbp | 4 | trade | 52 | mktdata | instrument 4 u32, source 8 u16, aggressor 10 u8, flags 11 u8, source_ts 12 u64, price 20 i64, qty 28 u64, trade_id 36 u64, volume 44 u64
tob midpoint mbo mbp perp | 6 | end_of_session | 12 | mktdata | ts 4 u64
tob midpoint mbo mbp perp intent | 7 | manifest | 24 | refdata | channel 4 u8, valid 5 u8, manifest_seq 8 u16, count 12 u32, ts 16 u64
mbp | 8 | liquidation | 48 | mktdata | instrument 4 u32, source 8 u16, flags 10 u8, method 11 u8, trade_id 12 u64, mark_price 20 i64, user 28 b20
mbo | 16 | order_add | 52 | mktdata | instrument 4 u32, source 8 u16, side 10 u8, flags 11 u8, per_seq 12 u32, order_id 16 u64, enter_ts 24 u64, price 32 i64, qty 40 u64
mbo | 17 | order_cancel | 32 | mktdata | instrument 4 u32, source 8 u16, reason 10 u8, per_seq 12 u32, order_id 16 u64, ts 24 u64
mbo | 18 | order_execute | 56 | mktdata | instrument 4 u32, source 8 u16, aggressor 10 u8, exec_flags 11 u8, per_seq 12 u32, order_id 16 u64, trade_id 24 u64, ts 32 u64, price 40 i64, qty 48 u64
mbo mbp | 19 | batch_boundary | 16 | mktdata | batch_id 4 u32, batch_ts 8 u64
mbo mbp | 20 | instrument_reset | 28 | mktdata | instrument 4 u32, reason 8 u8, anchor 12 u64, ts 20 u64
mbo | 32 | snapshot_begin | 36 | snapshot | {_BEGIN}
mbp | 32 | snapshot_begin | 40 | snapshot | {_BEGIN}, depth_bound 36 u32
mbo | 33 | snapshot_order | 44 | snapshot | snapshot_id 4 u32, order_id 8 u64, side 16 u8, flags 17 u8, enter_ts 20 u64, price 28 i64, qty 36 u64
mbo mbp | 34 | snapshot_end | 20 | snapshot | instrument 4 u32, anchor 8 u64, snapshot_id 16 u32
mbp | 64 | level_update | 48 | mktdata | instrument 4 u32, source 8 u16, side 10 u8, action 11 u8, per_seq 12 u32, price 16 i64, qty 24 u64, ts 32 u64, order_count 40 u16, level_index 42 u16, reason 44 u8, level_flags 45 u8
mbp | 65 | book_clear | 36 | mktdata | instrument 4 u32, source 8 u16, clear_side 10 u8, scope 11 u8, per_seq 12 u32, from_price 16 i64, ts 24 u64, reason 32 u8
mbp | 66 | snapshot_level | 32 | snapshot | snapshot_id 4 u32, price 8 i64, qty 16 u64, order_count 24 u16, side 26 u8, level_flags 27 u8
intent | 48 | order_new | 124 | mktdata | instrument 4 u32, source 8 u16, side 10 u8, order_type 11 u8, tif 12 u8, event_flags 13 u8, batch_index 14 u16, batch_count 16 u16, grouping 18 u8, action_tag 20 u64, nonce 28 u64, source_ts 36 u64, price 44 i64, trigger_price 52 i64, qty 60 u64, client_oid 68 b16, signer 84 b20, vault 104 b20
intent | 49 | order_cancel | 88 | mktdata | {_INTENT}, order_id 40 u64, signer 48 b20, vault 68 b20
intent | 50 | order_cancel_client | 96 | mktdata | {_INTENT}, client_oid 40 b16, signer 56 b20, vault 76 b20
intent | 51 | order_modify | 148 | mktdata | {_INTENT}, target_oid 44 u64, target_client_oid 52 b16, price 68 i64, trigger_price 76 i64, qty 84 u64, new_client_oid 92 b16, signer 108 b20, vault 128 b20
intent | 52 | schedule_cancel | 88 | mktdata | {_INTENT}, trigger_time_ms 40 u64, signer 48 b20, vault 68 b20
perp | 48 | perp_stats | 124 | mktdata | instrument 4 u32, source 8 u16, funding_hours 10 u8, source_ts 12 u64, mark 20 i64, oracle 28 i64, mid 36 i64, prev_day 44 i64, impact_bid 52 i64, impact_ask 60 i64, open_interest 68 u64, day_base_vol 76 u64, day_notional 84 i64, funding 92 i64, predicted 100 i64, premium 108 i64, next_funding 116 u64
"""


@dataclass(frozen=True)
class Field:
    name: str
    offset: int  # from the start of the message
    kind: str  # u8 u16 u32 u64 i8 i64, cN text, bN bytes

    @property
    def size(self) -> int:
        return int(self.kind[1:]) // (1 if self.kind[0] in "cb" else 8)


@dataclass(frozen=True)
class Message:
    feed: str
    type: int
    name: str
    length: int
    port: str
    fields: tuple[Field, ...]


def _read() -> dict[tuple[str, int], Message]:
    out = {}
    for line in _TABLE.strip().splitlines():
        feeds, kind, name, length, port, fields = (x.strip() for x in line.split("|"))
        parts = tuple(Field(n, int(o), k) for n, o, k in (f.split() for f in fields.split(", ")))
        for feed in feeds.split():
            out[feed, int(kind)] = Message(feed, int(kind), name, int(length), port, parts)
    return out


#: (feed, type) -> message. A type number means different things in different feeds.
MESSAGES = _read()


def message(feed: str, name: str) -> Message:
    return next(m for m in MESSAGES.values() if m.feed == feed and m.name == name)


def of_feed(feed: str) -> list[Message]:
    return [m for m in MESSAGES.values() if m.feed == feed]
