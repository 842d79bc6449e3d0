"""Little-endian readers and writers as Column expressions, so that Catalyst prunes the fields nobody reads.

Readers give 0 where the body is too short. u64 is DECIMAL(20,0), i64 and everything smaller BIGINT.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import FRAME_HEADER, MAGIC, MESSAGE_HEADER, SCHEMA_VERSION, Field, Message

U64 = "decimal(20,0)"


def backward(body: str) -> str:
    """SQL text for the hex digits of a body, last byte first: one reversal for all numbers of a message."""
    return f"hex(encode(reverse(decode({body}, 'ISO-8859-1')), 'ISO-8859-1'))"


def reading(body: str, field: Field, base: int = MESSAGE_HEADER, back: str | None = None) -> str:
    """SQL text for the field of a message body, a column's name; ``base`` is the offset at which the body starts, and
    ``back`` the column that holds the body ``backward``, if there is one."""
    at, size = field.offset - base, field.size
    whole = f"octet_length({body}) >= {at + size}"
    if field.kind[0] == "b":
        return f"if({whole}, substring({body}, {at + 1}, {size}), null)"
    if field.kind[0] == "c":
        return f"if({whole}, rtrim(translate(decode(substring({body}, {at + 1}, {size}), 'US-ASCII'), '\\u0000', ' ')), null)"
    own = f"substring({body}, {at + 1}, {size})"
    digits = f"substring({back}, {-2 * (at + size)}, {2 * size})" if back else f"hex({own})" if size == 1 else backward(own)
    kind = U64 if field.kind == "u64" else "bigint"
    value = f"cast(conv({digits}, 16, {-10 if field.kind == 'i64' else 10}) as {kind})"
    if field.kind == "i8":
        value = f"(({value} + 128) % 256 - 128)"
    return f"coalesce(if({whole}, {value}, null), cast(0 as {kind}))"


def read(body: Column | str, field: Field, base: int = MESSAGE_HEADER, back: str | None = None) -> Column:
    """The same as a column; ``body`` is a column's name, or the column itself."""
    name = body if isinstance(body, str) else str(body).removeprefix("Column<'").removesuffix("'>")
    return F.expr(reading(name, field, base, back))


def decode(messages: DataFrame, kind: Message, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed view: the messages of one kind with their fields as columns, and the columns in ``keep``."""
    own = messages.where(f"feed = '{kind.feed}' and type = {kind.type}")
    own = own.selectExpr("*", f"{backward('body')} as __back")
    return own.selectExpr(*keep, *(f"{reading('body', f, back='__back')} as {f.name}" for f in kind.fields))


def _digits(value: Column, size: int) -> Column:
    """The hex digits, high byte first, of a number that fits in ``size`` bytes (negative ones in two's complement)."""
    text = F.when(value > F.lit((1 << 63) - 1), F.conv(value.cast(U64).cast("string"), 10, 16)).otherwise(F.hex(value.cast("bigint")))
    return F.lpad(F.right(text, F.lit(2 * size)), 2 * size, "0")


def _turned(digits: Column) -> Column:
    """The bytes of hex digits, last byte first: one reversal for all numbers of a message, as text of a character a byte."""
    return F.encode(F.reverse(F.decode(F.unhex(digits), "ISO-8859-1")), "ISO-8859-1")


def little(value: Column, size: int) -> Column:
    """``size`` bytes, low byte first, of a number that fits (negative ones in two's complement)."""
    return _turned(_digits(value, size))


def _bytes(parts: list[tuple[str, Column]]) -> Column:
    """The bytes of ("digits", digits of a number or zeros) and ("bytes", bytes), one after the other."""
    runs = [(kind, [c for _, c in own]) for kind, own in groupby(parts, lambda p: p[0])]
    return F.concat(*(_turned(F.concat(*reversed(own))) if kind == "digits" else F.concat(*own) for kind, own in runs))


def write(kind: Message, values: dict[str, Column], flags: Column | int = 0, length: Column | int | None = None) -> Column:
    """The bytes of a message, header included; fields without a value are 0."""
    flags = flags if isinstance(flags, Column) else F.lit(flags)
    length = F.lit(kind.length) if length is None else length if isinstance(length, Column) else F.lit(length)
    zeros = lambda size: ("digits", F.lit("00" * size))
    parts, at = [("digits", _digits(*x)) for x in ((F.lit(kind.type), 1), (length, 1), (flags, 2))], MESSAGE_HEADER
    for f in kind.fields:
        if f.offset > at:
            parts.append(zeros(f.offset - at))
        value = values.get(f.name)
        if value is None:
            parts.append(zeros(f.size))
        elif f.kind[0] == "c":
            parts.append(("bytes", F.unhex(F.rpad(F.hex(F.encode(value, "US-ASCII")), 2 * f.size, "0"))))
        elif f.kind[0] == "b":
            parts.append(("bytes", F.unhex(F.rpad(F.hex(value), 2 * f.size, "0"))))
        else:
            parts.append(("digits", _digits(value, f.size)))
        at = f.offset + f.size
    if at < kind.length:
        parts.append(zeros(kind.length - at))
    return _bytes(parts)


def frame(feed: str, channel: Column, seq: Column, send_ts: Column, reset_count: Column, messages: Column, count: Column, version: Column | None = None, length: Column | None = None) -> Column:
    """The bytes of a frame; ``messages`` is the concatenated bytes of ``count`` messages. Length may be forged."""
    size = F.octet_length(messages) + FRAME_HEADER
    head = [
        (F.lit(MAGIC[feed]), 2), (version if version is not None else F.lit(SCHEMA_VERSION[feed]), 1), (channel, 1), (seq, 8),
        (send_ts, 8), (count, 1), (reset_count, 1), (length if length is not None else size, 2),
    ]
    return F.concat(_bytes([("digits", _digits(*x)) for x in head]), messages)
