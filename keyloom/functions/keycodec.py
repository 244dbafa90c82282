"""An order-preserving binary form of key tuples.

Unsigned byte order of the packed form is the order of the tuples. Integers, times, booleans and
missing elements are packed by Spark expressions; bytes and texts, whose bits are regrouped by
sevens, by an Arrow-batched function.
"""

from __future__ import annotations

import datetime
import uuid

import pandas as pd
from pyspark.sql import functions as F

#: Kind bytes in order. Fixed values of the format.
NONE, NEGATIVE, INTEGER, BOOLEAN, BYTES, TEXT, UUID, TIME_BEFORE, TIME, SEPARATOR = 0x0F, 0x14, 0x15, 0x1E, 0x28, 0x32, 0x5A, 0x5B, 0x5C, 0x66
#: Largest values of one, two and three bytes; from there on a length byte from 250 on and the value. Fixed values of the format.
ONE, TWO, THREE = 240, 2287, 67823
#: Times keep quarters of an hour of their offset in the low seven bits, around this value. Fixed values of the format.
OFFSET_ZERO, OFFSET_BITS, QUARTER = 64, 7, 900
EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def _varint_hex(v: F.Column) -> F.Column:
    """Hex of a value from 0 to 2**63 - 1, or of a DECIMAL up to 2**64 - 1 given as a long pattern."""
    digits = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    out = F.when(v <= ONE, digits(v, 1)).when(v <= TWO, digits(v + (241 * 256 - ONE), 2)).when(v <= THREE, F.concat(F.lit("F9"), digits(v - (TWO + 1), 2)))
    for n in range(3, 8):
        out = out.when(v < 2 ** (8 * n), F.concat(F.lit(f"{247 + n:02X}"), digits(v, n)))
    return out.otherwise(F.concat(F.lit("FF"), digits(v, 8)))


def _inverted(h: F.Column) -> F.Column:
    return F.translate(h, "0123456789ABCDEF", "FEDCBA9876543210")


def _or_none(c: F.Column, packed: F.Column) -> F.Column:
    return F.unhex(F.when(c.isNull(), F.lit(f"{NONE:02X}")).otherwise(packed))


def pack_int(c: F.Column) -> F.Column:
    v = c.cast("long")
    return _or_none(c, F.when(v < 0, F.concat(F.lit(f"{NEGATIVE:02X}"), _inverted(_varint_hex(-v)))).otherwise(F.concat(F.lit(f"{INTEGER:02X}"), _varint_hex(v))))


def pack_bool(c: F.Column) -> F.Column:
    return _or_none(c, F.when(c, F.lit(f"{BOOLEAN:02X}01")).otherwise(F.lit(f"{BOOLEAN:02X}00")))


def time_value(c: F.Column, quarters: F.Column | int = 0) -> F.Column:
    """Milliseconds since 1970 and the offset in one integer; a time without a zone is UTC."""
    ms = F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("long")
    return F.shiftleft(ms, OFFSET_BITS).bitwiseOR((F.lit(quarters) if isinstance(quarters, int) else quarters).cast("long") + OFFSET_ZERO)


def pack_time(c: F.Column, quarters: F.Column | int = 0) -> F.Column:
    v = time_value(c, quarters)
    return _or_none(c, F.when(v < 0, F.concat(F.lit(f"{TIME_BEFORE:02X}"), _inverted(_varint_hex(-v)))).otherwise(F.concat(F.lit(f"{TIME:02X}"), _varint_hex(v))))


def pack_uuid(c: F.Column) -> F.Column:
    """Of a UUID's usual text."""
    return _or_none(c, F.concat(F.lit(f"{UUID:02X}"), F.upper(F.replace(c, F.lit("-"), F.lit("")))))


def _sevens(data: bytes) -> bytes:
    bits = "".join(f"{b:08b}" for b in data)
    return bytes(0x80 | int(bits[i : i + 7].ljust(7, "0"), 2) for i in range(0, len(bits), 7))


def _eights(data: bytes) -> bytes:
    bits = "".join(f"{b & 0x7F:07b}" for b in data)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits) - 7, 8))


def _packed_with(kind: int, encode):
    @F.pandas_udf("binary")
    def packed(c: pd.Series) -> pd.Series:
        return c.map(lambda x: bytes([NONE]) if x is None else bytes([kind]) + _sevens(encode(x)))

    return packed


def pack_bytes(c: F.Column) -> F.Column:
    return _packed_with(BYTES, bytes)(c)


def pack_text(c: F.Column) -> F.Column:
    return _packed_with(TEXT, str.encode)(c)


def pack_columns(*packed: F.Column, prefix: bytes = b"") -> F.Column:
    """A tuple's form from its elements' forms."""
    return F.concat(F.lit(prefix), *packed) if prefix else F.concat(*packed)


def key_list(*keys: F.Column) -> F.Column:
    """Packed keys one after another, as an index holds a tuple and a record's key."""
    out = [keys[0]]
    for k in keys[1:]:
        out += [F.lit(bytes([SEPARATOR])), k]
    return F.concat(*out)


def varint(v: int) -> bytes:
    if v < 0 or v >= 1 << 64:
        raise ValueError("out of range")
    if v <= ONE:
        return bytes([v])
    if v <= TWO:
        return (v + 241 * 256 - ONE).to_bytes(2, "big")
    if v <= THREE:
        return b"\xf9" + (v - TWO - 1).to_bytes(2, "big")
    n = max(3, (v.bit_length() + 7) // 8)
    return bytes([247 + n]) + v.to_bytes(n, "big")


def pack(key: tuple) -> bytes:
    """The form of a literal key, for bounds of packed columns."""
    flip = bytes(255 - i for i in range(256))

    def number(v: int, below: int, above: int) -> bytes:
        return bytes([below]) + varint(-v).translate(flip) if v < 0 else bytes([above]) + varint(v)

    out = b""
    for x in key:
        if x is None:
            out += bytes([NONE])
        elif isinstance(x, bool):
            out += bytes([BOOLEAN, x])
        elif isinstance(x, int):
            out += number(x, NEGATIVE, INTEGER)
        elif isinstance(x, (bytes, bytearray)):
            out += bytes([BYTES]) + _sevens(bytes(x))
        elif isinstance(x, str):
            out += bytes([TEXT]) + _sevens(x.encode())
        elif isinstance(x, uuid.UUID):
            out += bytes([UUID]) + x.bytes
        elif isinstance(x, datetime.datetime):
            zoned = x if x.tzinfo else x.replace(tzinfo=datetime.timezone.utc)
            ms = (zoned - EPOCH) // datetime.timedelta(milliseconds=1)
            out += number(ms << OFFSET_BITS | int(zoned.utcoffset().total_seconds()) // QUARTER + OFFSET_ZERO, TIME_BEFORE, TIME)
        else:
            raise TypeError(f"{type(x).__name__} can't be part of a key")
    return out


def unpack(data: bytes) -> list[tuple[str, str | None]]:
    """Kinds and values (as text; bytes as hex, times as ISO 8601) of a packed key."""
    at, out = 0, []

    def number(inverted: bool) -> int:
        nonlocal at
        raw = bytes(255 - b for b in data[at : at + 9]) if inverted else data[at : at + 9]
        first = raw[0]
        n = 1 if first <= ONE else 2 if first < 249 else first - 246
        at += n
        if first <= ONE:
            v = first
        elif first < 249:
            v = int.from_bytes(raw[:2], "big") - 241 * 256 + ONE
        else:
            v = int.from_bytes(raw[1:n], "big") + (TWO + 1) * (first == 249)
        return -v if inverted else v

    while at < len(data):
        kind = data[at]
        at += 1
        if kind == NONE:
            out.append(("none", None))
        elif kind in (INTEGER, NEGATIVE):
            out.append(("int", str(number(kind == NEGATIVE))))
        elif kind == BOOLEAN:
            out.append(("bool", "true" if data[at] else "false"))
            at += 1
        elif kind == UUID:
            out.append(("uuid", str(uuid.UUID(bytes=data[at : at + 16]))))
            at += 16
        elif kind in (BYTES, TEXT):
            stop = at
            while stop < len(data) and data[stop] & 0x80:
                stop += 1
            got = _eights(data[at:stop])
            out.append(("bytes", got.hex()) if kind == BYTES else ("text", got.decode()))
            at = stop
        elif kind in (TIME, TIME_BEFORE):
            v = number(kind == TIME_BEFORE)
            zone = datetime.timezone(datetime.timedelta(seconds=((v & 127) - OFFSET_ZERO) * QUARTER))
            out.append(("time", (EPOCH + datetime.timedelta(milliseconds=v >> OFFSET_BITS)).astimezone(zone).isoformat(timespec="milliseconds")))
        elif kind == SEPARATOR:
            out.append(("separator", None))
        else:
            raise ValueError(f"unknown kind {kind:#x}")
    return out


def unpack_column(c: F.Column, prefix: bytes = b"") -> F.Column:
    """Elements of packed keys; null where the prefix isn't there."""

    @F.pandas_udf("array<struct<kind string, value string>>")
    def elements(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: None if k is None or not bytes(k).startswith(prefix) else [{"kind": a, "value": b} for a, b in unpack(bytes(k)[len(prefix) :])])

    return elements(c)
