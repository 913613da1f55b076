"""MessagePack values of key-value tables as struct columns, and structs as such values, in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Fixed values of the format: the extension of timestamps, and, by first byte, a number's layout or the layout of the length before a body.
TIMESTAMP = -1
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
BYTES = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}
TEXTS = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}
EXTENSIONS = {0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}
FIXED_EXTENSIONS = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}
ARRAYS = {0xDC: ">H", 0xDD: ">I"}
MAPS = {0xDE: ">H", 0xDF: ">I"}
#: Values may lie this deep in each other.
MOST_DEPTH = 64


def _sized(n: int, small: int, most: int, codes: dict[int, str]) -> bytes:
    """The head of a value of length ``n``: in the first byte up to ``most``, or behind the first code whose layout holds it."""
    if n <= most:
        return bytes([small | n])
    code, layout = next((c, x) for c, x in codes.items() if n < 1 << 8 * struct.calcsize(x))
    return bytes([code]) + struct.pack(layout, n)


def pack(value: Any) -> bytes:
    """One value: null, bool, whole number, float (64 bits), text, bytes, datetime, list or map."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value) if value < 0 else bytes([value])
        code = next(c for c in ((0xCC, 0xCD, 0xCE, 0xCF) if value > 0 else (0xD0, 0xD1, 0xD2, 0xD3)) if _fits(value, NUMBERS[c]))
        return bytes([code]) + struct.pack(NUMBERS[code], value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _sized(len(raw), 0xA0, 31, TEXTS) + raw
    if isinstance(value, bytes):
        return _sized(len(value), 0, -1, BYTES) + value
    if isinstance(value, datetime):
        return _pack_time(value)
    if isinstance(value, dict):
        return _sized(len(value), 0x80, 15, MAPS) + b"".join(pack(x) for pair in value.items() for x in pair)
    return _sized(len(value), 0x90, 15, ARRAYS) + b"".join(map(pack, value))


def _fits(value: int, layout: str) -> bool:
    bits = 8 * struct.calcsize(layout)
    return value < 1 << bits if layout[1].isupper() else -1 << bits - 1 <= value < 1 << bits - 1


def _pack_time(value: datetime) -> bytes:
    """4 bytes for whole seconds up to 2^32, 8 up to 2^34, 12 for all others."""
    value = value.replace(tzinfo=UTC) if value.tzinfo is None else value
    micros = (value - _EPOCH) // timedelta(microseconds=1)
    seconds, nanos = micros // 1_000_000, micros % 1_000_000 * 1000
    if 0 <= seconds < 1 << 34:
        return b"\xd6\xff" + struct.pack(">I", seconds) if not nanos and seconds < 1 << 32 else b"\xd7\xff" + struct.pack(">Q", nanos << 34 | seconds)
    return b"\xc7\x0c\xff" + struct.pack(">Iq", nanos, seconds)


def _unpack_time(raw: bytes) -> datetime:
    if len(raw) == 4:
        seconds, nanos = struct.unpack(">I", raw)[0], 0
    elif len(raw) == 8:
        whole = struct.unpack(">Q", raw)[0]
        seconds, nanos = whole & (1 << 34) - 1, whole >> 34
    elif len(raw) == 12:
        nanos, seconds = struct.unpack(">Iq", raw)
    else:
        raise ValueError("a timestamp of no known length")
    if nanos >= 1_000_000_000:
        raise ValueError("more than a second of nanoseconds")
    return _EPOCH + timedelta(seconds=seconds, microseconds=nanos // 1000)


class _Reader:
    """Reads one value after the other; ends of the bytes, unknown codes and other extensions are errors."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n > len(self.raw) - self.at:
            raise ValueError("the value ends too soon")
        self.at += n
        return self.raw[self.at - n : self.at]

    def number(self, layout: str) -> Any:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def value(self, depth: int = 0) -> Any:
        if depth > MOST_DEPTH:
            raise ValueError("values lie too deep")
        c = self.take(1)[0]
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c < 0x90 or c in MAPS:
            return {self.value(depth + 1): self.value(depth + 1) for _ in range(c & 15 if c < 0x90 else self.number(MAPS[c]))}
        if c < 0xA0 or c in ARRAYS:
            return [self.value(depth + 1) for _ in range(c & 15 if c < 0xA0 else self.number(ARRAYS[c]))]
        if c < 0xC0 or c in TEXTS:
            return self.take(c & 31 if c < 0xC0 else self.number(TEXTS[c])).decode()
        if c in BYTES:
            return self.take(self.number(BYTES[c]))
        if c in NUMBERS:
            return self.number(NUMBERS[c])
        if c in EXTENSIONS or c in FIXED_EXTENSIONS:
            n = FIXED_EXTENSIONS.get(c) or self.number(EXTENSIONS[c])
            if self.number(">b") != TIMESTAMP:
                raise ValueError("an unknown extension")
            return _unpack_time(self.take(n))
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        raise ValueError("an unknown code")


def unpack(raw: bytes) -> Any:
    """The one value that ``raw`` holds; anything else is a ValueError."""
    reader = _Reader(raw)
    try:
        found = reader.value()
    except (TypeError, OverflowError) as e:
        raise ValueError(str(e)) from e
    if reader.at != len(raw):
        raise ValueError("there is more than one value")
    return found


def _time(value: Any) -> datetime:
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
        if value.tzinfo is None:
            raise ValueError("a time without a zone")
    if not isinstance(value, datetime):
        raise ValueError("no time")
    return value


def _reads(kind: T.DataType) -> Callable[[Any], Any]:
    """What makes a value of a field's type out of an unpacked one, or fails."""

    def of(*types: type, make: Callable[[Any], Any]) -> Callable[[Any], Any]:
        def read(value: Any) -> Any:
            if isinstance(value, bool) != (bool in types) or not isinstance(value, types):
                raise ValueError(f"{value!r} is no {kind.simpleString()}")
            return make(value)

        return read

    if isinstance(kind, T.TimestampType):
        return _time
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return of(int, float, make=float)
    if isinstance(kind, T.IntegralType):
        most = 1 << {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind), 63)

        def whole(value: int) -> int:
            if not -most <= value < most:
                raise ValueError(f"{value} is no {kind.simpleString()}")
            return value

        return of(int, make=whole)
    if isinstance(kind, T.BooleanType):
        return of(bool, make=bool)
    if isinstance(kind, T.BinaryType):
        return of(bytes, make=bytes)
    if isinstance(kind, T.StringType):
        return of(str, make=str)
    if isinstance(kind, T.ArrayType):
        inner = _reads(kind.elementType)
        return of(list, make=lambda v: [None if x is None else inner(x) for x in v])
    if isinstance(kind, T.MapType):
        key, inner = _reads(kind.keyType), _reads(kind.valueType)
        return of(dict, make=lambda v: [(key(k), None if x is None else inner(x)) for k, x in v.items()])
    raise TypeError(f"fields of type {kind.simpleString()} can't be read")


def unpacked(raw: Column, fields: T.StructType) -> Column:
    """``fields`` of the map in each value; fields that are missing are null, others are left out.

    Timestamps may be of the extension's three lengths or texts with a zone. The struct is null where the bytes are null, hold no
    map, are malformed, or have a field of another type.
    """
    readers = {f.name: _reads(f.dataType) for f in fields}
    shape = pa.struct(list(to_arrow_schema(fields)))

    def row(value: bytes | None) -> dict | None:
        try:
            found = unpack(value) if value is not None else None
            return {name: None if (x := found.get(name)) is None else read(x) for name, read in readers.items()} if isinstance(found, dict) else None
        except ValueError:
            return None

    @F.arrow_udf(fields)
    def decode(values: pa.Array) -> pa.Array:
        return pa.array([row(v) for v in values.to_pylist()], shape)

    return decode(raw)


def packed(rows: DataFrame, names: list[str]) -> Column:
    """The columns ``names`` of each of ``rows`` as a map in MessagePack, nulls left out."""
    kinds = {n: rows.schema[n].dataType for n in names}
    as_time = lambda v: _EPOCH + timedelta(microseconds=v)
    writers = {n: as_time if isinstance(k, T.TimestampType) else dict if isinstance(k, T.MapType) else lambda v: v for n, k in kinds.items()}

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array([pack({n: writers[n](v) for n, v in row.items() if v is not None}) for row in values.to_pylist()], pa.binary())

    return encode(F.struct(*[(F.unix_micros(n) if isinstance(k, T.TimestampType) else F.col(n)).alias(n) for n, k in kinds.items()]))
