"""Recorded values in CBOR (RFC 8949) as JSON texts, and back."""

from __future__ import annotations

import base64
import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# The simple values of CBOR.
_SIMPLE = {20: False, 21: True, 22: None, 23: None}


def loads(data: bytes):
    """The Python value of one CBOR item; tags are dropped, byte strings stay bytes."""
    value, end = _item(data, 0)
    if end != len(data):
        raise ValueError("bytes after the value")
    return value


def _item(data: bytes, at: int):
    kind, short = data[at] >> 5, data[at] & 31
    at += 1
    if short < 24:
        n = short
    elif short < 28:
        size = 1 << short - 24
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise ValueError("lengths must be known")
    if kind == 0:
        return n, at
    if kind == 1:
        return -1 - n, at
    if kind in (2, 3):
        part = data[at : at + n]
        if len(part) < n:
            raise ValueError("the value ends too early")
        return part if kind == 2 else part.decode("utf-8"), at + n
    if kind == 4:
        out = []
        for _ in range(n):
            value, at = _item(data, at)
            out.append(value)
        return out, at
    if kind == 5:
        pairs = {}
        for _ in range(n):
            key, at = _item(data, at)
            pairs[key], at = _item(data, at)
        return pairs, at
    if kind == 6:
        return _item(data, at)
    if short == 27:
        return struct.unpack(">d", n.to_bytes(8, "big"))[0], at
    if short == 26:
        return struct.unpack(">f", n.to_bytes(4, "big"))[0], at
    return _SIMPLE[n], at


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    size = next(k for k in range(4) if n < 1 << (8 << k))
    return bytes([kind << 5 | 24 + size]) + n.to_bytes(1 << size, "big")


def dumps(value) -> bytes:
    """The CBOR bytes of a Python value, in the shortest lengths and with floats of 64 bits."""
    if isinstance(value, bool) or value is None:
        return bytes([0xF6 if value is None else 0xF4 + value])
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        text = value.encode("utf-8")
        return _head(3, len(text)) + text
    if isinstance(value, list):
        return _head(4, len(value)) + b"".join(map(dumps, value))
    return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())


def shown(value):
    """A decoded record as JSON shows it: printed forms of booleans, base64 and hex of big numbers, names beside a struct's fields."""
    if isinstance(value, list):
        return [shown(v) for v in value]
    if not isinstance(value, dict):
        return base64.b64encode(value).decode() if isinstance(value, bytes) else value
    out = {}
    for key, v in value.items():
        out[key] = shown(v)
        if key == "b" and isinstance(v, bytes):
            out["b_hex"] = v.hex()
        elif key == "b" and value.get("kind") == "Bool":
            out["text"] = "true" if v else "false"
    names = out.pop("field_names", None)
    if names and len(names) == len(out.get("field_values", ())):
        out["fields"] = [[n, v] for n, v in zip(names, out["field_values"], strict=True)]
    return out


def _text(data) -> str:
    """JSON of one value; empty bytes are an Empty one, what is no CBOR an Undecodable one with its hex."""
    if not data:
        return '{"kind":"Empty"}'
    try:
        value = shown(loads(bytes(data)))
    except (ValueError, IndexError, KeyError, RecursionError, UnicodeDecodeError):
        value = {"kind": "Undecodable", "hex": bytes(data).hex()}
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def _to_json(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else _text(d) for d in data], dtype=object)


@F.pandas_udf(BinaryType())
def _from_json(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else dumps(json.loads(t)) for t in texts], dtype=object)


def to_json(data: Column) -> Column:
    """The JSON text of a CBOR value; parse_json makes it a VARIANT."""
    return _to_json(data)


def from_json(text: Column) -> Column:
    """The CBOR bytes of a value given as JSON text."""
    return _from_json(text)
