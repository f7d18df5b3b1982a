"""Strict reading of request documents: what Spark's own JSON readers let pass is rejected here.

Rejected: duplicate members (escaped spellings too), unknown members, missing or null required members, anything after
the document, nesting beyond 16, numbers that are not exact integers of 16 digits at most, lone surrogates, NaN and infinities.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_JSON, MAX_DEPTH, MAX_INTEGER = 1 << 20, 16, 9007199254740991


class Rejected(ValueError):
    """The document is not acceptable."""


@dataclass(frozen=True)
class Kind:
    """Shape of a value: a name of a primitive, members of an object, or an array of one kind."""

    type: str
    members: dict[str, Kind] | None = None
    items: Kind | None = None
    required: bool = True


INT, TEXT = Kind("integer"), Kind("string")
_OPTIONAL_INT, _OPTIONAL_TEXT = Kind("integer", required=False), Kind("string", required=False)
PROFILE = Kind("object", {"id": TEXT, "requested_width": INT, "requested_height": INT, "jpeg_quality": INT, "negotiated_width": _OPTIONAL_INT, "negotiated_height": _OPTIONAL_INT}, required=False)
METADATA = Kind("object", {"frame_id": TEXT, "request_wall_ms": INT, "sha256": TEXT, "byte_length": INT, "session_id": _OPTIONAL_TEXT, "request_elapsed_ms": _OPTIONAL_INT, "saved_wall_ms": _OPTIONAL_INT, "capture_settings": _OPTIONAL_TEXT, "profile": PROFILE})
MANIFEST = Kind("object", {"frames": Kind("array", items=METADATA)})
PAIRING = Kind("object", {"invitation_token": TEXT, "device_name": TEXT})
ANY = Kind("any")
_SURROGATE = re.compile("[\ud800-\udfff]")


def integer(text: str) -> int:
    """The exact integer that a JSON number stands for; exponents are bounded before any power is taken."""
    mantissa, _, exponent = text.lower().partition("e")
    if not any(c in "123456789" for c in mantissa):
        return 0
    if len(exponent.lstrip("+-0")) > 9:
        raise Rejected("number")
    try:
        sign, digits, power = Decimal(text).as_tuple()
    except InvalidOperation as e:
        raise Rejected("number") from e
    number = "".join(map(str, digits)).lstrip("0")
    if power < 0:
        cut = len(number) + power
        if cut <= 0 or number[cut:].strip("0"):
            raise Rejected("number")
        number = number[:cut]
    elif len(number) + power > 16:
        raise Rejected("number")
    else:
        number += "0" * power
    if len(number) > 16:
        raise Rejected("number")
    return -int(number) if sign else int(number)


def _members(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise Rejected("duplicate member")
    if any(_SURROGATE.search(k) for k in found):
        raise Rejected("surrogate")
    return found


def _constant(name: str) -> None:
    raise Rejected(name)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_int=integer, parse_float=integer, parse_constant=_constant)


def _walk(value: object, kind: Kind, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise Rejected("depth")
    if isinstance(value, str) and _SURROGATE.search(value):
        raise Rejected("surrogate")
    if kind.type == "any":
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            _walk(x, ANY, depth + 1)
        return
    fits = {"object": dict, "array": list, "string": str, "integer": int}[kind.type]
    if not isinstance(value, fits) or isinstance(value, bool):
        raise Rejected(f"not of type {kind.type}")
    if kind.members is not None:
        if value.keys() - kind.members.keys():
            raise Rejected("unknown member")
        for name, member in kind.members.items():
            if value.get(name) is None:
                if member.required:
                    raise Rejected(f"{name} is required")
            else:
                _walk(value[name], member, depth + 1)
    elif kind.items is not None:
        for x in value:
            _walk(x, kind.items, depth + 1)


def read(raw: bytes, kind: Kind = ANY) -> object:
    """The document, with optional members that are null left out; Rejected if it is not acceptable."""
    if len(raw) > MAX_JSON:
        raise Rejected("size")
    try:
        text = raw.decode("utf-8")
        stripped = text.strip(" \t\n\r")
        value, end = _DECODER.raw_decode(stripped)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise Rejected("syntax") from e
    if end != len(stripped):
        raise Rejected("trailing data")
    _walk(value, kind, 1)
    return _clean(value)


def _clean(value: object) -> object:
    if isinstance(value, dict):
        return {k: _clean(v) for k, v in value.items() if v is not None}
    return [_clean(x) for x in value] if isinstance(value, list) else value


def _verdicts(kind: Kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, why, out = [], [], []
            for raw in batch.column("__raw").to_pylist():
                try:
                    value = None if raw is None else read(raw, kind)
                    ok.append(raw is not None)
                    why.append("null" if raw is None else None)
                    out.append(None if raw is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")))
                except Rejected as e:
                    ok.append(False)
                    why.append(str(e))
                    out.append(None)
            yield pa.record_batch([batch.column("__row"), pa.array(ok, pa.bool_()), pa.array(why, pa.string()), pa.array(out, pa.string())], names=["__row", "ok", "reason", "document"])

    return run


def verdicts(df: DataFrame, column: str, kind: Kind = ANY) -> DataFrame:
    """The columns of ``df``, ok, reason (null if ok) and document: a normal form that from_json reads without loss."""
    rows = df.selectExpr(f"struct({', '.join(f'`{c}`' for c in df.columns)}) AS __row", f"CAST(`{column}` AS BINARY) AS __raw")
    out = rows.mapInArrow(_verdicts(kind), f"__row {rows.schema['__row'].dataType.simpleString()}, ok boolean, reason string, document string")
    return out.select("__row.*", "ok", "reason", "document")
