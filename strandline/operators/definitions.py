"""Documents against named definitions: what is violated, and where, as column expressions over JSON values.

A definition is a dict of the words of JSON Schema that are listed in ``WORDS``; ``compile_definition`` makes of it a column: an array of
(path, keyword), one for each violation, empty for a sound document. Values are Spark's VARIANT, so no Python worker takes part.
As there, a word that is about another type than the value's is satisfied. Paths join members and indexes by a slash.

A value, its type and its members are worked out once and held as a lambda's variable, whatever number of words look at them: written out
at each word, a text would be parsed, and all that leads to a member be walked, for every one. Work so grows with definition and text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import scalars
from strandline.operators.manifest import CONTRACT, INTEGRITY, MOST_FRAMES, STATE

Definition = dict[str, Any]
WORDS = {"ref", "type", "const", "enum", "minLength", "maxLength", "pattern", "format", "minimum", "maximum", "minItems", "maxItems", "items", "required", "properties", "closed", "anyOf", "allOf", "if", "then", "else", "not"}
_FOUND = "array<struct<path: string, keyword: string>>"
_KINDS = {"STRING": "string", "BIGINT": "number", "BOOLEAN": "boolean", "VOID": "null", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}


def text(least: int | None = None, most: int | None = None, pattern: str | None = None, **more: Any) -> Definition:
    return {"type": "string", **{k: x for k, x in (("minLength", least), ("maxLength", most), ("pattern", pattern)) if x is not None}, **more}


def whole(least: int, most: int) -> Definition:
    return {"type": "integer", "minimum": least, "maximum": most}


def record(optional: dict[str, Definition] | None = None, **members: Definition) -> Definition:
    """An object with these members and, if given, the optional ones; no others."""
    return {"type": "object", "closed": True, "required": list(members), "properties": {**members, **(optional or {})}}


def ref(name: str) -> Definition:
    return {"ref": name}


def or_null(d: Definition) -> Definition:
    return {"anyOf": [d, {"type": "null"}]}


#: The definitions of the contract's documents, by name.
_NO_NUL = "^[^\\x00]*$"
_RETRYABLE = sorted(code for code, _, again in schemas.ERRORS if again)
DEFINITIONS: dict[str, Definition] = {
    "version": {"type": "string", "const": CONTRACT},
    "uuid": text(36, 36, "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
    "sha256": text(64, 64, "^[0-9a-f]{64}$"),
    "token": text(43, 43, "^[A-Za-z0-9_-]{42}[AEIMQUYcgkosw048]$"),
    "time": text(pattern="^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$", format="date-time"),
    "milliseconds": whole(0, scalars.MAX_TIME),
    "bytes": whole(1, scalars.MAX_BYTES),
    "side": whole(1, scalars.MAX_SIDE),
    "pairing": record(invitation_token=ref("token"), device_name=text(1, 80, _NO_NUL)),
    "profile": record({n: or_null(ref("side")) for n in ("negotiated_width", "negotiated_height")}, id=text(1, 64, _NO_NUL), requested_width=ref("side"), requested_height=ref("side"), jpeg_quality=whole(1, 100)),
    "metadata": record(
        {"session_id": or_null(ref("uuid")), "request_elapsed_ms": or_null(ref("milliseconds")), "saved_wall_ms": or_null(ref("milliseconds")), "capture_settings": {"type": ["string", "null"], "maxLength": 2048, "pattern": _NO_NUL}, "profile": or_null(ref("profile"))},
        frame_id=ref("uuid"), request_wall_ms=ref("milliseconds"), sha256=ref("sha256"), byte_length=ref("bytes"),
    ),
    "manifest": record(frames={"type": "array", "minItems": 1, "maxItems": MOST_FRAMES, "items": ref("metadata")}),
    "receipt": record(contract_version=ref("version"), archive_id=ref("uuid"), frame_id=ref("uuid"), sha256=ref("sha256"), byte_length=ref("bytes"), committed_at=ref("time"), integrity={"const": INTEGRITY}, state={"const": STATE}),
    "frame": {
        **record(frame_id=ref("uuid"), state={"enum": ["pending", "committed"]}, receipt=or_null(ref("receipt"))),
        "if": {"properties": {"state": {"const": "pending"}}, "required": ["state"]}, "then": {"properties": {"receipt": {"type": "null"}}}, "else": {"properties": {"receipt": ref("receipt")}},
    },
    "error_detail": {
        **record(code={"enum": [code for code, _, _ in schemas.ERRORS]}, message={"type": "string"}, retryable={"type": "boolean"}),
        "if": {"properties": {"code": {"enum": _RETRYABLE}}, "required": ["code"]}, "then": {"properties": {"retryable": {"const": True}}}, "else": {"properties": {"retryable": {"const": False}}},
    },
    "error": record(error=ref("error_detail")),
}


@dataclass(frozen=True)
class Value:
    """A JSON value, its type, and its text and number if it is one."""

    value: Column
    kind: Column
    string: Column
    number: Column


def _kind(v: Column) -> Column:
    """The JSON type of a value, where whole numbers are numbers.

    Objects and arrays are told first, by casts that keep no members: their schema would be worked out down to the last member,
    at each level again.
    """

    def scalar(name: Column) -> Column:
        return reduce(lambda found, pair: found.when(name.startswith(pair[0]), pair[1]), list(_KINDS.items())[1:], F.when(name.startswith("STRING"), "string"))

    is_ = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    return F.when(is_("struct<>"), "object").when(is_("array<struct<>>"), "array").otherwise(_held(F.schema_of_variant(v), scalar, "string"))


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "decimal(38,9)")


def _equals(v: Value, x: Any) -> Column:
    if x is None:
        return v.kind == "null"
    if isinstance(x, bool):
        return (v.kind == "boolean") & (F.try_variant_get(v.value, "$", "boolean") == x)
    if isinstance(x, str):
        return (v.kind == "string") & (v.string == x)
    return (v.kind == "number") & (v.number == x)


def _is(v: Value, name: str) -> Column:
    return (v.kind == "number") & F.coalesce(v.number == F.floor(v.number), F.lit(False)) if name == "integer" else v.kind == name


def _held(value: Column, body: Callable[[Column], Column], kind: str = _FOUND) -> Column:
    """``body``, of type ``kind``, of a value that is worked out once.

    A fold over one value: taking an element of a transformed array would work out the type of all that is within, row by row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, x: body(x))


@dataclass(frozen=True)
class One:
    """A violation, or null."""

    found: Column


def _joined(parts: list[Column | One]) -> Column:
    """The violations of all parts in their order: single ones go into one array, so that few arrays are put together."""
    arrays = []
    for single, group in groupby(parts, lambda x: isinstance(x, One)):
        arrays += [F.array_compact(F.array(*[x.found for x in group]))] if single else group
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0] if arrays else F.array().cast(_FOUND)


def _path(parts: list[str | Column]) -> Column:
    return F.concat_ws("/", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]) if parts else F.lit("")


def _flat(d: Definition, named: dict[str, Definition]) -> list[Definition]:
    """``d`` and the definitions that it applies to the same value."""
    others = [named[d["ref"]]] if "ref" in d else []
    others += [*d.get("anyOf", []), *d.get("allOf", []), *[d[w] for w in ("not", "if", "then", "else") if w in d]]
    return [d, *[x for other in others for x in _flat(other, named)]]


def _check(d: Definition, v: Column, path: list[str | Column], named: dict[str, Definition]) -> Column:
    """The violations of one value that is there; its text and its number are held if a word looks at them."""
    flat = _flat(d, named)
    wanted = [x for w in flat for x in ([w["const"]] if "const" in w else w.get("enum", []))]
    strings = any({"minLength", "maxLength", "pattern", "format"} & set(w) for w in flat) or any(isinstance(x, str) for x in wanted)
    numbers = any({"minimum", "maximum"} & set(w) or "integer" in w.get("type", []) for w in flat) or any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in wanted)

    def of(x: Column, kind: Column) -> Column:
        string, number = F.when(kind == "string", F.try_variant_get(x, "$", "string")), F.when(kind == "number", _number(x))
        found = lambda s, n: _violations(d, Value(x, kind, s, n), path, named)
        with_number = lambda s: _held(number, lambda n: found(s, n)) if numbers else found(s, number)
        return _held(string, with_number) if strings else with_number(string)

    return _held(v, lambda x: _held(_kind(x), lambda kind: of(x, kind)))


def _violations(d: Definition, v: Value, path: list[str | Column], named: dict[str, Definition]) -> Column:
    """The violations of a value that is held."""
    unknown = set(d) - WORDS
    if unknown:
        raise ValueError(f"words that are not known: {sorted(unknown)}")
    none = F.array().cast(_FOUND)
    found: list[Column | One] = []
    kind, string, n = v.kind, v.string, v.number

    def wrong(ok: Column, keyword: str, about: str | None = None) -> One:
        bad = ~F.coalesce(ok, F.lit(False)) if about is None else (kind == about) & ~F.coalesce(ok, F.lit(False))
        return One(F.when(bad, F.struct(_path(path).alias("path"), F.lit(keyword).alias("keyword"))))

    def of(other: Definition) -> Column:
        return _violations(other, v, path, named)

    def sound(other: Definition) -> Column:
        return F.size(of(other)) == 0

    if "ref" in d:
        found.append(of(named[d["ref"]]))
    if "type" in d:
        names = d["type"] if isinstance(d["type"], list) else [d["type"]]
        found.append(wrong(reduce(lambda a, b: a | b, [_is(v, t) for t in names]), "type"))
    if "const" in d:
        found.append(wrong(_equals(v, d["const"]), "const"))
    if "enum" in d:
        found.append(wrong(reduce(lambda a, b: a | b, [_equals(v, x) for x in d["enum"]]), "enum"))
    for word, ok, about in (
        ("minLength", lambda x: F.length(string) >= x, "string"), ("maxLength", lambda x: F.length(string) <= x, "string"), ("pattern", lambda x: F.rlike(string, F.lit(x)), "string"),
        ("format", lambda x: F.try_to_timestamp(string).isNotNull() if x == "date-time" else F.lit(True), "string"),
        ("minimum", lambda x: n >= x, "number"), ("maximum", lambda x: n <= x, "number"),
    ):
        if word in d:
            found.append(wrong(ok(d[word]), word, about))
    if {"minItems", "maxItems", "items"} & set(d):

        def of_items(items: Column) -> Column:
            parts: list[Column | One] = []
            if "minItems" in d:
                parts.append(wrong(F.size(items) >= d["minItems"], "minItems", "array"))
            if "maxItems" in d:
                parts.append(wrong(F.size(items) <= d["maxItems"], "maxItems", "array"))
            if "items" in d:
                parts.append(F.flatten(F.transform(items, lambda x, i: _check(d["items"], x, [*path, i], named))))
            return _joined(parts)

        found.append(F.when(kind == "array", _held(F.try_variant_get(v.value, "$", "array<variant>"), of_items)).otherwise(none))
    if {"required", "properties", "closed"} & set(d):

        def of_members(members: Column) -> Column:
            parts: list[Column | One] = [wrong(members[name].isNotNull(), "required") for name in d.get("required", [])]
            if d.get("closed"):
                parts.append(wrong(F.forall(F.map_keys(members), lambda name: name.isin(list(d.get("properties", {})))), "additionalProperties"))
            for name, other in d.get("properties", {}).items():
                parts.append(F.when(members[name].isNotNull(), _check(other, members[name], [*path, name], named)).otherwise(none))
            return _joined(parts)

        found.append(F.when(kind == "object", _held(F.try_variant_get(v.value, "$", "map<string,variant>"), of_members)).otherwise(none))
    if "anyOf" in d:
        found.append(wrong(reduce(lambda a, b: a | b, [sound(x) for x in d["anyOf"]]), "anyOf"))
    for other in d.get("allOf", []):
        found.append(of(other))
    if "not" in d:
        found.append(wrong(~sound(d["not"]), "not"))
    if "if" in d:
        then, otherwise = [of(d[w]) if w in d else none for w in ("then", "else")]
        found.append(F.when(sound(d["if"]), then).otherwise(otherwise))
    return _joined(found)


def compile_definition(definition: str | Definition, document: Column, named: dict[str, Definition] = DEFINITIONS) -> Column:
    """Array of (path, keyword) for a column of JSON texts; null where the text is null, and one ("", "json") where it is no JSON.

    How texts must be written (duplicate members, exact numbers) is told by strict reading, not here.
    """
    bad = F.array(F.struct(F.lit("").alias("path"), F.lit("json").alias("keyword"))).cast(_FOUND)
    checked = lambda value: _check(ref(definition) if isinstance(definition, str) else definition, value, [], named)
    return _held(document, lambda text: F.when(text.isNotNull(), _held(F.try_parse_json(text), lambda value: F.when(value.isNull(), bad).otherwise(checked(value)))))


def violations(df: DataFrame, document: str, definition: str | Definition, named: dict[str, Definition] = DEFINITIONS) -> DataFrame:
    """The columns of ``df``, path and keyword: a row for each violation. Repeated rows give theirs again; columns of these names go."""
    kept = [c for c in df.columns if c not in ("path", "keyword")]
    x = df.withColumn("__found", F.explode(compile_definition(definition, F.col(document), named)))
    return x.select(*[F.col(f"`{c}`") for c in kept], "__found.path", "__found.keyword")
