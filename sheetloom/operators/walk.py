"""Configuration texts walked through once, for jobs that count and list names only.

How a text is read is defined by the column functions of ``config``. They build every level of a
text as columns and cast each element by itself, which takes most of the time of such jobs. Here a
text is parsed and walked through in Python, with the same result. A text for which that is not
certain is left to the column functions and travels on in ``body``: one that is no JSON to Python,
has a key twice, a number or a name of unusual length, half a surrogate pair, an object inside a
string, or among used devices a fraction or something that takes an escape to print.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sheetloom.functions import names

# Texts per block of rows that are built at once.
_ROWS = 1000
# Limits up to which both parsers are known to agree: digits of a whole number and characters of others, of a name and of a text; levels.
_DIGITS, _FRACTION, _NAME, _TEXT, _LEVELS = 18, 900, 50_000, 10_000_000, 900
_LISTS = ("opened_devices", "closed_devices", "checked_devices")
COUNTS = ("tech_objects", "operations", "states", "steps", "parameters")
_DEVICE = pa.struct([("name", pa.string()), ("mentioned", pa.bool_()), ("uses", pa.int32()), ("owners", pa.int32())])
_COLUMNS = (
    "body binary, roots array<string>, devices array<struct<name:string,mentioned:boolean,uses:int,owners:int>>, signals array<string>, "
    + ", ".join(f"n_{c} int" for c in COUNTS)
)

_open = re.compile(r"[ \t\n\x0b\f\r]*\{").match
_half = re.compile(r"\\u[dD][89a-fA-F]").search
_marks = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]').findall


class _Odd(Exception):
    """The text is left to the column functions."""


class _Fraction:
    """Stands for a number that is not whole."""


def _object(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise _Odd
    return found


def _object_of_long_text(pairs: list) -> dict:
    if any(len(k) > _NAME for k, _ in pairs):
        raise _Odd
    return _object(pairs)


def _whole(digits: str) -> int:
    if len(digits) > _DIGITS:
        raise _Odd
    return int(digits)


def _fraction(digits: str) -> type:
    if len(digits) > _FRACTION:
        raise _Odd
    return _Fraction


def _no_number(word: str) -> None:
    raise _Odd


_numbers = {"parse_int": _whole, "parse_float": _fraction, "parse_constant": _no_number}
_decode = json.JSONDecoder(object_pairs_hook=_object, **_numbers).decode
_decode_long = json.JSONDecoder(object_pairs_hook=_object_of_long_text, **_numbers).decode


def _levels(text: str) -> int:
    depth = most = 0
    for mark in _marks(text):
        if mark in "[{":
            depth += 1
            most = max(most, depth)
        elif mark in "]}":
            depth -= 1
    return most


def _parse(body: bytes) -> object:
    if len(body) > _TEXT:
        raise _Odd
    try:
        text = body.decode()
        if b"\\u" in body and _half(text):
            raise _Odd
        if text.count("{") + text.count("[") > _LEVELS and _levels(text) > _LEVELS:
            raise _Odd
        return (_decode_long if len(text) > _NAME else _decode)(text)
    except (ValueError, RecursionError):
        raise _Odd from None


def _entries(level: object) -> Sequence[tuple[str, dict]]:
    """The entries of a level that are objects."""
    if type(level) is dict:
        found = []
        for entry in level.items():
            if type(entry[1]) is dict:
                found.append(entry)
            elif type(entry[1]) is str and _open(entry[1]):
                raise _Odd
        return found
    if type(level) is str and _open(level):
        raise _Odd
    return ()


def _printed(value: object, escaped: bool) -> str | None:
    """An element of a list as the text that a variant gives; an escape would be printed in another form."""
    if value is None or type(value) is str:
        return value
    if type(value) is bool:
        return "true" if value else "false"
    if type(value) is int:
        return str(value)
    if escaped or value is _Fraction:
        raise _Odd
    return _nested(value)


def _nested(value: object) -> str:
    if type(value) is str:
        return f'"{value}"'
    if type(value) is dict:
        # Names are sorted by UTF-16 there and by character here.
        if any(max(k, default="") >= "\ud800" for k in value if not k.isascii()):
            raise _Odd
        return "{" + ",".join([f'"{k}":{_nested(value[k])}' for k in sorted(value)]) + "}"
    if type(value) is list:
        return "[" + ",".join(map(_nested, value)) + "]"
    return "null" if value is None else _printed(value, False)


def _valid(found: set[str]) -> set[str]:
    """The texts that ``names.is_device_name`` holds for."""
    return {x for x in found if (x[:1].isalnum() or x.strip(names.WHITE_SPACE)) and x != names.NO_DEVICE}


class _Walk:
    """What one text holds: its devices, signals and counts."""

    def __init__(self, used: bool, escaped: bool) -> None:
        self.used = used
        self.escaped = escaped
        self.roots: list[str] = []
        self.owners: list[str] = []
        self.names: set[str] = set()
        self.signals: set[str] = set()
        # Every use of a device, and the first one of each owner.
        self.uses: list[str | None] = []
        self.firsts: list[str | None] = []
        self.counts = [0] * len(COUNTS)

    def _lists(self, owner: str, entry: dict, fields: Sequence[str], of_state: bool) -> None:
        """Devices in the lists of a state or a step; of an object in place of a list, a step has the keys."""
        found = []
        for field in fields:
            items = entry.get(field)
            if type(items) is list:
                texts = [x for x in items if type(x) is str]
                self.names.update(texts)
                if len(texts) == len(items):
                    found += texts
                    continue
                if of_state:
                    for x in items:
                        if type(x) is dict:
                            self.names.update([v for v in x.values() if type(v) is str])
                if self.used:
                    found += [_printed(x, self.escaped) for x in items]
            elif type(items) is dict and not of_state:
                self.names.update(items)
        if self.used:
            self.owners.append(owner)
            self.uses += found
            once = set(found)
            self.firsts += found if len(once) == len(found) else once

    def _state(self, owner: str, state: dict) -> None:
        self._lists(owner, state, _LISTS, True)
        groups = state.get("devices_data")
        if type(groups) is list:
            for group in groups:
                items = group.get("devices") if type(group) is dict else None
                if type(items) is list:
                    self.names.update([x for x in items if type(x) is str])
        groups = state.get("DI_DO")
        if type(groups) is list:
            for group in groups:
                if type(group) is list and group and type(group[0]) is list:
                    self.signals.update([x for x in group[0] if type(x) is str])
        steps = _entries(state.get("steps"))
        self.counts[3] += len(steps)
        for key, step in steps:
            self._lists(f"{owner}_{key}", step, _LISTS[:2], False)

    def objects(self, top: object) -> None:
        objects = _entries(top)
        self.counts[0] += len(objects)
        for key, entry in objects:
            self.roots.append(key.split("_", 1)[0])
            equipment = entry.get("equipment")
            if type(equipment) is dict:
                self.names.update([v for v in equipment.values() if type(v) is str])
            self.counts[4] += len(_entries(entry.get("par_float")))
            modes = _entries(entry.get("modes"))
            self.counts[1] += len(modes)
            for mode, value in modes:
                states = _entries(value.get("states"))
                self.counts[2] += len(states)
                for state, lists in states:
                    self._state(f"{key}_{mode}_{state}", lists)
        if len(set(self.owners)) < len(self.owners):
            # Owners that come twice are told by their object coming twice.
            self.roots *= 2

    def devices(self) -> list[tuple[str, bool, int, int]]:
        known = _valid(self.names)
        if not self.used:
            return [(x, True, 0, 0) for x in known]
        uses: dict[str | None, int] = {}
        owners: dict[str | None, int] = {}
        for x in self.uses:
            uses[x] = uses.get(x, 0) + 1
        for x in self.firsts:
            owners[x] = owners.get(x, 0) + 1
        uses.pop(None, None)
        return [(x, x in known, n, owners[x]) for x, n in uses.items()] + [(x, True, 0, 0) for x in known if x not in uses]


def _walked(body: bytes | None, used: bool) -> _Walk:
    walk = _Walk(used, body is not None and b"\\" in body)
    if body is not None:
        walk.objects(_parse(body))
    return walk


def _array(rows: list[list], kind: pa.DataType) -> pa.Array:
    ends = [0]
    for row in rows:
        ends.append(ends[-1] + len(row))
    flat = [x for row in rows for x in row]
    if pa.types.is_struct(kind):
        fields = zip(*flat, strict=True) if flat else [()] * kind.num_fields
        values = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(fields, kind, strict=True)], fields=list(kind))
    else:
        values = pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def walk_texts(config: DataFrame, used: bool = False) -> DataFrame:
    """One row per text of ``config``, by one scan.

    ``devices`` holds each device once: whether it is ``mentioned`` as a valid name and, if ``used`` is
    asked for, its uses in states and steps (``uses``) and the states and steps that use it (``owners``).
    ``roots`` are the ids of the objects up to their first underscore: owners of texts or objects with
    different roots are different. ``signals`` are the valid signal names, the other columns counts of
    entities. ``body`` is null but for texts that are left to the column functions, whose row holds nothing else.
    """

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                left, walks = [], []
                for body in batch.column(2).to_pylist():
                    try:
                        walks.append(_walked(body, used))
                        left.append(None)
                    except _Odd:
                        walks.append(_Walk(used, False))
                        left.append(body)
                signals = [list(_valid(w.signals)) for w in walks]
                made = [
                    pa.array(left, pa.binary()), _array([w.roots for w in walks], pa.string()), _array([w.devices() for w in walks], _DEVICE),
                    _array(signals, pa.string()), *[pa.array([w.counts[i] for w in walks], pa.int32()) for i in range(len(COUNTS))],
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=columns)

    texts = config.selectExpr("doc_id", "part", "cast(body as binary) as body")
    schema = StructType([*texts.schema.fields[:2], *StructType.fromDDL(_COLUMNS).fields])
    columns = schema.names
    return texts.mapInArrow(walked, schema)
