"""Nested object configurations flattened into seven tables.

Input is ``config(doc_id, part, body)``: JSON text of a map from object id to object, with
``part`` giving the order of the texts of one document.

A text is parsed once, against a nested type with variants at the leaves that holds only the
fields a table needs; what the levels above give to a table travels down with their entries, so
no table is joined to its parents. Maps keep the document order of their keys (fields of a
variant are sorted), which the ordinals ``obj_ord``, ``mode_pos``, ``state_pos`` and ``step_pos``
carry on. Where a text has an entry of a wrong type its objects are parsed one by one, and only
an object with such an entry inside is read level by level, so that only wrong entries drop out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import names
from sheetloom.operators.walk import COUNTS, walk_texts
from sheetloom.session import stored

# Default names and defaults of missing numbers.
OPERATION_NAME = "Операция %s"
STATE_NAME = "Состояние %s"
STEP_NAME = "Шаг %s"
NO_NUMBER = -1
TABLES = ("tech_objects", "devices", "operations", "states", "steps", "signals", "parameters")
DEVICE_LISTS = ("opened_devices", "closed_devices", "checked_devices")

# Fields of every level; a nested dict stands for a map of entries with those fields.
_STEP = {
    "name": "string",
    "time_param_n": "string",
    "next_step_n": "string",
    "baseStep": "string",
    "opened_devices": "variant",
    "closed_devices": "variant",
    "devices_data": "variant",
    "DI_DO": "variant",
    "enable_step_by_signal": "variant",
    "jump_if": "variant",
}
_STATE = {
    "name": "string",
    **{f: "variant" for f in DEVICE_LISTS},
    "devices_data": "variant",
    "DI_DO": "variant",
    "steps": _STEP,
}
_MODE = {"name": "string", "base_operation": "string", "props": "variant", "states": _STATE}
_PARAMETER = {"name": "string", "value": "variant", "meter": "string", "nameLua": "string", "oper": "variant"}
_OBJECT = {
    "n": "string",
    "tech_type": "string",
    "name": "string",
    "name_eplan": "string",
    "name_BC": "string",
    "base_tech_object": "string",
    "attached_objects": "string",
    "cooper_param_number": "string",
    "system_parameters": "variant",
    "properties": "variant",
    "equipment": "variant",
    "par_float": _PARAMETER,
    "modes": _MODE,
}


# The fields that each table needs, and its parents' fields that travel down to it.
_OWNER = {f: _OBJECT[f] for f in ("tech_type", "name", "name_eplan", "name_BC", "base_tech_object")}
_LISTS = {f: "variant" for f in DEVICE_LISTS}
LEVELS = {
    "tech_objects": {f: t for f, t in _OBJECT.items() if f not in ("par_float", "modes")},
    "parameters": {"name": "string", "par_float": _PARAMETER},
    "operations": {"name": "string", "modes": {f: t for f, t in _MODE.items() if f != "states"}},
    "operations_with_objects": _OWNER | {"par_float": _PARAMETER, "modes": {f: t for f, t in _MODE.items() if f != "states"}},
    "states": {"name": "string", "modes": {"name": "string", "base_operation": "string", "states": {f: t for f, t in _STATE.items() if f != "steps"}}},
    "steps": {"name": "string", "modes": {"name": "string", "base_operation": "string", "states": {"name": "string", "steps": _STEP}}},
    "signals": {"name": "string", "modes": {"name": "string", "states": {"DI_DO": "variant"}}},
    "uses": {"name": "string", "modes": {"name": "string", "states": _LISTS | {"steps": {f: _STEP[f] for f in DEVICE_LISTS[:2]}}}},
    "mentions": {
        "name": "string",
        "equipment": "variant",
        "modes": {"name": "string", "states": _LISTS | {"devices_data": "variant", "steps": {f: _STEP[f] for f in DEVICE_LISTS[:2]}}},
    },
    "tree": {"name": "string", "modes": {"name": "string", "base_operation": "string", "states": {"name": "string", "steps": {"name": "string"}}}},
}


def _struct_type(level: dict) -> str:
    return "struct<" + ",".join(f"`{f}`:{_map_type(t) if isinstance(t, dict) else t}" for f, t in level.items()) + ">"


def _map_type(level: dict) -> str:
    return f"map<string,{_struct_type(level)}>"


def _is_object(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))


def _strict(text: Column, kind: str) -> Column:
    """``text`` parsed as ``kind``, null unless all of it is one value of that kind.

    Inside a list, what follows the first value is either a fault or a second element.
    """
    whole = F.concat(F.lit('{"top":['), text, F.lit("]}"))
    parsed = F.from_json(whole, f"top array<{kind}>, wrong string", {"columnNameOfCorruptRecord": "wrong"})
    one = lambda p: F.when(p["wrong"].isNull() & (F.size(p["top"]) == 1), F.get(p["top"], 0))
    return F.get(F.transform(F.array(parsed), one), 0)


def _by_level(text: Column, level: dict) -> Column:
    """Map of the entries that are objects, each level parsed by itself."""
    found = F.map_filter(_strict(text, "map<string,string>"), lambda k, v: _is_object(v))
    return F.when(_is_object(text), F.transform_values(found, lambda k, v: _entry_by_level(v, level)))


def _entry_by_level(text: Column, level: dict) -> Column:
    fields = ",".join(f"`{f}` {'string' if isinstance(t, dict) else t}" for f, t in level.items())
    nested = lambda v: F.struct(*[(_by_level(v[f], t) if isinstance(t, dict) else v[f]).alias(f) for f, t in level.items()])
    return F.get(F.transform(F.array(F.from_json(text, fields)), nested), 0)


def _by_entry(text: Column, level: dict) -> Column:
    """Map of the entries that are objects, each parsed at once where all of it has its type."""
    found = F.map_filter(_strict(text, "map<string,string>"), lambda k, v: _is_object(v))
    return F.transform_values(found, lambda k, v: F.coalesce(_strict(v, _struct_type(level)), _entry_by_level(v, level)))


def _parse(text: Column, level: dict) -> Column:
    """Map of the entries of ``text``, in one pass where every entry has its type."""
    typed = _strict(text, _map_type(level))
    return F.when(_is_object(text), F.get(F.transform(F.array(typed), lambda t: F.coalesce(t, _by_entry(text, level))), 0))


def there(entries: Column) -> Column:
    """The entries of a map of a level that are objects, in document order, as (key, value)."""
    return F.filter(F.coalesce(F.map_entries(entries), F.array()), lambda e: e["value"].isNotNull())


def _entries(df: DataFrame, source: str, key: str, pos: str) -> DataFrame:
    """One row per entry of the map ``source``; its fields arrive in ``v``.

    The outer form keeps Spark from testing the size of the map first, which would parse
    the text once more.
    """
    rest = [c for c in df.columns if c != source]
    return df.select(*rest, F.posexplode_outer(source).alias(pos, key, "v")).where(F.col("v").isNotNull())


def _number(text: Column, default: int | None = None) -> Column:
    """Whole number of a field, ``2.0`` included; the default stands for a missing field only.

    A field that is there but no whole number is null here; its text is kept beside.
    """
    # The pattern comes first, as a failing cast is dear.
    whole = text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$")
    value = F.when(whole, F.split_part(F.trim(text), F.lit("."), F.lit(1)).try_cast("bigint"))
    return value if default is None else F.when(text.isNull(), F.lit(default).cast("bigint")).otherwise(value)


def _list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _map(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def texts_of(v: Column) -> Column:
    """List elements as text, an empty array for anything that is no list."""
    return F.coalesce(F.transform(_list(v), lambda e: e.try_cast("string")), F.array().cast("array<string>"))


def _text_map(v: Column) -> Column:
    return F.transform_values(_map(v), lambda k, e: e.try_cast("string"))


def _there_only(columns: Sequence[tuple[str, Column]], level: dict) -> list[Column]:
    """The columns whose field the level has."""
    return [c for f, c in columns if f in level]


def read_objects(config: DataFrame, level: dict = _OBJECT) -> DataFrame:
    """Objects with the fields of ``level``; ``_par_float`` and ``_modes`` hold the levels below."""
    parsed = config.select("doc_id", "part", _parse(F.col("body"), level).alias("_objects"))
    plain = ("name", "name_eplan", "name_BC", "base_tech_object", "attached_objects")
    v = lambda f: F.col(f"v.{f}")
    columns = [
        ("n", _number(v("n")).alias("n")),
        ("tech_type", _number(v("tech_type")).alias("tech_type")),
        *((f, v(f).alias(f)) for f in plain),
        ("cooper_param_number", _number(v("cooper_param_number")).alias("cooper_param_number")),
        *((f, v(f).alias(f"{f}_text")) for f in ("n", "tech_type", "cooper_param_number")),
        ("system_parameters", F.when(_map(v("system_parameters")).isNotNull(), v("system_parameters")).alias("system_parameters")),
        ("properties", _text_map(v("properties")).alias("properties")),
        ("equipment", _text_map(v("equipment")).alias("equipment")),
        ("equipment", v("equipment").alias("_equipment")),
        ("par_float", v("par_float").alias("_par_float")),
        ("modes", v("modes").alias("_modes")),
    ]
    place = F.struct("part", "obj_pos").alias("obj_ord")
    return _entries(parsed, "_objects", "id", "obj_pos").select("doc_id", place, "id", *_there_only(columns, level))


def read_parameters(objects: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Parameters of all objects, with the columns ``carry`` of their object."""
    base = objects.select(
        "doc_id", "obj_ord", F.col("id").alias("obj_id"), F.col("name").alias("obj_name"), *carry, "_par_float"
    )
    blank = F.lit("")
    oper = F.transform(_list(F.col("v.oper")), lambda e: e.try_cast("int"))
    return _entries(base, "_par_float", "id", "param_pos").select(
        "doc_id",
        "obj_ord",
        "obj_id",
        "obj_name",
        *carry,
        "param_pos",
        "id",
        F.coalesce("v.name", blank).alias("name"),
        F.coalesce("v.value", F.parse_json(F.lit("0"))).alias("value"),
        F.coalesce("v.meter", blank).alias("meter"),
        F.coalesce("v.nameLua", blank).alias("nameLua"),
        F.coalesce(oper, F.array().cast("array<int>")).alias("oper"),
    )


def read_operations(objects: DataFrame, level: dict = _OBJECT, carry: Sequence[str] = ()) -> DataFrame:
    """Operations of all objects, with the columns ``carry`` of their object; ``_states`` holds the level below."""
    base = objects.select(
        "doc_id", "obj_ord", F.col("id").alias("obj_id"), F.col("name").alias("obj_name"), *carry, "_modes"
    )
    no_props = F.create_map().cast("map<string,string>")
    columns = [
        ("base_operation", F.col("v.base_operation").alias("base_operation")),
        ("props", F.coalesce(_text_map(F.col("v.props")), no_props).alias("props")),
        ("states", F.col("v.states").alias("_states")),
    ]
    return _entries(base, "_modes", "mode_id", "mode_pos").select(
        "doc_id",
        "obj_ord",
        "mode_pos",
        F.concat_ws("_", "obj_id", "mode_id").alias("id"),
        F.coalesce("v.name", F.format_string(OPERATION_NAME, "mode_id")).alias("name"),
        "obj_id",
        "obj_name",
        *carry,
        *_there_only(columns, level["modes"]),
    )


def read_states(operations: DataFrame, level: dict = _OBJECT, carry: Sequence[str] = ()) -> DataFrame:
    """States of all operations, with the columns ``carry`` of their operation; the underscored columns hold lists and the level below."""
    base = operations.select(
        "doc_id",
        "obj_ord",
        "mode_pos",
        F.col("id").alias("operation_id"),
        F.col("name").alias("operation_name"),
        "obj_id",
        "obj_name",
        *carry,
        "_states",
    )
    keep = [c for c in base.columns if c != "_states"]
    name = F.col("v.name") if "name" in level["modes"]["states"] else F.lit(None).cast("string")
    columns = [
        *((f, texts_of(F.col(f"v.{f}")).alias(f)) for f in DEVICE_LISTS),
        ("devices_data", F.col("v.devices_data").alias("devices_data")),
        ("DI_DO", F.col("v.DI_DO").alias("DI_DO")),
        *((f, F.col(f"v.{f}").alias(f"_{f}")) for f in DEVICE_LISTS),
        ("steps", F.col("v.steps").alias("_steps")),
    ]
    return _entries(base, "_states", "state_key", "state_pos").select(
        *keep,
        "state_pos",
        "state_key",
        F.concat_ws("_", "operation_id", "state_key").alias("id"),
        F.coalesce(name, F.format_string(STATE_NAME, "state_key")).alias("name"),
        *_there_only(columns, level["modes"]["states"]),
    )


def read_state_data(config: DataFrame) -> DataFrame:
    """Complete data of every state as a variant, by id and place, unknown fields included."""
    outer = {"modes": {"states": "variant"}}
    parsed = config.select("doc_id", "part", _parse(F.col("body"), outer).alias("_objects"))
    modes = _entries(parsed, "_objects", "id", "obj_pos").select(
        "doc_id", F.struct("part", "obj_pos").alias("obj_ord"), F.col("id").alias("obj_id"), F.col("v.modes").alias("_modes")
    )
    states = _entries(modes, "_modes", "mode_id", "mode_pos").select(
        "doc_id", F.concat_ws("_", "obj_id", "mode_id").alias("operation_id"), _map(F.col("v.states")).alias("_states")
    )
    return (
        states.select("doc_id", "operation_id", F.explode("_states").alias("state_key", "state_data"))
        .where(_map(F.col("state_data")).isNotNull())
        .select("doc_id", F.concat_ws("_", "operation_id", "state_key").alias("id"), "state_data")
    )


def read_steps(states: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Steps of all states, numbered by their key, with the columns ``carry`` of their state."""
    own = ("doc_id", "obj_ord", "mode_pos", "state_pos", "operation_id", "operation_name", "obj_id", "obj_name")
    base = states.select(
        *[c for c in own if c in states.columns], F.col("id").alias("state_id"), F.col("name").alias("state_name"), *carry, "_steps"
    )
    keep = [c for c in base.columns if c != "_steps"]
    number = F.when(F.col("step_key").rlike("^[0-9]+$"), F.col("step_key").try_cast("bigint"))
    return _entries(base, "_steps", "step_key", "step_pos").select(
        *keep,
        "step_pos",
        "step_key",
        F.concat_ws("_", "state_id", "step_key").alias("id"),
        F.coalesce(number, F.lit(0).cast("bigint")).alias("step_number"),
        F.coalesce("v.name", F.format_string(STEP_NAME, "step_key")).alias("name"),
        _number(F.col("v.time_param_n"), NO_NUMBER).alias("time_param_n"),
        _number(F.col("v.next_step_n"), NO_NUMBER).alias("next_step_n"),
        *[F.col(f"v.{f}").alias(f"{f}_text") for f in ("time_param_n", "next_step_n")],
        F.col("v.baseStep").alias("baseStep"),
        texts_of(F.col("v.opened_devices")).alias("opened_devices"),
        texts_of(F.col("v.closed_devices")).alias("closed_devices"),
        *[F.col(f"v.{f}").alias(f) for f in ("devices_data", "DI_DO", "enable_step_by_signal", "jump_if")],
        F.col("v.opened_devices").alias("_opened_devices"),
        F.col("v.closed_devices").alias("_closed_devices"),
    )


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _strings(elements: Column) -> Column:
    """String elements of an array of variants with their position; other types drop out."""
    placed = F.transform(elements, lambda e, i: F.struct(i.alias("pos"), F.when(_is_text(e), e.try_cast("string")).alias("value")))
    return F.filter(placed, lambda p: p["value"].isNotNull())


_MENTION = "struct<section:int,field:int,pos:int,inner:int,source:string,name:string,step_pos:int,step_key:string>"


def _or_none(mentions: Column) -> Column:
    return F.coalesce(mentions, F.array().cast(f"array<{_MENTION}>"))


def _mention(section: int, field: int, pos: Column, inner: Column, source: str, value: Column, step: tuple[Column, Column] | None = None) -> Column:
    step_pos, step_key = step or (F.lit(-1), F.lit(None).cast("string"))
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(field).alias("field"),
        pos.cast("int").alias("pos"),
        inner.cast("int").alias("inner"),
        F.lit(source).alias("source"),
        value.alias("name"),
        step_pos.cast("int").alias("step_pos"),
        step_key.alias("step_key"),
    )


def _equipment_mentions() -> Column:
    """Devices among the values of an object's equipment."""
    found = _strings(F.map_values(_map(F.col("_equipment"))))
    return _or_none(F.transform(found, lambda s: _mention(-1, 0, s["pos"], F.lit(0), "equipment", s["value"])))


def _list_mentions(field: int, name: str) -> Column:
    """Devices in a state list: strings, and the string values of nested objects."""
    elements = _list(F.col(f"_{name}"))
    direct = F.transform(
        _strings(elements), lambda s: _mention(0, field, s["pos"], F.lit(0), name, s["value"])
    )

    def nested(e: Column, i: Column) -> Column:
        values = _strings(F.map_values(_map(e)))
        return _or_none(F.transform(values, lambda s: _mention(0, field, i, s["pos"], f"{name}_nested", s["value"])))

    return _or_none(F.concat(direct, F.flatten(F.transform(elements, nested))))


def _group_mentions() -> Column:
    """Devices in the ``devices`` list of every group of ``devices_data``."""

    def group(e: Column, i: Column) -> Column:
        found = _strings(_list(F.try_element_at(_map(e), F.lit("devices"))))
        return _or_none(F.transform(found, lambda s: _mention(1, 0, i, s["pos"], "devices_data", s["value"])))

    return _or_none(F.flatten(F.transform(_list(F.col("devices_data")), group)))


def _step_mentions() -> Column:
    """Devices in the lists of all steps of a state; of an object the keys count, as they are what a loop visits."""

    def of_list(entry: Column, i: Column, field: int, name: str) -> Column:
        v = entry["value"][name]
        keys = F.transform(F.map_keys(_map(v)), lambda k, j: F.struct(j.alias("pos"), k.alias("value")))
        items = F.coalesce(_strings(_list(v)), keys)
        return _or_none(F.transform(items, lambda s: _mention(2, field, s["pos"], F.lit(0), f"step_{name}", s["value"], (i, entry["key"]))))

    def of_step(entry: Column, i: Column) -> Column:
        return F.concat(*[of_list(entry, i, k, f) for k, f in enumerate(DEVICE_LISTS[:2])])

    return _or_none(F.flatten(F.transform(F.map_entries("_steps"), of_step)))


def _parent(*parts: str) -> Column:
    # A missing name prints as the word None in parent paths.
    return F.concat_ws(".", *[F.coalesce(p, F.lit("None")) for p in parts])


def _mention_states(objects: DataFrame) -> DataFrame:
    """One row per state with the lists that can mention devices.

    An object's equipment goes with its first state (``_first``), or with the row that stands for
    an object without any.
    """
    fields = [*DEVICE_LISTS, "devices_data", "steps"]
    modes = objects.select("doc_id", "obj_ord", "id", "name", "_equipment", F.posexplode_outer("_modes").alias("mode_pos", "mode_id", "m"))
    rows = modes.select(
        *[c for c in modes.columns if c != "m"], F.col("m.name").alias("_named"), F.posexplode_outer("m.states").alias("state_pos", "state_key", "s")
    )
    first = (F.coalesce("mode_pos", F.lit(0)) == 0) & (F.coalesce("state_pos", F.lit(0)) == 0)
    operation = F.coalesce("_named", F.format_string(OPERATION_NAME, "mode_id"))
    return rows.select(
        "doc_id", "obj_ord", "mode_pos", "state_pos", F.col("id").alias("obj_id"), F.col("name").alias("obj_name"), operation.alias("operation_name"),
        first.alias("_first"), "_equipment", *[F.col(f"s.{f}").alias(f if f == "devices_data" else f"_{f}") for f in fields],
    )


def device_mentions(objects: DataFrame) -> DataFrame:
    """Every valid device mention with its place ``ord`` in document order.

    The objects are walked through once, by operation and state; the steps' lists are read where
    they are nested.
    """
    states = _mention_states(objects)
    lists = [_list_mentions(i, f) for i, f in enumerate(DEVICE_LISTS)]
    equipment = F.when(F.col("_first"), _equipment_mentions()).otherwise(_or_none(F.lit(None)))
    found = states.select(
        "doc_id", "obj_ord", "mode_pos", "state_pos", "obj_id", "obj_name", "operation_name", F.explode(F.concat(equipment, *lists, _group_mentions(), _step_mentions())).alias("m")
    ).where(names.is_device_name(F.col("m.name")))
    of_object = F.col("m.section") < 0
    level = lambda c: F.when(of_object, F.lit(-1)).otherwise(F.col(c)).alias(c)
    place = F.struct("obj_ord", level("mode_pos"), level("state_pos"), "m.section", "m.step_pos", "m.field", "m.pos", "m.inner")
    parent = (
        F.when(of_object, F.col("obj_name"))
        .when(F.col("m.step_key").isNull(), _parent("obj_name", "operation_name"))
        .otherwise(_parent("obj_name", "operation_name", "m.step_key"))
    )
    return found.select(
        "doc_id", place.alias("ord"), F.col("m.name").alias("name"), F.col("m.source").alias("source"), parent.alias("parent"), "obj_id"
    )


def device_names(objects: DataFrame) -> DataFrame:
    """Valid device names that ``device_mentions`` finds, with ``obj_ord``; a name comes once per state at most."""
    none = F.array().cast("array<string>")
    texts = lambda elements: F.transform(elements, lambda e: F.when(_is_text(e), e.try_cast("string")))
    some = lambda found: F.coalesce(found, none)
    each = lambda elements, read: some(F.flatten(F.transform(elements, read)))
    of_values = lambda e: some(texts(F.map_values(_map(e))))
    of_group = lambda e: some(texts(_list(F.try_element_at(_map(e), F.lit("devices")))))
    of_step = lambda v: F.concat(*[F.coalesce(texts(_list(v[f])), F.map_keys(_map(v[f])), none) for f in DEVICE_LISTS[:2]])
    lists = [_list(F.col(f"_{f}")) for f in DEVICE_LISTS]
    parts = [
        F.when(F.col("_first"), of_values(F.col("_equipment"))).otherwise(none),
        *[some(texts(items)) for items in lists],
        *[each(items, of_values) for items in lists],
        each(_list(F.col("devices_data")), of_group),
        each(F.map_values("_steps"), of_step),
    ]
    found = _mention_states(objects).select("doc_id", "obj_ord", F.explode_outer(F.array_distinct(F.concat(*parts))).alias("name"))
    return found.where(names.is_device_name(F.col("name")))


def first_devices(config: DataFrame) -> DataFrame:
    """``first_mentions`` of all texts in two passes, so that no place of a mention is sorted or moved but the first ones.

    The first pass finds the first text of each name by its ``part`` alone, the second reads the
    texts that hold a first mention for its place.
    """
    seen = device_names(read_objects(config, LEVELS["mentions"])).select("doc_id", "name", F.col("obj_ord.part").alias("part"))
    # A text without a part comes before all others.
    ends = seen.groupBy("doc_id", "name").agg(F.min("part").alias("part"), F.max(F.col("part").isNull()).alias("bare"))
    first = stored(ends.select("doc_id", "name", F.when(~F.col("bare"), F.col("part")).alias("part")))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    wanted = first.select("doc_id", "part").distinct()
    texts = config.join(wanted, same(config, wanted, "doc_id", "part"), "left_semi")
    mentions = device_mentions(read_objects(texts, LEVELS["mentions"])).withColumn("part", F.col("ord.obj_ord.part"))
    return first_mentions(mentions.join(first, same(mentions, first, "doc_id", "name", "part"), "left_semi"))


def first_mentions(mentions: DataFrame) -> DataFrame:
    """One row per device name: source, parent and object of its first mention."""
    return (
        mentions.groupBy("doc_id", "name")
        .agg(F.min_by(F.struct("source", "parent", "obj_id"), "ord").alias("m"))
        .select("doc_id", "name", "m.*")
    )


def read_signals(states: DataFrame) -> DataFrame:
    """Signals: strings of the first list of every DI_DO group, first mention per name and type."""
    none = F.array().cast("array<struct<grp:int,pos:int,name:string>>")

    def group(e: Column, i: Column) -> Column:
        inner = _strings(_list(F.get(_list(e), 0)))
        found = F.transform(
            inner, lambda s: F.struct(i.alias("grp"), s["pos"].alias("pos"), s["value"].alias("name"))
        )
        return F.coalesce(found, none)

    rows = states.select(
        "doc_id",
        "obj_ord",
        "mode_pos",
        "state_pos",
        _parent("obj_name", "operation_name").alias("parent"),
        F.explode(F.flatten(F.transform(_list(F.col("DI_DO")), group))).alias("s"),
    ).where(names.is_device_name(F.col("s.name")))
    place = F.struct("obj_ord", "mode_pos", "state_pos", "s.grp", "s.pos")
    return rows.groupBy("doc_id", F.col("s.name").alias("name"), F.lit("DI_DO").alias("type")).agg(
        F.min_by("parent", place).alias("parent")
    )


class ConfigTables:
    """The tables of a configuration corpus, each planned when first asked for.

    Every table is one pass over the texts that reads only the fields it needs. Columns that
    start with an underscore hold lists and levels below. With ``write_once`` the parsed objects
    are written to the shared folder, which pays off when a job reads several tables.
    """

    def __init__(self, config: DataFrame, write_once: bool = False) -> None:
        self._config = config
        self._write_once = write_once

    @cached_property
    def _all_objects(self) -> DataFrame:
        return stored(read_objects(self._config))

    def objects_for(self, table: str) -> tuple[DataFrame, dict]:
        """Objects with the fields that a table needs, and these fields."""
        if self._write_once:
            return self._all_objects, _OBJECT
        return read_objects(self._config, LEVELS[table]), LEVELS[table]

    @cached_property
    def tech_objects(self) -> DataFrame:
        return self.objects_for("tech_objects")[0]

    @cached_property
    def parameters(self) -> DataFrame:
        return read_parameters(self.objects_for("parameters")[0])

    @cached_property
    def operations(self) -> DataFrame:
        return read_operations(*self.objects_for("operations"))

    @cached_property
    def operations_with_objects(self) -> DataFrame:
        """Operations with the names of their object, the number of its parameters (``n_parameters``), and these in ``_par_float``."""
        objects, level = self.objects_for("operations_with_objects")
        counted = objects.withColumn("n_parameters", F.size(there(F.col("_par_float"))).cast("bigint"))
        return read_operations(counted, level, ("tech_type", "name_eplan", "name_BC", "base_tech_object", "n_parameters", "_par_float"))

    def _states(self, table: str, carry: Sequence[str] = ("base_operation",)) -> DataFrame:
        objects, level = self.objects_for(table)
        return read_states(read_operations(objects, level), level, carry)

    @cached_property
    def states(self) -> DataFrame:
        """States, with the base operation of their operation."""
        return self._states("states")

    @cached_property
    def steps(self) -> DataFrame:
        return read_steps(self._states("steps"))

    @cached_property
    def states_in_use(self) -> DataFrame:
        """States with their device lists, and those of their steps in ``_steps``."""
        return self._states("uses", ())

    @cached_property
    def tree(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Objects, operations and states with no more than names and the level below."""
        objects, level = self.objects_for("tree")
        operations = read_operations(objects, level)
        return objects, operations, read_states(operations, level)

    @cached_property
    def devices(self) -> DataFrame:
        return first_mentions(device_mentions(self.objects_for("mentions")[0]))

    @cached_property
    def devices_in_two_passes(self) -> DataFrame:
        """``devices`` by two scans, for corpora whose mentions are too many to sort."""
        return first_devices(self._config)

    @cached_property
    def device_names(self) -> DataFrame:
        """``doc_id`` and ``name`` of ``devices``."""
        return device_names(self.objects_for("mentions")[0]).select("doc_id", "name").distinct()

    @cached_property
    def signals(self) -> DataFrame:
        return read_signals(self._states("signals", ()))

    @cached_property
    def signal_names(self) -> DataFrame:
        """``doc_id``, ``name`` and ``type`` of ``signals``."""
        return self.signals.select("doc_id", "name", "type")

    def public(self) -> dict[str, DataFrame]:
        """All tables without the raw columns."""
        named = {n: getattr(self, n) for n in TABLES}
        return {n: df.drop(*[c for c in df.columns if c.startswith("_")]) for n, df in named.items()}


class CountedConfig(ConfigTables):
    """``ConfigTables`` for jobs that count and list names: all texts are walked through once (``walk``).

    Texts that the walk leaves are read by the column functions. With ``used``, uses of devices are
    counted as well, and ``states_in_use`` holds the states of those documents only that are not counted.
    """

    def __init__(self, config: DataFrame, used: bool = False) -> None:
        super().__init__(config)
        self._used = used

    @cached_property
    def _walked(self) -> DataFrame:
        return stored(walk_texts(self._config, self._used))

    @cached_property
    def _left(self) -> DataFrame:
        return self._walked.where(F.col("body").isNotNull()).select("doc_id", "part", F.col("body").cast("string").alias("body"))

    @cached_property
    def _left_tables(self) -> ConfigTables:
        return ConfigTables(self._left)

    @cached_property
    def device_names(self) -> DataFrame:
        walked = self._walked.select("doc_id", F.explode("devices").alias("d")).where("d.mentioned").select("doc_id", "d.name")
        return walked.union(self._left_tables.device_names).distinct()

    @cached_property
    def signal_names(self) -> DataFrame:
        walked = self._walked.select("doc_id", F.explode("signals").alias("name")).select("doc_id", "name", F.lit("DI_DO").alias("type"))
        return walked.union(self._left_tables.signal_names).distinct()

    @cached_property
    def _uncounted(self) -> DataFrame:
        """Documents whose owners must be told apart by their ids: with a text that is left, or with objects that may share an owner."""
        roots = self._walked.select("doc_id", F.explode("roots").alias("root"))
        repeated = roots.groupBy("doc_id", "root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return stored(repeated.select("doc_id").union(self._left.select("doc_id")).distinct())

    @cached_property
    def counted_uses(self) -> DataFrame:
        """``uses`` and ``owners`` of the devices (``lua_name``) of the documents that are counted."""
        rows = self._walked.join(self._uncounted, "doc_id", "left_anti").select("doc_id", F.explode("devices").alias("d")).where("d.uses > 0")
        return rows.groupBy("doc_id", F.col("d.name").alias("lua_name")).agg(F.sum("d.uses").alias("uses"), F.sum("d.owners").alias("owners"))

    @cached_property
    def states_in_use(self) -> DataFrame:
        return ConfigTables(self._config.join(self._uncounted, "doc_id", "left_semi")).states_in_use

    @cached_property
    def entity_counts(self) -> DataFrame:
        """Rows (``n``) of the tables in ``walk.COUNTS`` by ``entity``."""
        sums = self._walked.agg(*[F.coalesce(F.sum(f"n_{c}"), F.lit(0).cast("bigint")).alias(c) for c in COUNTS])
        out = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("entity"), F.col(c).alias("n")) for c in COUNTS])).alias("c")).select("c.*")
        for c in COUNTS:
            out = out.union(getattr(self._left_tables, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("entity"), "n"))
        return out.groupBy("entity").agg(F.sum("n").alias("n"))

    @cached_property
    def of_first_texts(self) -> ConfigTables:
        """Tables of the texts that hold the first object, state or step, in the order of ``doc_id`` and ``part``; they may hold more."""
        place = F.struct("doc_id", "part")
        firsts = self._walked.agg(*[F.min(F.when(F.col(f"n_{c}") > 0, place)).alias(c) for c in ("tech_objects", "states", "steps")])
        # Three places at most: as literals they are tested before a text is built or read.
        here = [self._config["doc_id"].eqNullSafe(F.lit(p.doc_id)) & self._config["part"].eqNullSafe(F.lit(p.part)) for p in firsts.first() if p is not None]
        texts = self._config.where(reduce(or_, here, F.lit(False))).select("doc_id", "part", "body")
        return ConfigTables(stored(texts.union(self._left)))


def flatten_config(config: DataFrame, write_once: bool = False) -> ConfigTables:
    """Tables of a configuration corpus."""
    return ConfigTables(config, write_once)


_FLAT_STATE = (
    "struct<state_id:string,operation_id:string,operation_name:string,obj_id:string,obj_name:string,state_data:struct<name:string,steps:string>>"
)
_FLAT_OBJECT = "struct<id:string,name:string,parameters:array<struct<" + ",".join(f"{f}:{t}" for f, t in ({"id": "string"} | _PARAMETER).items()) + ">>>"
_FLAT_OPERATION = "struct<id:string,name:string,base_operation:string,obj_id:string,obj_name:string,props:variant>"
FLAT_TYPES = {"tech_objects": _FLAT_OBJECT, "operations": _FLAT_OPERATION, "states": _FLAT_STATE}


def flat_rows(texts: DataFrame, *tables: str) -> DataFrame:
    """``doc_id`` and the lists of flat files that are asked for, each text parsed once.

    A text that is no object, or in which a list that is asked for holds anything but objects, is
    left out as a whole, as such a file cannot be loaded; a missing list is empty.
    """
    lists = [f"{t}:array<{FLAT_TYPES[t]}>" for t in tables]
    parsed = texts.select("doc_id", _strict(F.col("body"), f"struct<{','.join(lists)}>").alias("_top"))
    none = lambda t: F.array().cast(f"array<{FLAT_TYPES[t]}>")
    return parsed.where(F.col("_top").isNotNull()).select("doc_id", *[F.coalesce(f"_top.{t}", none(t)).alias(t) for t in tables])


def flat_states(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """States of ``flat_rows`` with ``ord``, their place in the list; ``_steps`` holds the steps of their data.

    Steps are parsed from the state's own data; entries that are no objects drop out.
    """
    blank = F.lit("")
    parents = ("operation_id", "operation_name", "obj_id", "obj_name")
    placed = rows.select("doc_id", *carry, F.posexplode("states").alias("ord", "s")).where(F.col("s").isNotNull())
    own = placed.select("doc_id", *carry, "ord", F.coalesce("s.state_id", blank).alias("id"), *[F.coalesce(f"s.{p}", blank).alias(p) for p in parents], "s.state_data")
    name = F.coalesce("state_data.name", F.concat(F.lit("state_"), "id"))
    return own.withColumn("name", name).withColumn("_steps", _parse(F.col("state_data.steps"), _STEP)).drop("state_data")


def flat_steps(rows: DataFrame) -> DataFrame:
    """Steps rebuilt from the data of the states of ``flat_rows``, with their place in their state by number."""
    states = flat_states(rows).withColumn("state_pos", F.col("ord"))
    # Numbers are sorted where the steps are nested, so that no state is gathered.
    number = lambda e: F.when(e["key"].rlike("^[0-9]+$"), e["key"].try_cast("bigint"))
    key = lambda e, i: F.struct(F.coalesce(number(e), F.lit(0).cast("bigint")).alias("n"), i.alias("i"), e["key"].alias("key"))
    ranked = F.transform(F.array_sort(F.transform(there(F.col("_steps")), key)), lambda e, i: F.struct(e["key"].alias("key"), (i + 1).alias("place")))
    placed = states.withColumn("places", F.map_from_entries(ranked))
    base = read_steps(placed.drop("ord"), ("places",))
    return base.withColumn("place", F.try_element_at("places", F.col("step_key"))).drop("places")


def flat_orphans(rows: DataFrame) -> DataFrame:
    """States of ``flat_rows`` (with ``operations``) whose operation their file does not list."""
    known = F.transform("operations", lambda o: F.coalesce(o["id"], F.lit("")))
    # A map is looked up by hash, and the lists of a file lie in one row as they are parsed.
    listed = F.map_from_arrays(F.array_distinct(known), F.transform(F.array_distinct(known), lambda k: F.lit(True)))
    states = flat_states(rows.withColumn("_known", listed), ("_known",))
    return states.where(F.try_element_at("_known", F.col("operation_id")).isNull()).drop("_known", "_steps")


def flat_parameters(rows: DataFrame) -> DataFrame:
    """Parameters of the objects of ``flat_rows``, with the defaults of missing fields."""
    blank = F.lit("")
    objects = rows.select("doc_id", F.posexplode("tech_objects").alias("obj_ord", "o")).where(F.col("o").isNotNull())
    placed = objects.select("doc_id", "obj_ord", F.coalesce("o.id", blank).alias("obj_id"), F.posexplode("o.parameters").alias("param_pos", "v"))
    oper = F.transform(_list(F.col("v.oper")), lambda e: e.try_cast("int"))
    return placed.where(F.col("v").isNotNull()).select(
        "doc_id", "obj_ord", "obj_id", "param_pos", *[F.coalesce(f"v.{f}", blank).alias(f) for f in ("id", "name", "meter", "nameLua")],
        F.coalesce("v.value", F.parse_json(F.lit("0"))).alias("value"), F.coalesce(oper, F.array().cast("array<int>")).alias("oper"),
    )


def operations_of_objects(operations: DataFrame, objects: DataFrame) -> DataFrame:
    """Operations whose object exists, with the object's names."""
    owner = objects.select(
        "doc_id", F.col("id").alias("obj_id"), "obj_ord", "tech_type", "name_eplan", "name_BC", "base_tech_object"
    )
    return operations.drop("obj_ord").join(owner, ["doc_id", "obj_id"])


def indexed_states(states: DataFrame, operations: DataFrame) -> DataFrame:
    """States whose operation exists."""
    return states.join(operations.select("doc_id", F.col("id").alias("operation_id")), ["doc_id", "operation_id"], "left_semi")


def orphan_states(states: DataFrame, operations: DataFrame) -> DataFrame:
    """States of unknown operations."""
    return states.join(operations.select("doc_id", F.col("id").alias("operation_id")), ["doc_id", "operation_id"], "left_anti")
