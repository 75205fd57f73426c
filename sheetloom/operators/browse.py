"""Views over flattened configurations and matched drawings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.operators.config import OPERATION_NAME, texts_of, there


# Margin of the scene, lengths of the tree and of the short and long device lists.
SCENE_MARGIN = 50.0
TREE_LIMIT = 2
LIST_LIMITS = (3, 10)


def device_usage(states: DataFrame, steps: DataFrame) -> DataFrame:
    """Opened, closed and checked devices per state and step in long form."""

    def lists(df: DataFrame, level: str, actions: Sequence[str]) -> DataFrame:
        def entries(action: str) -> Column:
            return F.transform(
                F.col(f"{action}_devices"),
                lambda d, i: F.struct(F.lit(action).alias("action"), i.cast("int").alias("pos"), d.alias("device")),
            )

        return df.select(
            "doc_id", F.lit(level).alias("level"), F.col("id").alias("owner_id"), F.explode(F.concat(*map(entries, actions))).alias("u")
        ).select("doc_id", "level", "owner_id", "u.*")

    return lists(states, "state", ("opened", "closed", "checked")).union(lists(steps, "step", ("opened", "closed")))


def nested_usage(states: DataFrame) -> DataFrame:
    """``device_usage`` of states that hold their steps in ``_steps``, in one pass."""

    def entries(level: str, owner: Column, action: str, texts: Column) -> Column:
        return F.transform(
            texts,
            lambda d, i: F.struct(F.lit(level).alias("level"), owner.alias("owner_id"), F.lit(action).alias("action"), i.cast("int").alias("pos"), d.alias("device")),
        )

    def of_step(e: Column) -> Column:
        owner = F.concat_ws("_", F.col("id"), e["key"])
        return F.concat(*[entries("step", owner, a, texts_of(e["value"][f"{a}_devices"])) for a in ("opened", "closed")])

    own = [entries("state", F.col("id"), a, F.col(f"{a}_devices")) for a in ("opened", "closed", "checked")]
    of_steps = F.flatten(F.transform(there(F.col("_steps")), of_step))
    return states.select("doc_id", F.explode(F.concat(*own, of_steps)).alias("u")).select("doc_id", "u.*")


def operations_of_matches(matches: DataFrame, states: DataFrame, steps: DataFrame) -> DataFrame:
    """Operations and states in which a matched device is used, counted per device name."""
    return uses_of_matches(matches, device_usage(states, steps))


def uses_of_matches(matches: DataFrame, usage: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``operations_of_matches`` of the rows of ``device_usage`` or ``nested_usage``.

    ``counted`` may hold the ``uses`` and ``owners`` of the documents that have no rows in ``usage``.
    """
    used = (
        usage.groupBy("doc_id", F.col("device").alias("lua_name"))
        .agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("owner_id").alias("owners"))
    )
    if counted is not None:
        used = used.unionByName(counted)
    return matches.join(used, ["doc_id", "lua_name"], "left")


def caption(name: Column, base: Column) -> Column:
    """Operation caption with its base operation."""
    return F.when(F.coalesce(base, F.lit("")) != "", F.concat(name, F.lit(" (base: "), base, F.lit(")"))).otherwise(name)


def device_caption(pdf_name: Column, confidence: Column) -> Column:
    """Device caption with the confidence when it is below one."""
    return F.concat(pdf_name, F.when(confidence < 1.0, F.format_string(" (%.1f)", confidence)).otherwise(""))


def filter_operations(operations: DataFrame, obj_name: str | None = None, text: str = "") -> DataFrame:
    """Operations of one or all objects whose caption holds the text, in any case."""
    rows = operations.withColumn("caption", caption(F.col("name"), F.col("base_operation")))
    if obj_name is not None:
        rows = rows.where(F.col("obj_name") == obj_name)
    return rows.where(F.contains(F.lower("caption"), F.lit(text.lower())))


def visible_operations(operations: DataFrame, obj_name: str | None = None, text: str = "") -> DataFrame:
    """Number of operations the filter leaves, per object."""
    shown = filter_operations(operations, obj_name, text)
    return shown.groupBy("doc_id", "obj_id", "obj_name").agg(F.count(F.lit(1)).alias("visible"))


def of_object(df: DataFrame, tech_object: str | None) -> DataFrame:
    """Contours or devices of one object; all when none is given."""
    return df if tech_object is None else df.where(F.col("tech_object") == tech_object)


def operation_details(operations: DataFrame, objects: DataFrame, parameters: DataFrame) -> DataFrame:
    """Operations with their object and the number of the object's parameters."""
    owner = objects.select(
        "doc_id", F.col("id").alias("obj_id"), "tech_type", "name_eplan", "name_BC", "base_tech_object"
    )
    count = parameters.groupBy("doc_id", "obj_id").agg(F.count(F.lit(1)).alias("n_parameters"))
    return (
        operations.join(owner, ["doc_id", "obj_id"], "left")
        .join(count, ["doc_id", "obj_id"], "left")
        .withColumn("n_parameters", F.coalesce("n_parameters", F.lit(0).cast("bigint")))
    )


def operation_parameters(requests: DataFrame, operations: DataFrame, parameters: DataFrame) -> DataFrame:
    """Parameter rows for requested operations, given as (doc_id, operation_id)."""
    wanted = requests.join(
        operations.select("doc_id", F.col("id").alias("operation_id"), "obj_id"), ["doc_id", "operation_id"]
    )
    return wanted.join(parameters.drop("obj_ord"), ["doc_id", "obj_id"])


def first_of_parent(
    df: DataFrame, parent: Sequence[str], order: Sequence[str | Column], limit: int
) -> DataFrame:
    """First rows per parent with ``more``, the number left out.

    The limit is applied before the shuffle (window group limit) and the totals are counted
    apart, so a parent with very many rows does not travel to one task.
    """
    window = Window.partitionBy(*parent).orderBy(*order)
    top = df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    totals = df.groupBy(*parent).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
    return top.join(totals, list(parent))


def first_of_list(items: Column, limit: int) -> tuple[Column, Column]:
    """First items of an array column, and how many follow."""
    return F.slice(items, 1, limit), F.greatest(F.size(items) - limit, F.lit(0))


def first_entries(df: DataFrame, source: str, key: str, limit: int) -> DataFrame:
    """The first entries of the level in ``source`` with their ``rank``, and in ``more`` how many follow.

    They are counted where they are nested, so nothing is shuffled.
    """
    found = df.withColumn("_found", there(F.col(source)))
    rest = [c for c in df.columns if c != source]
    more = F.greatest(F.size("_found") - limit, F.lit(0)).cast("bigint").alias("more")
    return found.select(*rest, more, F.posexplode(F.slice("_found", 1, limit)).alias("_at", "_e")).select(
        *rest, F.col("_e.key").alias(key), (F.col("_at") + 1).alias("rank"), "more"
    )


def hierarchy_counts(objects: DataFrame) -> DataFrame:
    """States and steps per operation, and operations per object, counted where they are nested."""
    modes = objects.select(
        "doc_id", F.col("id").alias("obj_id"), F.col("name").alias("obj_name"), F.size(there(F.col("_modes"))).cast("bigint").alias("n_operations"),
        F.explode("_modes").alias("mode_id", "v"),
    ).where(F.col("v").isNotNull())
    n_steps = F.aggregate(there(F.col("v.states")), F.lit(0).cast("bigint"), lambda n, s: n + F.size(there(s["value"]["steps"])))
    return modes.select(
        "doc_id",
        "obj_id",
        "obj_name",
        F.concat_ws("_", "obj_id", "mode_id").alias("operation_id"),
        F.coalesce("v.name", F.format_string(OPERATION_NAME, "mode_id")).alias("name"),
        F.size(there(F.col("v.states"))).cast("bigint").alias("n_states"),
        n_steps.alias("n_steps"),
        "n_operations",
    )


def steps_in_order(steps: DataFrame) -> DataFrame:
    """Steps with their place in their state by number, ties in document order."""
    window = Window.partitionBy("doc_id", "state_id").orderBy("step_number", "step_pos")
    return steps.withColumn("place", F.row_number().over(window))


def labels_of_object(matches: DataFrame) -> DataFrame:
    """Devices inside an object by label: ``place`` numbers them by label, then contour and text."""
    window = Window.partitionBy("doc_id", "tech_object").orderBy("pdf_name", "page", "contour_id", "text_id")
    return matches.withColumn("place", F.row_number().over(window))


def operations_by_name(operations: DataFrame) -> DataFrame:
    """Operations inside an object by name, ties in document order."""
    window = Window.partitionBy("doc_id", "obj_id").orderBy("name", "mode_pos")
    return operations.withColumn("place", F.row_number().over(window))


def operation_totals(operations: DataFrame) -> DataFrame:
    """Objects with operations and operations per document."""
    return operations.groupBy("doc_id", "obj_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("objects_with_operations"), F.sum("n").alias("operations")
    )


def entity_summary(tables: dict[str, tuple[DataFrame, Column, Column]], counts: DataFrame | None = None) -> DataFrame:
    """Row count and first row (as text) per entity; values are (table, order, text).

    ``counts(entity, n)`` may hold the row counts of entities whose table is cut to the texts of its first row.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.min_by(text, order).alias("sample")).select(
            F.lit(name).alias("entity"), "n", "sample"
        )
        for name, (df, order, text) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    if counts is None:
        return out
    whole = counts.select("entity", F.col("n").alias("_n"))
    return out.join(whole, "entity", "left").select("entity", F.coalesce("_n", "n").alias("n"), "sample")


def scene_extent(contours: DataFrame) -> DataFrame:
    """Box around all contours of a drawing with a margin."""
    return (
        contours.groupBy("doc_id")
        .agg(*[F.min(c).alias(c) for c in ("min_x", "min_y")], *[F.max(c).alias(c) for c in ("max_x", "max_y")])
        .select(
            "doc_id",
            (F.col("min_x") - SCENE_MARGIN).alias("x"),
            (F.col("min_y") - SCENE_MARGIN).alias("y"),
            (F.col("max_x") - F.col("min_x") + 2 * SCENE_MARGIN).alias("width"),
            (F.col("max_y") - F.col("min_y") + 2 * SCENE_MARGIN).alias("height"),
        )
    )


def document_counts(contours: DataFrame, matches: DataFrame) -> DataFrame:
    """Contours and devices per document."""
    c = contours.groupBy("doc_id").agg(F.count(F.lit(1)).alias("contours"))
    d = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("devices"))
    zero = F.lit(0).cast("bigint")
    return c.join(d, "doc_id", "full").select(
        "doc_id", F.coalesce("contours", zero).alias("contours"), F.coalesce("devices", zero).alias("devices")
    )


def contour_sizes(contours: DataFrame) -> DataFrame:
    """Contours with width and height."""
    return contours.withColumns(
        {"width": F.col("max_x") - F.col("min_x"), "height": F.col("max_y") - F.col("min_y")}
    )


def object_filter(objects: DataFrame, operations: DataFrame) -> DataFrame:
    """Distinct names of objects that have operations."""
    with_ops = operations.select("doc_id", F.col("obj_id").alias("id"))
    return objects.join(with_ops, ["doc_id", "id"], "left_semi").select("doc_id", "name").distinct()


def objects_with_operations(objects: DataFrame) -> DataFrame:
    """Distinct names of objects whose ``_modes`` hold operations."""
    return objects.where(F.size(there(F.col("_modes"))) > 0).select("doc_id", "name").distinct()


def match_filter(matches: DataFrame) -> DataFrame:
    """Distinct objects of the matches, sorted."""
    return matches.select("doc_id", "tech_object").distinct().orderBy("doc_id", "tech_object")


def operation_names(operations: DataFrame) -> DataFrame:
    """Non-empty operation names, sorted, repeats kept."""
    return operations.where(F.coalesce("name", F.lit("")) != "").select("doc_id", "name").orderBy("doc_id", "name")


def objects_by_name(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """First object per requested (doc_id, wanted) with that name, eplan name or BC name."""
    cols = ["id", "name", "name_eplan", "name_BC", "obj_ord"]
    known = (
        objects.select("doc_id", *cols, F.explode(F.array_distinct(F.array("name", "name_eplan", "name_BC"))).alias("wanted"))
        .groupBy("doc_id", "wanted")
        .agg(F.min_by(F.struct(*cols), "obj_ord").alias("o"))
    )
    return requests.select("doc_id", "wanted").distinct().join(known, ["doc_id", "wanted"]).select("doc_id", "wanted", "o.*")


def children_of(requests: DataFrame, df: DataFrame, parent: str) -> DataFrame:
    """Rows of ``df`` whose ``parent`` id is requested."""
    return df.join(requests.select("doc_id", parent).distinct(), ["doc_id", parent], "left_semi")


def first_operation_by_name(operations: DataFrame) -> DataFrame:
    """First operation of every name in document order."""
    return (
        operations.groupBy("doc_id", "name")
        .agg(F.min_by("id", F.struct("obj_ord", "mode_pos")).alias("operation_id"))
    )


def object_devices(matches: DataFrame) -> DataFrame:
    """Matches with the devices of their object (``total``), and whether they are its ``first``.

    The order within an object is that of page, contour and text; it stays in the columns.
    """
    own = ["doc_id", "tech_object"]
    place = F.struct(*[c for c in ("page", "contour_id", "text_id") if c in matches.columns])
    sizes = matches.groupBy(*own).agg(F.count(F.lit(1)).alias("total"), F.min(place).alias("_first"))
    return matches.join(sizes, own).withColumn("first", place == F.col("_first")).drop("_first")


def label_vocabulary(classes: DataFrame, used: DataFrame) -> DataFrame:
    """Predefined classes, then used labels, each once, in order of first sight.

    ``classes(label, ord)`` come first; ``used(label, ord)`` follow. Predefined classes keep
    repeats of the class list.
    """
    fresh = (
        used.groupBy("label").agg(F.min("ord").alias("ord")).join(classes.select("label"), "label", "left_anti")
    )
    return classes.select("label", "ord", F.lit(0).alias("group")).union(
        fresh.select("label", "ord", F.lit(1).alias("group"))
    )
