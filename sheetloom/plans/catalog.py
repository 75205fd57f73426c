"""Queries over the driver tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions import names, numbers, shapes, svg
from sheetloom.operators import browse, classify, config, fuzzy, loops, matching, naming, tiles
from sheetloom.plans import views
from sheetloom.sinks import writers
from sheetloom.sources import annotations, config_files, drawings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[build.__name__] = build
    return build


def _drawing(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return views.contours(spark, sf_dir), views.texts(spark, sf_dir), views.devices(spark, sf_dir)


# Device matching


@query
def device_match_counts(spark, sf_dir):
    return browse_counts(spark, sf_dir).orderBy("doc_id", "tech_object")


def browse_counts(spark, sf_dir):
    return matching.matches_per_object(matching.match_devices(*_drawing(spark, sf_dir)))


@query
def device_match_rows(spark, sf_dir):
    return matching.match_devices(*_drawing(spark, sf_dir))


@query
def unmatched_labels(spark, sf_dir):
    return matching.unmatched_labels(*_drawing(spark, sf_dir)).select("doc_id", "contour_id", "text_id", "label")


@query
def empty_contours(spark, sf_dir):
    return matching.empty_contours(*_drawing(spark, sf_dir)).select("doc_id", "contour_id", "tech_object")


@query
def expected_devices(spark, sf_dir):
    contours, _, devices = _drawing(spark, sf_dir)
    return matching.expected_devices(contours, devices).select("doc_id", "contour_id", "tech_object", "expected")


@query
def device_enrich(spark, sf_dir):
    contours, texts, devices = _drawing(spark, sf_dir)
    rows = matching.enrich_matches(matching.match_devices(contours, texts, devices), devices)
    return rows.select(
        "doc_id", "contour_id", "text_id", "lua_name", "descr", "article", "type", "category",
        F.try_element_at("extra", F.lit("size")).alias("size"),
    )


@query
def object_first_contour(spark, sf_dir):
    contours, _, devices = _drawing(spark, sf_dir)
    wanted = matching.device_parts(devices)
    return matching.first_contour_of_object(wanted, contours).select(
        "doc_id", "tech_object", "page", "contour_id", "name", "min_x", "min_y", "max_x", "max_y"
    )


@query
def object_named_contour(spark, sf_dir):
    contours, _, devices = _drawing(spark, sf_dir)
    wanted = matching.device_parts(devices)
    return matching.first_contour_of_object(wanted, contours, mode="exact").select(
        "doc_id", "tech_object", "page", "contour_id", "name"
    )


@query
def device_name_parts(spark, sf_dir):
    return views.devices(spark, sf_dir).select(
        "doc_id",
        "ord",
        "name",
        names.device_type(F.col("name")).alias("device_type"),
        names.device_object(F.col("name")).alias("tech_object"),
        names.device_short_name(F.col("name")).alias("short_name"),
        names.name_prefix(F.col("name")).alias("prefix"),
    )


@query
def configured_devices(spark, sf_dir):
    return matching.configured_devices(views.devices(spark, sf_dir)).select(
        "doc_id", "tech_object", "short_name", "ord", "name", "article"
    )


@query
def label_parts(spark, sf_dir):
    return matching.label_texts(views.texts(spark, sf_dir)).select("doc_id", "text_id", "text", "label", "cx", "cy")


# Contours


@query
def segment_flags(spark, sf_dir):
    length = shapes.segment_length(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return views.segments(spark, sf_dir).select("doc_id", "seg_id", "dashed", F.round(length, 6).alias("length"))


@query
def vertex_degrees(spark, sf_dir):
    keys = ("doc_id", "page")
    degrees = loops.vertex_degrees(loops.dashed_edges(views.segments(spark, sf_dir), keys), keys)
    return degrees.groupBy("doc_id", "degree").agg(F.count(F.lit(1)).alias("vertices"))


def _contours(spark, sf_dir, strict=True):
    segments = views.segments(spark, sf_dir)
    edges = loops.contour_edges(loops.closed_loops(segments, strict=strict, by_place=True), segments)
    return loops.contours_of(edges), edges


@query
def contours_closed(spark, sf_dir):
    return _contours(spark, sf_dir)[0].drop("ambiguous")


@query
def contours_stripped(spark, sf_dir):
    return _contours(spark, sf_dir, strict=False)[0]


@query
def contour_edges(spark, sf_dir):
    return _contours(spark, sf_dir)[1].select("doc_id", "page", "contour_id", "seg_id", "pos", "n_edges")


def _candidates(spark, sf_dir):
    contours, edges = _contours(spark, sf_dir)
    dictionary = naming.name_dictionary(views.objects(spark, sf_dir))
    return contours, edges, naming.text_candidates(edges, views.texts(spark, sf_dir), dictionary)


@query
def name_dictionary(spark, sf_dir):
    return naming.name_dictionary(views.objects(spark, sf_dir)).select("doc_id", "known", "object.name_eplan")


@query
def configured_names(spark, sf_dir):
    dictionary = naming.name_dictionary(views.objects(spark, sf_dir))
    rows = naming.configured_names(naming.name_candidates(views.texts(spark, sf_dir)), dictionary)
    return rows.select("doc_id", "text_id", "candidate", "configured", "final_name")


@query
def contour_text_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir)[2]
    return rows.select(
        "doc_id", "page", "contour_id", "text_id", "candidate", "configured", "inside",
        F.round("dist", 6).alias("dist"), F.round("score", 6).alias("score"),
    )


@query
def contour_names(spark, sf_dir):
    contours, _, candidates = _candidates(spark, sf_dir)
    return naming.name_contours(contours, candidates).select(
        "doc_id", "page", "contour_id", "text_id", "name", "original_name", "name_x", "name_y"
    )


@query
def contour_sizes(spark, sf_dir):
    return browse.contour_sizes(_contours(spark, sf_dir)[0]).select("doc_id", "page", "contour_id", "width", "height")


# Configurations


def _tables(spark, sf_dir, write_once=False) -> config.ConfigTables:
    """Configuration tables; ``write_once`` where a query reads several of them."""
    return config.flatten_config(views.config(spark, sf_dir), write_once)


def _entries_text(column: str):
    """All entries of a map, in key order."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")


@query
def config_objects(spark, sf_dir):
    return _tables(spark, sf_dir).tech_objects.select(
        "doc_id", "id", "n", "tech_type", "name", "name_eplan", "name_BC", "base_tech_object", "cooper_param_number",
        "n_text", "attached_objects", _entries_text("properties").alias("properties"), _entries_text("equipment").alias("equipment"),
    )


@query
def config_parameters(spark, sf_dir):
    return _tables(spark, sf_dir).parameters.select(
        "doc_id", "obj_id", "obj_name", "id", "name", F.try_variant_get("value", "$", "double").alias("value"),
        "meter", "nameLua", F.array_join(F.col("oper").cast("array<string>"), ",").alias("oper"),
    )


@query
def config_operations(spark, sf_dir):
    return _tables(spark, sf_dir).operations.select(
        "doc_id", "id", "name", "base_operation", "obj_id", "obj_name", F.try_element_at("props", F.lit("k")).alias("k")
    )


@query
def config_states(spark, sf_dir):
    return _tables(spark, sf_dir).states.select(
        "doc_id", "id", "name", "operation_id", "operation_name", "obj_id",
        *[F.array_join(f"{a}_devices", "|").alias(a) for a in ("opened", "closed", "checked")],
    )


@query
def config_state_data(spark, sf_dir):
    rows = config.read_state_data(views.config(spark, sf_dir))
    part = lambda p: F.try_variant_get("state_data", p, "string")
    return rows.select("doc_id", "id", part("$.DI_DO").alias("signals"), part("$.devices_data").alias("devices_data"), part("$.checked_devices").alias("checked"))


@query
def config_steps(spark, sf_dir):
    return _tables(spark, sf_dir).steps.select(
        "doc_id", "id", "name", "step_number", "step_pos", "state_id", "state_name", "operation_name",
        "time_param_n", "time_param_n_text", "next_step_n", "next_step_n_text", F.array_join("opened_devices", ",").alias("opened"),
        F.array_join("closed_devices", ",").alias("closed"),
    )


@query
def config_devices_first_seen(spark, sf_dir):
    return _tables(spark, sf_dir).devices_in_two_passes


@query
def config_signals(spark, sf_dir):
    return _tables(spark, sf_dir).signals


@query
def object_operations(spark, sf_dir):
    return _tables(spark, sf_dir).operations_with_objects.select("doc_id", "id", "obj_id", "name_eplan", "tech_type")


@query
def indexed_states(spark, sf_dir):
    return _tables(spark, sf_dir).states.where("base_operation = 'FILL'").select("doc_id", "id")


@query
def orphan_states(spark, sf_dir):
    return _tables(spark, sf_dir).states.where("NOT base_operation <=> 'FILL'").select("doc_id", "id")


@query
def flat_steps(spark, sf_dir):
    rows = config.flat_steps(config.flat_rows(views.flat_config(spark, sf_dir), "states"))
    return rows.select(
        "doc_id", "id", "name", "step_number", "place", "state_id", "state_name", "operation_id", "obj_id", "time_param_n", "next_step_n",
        F.array_join("opened_devices", ",").alias("opened"), F.size("closed_devices").alias("n_closed"),
    )


@query
def flat_orphans(spark, sf_dir):
    rows = config.flat_orphans(config.flat_rows(views.flat_config(spark, sf_dir), "operations", "states"))
    return rows.select("doc_id", "ord", "id", "name", "operation_id")


@query
def flat_parameters(spark, sf_dir):
    rows = config.flat_parameters(config.flat_rows(views.flat_config(spark, sf_dir), "tech_objects"))
    return rows.select("doc_id", "obj_id", "param_pos", "id", "name", F.try_variant_get("value", "$", "bigint").alias("value"), F.array_join(F.col("oper").cast("array<string>"), ",").alias("oper"))


@query
def device_usage(spark, sf_dir):
    return browse.nested_usage(_tables(spark, sf_dir).states_in_use)


@query
def device_operation_use(spark, sf_dir):
    t = config.CountedConfig(views.config(spark, sf_dir), used=True)
    return browse.uses_of_matches(t.device_names.withColumnRenamed("name", "lua_name"), browse.nested_usage(t.states_in_use), t.counted_uses)


@query
def tree_first_states(spark, sf_dir):
    _, operations, _ = _tables(spark, sf_dir).tree
    rows = browse.first_entries(operations, "_states", "state_key", browse.TREE_LIMIT)
    return rows.select("doc_id", F.col("id").alias("operation_id"), F.concat_ws("_", "id", "state_key").alias("id"), "rank", "more")


@query
def tree_first_steps(spark, sf_dir):
    _, _, states = _tables(spark, sf_dir).tree
    rows = browse.first_entries(states, "_steps", "step_key", browse.TREE_LIMIT)
    return rows.select("doc_id", F.col("id").alias("state_id"), F.concat_ws("_", "id", "step_key").alias("id"), "rank", "more")


@query
def list_heads(spark, sf_dir):
    heads = []
    for limit in browse.LIST_LIMITS:
        head, more = browse.first_of_list(F.concat("opened_devices", "checked_devices"), limit)
        heads += [F.array_join(head, "|").alias(f"first_{limit}"), more.alias(f"more_{limit}")]
    return _tables(spark, sf_dir).states.select("doc_id", "id", *heads)


@query
def tree_first_operations(spark, sf_dir):
    objects, _, _ = _tables(spark, sf_dir).tree
    rows = browse.first_entries(objects, "_modes", "mode_id", browse.LIST_LIMITS[0])
    return rows.select("doc_id", F.col("id").alias("obj_id"), F.concat_ws("_", "id", "mode_id").alias("id"), "rank", "more")


@query
def steps_in_order(spark, sf_dir):
    return browse.steps_in_order(_tables(spark, sf_dir).steps).select("doc_id", "state_id", "id", "place")


@query
def operations_by_name(spark, sf_dir):
    return browse.operations_by_name(_tables(spark, sf_dir).operations).select("doc_id", "obj_id", "id", "name", "place")


@query
def devices_by_label(spark, sf_dir):
    rows = browse.labels_of_object(matching.match_devices(*_drawing(spark, sf_dir)))
    return rows.select("doc_id", "tech_object", "page", "contour_id", "text_id", "pdf_name", "place")


@query
def hierarchy_counts(spark, sf_dir):
    return browse.hierarchy_counts(_tables(spark, sf_dir).tree[0])


@query
def operation_totals(spark, sf_dir):
    return browse.operation_totals(_tables(spark, sf_dir).operations)


@query
def entity_summary(spark, sf_dir):
    t = config.CountedConfig(views.config(spark, sf_dir))
    first = t.of_first_texts
    doc = F.col("doc_id")
    place = ["obj_ord", "mode_pos", "state_pos", "step_pos"]
    joined = lambda c: F.array_join(c, "|")
    row = lambda *c: F.concat_ws(";", *[F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("-")) for x in c])
    none = F.lit(None).cast("string")
    return browse.entity_summary(
        {
            "tech_objects": (
                first.tech_objects,
                F.struct(doc, F.col("obj_ord")),
                row("id", F.col("n").cast("string"), F.col("tech_type").cast("string"), "name", "name_eplan", "name_BC", "base_tech_object", _entries_text("properties")),
            ),
            "devices": (t.device_names, F.struct(doc), none),
            "operations": (first.operations, F.struct(doc), none),
            "states": (
                first.states, F.struct(doc, *place[:3]),
                row("id", "name", "operation_id", "operation_name", "obj_name", joined("opened_devices"), joined("closed_devices"), joined("checked_devices")),
            ),
            "steps": (
                first.steps, F.struct(doc, *place),
                row("id", "name", "state_id", "state_name", "operation_name", "time_param_n_text", "next_step_n_text", joined("opened_devices"), joined("closed_devices")),
            ),
            "signals": (t.signal_names, F.struct(doc), none),
            "parameters": (first.parameters, F.struct(doc), none),
        },
        t.entity_counts,
    )


@query
def operation_details(spark, sf_dir):
    return _tables(spark, sf_dir).operations_with_objects.select("doc_id", "id", "name", "obj_id", "tech_type", "name_eplan", "n_parameters")


@query
def operation_parameters(spark, sf_dir):
    wanted = _tables(spark, sf_dir).operations_with_objects.where("base_operation = 'FILL'")
    owned = wanted.select("doc_id", "obj_ord", F.col("id").alias("operation_id"), F.col("obj_id").alias("id"), F.col("obj_name").alias("name"), "_par_float")
    return config.read_parameters(owned, ("operation_id",)).select("doc_id", "operation_id", "obj_id", "id", "name", "meter")


@query
def operation_filter(spark, sf_dir):
    return browse.visible_operations(_tables(spark, sf_dir).operations, text="BASE: fill")


@query
def object_filter(spark, sf_dir):
    return browse.objects_with_operations(_tables(spark, sf_dir).tree[0])


@query
def operation_names(spark, sf_dir):
    return browse.operation_names(_tables(spark, sf_dir).operations)


@query
def first_operation_by_name(spark, sf_dir):
    return browse.first_operation_by_name(_tables(spark, sf_dir).operations)


@query
def objects_by_name(spark, sf_dir):
    t = _tables(spark, sf_dir)
    wanted = views.contours(spark, sf_dir).select("doc_id", F.col("name").alias("wanted"))
    return browse.objects_by_name(wanted, t.tech_objects).select("doc_id", "wanted", "id", "name", "name_eplan")


@query
def states_of_operations(spark, sf_dir):
    return _tables(spark, sf_dir).states.where("base_operation = 'FILL'").select("doc_id", "operation_id", "id")


# Device configuration texts


def _event_configs(spark, sf_dir):
    return config_files.parse_device_configs(views.event_props(spark, sf_dir))


@query
def event_devices(spark, sf_dir):
    return config_files.devices_of(_event_configs(spark, sf_dir)).select(
        "path", "ord", "name", "descr", F.array_join(F.map_keys("extra"), ",").alias("keys"), F.try_element_at("extra", F.lit("user")).alias("user"), F.try_element_at("extra", F.lit("k")).alias("k"),
        F.size("extra").alias("n_extra"),
    )


@query
def event_nodes(spark, sf_dir):
    return config_files.nodes_of(_event_configs(spark, sf_dir)).select(
        "path", "ord", F.variant_get("body", "$", "bigint").alias("node")
    )


@query
def config_rejects(spark, sf_dir):
    return config_files.rejects_of(_event_configs(spark, sf_dir))


@query
def file_statistics(spark, sf_dir):
    return config_files.file_statistics(_event_configs(spark, sf_dir))


@query
def encoding_census(spark, sf_dir):
    text, encoding = config_files.decode_text(F.col("content"))
    return views.encoded_documents(spark, sf_dir).select("doc_id", encoding.alias("encoding"), F.length(text).alias("chars"), F.md5(text.cast("binary")).alias("text_md5"))


# Names alike


@query
def fuzzy_objects(spark, sf_dir):
    rows = fuzzy.suggest_objects(views.fuzzy_names(spark, sf_dir), views.fuzzy_devices(spark, sf_dir))
    return rows.select("doc_id", "contour_name", "prefix", F.round("score", 6).alias("score"))


@query
def device_prefixes(spark, sf_dir):
    return fuzzy.device_prefixes(views.devices(spark, sf_dir))


# Browsing of drawings


@query
def scene_extent(spark, sf_dir):
    return browse.scene_extent(views.contours(spark, sf_dir))


@query
def document_counts(spark, sf_dir):
    contours, texts, devices = _drawing(spark, sf_dir)
    return browse.document_counts(contours, matching.match_devices(contours, texts, devices))


@query
def matched_objects(spark, sf_dir):
    return browse.match_filter(matching.match_devices(*_drawing(spark, sf_dir)))


@query
def object_matches(spark, sf_dir):
    rows = browse.of_object(matching.match_devices(*_drawing(spark, sf_dir)), "TANK7")
    return rows.select("doc_id", "contour_id", "text_id", "pdf_name")


@query
def nested_objects(spark, sf_dir):
    rows = browse.object_devices(matching.match_devices(*_drawing(spark, sf_dir)))
    return rows.select("doc_id", "tech_object", "page", "contour_id", "text_id", "pdf_name", "total", "first")


@query
def device_captions(spark, sf_dir):
    texts = matching.label_texts(views.texts(spark, sf_dir))
    # Text sizes stand in for confidences, as every match of the matcher has 1.0.
    confidence = 1.0 - F.col("size") * 10
    return texts.select("doc_id", "text_id", browse.device_caption(F.col("label"), confidence).alias("caption"))


# Exchange rows


@query
def text_rows(spark, sf_dir):
    return writers.text_rows(views.texts(spark, sf_dir)).selectExpr(
        "doc_id", "_page as page", "_id as id", "_content as content", "_x as x", "_y as y", "BBox._x1 as x1", "BBox._y1 as y1", "BBox._x2 as x2", "BBox._y2 as y2"
    )


@query
def segment_rows(spark, sf_dir):
    return writers.segment_rows(views.segments(spark, sf_dir)).selectExpr(
        "doc_id", "_page as page", "_id as id", "_x1 as x1", "_y1 as y1", "_x2 as x2", "_y2 as y2", "_dashed as dashed"
    )


@query
def contour_rows(spark, sf_dir):
    contours, edges, candidates = _candidates(spark, sf_dir)
    return writers.contour_rows(naming.name_contours(contours, candidates), edges).selectExpr(
        "doc_id", "_page as page", "_id as id", "SegmentRefs as refs", "Bounds._min_x as min_x", "Bounds._min_y as min_y", "Bounds._max_x as max_x",
        "Bounds._max_y as max_y", "Center._x as cx", "Center._y as cy", "Name._VALUE as name", "Name._pos_x as name_x", "Name._pos_y as name_y",
    )


@query
def matched_rows(spark, sf_dir):
    contours, texts, devices = _drawing(spark, sf_dir)
    enriched = matching.enrich_matches(matching.match_devices(contours, texts, devices), devices)
    first = matching.first_contour_of_object(matching.device_parts(devices), contours)
    # The whole element: all attributes in the order they are written.
    return writers.matched_rows(enriched, first).selectExpr(
        "doc_id", "_name as tech_object", "Contour._bounds as bounds", "Contour._center as center",
        "array_join(transform(map_entries(Devices.Device[0]), e -> concat(substr(e.key, 2), '=', e.value)), ';') as attributes",
    )


@query
def matched_devices_read(spark, sf_dir):
    rows = drawings.devices_of_elements(drawings.element_texts(views.matched_files(spark, sf_dir)))
    return rows.select("doc_id", "tech_object", "ord", "lua_name", "x", "confidence", "descr", F.try_element_at("extra", F.lit("size")).alias("size"), F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("open"))


@query
def visualisation_contours(spark, sf_dir):
    contours = matching.contours_with_object(views.contours(spark, sf_dir))
    return writers.contour_view_rows(contours).selectExpr("doc_id", "_name as name", "_tech_object as tech_object", "_bounds as bounds", "_center as center", "_width as width", "_height as height")


@query
def visualisation_devices(spark, sf_dir):
    contours, texts, devices = _drawing(spark, sf_dir)
    rows = matching.enrich_matches(matching.match_devices(contours, texts, devices), devices)
    return writers.device_view_rows(rows).selectExpr(
        "doc_id", "_lua_name as lua_name", "_pdf_name as pdf_name", "_tech_object as tech_object", "_x as x", "_y as y", "_confidence as confidence",
        "_descr as descr", "_article as article", "_device_type as device_type", "_category as category", "ExtraData['size'] as size",
    )


@query
def svg_rescale(spark, sf_dir):
    attrs = svg.rescale_attributes(F.col("tag"), F.col("attrs"))
    rows = views.svg_elements(spark, sf_dir).select("elem_id", "tag", attrs.alias("a"))
    return rows.select("elem_id", "tag", *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("d", "points", "transform", "width")])


@query
def svg_rescale_grammar(spark, sf_dir):
    attrs = svg.rescale_attributes(F.col("tag"), F.col("attrs"), by_grammar=True)
    return views.arc_paths(spark, sf_dir).select("elem_id", F.try_element_at(attrs, F.lit("d")).alias("d"))


# Annotated images


@query
def annotation_text_boxes(spark, sf_dir):
    return annotations.boxes_of_texts(views.annotation_texts(spark, sf_dir))


@query
def annotation_text_sizes(spark, sf_dir):
    return annotations.sizes_of_texts(views.annotation_texts(spark, sf_dir))


@query
def annotation_text_rejects(spark, sf_dir):
    return annotations.rejects_of_texts(views.annotation_texts(spark, sf_dir))


@query
def class_filter(spark, sf_dir):
    return tiles.known_boxes(views.boxes(spark, sf_dir)).select("image_id", "box_id", "cls")


@query
def tile_grid(spark, sf_dir):
    return tiles.tile_grid(views.images(spark, sf_dir))


@query
def tile_labels(spark, sf_dir):
    return tiles.tile_labels(views.boxes(spark, sf_dir), views.images(spark, sf_dir))


@query
def tile_numbers(spark, sf_dir):
    return tiles.tile_numbers(tiles.tile_labels(views.boxes(spark, sf_dir), views.images(spark, sf_dir)))


@query
def label_lines(spark, sf_dir):
    labels = tiles.numbered_labels(tiles.tile_labels(views.boxes(spark, sf_dir), views.images(spark, sf_dir)))
    line = tiles.label_line(F.col("cls"), *[F.col(c) for c in ("cx", "cy", "bw", "bh")])
    return labels.select("tile_name", "box_id", line.alias("line"))


@query
def split_images(spark, sf_dir):
    return tiles.split_images(views.images(spark, sf_dir))


@query
def split_counts(spark, sf_dir):
    return tiles.split_images(views.images(spark, sf_dir)).groupBy("subset").agg(F.count(F.lit(1)).alias("images"))


@query
def label_vocabulary(spark, sf_dir):
    known = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in tiles.CLASSES])).alias("ord", "label"))
    used = views.boxes(spark, sf_dir).select(F.col("name").alias("label"), F.col("box_id").alias("ord"))
    return browse.label_vocabulary(known, used).select("label", F.col("group").alias("grp"))


@query
def annotation_precedence(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "R", ".xml").otherwise(".txt")
    files = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a/img"), "l_orderkey", kind).alias("path"))
    return annotations.preferred_annotations(files)


@query
def clamped_shapes(spark, sf_dir):
    drawn = views.boxes(spark, sf_dir).selectExpr(
        "image_id", "box_id", "array(struct(cast(xmin as double) as x, cast(ymin as double) as y),"
        " struct(cast(xmax as double) as x, cast(ymax as double) as y)) as points"
    )
    rows = annotations.clamp_shapes(drawn, views.images(spark, sf_dir))
    corner = lambda i: [F.get("points", i)[c].alias(f"{c}{i}") for c in ("x", "y")]
    return rows.select("image_id", "box_id", "changed", *corner(0), *corner(1))


@query
def annotation_files(spark, sf_dir):
    boxes = views.boxes(spark, sf_dir).withColumn("difficult", F.lit(False))
    images = views.images(spark, sf_dir).unionByName(views.bare_images(spark, sf_dir))
    rows = writers.annotation_rows(boxes, images.withColumn("verified", F.col("width") > 2000))
    text = lambda o: F.concat_ws(":", o["name"], *[o["bndbox"][s] for s in ("xmin", "ymin", "xmax", "ymax")])
    return rows.select("image_id", "_verified", "size.width", "size.height", F.array_join(F.transform("object", text), "|").alias("boxes"))


# Detections and primitives


def _page_boxes(spark, sf_dir):
    return classify.page_boxes(views.detections(spark, sf_dir), views.pages(spark, sf_dir))


@query
def detection_boxes(spark, sf_dir):
    return _page_boxes(spark, sf_dir).select("image_id", "doc_id", "x1", "y1", "x2", "y2")


@query
def primitive_classes(spark, sf_dir):
    rows = classify.classify_primitives(views.primitives(spark, sf_dir), _page_boxes(spark, sf_dir))
    return rows.select("doc_id", "prim_id", "kind", "class", "stroke")


@query
def class_counts(spark, sf_dir):
    rows = classify.classify_primitives(views.primitives(spark, sf_dir), _page_boxes(spark, sf_dir))
    return classify.class_counts(rows).drop("page")


@query
def text_classes(spark, sf_dir):
    corner = views.primitives(spark, sf_dir).selectExpr(
        "doc_id", "page", "prim_id as text_id", "struct(x as x1, y as y1, x + w as x2, y + h as y2) as bbox"
    )
    return classify.classify_texts(corner, _page_boxes(spark, sf_dir)).select("doc_id", "text_id", "class")


@query
def number_texts(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(
        F.expr(views.ROW_ID).alias("id"),
        numbers.fixed3(F.col("l_tax") / 16).alias("tax"),
        numbers.fixed3(-F.col("l_extendedprice") / 64).alias("price"),
    )


@query
def dash_patterns(spark, sf_dir):
    return views.drawing_items(spark, sf_dir).groupBy("dashes").agg(
        F.count_if(shapes.is_dashed(F.col("dashes"))).alias("dashed"), F.count(F.lit(1)).alias("items")
    )


