import json

from pyspark.sql import functions as F

from sheetloom.operators import browse, classify, config, matching, ordinals, tiles

OBJECT = {
    "n": 1, "tech_type": 2, "name": "Tank", "name_eplan": "TANK", "name_BC": "TankBC", "base_tech_object": "tank", "cooper_param_number": -1,
    "par_float": {"1": {"name": "Volume", "value": 10.5, "meter": "l", "nameLua": "V_1", "oper": [1]}},
    "equipment": {"lt": "TANK1LT1", "none": "Нет"}, "properties": {"p": "1"}, "system_parameters": {},
    "modes": {"1": {"name": "Fill", "base_operation": "FILL", "props": {"k": "v"}, "states": {"1": {
        "opened_devices": ["TANK1V1", {"a": "TANK1V2"}], "closed_devices": {}, "checked_devices": ["TANK1V1"],
        "devices_data": [{"devices": ["TANK1M1"]}], "DI_DO": [[["S1", "S2"], ["S3"]], ["S9"]],
        "steps": {"2": {"name": "b", "closed_devices": ["TANK1V2"]}, "1": {"opened_devices": ["TANK1V3"]}}}}}},
}


def check_tables(t):
    assert [r.id for r in t.operations.collect()] == ["1_1"]
    assert [(r.id, r.name) for r in t.states.collect()] == [("1_1_1", "Состояние 1")]
    steps = t.steps.orderBy("step_pos").collect()
    assert [(r.id, r.step_number, r.name, r.time_param_n) for r in steps] == [("1_1_1_2", 2, "b", -1), ("1_1_1_1", 1, "Шаг 1", -1)]
    assert {(r.name, r.source) for r in t.devices.collect()} == {
        ("TANK1LT1", "equipment"), ("TANK1V1", "opened_devices"), ("TANK1V2", "opened_devices_nested"),
        ("TANK1M1", "devices_data"), ("TANK1V3", "step_opened_devices"),
    }
    assert {(r.name, r.parent) for r in t.signals.collect()} == {("S1", "Tank.Fill"), ("S2", "Tank.Fill")}
    p = t.parameters.collect()
    assert [(r.id, r.name, r.oper) for r in p] == [("1", "Volume", [1])]


def test_clean_configuration(spark):
    rows = spark.createDataFrame([("d", 0, json.dumps({"1": OBJECT}))], "doc_id string, part int, body string")
    check_tables(config.flatten_config(rows, write_once=True))


def test_wrong_entries_drop_out_one_at_a_time(spark):
    body = json.loads(json.dumps({"0": 5, "1": OBJECT, "2": [1]}))
    body["1"]["modes"]["9"] = 7
    body["1"]["par_float"]["2"] = "x"
    body["1"]["modes"]["1"]["states"]["1"]["steps"]["3"] = []
    bad = [("d", 0, json.dumps(body)), ("e", 0, "nonsense"), ("f", 0, "[1]"), ("g", 0, None)]
    check_tables(config.flatten_config(spark.createDataFrame(bad, "doc_id string, part int, body string")))


def test_device_matching(spark):
    devices = spark.createDataFrame(
        [("d", 0, "TANK1V1", "old"), ("d", 1, "TANK1v1", "ignored"), ("d", 2, "tank1v1", None), ("d", 3, "V1", None), ("d", 4, "", None)],
        "doc_id string, ord int, name string, descr string",
    ).selectExpr("*", "cast(null as string) article", "cast(null as string) type", "cast(null as string) category", "map('dtype', '3') extra")
    contours = spark.createDataFrame(
        [("d", 0, 5, "=A+TANK1", 0.0, 0.0, 100.0, 100.0), ("d", 0, 3, "TANK10", 50.0, 50.0, 150.0, 150.0)],
        "doc_id string, page int, contour_id int, name string, min_x double, min_y double, max_x double, max_y double",
    ).selectExpr("*", "0.0D cx", "0.0D cy")
    texts = spark.createDataFrame(
        [("d", 0, 1, "V-1 ", 1.0, 1.0), ("d", 0, 2, "v1", 105.0, 50.0), ("d", 0, 3, "V1", 105.001, 1.0), ("d", 0, 4, "LT7", 9.0, 9.0)],
        "doc_id string, page int, text_id int, text string, cx double, cy double",
    )
    matches = matching.match_devices(contours, texts, devices)
    assert [(r.contour_id, r.text_id, r.lua_name, r.device_type) for r in matches.collect()] == [(5, 2, "TANK1V1", "V")]
    # The last device of an upper-case name wins, so the description is hidden.
    assert [r.descr for r in matching.enrich_matches(matches, devices).collect()] == [None]
    assert [r.label for r in matching.unmatched_labels(contours, texts, devices).collect()] == ["LT7"]
    objects = spark.createDataFrame([("d", "TANK1")], "doc_id string, tech_object string")
    assert matching.first_contour_of_object(objects, contours).first().contour_id == 3
    assert matching.first_contour_of_object(objects, contours, mode="exact").first().contour_id == 5


def test_tiles(spark):
    images = spark.createDataFrame([("a", 1024, 1024), ("b", 1793, 1025)], "image_id string, width int, height int")
    boxes = spark.createDataFrame(
        [("a", 0, "valve", 10, 10, 50, 50), ("b", 0, "valve1", 700, 10, 900, 60), ("b", 1, "motor", 5, 5, 9, 9),
         ("b", 2, "sensor", 1792, 1000, 1793, 1020), ("c", 0, "pump", 0, 0, 9, 9)],
        "image_id string, box_id int, name string, xmin int, ymin int, xmax int, ymax int",
    )
    assert [(r.image_id, r.tile_x) for r in tiles.tile_grid(images).orderBy("tile_x").collect()] == [("b", 0), ("b", 768)]
    labels = tiles.tile_labels(boxes, images)
    got = [(r.box_id, r.tile_x, r.cx * 1024, r.bw * 1024) for r in labels.orderBy("tile_x").collect()]
    assert got == [(0, 0, 800.0, 200.0), (0, 768, 66.0, 132.0)]
    assert [r.tile_name for r in tiles.numbered_labels(labels).orderBy("tile_x").collect()] == ["b_0", "b_1"]
    covered = tiles.tile_labels(boxes, images, cover_edges=True)
    assert {(r.image_id, r.box_id) for r in covered.collect()} == {("a", 0), ("b", 0), ("b", 2)}


def test_split_is_exact_and_repeatable(spark):
    images = spark.range(1003).selectExpr("concat('i', id) as image_id")
    one, two = (tiles.split_images(images).where("subset = 'train'").collect() for _ in range(2))
    assert len(one) == 802 and set(one) == set(two)
    assert tiles.split_images(images, exact=False).count() == 1003


def test_classes(spark):
    boxes = spark.createDataFrame([("d", 0, 10.0, 10.0, 20.0, 20.0)] * 2, "doc_id string, page int, x1 double, y1 double, x2 double, y2 double")
    line = lambda x: [(x, 15.0), (x, 15.0)]
    far = [(90.0, 90.0)] * 3
    rows = [
        ("l", line(23.0), None, None), ("l", line(23.1), None, None), ("c", far + [(25.0, 25.0)], None, None), ("c", far + far[:1], None, None),
        ("re", None, 20.0, 10.0), ("qu", None, None, None), ("l", None, None, None),
    ]
    prims = spark.createDataFrame(
        [("d", 0, i, k, p, x, 15.0, w, 0.0, "abc") for i, (k, p, x, w) in enumerate(rows)],
        "doc_id string, page int, prim_id int, kind string, pts array<struct<x:double,y:double>>, x double, y double, w double, h double, stroke_width string",
    )
    got = classify.classify_primitives(prims, boxes).orderBy("prim_id").collect()
    assert [r["class"] for r in got] == ["device", "pipe", "device", "pipe", "device", "other"]
    assert {r.stroke for r in got} == {1.0}
    assert [r.prim_id for r in classify.rejected_primitives(prims).collect()] == [6]


def test_devices_of_an_object_of_any_size(spark):
    matches = spark.range(30_000).selectExpr("'d' as doc_id", "0 as page", "'T' as tech_object", "id as contour_id", "id as text_id", "'V1' as pdf_name")
    rows = browse.object_devices(matches).select("contour_id", "total", "first").collect()
    assert len(rows) == 30_000 and {r.total for r in rows} == {30_000}
    assert [r.contour_id for r in rows if r.first] == [0]


def test_numbers_of_sparse_orders(spark):
    rows = spark.range(4000).selectExpr("if(id % 4 = 0, 'b', 'a') as g", "id * 1000000 as o").repartition(5)
    got = ordinals.number_within(rows, ["g"], "o", "n").collect()
    for g in "ab":
        assert [r.n for r in sorted(got, key=lambda r: r.o) if r.g == g] == list(range(1000 if g == "b" else 3000))


def test_numbers_and_broken_texts_of_configurations(spark):
    step = '"1":{"time_param_n":2.0,"next_step_n":"T5"},"2":{"time_param_n":"x1"},"3":{}'
    good = '{"1":{"n":1.0,"tech_type":"2.5","modes":{"1":{"states":{"1":{"steps":{%s}}}}}}}' % step
    texts = spark.createDataFrame([("d", 0, good), ("e", 0, '{"1":{"n":1}},"z":{"n":2}'), ("f", 0, '{"1":{"n":1}}{"2":{}}'), ("g", 0, '{"1":{"n":')], "doc_id string, part int, body string")
    t = config.flatten_config(texts)
    assert [(r.doc_id, r.id, r.n, r.tech_type, r.tech_type_text) for r in t.tech_objects.collect()] == [("d", "1", 1, None, "2.5")]
    assert [(r.time_param_n, r.time_param_n_text, r.next_step_n, r.next_step_n_text) for r in t.steps.orderBy("step_pos").collect()] == [
        (2, "2.0", None, "T5"), (None, "x1", -1, None), (-1, None, -1, None),
    ]


def test_flat_files_give_back_their_steps(spark):
    steps = {"10": {"name": "ten"}, "2": 5, "b": {}, "1": {"next_step_n": 3, "closed_devices": ["V1", 4]}, "a": {"time_param_n": None}}
    flat = {
        "operations": [{"id": "1_1"}],
        "states": [
            {"state_id": "s1", "operation_id": "1_1", "obj_id": "1", "state_data": {"name": "Run", "steps": steps}},
            {"state_id": "s2", "operation_id": "9_9", "state_data": {"steps": []}},
            {"state_id": "s3", "state_data": {}},
        ],
        "tech_objects": [{"id": "1", "parameters": [{"id": "1", "value": 2.5}, {}]}, {"id": "2"}],
    }
    bodies = [("d", json.dumps(flat)), ("e", json.dumps({"states": [3]})), ("f", "[]"), ("g", None), ("h", "{}")]
    texts = spark.createDataFrame(bodies, "doc_id string, body string")
    rows = config.flat_rows(texts, "tech_objects", "operations", "states")
    assert {r.doc_id for r in rows.collect()} == {"d", "h"}
    got = config.flat_steps(rows).orderBy("place").collect()
    assert [(r.id, r.name, r.step_number, r.next_step_n, r.closed_devices) for r in got] == [
        ("s1_b", "Шаг b", 0, -1, []), ("s1_a", "Шаг a", 0, -1, []), ("s1_1", "Шаг 1", 1, 3, ["V1", "4"]), ("s1_10", "ten", 10, -1, []),
    ]
    assert {(r.id, r.name) for r in config.flat_states(rows).collect()} == {("s1", "Run"), ("s2", "state_s2"), ("s3", "state_s3")}
    assert [r.id for r in config.flat_orphans(rows).orderBy("ord").collect()] == ["s2", "s3"]
    assert [(r.obj_id, r.id, r.value.toPython(), r.oper) for r in config.flat_parameters(rows).orderBy("param_pos").collect()] == [("1", "1", 2.5, []), ("1", "", 0, [])]


def test_each_table_is_one_scan_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([("d", 0, json.dumps({"1": OBJECT}))], "doc_id string, part int, body string").write.parquet(str(tmp_path / "c"))
    t = config.flatten_config(spark.read.parquet(str(tmp_path / "c")))
    objects, operations, states = t.tree
    usage = browse.nested_usage(t.states_in_use)
    heads = [browse.first_entries(df, c, "key", 1) for df, c in ((objects, "_modes"), (operations, "_states"), (states, "_steps"))]
    for df in (t.tech_objects, t.parameters, t.operations, t.operations_with_objects, t.states, t.steps, usage, *heads):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    plan = t.devices._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Exchange") == 1
    assert [(r.key, r["rank"], r.more) for r in heads[2].collect()] == [("2", 1, 1)]
    assert sorted((r.level, r.owner_id, r.action, r.device) for r in usage.collect()) == sorted(
        (r.level, r.owner_id, r.action, r.device) for r in browse.device_usage(t.states, t.steps).collect()
    )
