import json

from pyspark.sql import functions as F

from sheetloom.operators.config import flatten_config
from sheetloom.sinks import writers
from sheetloom.sources import annotations, config_files, drawings


def test_device_files(spark, tmp_path):
    good = {"nodes": [{"ntype": 1}], "devices": [{"name": "TANK1V1", "descr": "valve", "dtype": 3, "sub": {"a": 1}, "on": True}, {"name": "V2"}]}
    (tmp_path / "a.json").write_text(json.dumps(good), encoding="utf-8")
    (tmp_path / "b.json").write_bytes('{"nodes": [], "devices": [{"name": "Нет"}]}'.encode("cp1251"))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"nodes": []}')
    texts = config_files.read_text_files(spark, str(tmp_path), "*.json")
    assert {r.doc_id: r.encoding for r in texts.collect()} == {"a": "utf-8", "b": "cp1251", "c": "utf-8", "d": "utf-8"}
    configs = config_files.parse_device_configs(texts)
    devices = config_files.devices_of(configs).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.name, r.descr, r.extra) for r in devices] == [
        ("a", "TANK1V1", "valve", {"dtype": "3", "on": "True"}), ("a", "V2", None, {}), ("b", "Нет", None, {}),
    ]
    assert config_files.nodes_of(configs).count() == 1
    assert {r.path[-6:]: r.reason for r in config_files.rejects_of(configs).collect()} == {"c.json": "not a JSON object", "d.json": "no devices"}
    assert tuple(config_files.file_statistics(configs).first()) == (2, 4, 1, 3)


def test_flat_object_files(spark, tmp_path):
    flat = {"operations": [{"id": "1_1", "name": "x", "props": {"a": "b"}}], "states": [{"state_id": "1_1_1", "state_data": {"name": "s"}}]}
    (tmp_path / "o.json").write_text(json.dumps(flat))
    assert [r.id for r in config_files.read_flat_objects(spark, str(tmp_path), "operations").collect()] == ["1_1"]
    assert config_files.read_flat_objects(spark, str(tmp_path), "signals").count() == 0
    assert config_files.read_flat_objects(spark, str(tmp_path / "none"), "states").count() == 0
    nested = tmp_path / "nested"
    nested.mkdir()
    (nested / "n.json").write_text('{"1": {"name": "t", "modes": {"1": {}}}}')
    tables = flatten_config(config_files.read_object_configs(spark, str(nested)))
    writers.write_config(tables.public(), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "operations")).first().name == "Операция 1"


def test_geometry_round_trip(spark, tmp_path):
    contours = spark.createDataFrame(
        [("d", 0, 0, "TANK1", 1.0, 2.0), ("d", 0, 1, None, None, None), ("d", 1, 0, "TANK2", 3.0, 4.0), ("e", 0, 0, "TANK1", 5.0, 6.0)],
        "doc_id string, page int, contour_id bigint, name string, name_x double, name_y double",
    ).selectExpr("*", "0.0D min_x", "0.0625D min_y", "9.0D max_x", "9.0D max_y", "4.5D cx", "4.5D cy")
    edges = spark.createDataFrame(
        [(d, g, c, s, p, 3) for d, g in (("d", 0), ("d", 1), ("e", 0)) for c in (0, 1) for p, s in enumerate((7, 9, 8))],
        "doc_id string, page int, contour_id bigint, seg_id bigint, pos bigint, n_edges bigint",
    )
    segments = spark.createDataFrame([("d", 0, 7, 0.0, 0.0, 1.0, 1.0, True)], "doc_id string, page int, seg_id bigint, x1 double, y1 double, x2 double, y2 double, dashed boolean")
    writers.write_geometry(segments, contours, edges, str(tmp_path / "g"))
    back = drawings.read_geometry_xml(spark, str(tmp_path / "g" / "contours")).collect()
    assert sorted((r.doc_id, r.page, r.contour_id, r.name, r.min_y, r.name_x, r.seg_ids) for r in back) == [
        ("d", 0, 0, "TANK1", 0.062, 1.0, [7, 9, 8]), ("d", 1, 0, "TANK2", 0.062, 3.0, [7, 9, 8]), ("e", 0, 0, "TANK1", 0.062, 5.0, [7, 9, 8]),
    ]


def test_matched_device_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            ("d", "TANK1", 0, 1, "TANK1V1", "V1", 1.5, 2.0, 1.0, "V", 'a "b" <c>', "A-1", None, None, {"dtype": "3"}),
            ("e", "TANK1", 0, 1, "TANK1V1", "V1", 1.5, 2.0, 1.0, "V", "x", "A-1", None, None, {"other": "4"}),
        ],
        "doc_id string, tech_object string, contour_id int, text_id int, lua_name string, pdf_name string, x double, y double, confidence double,"
        " device_type string, descr string, article string, type string, category string, extra map<string,string>",
    )
    first = spark.createDataFrame([("d", "TANK1")], "doc_id string, tech_object string").selectExpr(
        "*", "0.0D min_x", "1.0D min_y", "2.0D max_x", "3.0D max_y", "1.0D cx", "2.0D cy"
    )
    writers.write_matched(rows, first, str(tmp_path / "m"))
    folder = str(tmp_path / "m")
    assert {(r.doc_id, *r.extra.items()) for r in drawings.read_matched_devices(spark, folder).collect()} == {("d", ("dtype", "3")), ("e", ("other", "4"))}
    device = drawings.read_matched_devices(spark, folder).where("doc_id = 'd'").first()
    assert (device.lua_name, device.x, device.descr, device.extra) == ("TANK1V1", 1.5, 'a "b" <c>', {"dtype": "3"})
    contour = drawings.read_matched_contours(spark, folder).first()
    assert (contour.doc_id, contour.tech_object, contour.max_y, contour.cx) == ("d", "TANK1", 3.0, 1.0)


def test_bad_devices_are_skipped(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<PlantGeometry><TechnologicalObjects><TechnologicalObject name="T"><Contour bounds="1,2,x,4" center="1,2"/><Devices>'
        '<Device lua_name="TV1" x="1" y="2" confidence="1.00" foo="9"/><Device lua_name="TV2" x="q" y="2"/><Device lua_name="TV3"/>'
        "</Devices></TechnologicalObject></TechnologicalObjects></PlantGeometry>"
    )
    rows = drawings.read_matched_devices(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.lua_name, r.x, r.extra) for r in rows] == [("TV1", 1.0, {"foo": "9"}), ("TV3", 0.0, {})]
    assert drawings.read_matched_contours(spark, str(tmp_path)).count() == 0


def test_annotations(spark, tmp_path):
    out = tmp_path / "out"
    tmp_path = tmp_path / "src"
    tmp_path.mkdir()
    (tmp_path / "img1.xml").write_text(
        '<annotation verified="yes"><size><width>10</width><height>20</height></size><object><name>valve</name><difficult>1</difficult>'
        "<bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"
    )
    boxes = annotations.read_boxes(spark, str(tmp_path))
    images = annotations.read_image_sizes(spark, str(tmp_path))
    want = ("img1", 0, "valve", 1, 2, 3, 4, True)
    assert tuple(boxes.first()) == want and tuple(images.first()) == ("img1", 10, 20, True)
    more = images.union(spark.createDataFrame([("bare", 5, 6, True)], images.schema))
    writers.write_annotations(boxes, more, str(out))
    assert [tuple(r) for r in annotations.read_boxes(spark, str(out)).collect()] == [want]
    assert {tuple(r) for r in annotations.read_image_sizes(spark, str(out)).collect()} == {("img1", 10, 20, True), ("bare", 5, 6, True)}
    for name in ("b10.PNG", "b9.png", "x.txt"):
        (tmp_path / name).write_text("x")
    listed = [r.path.rsplit("/", 1)[1] for r in annotations.list_images(spark, str(tmp_path)).collect()]
    assert listed == ["b9.png", "b10.PNG"]
    assert annotations.list_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "classes.lst").write_text("valve\n pump \n")
    got = annotations.read_classes(spark, str(tmp_path / "classes.lst")).orderBy("ord")
    assert [r.label for r in got.collect()] == ["valve", "pump"]


def test_text_file(spark, tmp_path):
    spans = spark.createDataFrame([("d", 0, 1, " V1 "), ("d", 0, 2, "  ")], "doc_id string, page int, text_id int, text string").selectExpr(
        "*", "struct(0.0D as x1, 0.0D as y1, 1.0D as x2, 2.0D as y2) as bbox"
    )
    texts = drawings.text_elements(spans)
    writers.write_texts(texts, str(tmp_path / "t"))
    back = spark.read.format("xml").option("rowTag", "Text").load(str(tmp_path / "t")).select("_content", "_y", F.col("BBox._y2"))
    assert [tuple(r) for r in back.collect()] == [("V1", 1.0, 2.0)]


def test_matched_devices_by_element(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<?xml version="1.0"?>\n<PlantGeometry><TechnologicalObjects><!-- <TechnologicalObject name="no"><Devices><Device lua_name="N"/></Devices> -->\n'
        '<TechnologicalObject name="empty"/><TechnologicalObject name="T&amp;1" note="a > b"><Devices><Device lua_name="V1" size="01" x="1"/>\n'
        '<!-- <Device lua_name="C"/> --><Device lua_name="V2"><![CDATA[<Device lua_name="D"/>]]></Device></Devices></TechnologicalObject>'
        '<TechnologicalObject name=""><Devices><Device lua_name="V3"/></Devices></TechnologicalObject></TechnologicalObjects></PlantGeometry>'
    )
    rows = drawings.read_matched_devices(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.doc_id, r.tech_object, r.lua_name, r.x, r.extra) for r in rows] == [("x", "T&1", "V1", 1.0, {"size": "01"}), ("x", "T&1", "V2", 0.0, {})]


def test_open_attributes_are_written_without_a_list(spark, tmp_path):
    extra = {"z": "1", "a": '<"&>', "bad name": "2", "lua_name": "x", "ü": "3", "none": None}
    rows = spark.createDataFrame(
        [("d", "T", 0, i, f"TV{i}", f"V{i}", 1.0, 2.0, 1.0, "V", None, "", None, None, extra if i else {}) for i in range(2)],
        "doc_id string, tech_object string, contour_id int, text_id int, lua_name string, pdf_name string, x double, y double, confidence double,"
        " device_type string, descr string, article string, type string, category string, extra map<string,string>",
    )
    none = spark.createDataFrame([], "doc_id string, tech_object string, min_x double, min_y double, max_x double, max_y double, cx double, cy double")
    found = writers.matched_rows(rows, none)
    fixed = {"_device_type": "V", "_x": "1.000", "_y": "2.000", "_confidence": "1.00", "_article": ""}
    got = [r.Devices.Device[0] for r in found.collect()]
    own = {"TV0": {}, "TV1": {"_a": '<"&>', "_z": "1", "_ü": "3"}}
    assert sorted(got, key=len) == [{**fixed, "_lua_name": n, "_pdf_name": n[1:], **own[n]} for n in ("TV0", "TV1")]
    writers.write_matched(rows, none, str(tmp_path / "m"))
    back = drawings.read_matched_devices(spark, str(tmp_path / "m")).collect()
    assert {r.lua_name: r.extra for r in back} == {"TV0": {}, "TV1": {"a": '<"&>', "z": "1", "ü": "3"}}


def test_annotation_texts(spark):
    box = "<object><name>a &lt; b</name><bndbox><xmin>{}</xmin><ymin>2</ymin><xmax>3</xmax>{}</bndbox></object>"
    whole = "<annotation><size><width>8</width><height>9</height></size>" + box.format(1, "<ymax> 4</ymax>") + box.format("x", "<ymax>4</ymax>") + box.format(1, "") + "</annotation>"
    rows = [("whole", whole), ("cut", whole[:-5]), ("text", "no element"), ("none", None), ("blank", " "), ("bare", "<annotation/>"), ("whole", whole)]
    texts = spark.createDataFrame([(*r, 1, 2) for r in rows], "image_id string, body string, broken int, size int")
    assert [tuple(r) for r in annotations.boxes_of_texts(texts).collect()] == [("whole", 0, "a < b", 1, 2, 3, 4, None)] * 2
    assert sorted((r.image_id, r.width) for r in annotations.sizes_of_texts(texts.where("image_id != 'bare'")).collect()) == [("whole", 8)] * 2
    rejects = sorted(map(tuple, annotations.rejects_of_texts(texts).collect()), key=repr)
    assert rejects == sorted([(i, None, "broken") for i in ("cut", "text", "none", "blank")] + [("whole", 1, "unreadable"), ("whole", 2, "missing")] * 2, key=repr)
    assert annotations.boxes_of_texts(texts.limit(0)).count() == 0 == annotations.rejects_of_texts(texts.limit(0)).count()
