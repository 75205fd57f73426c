"""Steps that must not be done twice, or in a form that spills, whatever the size of the tables."""

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import numbers, svg
from sheetloom.operators import browse, config, grid, loops, walk
from sheetloom.plans import catalog, views
from sheetloom.sources import drawings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounded_numbers_of_an_array(spark):
    given = [0.0, -0.0, 0.0005, 0.0015, 2.0005, -1.2345, 1e-9, -1e-9, 999.9995, 8796093022207.9995, 8796093022208.5, -1e20, None]
    df = spark.createDataFrame([(given,)], "v array<double>")
    got = df.select(numbers.all_fixed3(F.col("v"))).first()[0]
    assert got == [None if v is None else f"{v:.3f}" for v in given]
    # The rounded number is a variable, and no pattern is searched in its text.
    assert "regexp_replace" not in plan(df.select(numbers.fixed3(F.col("v")[1])))


def test_matched_devices_read_each_tag_once(spark):
    body = "<P><TechnologicalObject name=\"A\"><Device lua_name='V1' x=\"1\" note=\"a &amp;amp; b > c\"/><Device x=\"bad\"/></TechnologicalObject></P>"
    files = spark.createDataFrame([(1, body), (2, None)], "doc_id long, body string")
    rows = drawings.devices_of_elements(drawings.element_texts(files))
    assert [(r.tech_object, r.ord, r.lua_name, r.x, r.extra) for r in rows.collect()] == [("A", 0, "V1", 1.0, {"note": "a &amp; b > c"})]
    steps = plan(rows).split("\n")
    # No predicate carries a copy of a search.
    assert not [s for s in steps if "Filter" in s.split("(")[0] and "regexp" in s]


def test_paths_are_cut_without_compiling_patterns(spark):
    given = [("M1.5.5 L2-3",), ("M1\u0001 2",), ("a1 2 30 0110 20a1,1 0 1,1 5 5",), ("1 2",), ("",), (None,)]
    df = spark.createDataFrame(given, "d string")
    got = [tuple(r) for r in df.select(svg.rescale_path_by_grammar(F.col("d")), svg.rescale_path(F.col("d"))).collect()]
    assert got == [
        ("M1.875 0.625 L2.500-3.750", "M1.875.6.250 L2.500-3.750"),
        ("M1.250\u0001 2.500", "M1.250\u0001 2.500"),
        ("a1.250 2.500 30 0112.500 25.000a1.250,1.250 0 1,1 6.250 6.250", "a1.250 2.500 37.500 137.500 25.000a1.250,1.250 0.000 1.250,1.250 6.250 6.250"),
        ("1 2", "1.250 2.500"),
        ("", ""),
        (None, None),
    ]
    assert "else split" in plan(df.select(svg.rescale_path(F.col("d")))).lower() or "ELSE split" in plan(df.select(svg.rescale_path(F.col("d"))))


SEGMENT = "doc_id long, page int, seg_id long, x1 double, y1 double, x2 double, y2 double, dashed boolean"


def ring(doc, first, corners):
    ends = [*corners, corners[0]]
    return [(doc, 0, first + i, *map(float, ends[i]), *map(float, ends[i + 1]), True) for i in range(len(corners))]


def test_small_loops_need_no_round(spark, monkeypatch):
    rows = [s for n in range(40) for s in ring(n % 3, n * 10, [(n * 50, 0), (n * 50, 20), (n * 50 + 20, 20), (n * 50 + 20, 0)])]
    # A segment without a document is in no loop; an open chain and a loop of two segments are none.
    rows += [(None, *s[1:]) for s in ring(0, 900, [(0, 900), (0, 920), (20, 900)])]
    rows += ring(1, 700, [(0, 700), (0, 720), (20, 700), (20, 720)])[:3] + ring(2, 800, [(0, 800), (0, 820)])
    df = spark.createDataFrame(rows, SEGMENT).repartition(3)
    want = {(n % 3, n * 10 + i, i) for n in range(40) for i in range(4)}
    read = lambda: {(r.doc_id, r.seg_id, r.pos) for r in loops.closed_loops(df, by_place=True).collect() if r.n_edges == 4}
    assert read() == want
    # Loops cut by the ends of batches give the same.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert read() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rounds = []
    monkeypatch.setattr(loops, "_cycles", lambda links, keys: rounds.append(links.count()) or links.selectExpr(*keys, "at", "next", *[f"0L as {c}" for c in ("end", "steps", "length")]).where("false"))
    assert read() == want
    # Only the open chain is left for the rounds.
    assert sum(rounds) <= 4


def test_boxes_travel_to_four_cells_at_most(spark):
    boxes = spark.range(400).selectExpr("0 as k", "id * 7.3 as x1", "id * 3.1 as y1", "id * 7.3 + 1 + id % 40 as x2", "id * 3.1 + 30 as y2")
    axes = (("x1", "x2"), ("y1", "y2"))
    most = grid._box_cells(boxes, axes, 5.0, wider=1).groupBy("x1", "y1").count().agg(F.max("count")).first()[0]
    assert most <= 4
    points = spark.range(300).selectExpr("0 as k", "id as pid", "id * 9.7 as x", "id * 4.1 as y")
    hit = grid.points_hit(points, boxes.union(boxes), ["k"], ["pid"], tol=5.0)
    near = "x between x1 - 5 and x2 + 5 and y between y1 - 5 and y2 + 5"
    want = points.join(boxes.drop("k"), F.expr(near)).select("pid").distinct()
    assert sorted(hit.collect()) == sorted(want.collect())


STATE = '{"opened_devices":["V%d",{"a":"LS2","b":5},7],"closed_devices":{"x":"V9"},"devices_data":[{"devices":["TE%d",1]},5],"steps":{"1":{"opened_devices":["M1","V%d"],"closed_devices":{"DO3":1}},"x":3}}'


def test_first_devices_in_two_passes(spark):
    state = STATE % (1, 2, 3)
    body = '{"1":{"name":"A","equipment":{"a":"LT1","b":"Нет","c":2},"modes":{"1":{"states":{"1":%s}},"2":{"name":"Fill","states":{"1":%s,"2":4}}}},"2":{"name":"B","equipment":{"a":"QT1"}}}'
    rows = [(1, 2, body % (state, STATE % (4, 5, 6))), (1, 1, body.replace('"A"', '"C"') % (STATE % (4, 2, 7), state)), (1, None, body.replace('"A"', '"D"') % (STATE % (8, 8, 8), STATE % (8, 8, 8))), (None, 3, body % (state, state)), (2, 1, None)]
    texts = spark.createDataFrame(rows, "doc_id long, part long, body string")
    mentions = config.device_mentions(config.read_objects(texts, config.LEVELS["mentions"]))
    want = sorted(map(str, config.first_mentions(mentions).collect()))
    tables = config.flatten_config(texts)
    assert sorted(map(str, tables.devices_in_two_passes.collect())) == want and len(want) > 20
    assert sorted(map(str, tables.device_names.collect())) == sorted(map(str, mentions.select("doc_id", "name").distinct().collect()))
    # The pass over all mentions aggregates by hash: no place is sorted.
    ends = config.device_names(config.read_objects(texts)).groupBy("doc_id", "name").agg(F.min("obj_ord.part"))
    assert "SortAggregate" not in ends._jdf.queryExecution().executedPlan().toString()
    by_table = browse.operations_of_matches(tables.device_names.withColumnRenamed("name", "lua_name"), tables.states, tables.steps)
    nested = browse.uses_of_matches(tables.device_names.withColumnRenamed("name", "lua_name"), browse.nested_usage(tables.states_in_use))
    assert sorted(map(str, by_table.collect())) == sorted(map(str, nested.collect()))


def odd_texts():
    """Texts that are walked through, and texts that the column functions must read."""
    plain = '{"%s":{"name":"A","equipment":{"a":"LT1","b":"Нет","c":2,"d":" "},"par_float":{"1":{},"2":5},"modes":{"1":{"states":{"1":%s}},"2":{"name":"Fill","states":{"1":%s,"2":4}}}},"skip":1}'
    own = lambda n, *more: plain % (n, STATE % (n, 2, 1), STATE % (1, n, n)) + "".join(more)
    signals = own(7).replace('"devices_data"', '"DI_DO":[[["DI1","я2",3],["S3"]],["S9"],[]],"devices_data"')
    walked = [(1, 1, own(1)), (1, 2, own(2)), (1, None, signals), (None, 5, own(5)), (2, 6, "[1]"), (2, 7, None), (2, 8, own(8).replace('"V8"', '"V8",true,null,{"b":[1,{}],"a":"V1"}'))]
    # Owners that come twice, in two texts and in one.
    twice = [(3, 1, own(1)), (3, 2, own(1)), (4, 1, '{"1":{"modes":{"2_3":{"states":{"4":%s}},"2":{"states":{"3":{"steps":{"4":{"opened_devices":["V1"]}}}}}}}}' % (STATE % (1, 1, 1)))]
    left = [
        own(1).replace('"V1"', '"V1","V1\\ud800"'), own(1).replace('"b":5', '"b":5.0'), own(1).replace('"b":5', '"b":"\\n"'), own(1).replace('"b":5', '"b":1234567890123456789'), own(1, "x"),
        own(1).replace('"steps":{', '"steps":{"1":{"closed_devices":["V4"]},'), own(1).replace('"skip":1', '"2":"{\\"modes\\":{\\"1\\":{\\"states\\":{\\"1\\":{\\"closed_devices\\":[\\"V5\\"]}}}}}"'), own(1).replace('"c":2', "'c':'V6'"), "{",
    ]
    return walked + twice, [(10 + i, i, body) for i, body in enumerate(left)]


def read_by_columns(monkeypatch):
    """Numbers of texts that go through the column functions."""
    seen, read = [], config.read_objects
    monkeypatch.setattr(config, "read_objects", lambda texts, *level: seen.append(texts.count()) or read(texts, *level))
    return seen


def test_uses_are_counted_in_one_walk(spark, monkeypatch):
    walked, left = odd_texts()
    texts = spark.createDataFrame(walked + left, "doc_id long, part long, body string").repartition(3)
    t = config.flatten_config(texts)
    want = browse.uses_of_matches(t.device_names.withColumnRenamed("name", "lua_name"), browse.nested_usage(t.states_in_use)).collect()
    assert {r.doc_id for r in want} == {None, 1, 2, 3, 4, *range(10, 14), *range(15, 18)}
    monkeypatch.setattr(views, "config", lambda *_: texts)
    assert sorted(map(str, catalog.QUERIES["device_operation_use"](spark, "").collect())) == sorted(map(str, want))
    assert [r.part for r in config.CountedConfig(texts, used=True)._left.orderBy("part").collect()] == [i for _, i, _ in left]
    # Texts that are walked through are not read by the column functions as well.
    seen = read_by_columns(monkeypatch)
    monkeypatch.setattr(views, "config", lambda *_: texts.where("doc_id < 3 or doc_id is null"))
    assert sorted(map(str, catalog.QUERIES["device_operation_use"](spark, "").collect())) == sorted(str(r) for r in want if r.doc_id is None or r.doc_id < 3)
    assert sum(seen) == 0


def test_long_and_deep_texts_keep_their_limits():
    read = lambda body: walk._walked(body.encode(), True)
    for body in ('{"1":%s}' % ("[" * 950 + "]" * 950), '{"%s":1}' % ("k" * 50_001), "﻿{}", '{"1":NaN}', '{"1":%s}' % ("1" * 19), '{"1":0.%s}' % ("1" * 1001)):
        with pytest.raises(walk._Odd):
            read(body)
    with pytest.raises(walk._Odd):
        walk._walked(b'{"1":"\xff"}', True)
    # Brackets of strings are no levels.
    assert read('{"1":{"x":["%s"],"y":[%s]}}' % ("[" * 2000, ",".join(["[]"] * 2000))).roots == ["1"]


def test_entities_are_summed_up_in_one_walk(spark, monkeypatch):
    walked, left = odd_texts()
    texts = spark.createDataFrame(walked + left, "doc_id long, part long, body string").repartition(3)
    t = config.flatten_config(texts)
    want = {
        **{n: getattr(t, n).count() for n in ("tech_objects", "operations", "states", "steps", "parameters", "signals")},
        "devices": t.device_names.count(),
    }
    assert want["signals"] == 2
    monkeypatch.setattr(views, "config", lambda *_: texts)
    got = {r.entity: (r.n, r["sample"]) for r in catalog.QUERIES["entity_summary"](spark, "").collect()}
    assert {e: n for e, (n, _) in got.items()} == want
    # The first text is that without a document, whose second mode has no name and whose steps come in their order.
    assert got["tech_objects"][1] == "5;-;-;A;-;-;-;-" and got["devices"][1] is None
    assert got["states"][1] == '5_1_1;Состояние 1;5_1;Операция 1;A;V5|{"a":"LS2","b":5}|7;;'
    assert got["steps"][1] == "5_1_1_1;Шаг 1;5_1_1;Состояние 1;Операция 1;-;-;M1|V1;"
    # The column functions read the texts of the first rows only, and those that are left.
    seen = read_by_columns(monkeypatch)
    monkeypatch.setattr(views, "config", lambda *_: texts.where("doc_id < 3 or doc_id is null"))
    catalog.QUERIES["entity_summary"](spark, "").collect()
    assert max(seen) == 1
    monkeypatch.setattr(views, "config", lambda *_: texts.where("false"))
    assert {(r.n, r["sample"]) for r in catalog.QUERIES["entity_summary"](spark, "").collect()} == {(0, None)}
