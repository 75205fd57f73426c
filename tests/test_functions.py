import math
import random

import pytest
from pyspark.sql import functions as F

from sheetloom.functions import names, numbers, shapes, svg
from sheetloom.sources.config_files import decode_text


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_device_names(spark):
    given = ["TANK1V1", "tank1v1", "V1", "FQT1", "", "tank1fqt12"]
    n = F.col("n")
    assert values(spark, given, "n string", names.device_object(n)) == ["TANK1", None, None, "F", None, None]
    assert values(spark, given[:1] + given[3:4], "n string", names.device_short_name(n)) == ["V1", "QT1"]
    assert values(spark, given, "n string", names.device_type(n)) == ["V", "V", "V", "FQT", None, "FQT"]


def test_labels(spark):
    t = F.col("t")
    given = ["V1", "v3", "V1A", "V-1", "VALVE NUMBER 1", "М1"]
    assert values(spark, given, "t string", names.is_label(t)) == [True, True, True, False, False, False]
    assert values(spark, ["V1A", "lt_12", "abc"], "t string", names.label_name(t)) == ["V1", "LT12", "abc"]


def test_contour_names(spark):
    t = F.col("t")
    given = ["=A+TANK1:", "=A+TANK1+M2", "=A+==", "TANK1"]
    assert values(spark, given, "t string", names.contour_candidate(t)) == ["TANK1", "TANK1", None, None]
    assert values(spark, given[:2] + ["TANK3", " "], "t string", names.contour_object(t)) == ["TANK1:", "M2", "TANK3", None]


def test_similarity(spark):
    pairs = [("TANK1", "tank1"), ("TANK1", "TANK10"), ("PUMP12", "PUMP34"), ("A", "B"), ("", "A")]
    got = values(spark, pairs, "a string, b string", names.similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([1.0, 5 / 6, 4 / 6, 0.0, 0.0])


def test_dash_patterns(spark):
    given = ["[3 3] 0", "[] 0", "", None, "3 3", "[ ] 0"]
    assert values(spark, given, "d string", shapes.is_dashed(F.col("d"))) == [True, False, False, False, False, False]


def test_fixed3_rounds_like_ieee(spark):
    rng = random.Random(1)
    given = [0.0625, 0.1875, -0.0625, 1.0005, 2.5, -0.0001, 0.0, 1e-9, 123456789.0125, 1e15 + 0.5]
    given += [rng.uniform(-1e4, 1e4) for _ in range(500)] + [rng.randrange(10**6) / 16 for _ in range(200)]
    given += [round(rng.uniform(0, 100), 4) for _ in range(500)]
    got = values(spark, given, "v double", numbers.fixed3(F.col("v")))
    assert got == [f"{v:.3f}" for v in given]
    assert values(spark, [(None,), (1.0,)], "v double", numbers.fixed3(F.col("v"))) == [None, "1.000"]


def test_float_text(spark):
    given = [1.0, 0.5, 0.001, 0.00025, 1e-5, 12345678.5, 1.5e16, 1e22, 123.456, -2.5e-7]
    assert values(spark, given, "v double", numbers.float_text(F.col("v"))) == [str(v) for v in given]


def test_number_reading(spark):
    given = ["1.5", " 2 ", "abc", "1d", "3e2", None, ""]
    assert values(spark, given, "v string", numbers.number_or(F.col("v"), 1.0)) == [1.5, 2.0, 1.0, 1.0, 300.0, 1.0, 1.0]


def test_distance(spark):
    cases = [(0, 5, -1, 0, 1, 0), (5, 0, 0, 0, 1, 0), (3, 4, 0, 0, 0, 0), (-3, 4, 0, 0, 1, 0)]
    rows = [tuple(float(v) for v in c) for c in cases]
    cols = ["x", "y", "x1", "y1", "x2", "y2"]
    got = values(spark, rows, ", ".join(f"{c} double" for c in cols), shapes.distance_to_segment(*map(F.col, cols)))
    assert got == pytest.approx([5, 4, 5, 5])


def test_snap_rounds_half_even(spark):
    given = [0.25, 0.75, -0.2, 1.0]
    assert values(spark, given, "v double", shapes.snap(F.col("v"))) == [round(v / 0.5) for v in given]


def test_svg_rescaling(spark):
    row = {
        "d": "M 1,2.5 L -3 4Z", "points": "1,2 x,3", "transform": "translate(1,2) rotate(3) translate(1)",
        "width": "100%", "x": "8", "other": "8",
    }
    df = spark.createDataFrame([("path", row), ("polyline", row)], "tag string, attrs map<string,string>")
    path, line = [r[0] for r in df.select(svg.rescale_attributes(F.col("tag"), F.col("attrs"))).collect()]
    assert path["d"] == "M 1.250,3.125 L -3.750 5.000Z" and line["d"] == row["d"]
    assert line["points"] == "1.250,2.500 x,3" and path["points"] == row["points"]
    assert path["transform"] == "translate(1.250,2.500) rotate(3) translate(1)"
    assert (path["width"], path["x"], path["other"]) == ("100%", "10.0", "8")


def test_encodings(spark):
    given = ["Нет".encode(), bytes.fromhex("CDE5F2"), bytes([0xCD, 0x41, 0x98])]
    text, encoding = decode_text(F.col("c"))
    got = values(spark, [(bytearray(g),) for g in given], "c binary", F.struct(text, encoding))
    assert [tuple(g) for g in got] == [("Нет", "utf-8"), ("Нет", "cp1251"), ("ÍA\x98", "latin-1")]


def test_length(spark):
    got = values(spark, [(0.0, 0.0, 3.0, 4.0)], "a double, b double, c double, d double", shapes.segment_length(*map(F.col, "abcd")))
    assert math.isclose(got[0], 5)


def test_paths_by_grammar(spark):
    paths = {
        "M1e1,2": "M12.500,2.500",
        "m.5.5-1+2": "m0.625 0.625-1.250 2.500",
        "M0 0A4 8 30 1 0 12 16Z": "M0.000 0.000A5.000 10.000 30 1 0 15.000 20.000Z",
        "a4,8,30,018,4-4": "a5.000,10.000,30,0110.000,5.000-4",
        "a4 8 0 0 1 .8.8 4 8 0 1 1 8-4": "a5.000 10.000 0 0 1 1.000 1.000 5.000 10.000 0 1 1 10.000-5.000",
        "a1 2 3": "a1 2 3",
        "7 M1": "7 M1.250",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(i, d) for i, d in enumerate(paths)], "i int, d string")
    got = df.select("i", svg.rescale_path_by_grammar(F.col("d"))).orderBy("i").collect()
    assert [r[1] for r in got] == list(paths.values())
