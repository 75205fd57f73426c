import random

from pyspark.sql import functions as F

from sheetloom.operators import loops
from sheetloom.operators.grid import points_hit, range_pairs
from sheetloom.operators.ordinals import number_within

SEGMENT = "doc_id string, page int, seg_id bigint, x1 double, y1 double, x2 double, y2 double, dashed boolean"


def polygon(doc, first, corners, dashed=True, jitter=0.0):
    ends = list(zip(corners, corners[1:] + corners[:1], strict=True))
    return [(doc, 0, first + i, a[0], a[1], b[0] + jitter, b[1], dashed) for i, (a, b) in enumerate(ends)]


def square(x, y, side):
    return [(x, y), (x, y + side), (x + side, y + side), (x + side, y)]


def found(spark, rows, strict=True):
    segments = spark.createDataFrame(rows, SEGMENT)
    edges = loops.contour_edges(loops.closed_loops(segments, strict=strict), segments)
    by_contour = {}
    for r in edges.orderBy("pos").collect():
        by_contour.setdefault((r.doc_id, r.contour_id, r.ambiguous), []).append(r.seg_id)
    return by_contour


def fixture():
    chain = [("d", 0, 10 + i, 300.0 + 10 * i, 0.0, 310.0 + 10 * i, 0.0, True) for i in range(3)]
    spur = [("d", 0, 17, 450.0, 50.0, 470.0, 50.0, True), ("d", 0, 18, 470.0, 50.0, 480.0, 50.0, True)]
    return (
        polygon("d", 0, square(0.0, 0.0, 100.0), jitter=0.1)
        + [("d", 0, 4, 150.0, 0.0, 150.0, 50.0, True), ("d", 0, 5, 150.0, 0.0, 150.0, 50.0, True)]
        + polygon("d", 6, square(200.0, 0.0, 50.0), dashed=False)
        + chain
        + polygon("d", 13, square(400.0, 0.0, 50.0))
        + spur
        + [("d", 0, 19, 5.0, 5.0, 5.1, 5.0, True)]
    )


def test_pure_loops_only(spark):
    assert found(spark, fixture()) == {("d", 0, False): [0, 1, 2, 3]}


def test_spurs_are_stripped(spark):
    assert found(spark, fixture(), strict=False) == {("d", 0, False): [0, 1, 2, 3], ("d", 1, True): [13, 14, 15, 16]}


def test_branched_spurs_and_junctions(spark):
    tree = [(450.0, 50.0, 470.0, 50.0), (470.0, 50.0, 480.0, 60.0), (470.0, 50.0, 480.0, 40.0), (480.0, 40.0, 490.0, 40.0)]
    rows = polygon("d", 0, square(400.0, 0.0, 50.0)) + [("d", 0, 10 + i, *t, True) for i, t in enumerate(tree)]
    # Two squares that share a corner have a junction and give no loop.
    rows += polygon("e", 0, square(0.0, 0.0, 10.0)) + polygon("e", 4, square(10.0, 10.0, 10.0))
    # A segment without length at a corner is dropped.
    rows += polygon("f", 0, square(0.0, 0.0, 10.0)) + [("f", 0, 9, 0.0, 0.0, 0.1, 0.0, True)]
    assert found(spark, rows, strict=False) == {("d", 0, True): [0, 1, 2, 3], ("f", 0, True): [0, 1, 2, 3]}


def test_random_loops_match_union_find(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in ("a", "b"):
        ids = list(range(2000))
        rng.shuffle(ids)
        loops_of = []
        for k in range(25):
            n, x, y = rng.randint(3, 45), 1000.0 * k, 0.0
            corners = [(x + 2.0 * i, y + (0.0 if i in (0, n - 1) else 10.0 + i % 3)) for i in range(n)]
            ends = list(zip(corners, corners[1:] + corners[:1], strict=True))
            if k % 5 == 0:
                ends = ends[:-1]
            mine = [ids.pop() for _ in ends]
            for seg, (p, q) in zip(mine, ends, strict=True):
                if rng.random() < 0.5:
                    p, q = q, p
                rows.append((doc, 0, seg, *p, *q, True))
            if k % 5:
                loops_of.append(sorted(mine))
        for i, mine in enumerate(sorted(loops_of)):
            want[(doc, i, False)] = mine
    rng.shuffle(rows)
    assert {k: sorted(v) for k, v in found(spark, rows).items()} == want


def test_range_pairs_match_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(300)]
    points += [("a", 1000 + i, 0.0, 0.0) for i in range(100)]
    boxes = []
    for i in range(80):
        x, y, side = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0, 0.01, 1, 7, 64, 500])
        boxes.append((rng.choice("ab"), i, x, y, x + side * rng.random(), y + side))
    boxes.append(("a", 99, -5.0, -5.0, -5.0, 5.0))
    p = spark.createDataFrame(points, "k string, pid int, x double, y double")
    b = spark.createDataFrame(boxes, "k string, bid int, x1 double, y1 double, x2 double, y2 double")
    want = {
        (q[1], r[1])
        for q in points
        for r in boxes
        if q[0] == r[0] and r[2] - 5 <= q[2] <= r[4] + 5 and r[3] - 5 <= q[3] <= r[5] + 5
    }
    got = [(r.pid, r.bid) for r in range_pairs(p, b, ["k"], tol=5.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    hit = [r.pid for r in points_hit(p, b, ["k"], ["pid"], tol=5.0).collect()]
    assert sorted(hit) == sorted({q for q, _ in want})


def test_no_nested_loop_join(spark):
    p = spark.range(10).selectExpr("0 as k", "id as pid", "1.0D as x", "1.0D as y")
    b = spark.range(10).selectExpr("0 as k", "id as bid", "0.0D as x1", "0.0D as y1", "2.0D as x2", "2.0D as y2")
    plan = range_pairs(p, b, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_numbers_inside_large_groups(spark):
    df = spark.range(200_000).selectExpr("id % 3 as g", "id * 7 as o")
    got = number_within(df, ["g"], "o", "n")
    check = got.groupBy("g").agg(F.count("*").alias("c"), F.max("n").alias("m"), F.countDistinct("n").alias("d"))
    assert all(r.c == r.m + 1 == r.d for r in check.collect())
    assert got.where("g = 1").orderBy("o").limit(3).agg(F.collect_list("n")).first()[0] == [0, 1, 2]


def test_settled_loops_leave_the_rounds(spark, monkeypatch):
    rows = [r for k in range(60) for r in polygon("d", 4 * k, square(100.0 * k, 0.0, 10.0))]
    ring = [(5.0 * i, 500.0 + (0.0 if i in (0, 99) else 10.0 + i % 3)) for i in range(100)]
    rows += polygon("d", 1000, ring)
    written, write = [], loops.cut_lineage
    monkeypatch.setattr(loops, "cut_lineage", lambda df: written.append(write(df)) or written[-1])
    got = loops.closed_loops(spark.createDataFrame(rows, SEGMENT)).orderBy("loop", "pos").collect()
    assert [(r.loop, r.seg_id, r.pos, r.n_edges) for r in got] == [
        *[(4 * k, 4 * k + i, i, 4) for k in range(60) for i in range(4)], *[(1000, 1000 + i, i, 100) for i in range(100)]
    ]
    # Two ends for each segment; after the third round only those of the long ring are written.
    assert [df.count() for df in written] == [680] * 4 + [200] * 5
