import random

from sheetloom.operators import fuzzy, naming


def serial(pairs):
    named, taken = {}, set()
    for _, contour, _, text in sorted((p[4], p[2], p[5], p[3]) for p in pairs):
        if contour not in named and text not in taken:
            named[contour] = text
            taken.add(text)
    return named


def test_rounds_match_the_serial_order(spark):
    rng = random.Random(11)
    pairs = []
    for c in range(60):
        area = float(rng.randint(1, 8))
        for t in rng.sample(range(40), rng.randint(0, 12)):
            pairs.append(("d", 0, c, t, area, float(rng.randint(0, 5))))
    df = spark.createDataFrame(pairs, "doc_id string, page int, contour_id int, text_id int, area double, score double")
    assert {r.contour_id: r.text_id for r in naming.assign_texts(df).collect()} == serial(pairs)


def test_contours_that_wait_for_each_other(spark):
    # Each contour prefers the text that the one before it must take.
    length = 40
    pairs = [("d", p, c, t, float(c), float(t - c)) for p in (0, 1) for c in range(length) for t in (c - 1, c) if t >= 0]
    df = spark.createDataFrame(pairs, "doc_id string, page int, contour_id int, text_id int, area double, score double").coalesce(1)
    got = naming.assign_texts(df).collect()
    assert sorted((r.page, r.contour_id, r.text_id) for r in got) == [(p, c, c) for p in (0, 1) for c in range(length)]


def test_final_names(spark):
    objects = spark.createDataFrame(
        [("d", 0, "TANK", "BC1"), ("d", 1, "M", "BC2"), ("d", 2, None, "Pump"), ("d", 3, "TANK7", "x"), ("d", 4, "P9", "TANK")],
        "doc_id string, obj_ord int, name_eplan string, name_BC string",
    )
    texts = [("d", i, t) for i, t in enumerate(["=A+TANK3", "=A+M4", "=A+PUMP", "=A+TANK7", "=A+Q1", "=A+MX", "plain"])]
    found = naming.configured_names(
        naming.name_candidates(spark.createDataFrame(texts, "doc_id string, text_id int, text string")),
        naming.name_dictionary(objects),
    )
    got = {r.candidate: (r.configured, r.final_name) for r in found.collect()}
    assert got == {
        "TANK3": (True, "TANK3"), "M4": (True, "M4"), "PUMP": (True, None), "TANK7": (True, "TANK7"), "Q1": (False, "Q1"), "MX": (False, "MX"),
    }


def score(a, b):
    a, b = a.upper(), b.upper()
    if not a or not b:
        return 0
    if a == b:
        return 1
    if a in b:
        return len(a) / len(b)
    if b in a:
        return len(b) / len(a)
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    return same / max(len(a), len(b))


def test_similar_names_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("AaBc") for _ in range(rng.randint(1, 9)))
    left, right = sorted({word() for _ in range(150)}), sorted({word() for _ in range(120)})
    lt = spark.createDataFrame([("d", w) for w in left], "doc_id string, a string")
    rt = spark.createDataFrame([("d", w) for w in right], "doc_id string, b string")
    want = {}
    for a in left:
        best = min(((-score(a, b), b) for b in right if score(a, b) > 0.6), default=None)
        if best:
            want[a] = (best[1], round(-best[0], 9))
    got = {r.a: (r.b, round(r.score, 9)) for r in fuzzy.best_similar(lt, rt, "a", "b").collect()}
    assert got == want
