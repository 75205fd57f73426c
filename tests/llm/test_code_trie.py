import hashlib
import math

import numpy as np
import pytest

from sheetloom.llm import code_trie as ct

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """Codes by comparing every part with every entry."""
    kept = []
    for key, vector, label in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [best(cut(v, p), books[p])[1] for _, v, _ in kept]
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), m in zip(kept, mine, strict=True) if m == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    out = []
    for key, v, label in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        out.append((key, bytes(i for _, i in found), sum(d for d, _ in found), label))
    return out, books


def rows_of(n, dim, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, spread, dim)], i % 3 if i % 4 else None) for i in range(n)]


def test_same_codes_as_by_comparing_all(spark):
    rows = rows_of(300, 16, 1)
    rows += [(400, rows[5][1], 7)] * 40 + [(5, rows[9][1], 1), (401, None, 1), (402, [math.nan] * 16, 1), (403, [math.inf] + [0.0] * 15, 1)]
    rows += [(404, [None] + [0.0] * 15, 1), (None, rows[3][1], None), (405, [-0.0] * 16, 2), (406, [1e6] + [0.0] * 15, 2)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "'a' AS code", "1 AS error", "2 AS _k0")
    coded, books = ct.compress(vectors, keep=("label",), parts=4, entries=16)
    want, want_books = plain(rows, 4, 16, 2)
    # 1e6 is beyond the bound.
    got = [(r["vec_id"], bytes(r["code"]), r["error"], r["label"]) for r in coded.collect()]
    clear = lambda found: sorted(((r for r in found if r[0] != 406)), key=repr)
    assert clear(got) == clear(want)
    assert len(got) == len(want) == 300 + 40 + 1 + 1 + 2
    assert books[1:].tolist() == want_books[1:]


def test_depth_first_runs_cover_the_trie():
    rng = np.random.default_rng(3)
    for width, high in ((1, 50), (3, 4), (4, 9), (2, 2)):
        rows = np.unique(rng.integers(-high, high, (700, width)), axis=0)
        entries = rng.integers(-high, high, (5, width))
        want = ((rows[:, None, :] - entries[None]) ** 2).sum(axis=2)
        for leaves in (1, 2, 7, 64, 10_000):
            found = list(ct.trie_distances(rows, entries, leaves))
            assert [low for low, _ in found] == sorted(low for low, _ in found)
            assert max(len(d) for _, d in found) <= leaves
            assert (np.concatenate([d for _, d in found]) == want).all()


def test_few_empty_and_uneven_vectors(spark):
    empty, books = ct.compress(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and books.size == 0
    none, _ = ct.compress(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], SCHEMA), parts=1)
    assert none.collect() == []
    hollow, _ = ct.compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA))
    assert [(bytes(r["code"]), r["error"]) for r in hollow.collect()] == [(bytes(16), 0)] * 2
    few, books = ct.compress(spark.createDataFrame([(1, [0.5, -0.5], 1), (2, [0.25, 0.0, 0.0], 1), (3, [0.5, -0.4], None)], SCHEMA), parts=2)
    assert sorted((r["vec_id"], bytes(r["code"]), r["error"]) for r in few.collect()) == [(1, b"\0\0", 0), (3, b"\0\1", 0)]
    assert books.tolist() == [[[128], [128]], [[-128], [-103]]]
    with pytest.raises(ValueError, match="equal parts"):
        ct.compress(spark.createDataFrame([(1, [0.5] * 3, 1)], SCHEMA), parts=2)


def test_decoded_vectors_are_near(spark):
    rows = rows_of(200, 8, 4)
    coded, books = ct.compress(spark.createDataFrame(rows, SCHEMA), parts=4, entries=32)
    back = {r["vec_id"]: (r["vector"], r["error"]) for r in ct.decode(coded, books).collect()}
    for key, vector, _ in rows:
        got, error = back[key]
        floor = np.floor(256 * np.float32(vector).astype(float))
        assert round(((np.array(got) * 256 - floor) ** 2).sum()) == error


def test_query_digests(spark, tmp_path):
    rows = rows_of(150, 64, 5) + [(900, rows_of(1, 64, 5)[0][1], None)] * 60
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = ct.op12_code_trie(spark, str(tmp_path)).collect()
    want, books = plain(rows, 16, 64, 2)
    by_label = {}
    for _, _, error, label in want:
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert sorted(tuple(r) for r in got) == sorted((k, c.hex(), e, by_label[la], digest) for k, c, e, la in want)
