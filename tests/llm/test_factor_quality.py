import zlib
from itertools import combinations

import numpy as np
import pytest

from sheetloom.llm import factor_quality as fq

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n):
    """Prose, and rows whose words all end in a symbol; every fifth row is of the second kind."""
    rng = np.random.default_rng(7)
    stems = ["the", "of", "rain", "street", "window", "tree", "under", "light", "slow", "morning", "and", "to", "in", "green", "river"]
    rows, labels = [], []
    for i in range(n):
        words = rng.choice(stems, rng.integers(5, 60)).tolist()
        if i % 5 == 0:
            words = [w + "$#%"[j % 3] * 3 for j, w in enumerate(words)]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 5 != 0), 0))
    return rows, labels


def test_pairs_by_sums_of_squares():
    rng = np.random.default_rng(2)
    machine = fq.Machine(0.3, rng.normal(size=40), rng.normal(size=(40, fq.FACTORS)))
    at, value = rng.choice(40, 12, replace=False), rng.normal(size=12)
    pairs = sum(value[i] * value[j] * (machine.factor[at[i]] @ machine.factor[at[j]]) for i, j in combinations(range(12), 2))
    assert machine.raw(at, value) == pytest.approx(0.3 + machine.weight[at] @ value + pairs)


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(4)
    at = [rng.choice(50, 6, replace=False) for _ in range(200)]
    value = [np.full(6, 0.5) for _ in at]
    # Only the pair of features 1 and 2 decides.
    label = np.array([float((1 in a) == (2 in a)) for a in at])
    start = fq.Machine.empty(50, 0.0)
    loss = lambda m: -np.mean([np.log(p if y else 1 - p) for p, y in zip((m.probability(a, v) for a, v in zip(at, value, strict=True)), label, strict=True)])
    after = fq.train_block(start, at, value, label, np.ones(200), 60, 1)
    assert loss(after) < 0.3 * loss(start)


def test_held_out_rows_are_told_apart(spark, make_docs):
    rows, labels = corpus(900)
    docs = make_docs(rows)
    given = spark.createDataFrame(labels, LABELS)
    got = fq.score_documents(docs, given).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 150
    assert sum(r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held) >= 0.98 * len(held)
    again = {r["doc_id"]: r["score"] for r in fq.score_documents(docs.repartition(7), given).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in got)
    # Labels of held-out rows, source and language change nothing.
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 1) for i, q, _ in labels], LABELS)
    other = docs.selectExpr("doc_id", "text", "'xx' AS lang", "NULL AS source", "n_chars", "1 AS label", "2 AS at", "3 AS _k0")
    same = {r["doc_id"]: r["score"] for r in fq.score_documents(other, turned).collect()}
    assert all(same[r["doc_id"]] == pytest.approx(r["score"], abs=1e-9) for r in got)


def test_odd_rows_and_few_labels(spark, make_docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (3, "x" * 300_000), (4, " \n" * 50_000), (5, "\x00\ud7ff\U0001f600 !!")]
    docs = make_docs(rows)
    none = fq.score_documents(docs, spark.createDataFrame([], LABELS)).collect()
    assert [round(r["score"], 6) for r in none] == [0.9] * 7
    one = fq.score_documents(docs, spark.createDataFrame([(1, 1, 0), (None, 1, 0), (9, None, 0)], LABELS)).collect()
    assert len(one) == 7 and len({r["score"] for r in one}) == 1
    both, labels = corpus(200)
    mixed = make_docs([*both, *((i and i + 1000, t) for i, t in rows)])
    got = fq.score_documents(mixed, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 207 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["score"])
    assert by_id[1001] == by_id[1002] and len(by_id[1002]) == 1
    assert fq.score_documents(make_docs([]), spark.createDataFrame(labels, LABELS)).collect() == []
