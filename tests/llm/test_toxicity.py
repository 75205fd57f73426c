import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetloom.llm import toxicity


def plain_segments(values):
    """Maximal segments by their definition: the best one, then those beside it."""

    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += values[j]
                if total > 0 and (found is None or total > found[0] or (total == found[0] and j + 1 - i < found[2] - found[1])):
                    found = (total, i, j + 1)
        return [] if found is None else best(a, found[1]) + [found[1:]] + best(found[2], b)

    return best(0, len(values))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.1, -1.7, -0.9, 0.8, 1.3, 2.6]), max_size=14))
def test_segments_are_the_maximal_ones(values):
    # Distinct sums, so that no two segments tie.
    values = [v + 0.001 * 1.7**i for i, v in enumerate(values)]
    got = toxicity.maximal_segments(np.array(values))
    assert [(a, b) for a, b, _ in got] == plain_segments(values)
    assert all(abs(s - sum(values[a:b])) < 1e-9 for a, b, s in got)


def test_scan_is_linear_on_bad_cases():
    for values in (np.tile([1.0, -0.5], 200_000), np.linspace(1, 2, 200_000) * np.tile([1, -1], 100_000)):
        assert toxicity.maximal_segments(values)
    assert toxicity.maximal_segments(np.zeros(0)) == []


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    common = ["w%d" % i for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(common, k=rng.choice([5, 60, 400]))
        bad = i % 5 == 0
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(["vile", "dread", "nasty"]) + rng.choice(["", "thing", "ness"]) for _ in range(rng.choice([1, 2, 4]))]
        rows.append((i, " ".join(words).replace("w1 ", "W1. ")))
        labels.append((i, 1, int(bad)))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_documents(spark, make_docs, crc):
    rows, labels = corpus()
    docs, given_labels = make_docs(rows + [(None, None), (9000, ""), (9001, "vilethinggg " * 3), (1, rows[1][1])]), spark.createDataFrame(labels + [(None, 1, 1), (2, 1, None)], LABELS)
    got = toxicity.score_documents(docs, given_labels).collect()
    assert len(got) == len(rows) + 4
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (crc("" if r.doc_id is None else r.doc_id) % 5 == 0) for r in got)
    wrong = [r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000 and r.predicted != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 3, wrong
    kept = toxicity.drop_toxic(docs, given_labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if not r.predicted)
    # What the held-out labels say changes nothing.
    other = [(i, q, 1 - t) if crc(i) % 5 == 0 else (i, q, t) for i, q, t in labels]
    again = toxicity.score_documents(docs, spark.createDataFrame(other, LABELS)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_passages_are_where_they_are(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    text = "İ Ünder w3 w4, VILE-dread nasty! w5 " + "w6 " * 300
    (row,) = toxicity.passages(make_docs([(1, text)]), model).collect()
    assert [text[p.start : p.end] for p in row.passages] == ["VILE-dread nasty"]
    assert all(p.expected < toxicity.MAX_E for p in row.passages)
    assert toxicity.passages(make_docs([(1, None), (2, "")]), model).where("size(passages) > 0").count() == 0


def test_without_usable_labels(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(20)])
    for labels in ([], [(i, 1, 0) for i in range(20)]):
        got = toxicity.score_documents(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 20 and {r.predicted for r in got} == {0}
    assert toxicity.score_documents(make_docs([]), spark.createDataFrame([], LABELS)).count() == 0
