import math
import re
from collections import Counter
from itertools import permutations

import pytest

from sheetloom.llm import filter_audit as fa

LABELS = "doc_id bigint, quality int, toxic int"


def plain(docs, labels):
    """All orders run over all documents one by one."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and d > least[text],
        }
        fails.append((source or "", d, {k for k, v in own.items() if v}))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        for order in permutations("ABCDE"):
            left = [(d, f) for p, d, f in fails if p == part]
            everyone = left
            for step, letter in enumerate(order, 1):
                here = [(d, f) for d, f in left if letter in f]
                before = left
                left = [(d, f) for d, f in left if letter not in f]
                shapley[part, letter] += len(here)
                failing = sum(letter in f for _, f in everyone)
                out[part, "".join(order), step] = [
                    len(left), len(here), failing - len(here), sum(f == {letter} for _, f in everyone),
                    sum(d in good for d, _ in here), sum(d in toxic for d, _ in here),
                ]
                assert len(before) == len(left) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(spark, docs, labels):
    masks = fa.failure_masks(docs)
    rows = fa.audit(fa.mask_counts(masks, spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def test_all_orders_and_odd_rows(spark, make_docs):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, words, "a"), (2, words, "b"), (3, words, "a"), (4, words.upper(), "a"), (5, "x " * 70, "a"), (6, "SHORT | text", "a"),
        (7, None, "a"), (8, "", None), (9, "", ""), (9, "", ""), (7, None, "a"), (None, words, "a"), (None, None, "b"), (10, words + " $", "b"),
        (11, "\x1c".join(["y"] * 90), "b"), (12, "É " * 51, "a"), (13, words + "\t\n\x0b\x0c\r #", None),
    ]
    labels = [(1, 1, 0), (4, 1, 1), (4, 0, 0), (5, 0, 1), (6, None, 1), (8, 1, None), (None, 1, 1), (77, 1, 1)]
    table = make_docs(docs).drop("n_chars", "lang").withColumnRenamed("lang", "mask")
    table = table.selectExpr("*", "1 AS mask", "'z' AS digest", "2 AS part", "3 AS n")
    assert got(spark, table, labels) == plain(docs, labels)


def test_empty_tables(spark, make_docs):
    assert got(spark, make_docs([]), []) == {}
    assert got(spark, make_docs([(1, "a", "s")]), []) == plain([(1, "a", "s")], [])


def test_path_counts():
    for k in range(1, 7):
        forward, backward = fa.path_counts(k)
        for state in range(1 << k):
            n = state.bit_count()
            assert (forward[state], backward[state]) == (math.factorial(n), math.factorial(k - n))
        edges = fa.lattice_edges("ABCDEF"[:k])
        assert len(edges) == k << (k - 1)
        assert all(e["weight"] == len(e["steps"]) for e in edges)
    with pytest.raises(ValueError, match="filters"):
        fa.audit(None, "ABCDEFGH")


def test_a_text_of_a_third_of_all_rows(spark, make_docs):
    docs = [(i, "same" if i % 3 == 0 else f"t{i}", f"s{i % 2}") for i in range(3000)]
    rows = fa.failure_masks(make_docs(docs, 8)).collect()
    assert len(rows) == 3000
    assert sum(r["mask"] >> 4 & 1 for r in rows) == 999
    assert not any(r["mask"] >> 4 & 1 for r in rows if r["doc_id"] == 0 or r["doc_id"] % 3)
