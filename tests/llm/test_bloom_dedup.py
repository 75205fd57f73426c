import hashlib
import random
import re

import numpy as np

from sheetloom.llm import bloom_dedup


def plain_groups(rows):
    """doc_id, keep_id, group_size, kept, digest by comparison of the normalised texts."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[3], best[3], len(members), m == best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return out


def sample_rows(n=400, seed=1):
    rng = random.Random(seed)
    pool = ["a b", "ab", "a\tb\n", "é", "é", " ", "", None, "a b", "x" * 5000]
    rows = [(i, rng.choice(pool) if rng.random() < 0.6 else f"text {i}") for i in range(n)]
    return rows + [(None, "a b"), (None, "zz"), (3, "twice"), (3, "twice"), (3, "t wice"), (2, "twice")]


def test_groups_are_the_plain_ones(spark, make_docs):
    rows = sample_rows()
    got = [tuple(r) for r in bloom_dedup.exact_groups(make_docs(rows, 5)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_groups(rows)))
    kept = bloom_dedup.drop_exact(make_docs(rows, 5))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = [(r.doc_id, len(r.text or ""), re.sub(r"[\x20\x09-\x0D]", "", r.text or "")) for r in kept.collect()]
    assert len(found) == len({f[2] for f in found})
    best = {}
    for i, t in rows:
        key, me = re.sub(r"[\x20\x09-\x0D]", "", t or ""), (-len(t or ""), i is None, i or 0)
        best[key] = min(best.get(key, me), me)
    assert {(f[2], -f[1], f[0] is None, f[0] or 0) for f in found} == {(k, *b) for k, b in best.items()}


def test_no_repeat_escapes_the_filter(spark):
    rng = np.random.default_rng(2)
    once = rng.integers(-(2**63), 2**63 - 1, 3000, np.int64)
    repeated = rng.integers(-(2**63), 2**63 - 1, 300, np.int64)
    hashes = spark.createDataFrame([(int(h),) for h in [*once, *repeated, *repeated, *repeated[:9]]], "h bigint").repartition(6)
    for size in (1 << 16, 1 << 20):
        bits = bloom_dedup.repeated_filter(hashes, size)
        assert bits.size * 8 == size
        flagged = {r.h for r in bloom_dedup.maybe_repeated(hashes, bits).where("maybe").collect()}
        assert set(repeated.tolist()) <= flagged
        if size == 1 << 20:
            assert len(flagged) < 320


def test_filter_sizes():
    assert bloom_dedup.filter_bits(0) == bloom_dedup.MIN_FILTER_BITS
    assert bloom_dedup.filter_bits(10**12) == bloom_dedup.MAX_FILTER_BITS
    assert bloom_dedup.filter_bits(10**6) == 1 << 24


def test_empty_table(spark, make_docs):
    assert bloom_dedup.exact_groups(make_docs([])).count() == 0
    assert bloom_dedup.drop_exact(make_docs([])).count() == 0


def test_one_of_repeated_rows_stays(make_docs):
    rows = [(7, "a b"), (7, "a b"), (7, "ab "), (8, "a b"), (None, "x"), (None, "x"), (9, "alone")]
    got = bloom_dedup.exact_groups(make_docs(rows, 4)).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in got) == sorted(
        [(7, 4, True), (7, 4, False), (7, 4, False), (7, 4, False), (0, 2, True), (0, 2, False), (9, 1, True)]
    )
