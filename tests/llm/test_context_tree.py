import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sheetloom.llm import context_tree
from sheetloom.llm.context_tree import score_texts


def plain_scores(rows):
    """Counts, block probabilities and mixtures by their definitions, one decision at a time."""
    depth = context_tree.DEPTH
    norm = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows}
    counts, words, contexts = defaultdict(lambda: [0, 0]), Counter(), set()

    def decisions(tokens):
        raw = b"\n" * depth + b" ".join(tokens) + b"\n"
        for at in range(depth, len(raw)):
            node = 1
            for j in range(7, -1, -1):
                bit = raw[at] >> j & 1
                yield [(raw[at - d : at], node) for d in range(depth + 1)], bit
                node = node * 2 + bit

    for i, text in rows:
        tokens = norm(text)
        for path, bit in decisions(tokens):
            contexts.update(path)
            if not held[i]:
                for key in path:
                    counts[key][bit] += 1
        if not held[i]:
            words.update([*tokens, None])
    log_kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    longer, log_w = defaultdict(float), {}
    for key in sorted(contexts, key=lambda k: -len(k[0])):
        own = log_kt(*counts[key]) if key in counts else 0.0
        log_w[key] = own if len(key[0]) == depth else math.log(0.5 * math.exp(own) + 0.5 * math.exp(longer[key]))
        if key[0]:
            longer[(key[0][1:], key[1])] += log_w[key]
    n, v = sum(words.values()), len(words)
    out = {}
    for i, text in rows:
        tokens = norm(text)
        total = 0.0
        for path, bit in decisions(tokens):
            p = None
            for key in reversed(path):
                a, b = counts[key] if key in counts else (0, 0)
                kt = ((b if bit else a) + 0.5) / (a + b + 1)
                if p is None:
                    p = kt
                else:
                    share = 1 / (1 + math.exp(longer[key] - log_kt(a, b)))
                    p = share * kt + (1 - share) * p
            total += math.log10(p)
        base = sum(math.log10((words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in [*tokens, None])
        out[i] = (held[i], len(tokens) + 1, sum(words[t] > 0 for t in [*tokens, None]), n, base, total)
    return out


def check(spark, docs, rows):
    got = {r.doc_id: r for r in context_tree.score_texts(docs).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys()
    for i, (held, n, known, train, base, score) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["on", "the", "there", "Ä", "ßt", "x" * 40, "\x00\xff", "日本", "Re"]
    return [(i, rng.choice(" \n").join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(n)] + [(None, None), (n, ""), (n + 1, "\t")]


def test_scores_are_the_plain_ones(spark, make_docs, tmp_path):
    rows = texts(25, 1)
    make_docs(rows).write.parquet(f"{tmp_path}/d")
    check(spark, spark.read.parquet(f"{tmp_path}/d"), rows)


def test_blocks_passed_on_in_parts(spark, make_docs, monkeypatch):
    rows = texts(25, 2)
    docs = make_docs(rows).cache()
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 200)
    monkeypatch.setattr(context_tree, "_CHUNK", 50)
    monkeypatch.setattr(context_tree, "HELD", 40)
    check(spark, docs, rows)


def test_large_counts_and_streams_in_parts(spark, make_docs, monkeypatch):
    import numpy as np

    n = np.array([0.0, 1, 4096, 4097, 10**6, 10**9])
    want = [math.lgamma(x + 0.5) - math.lgamma(0.5) for x in n]
    assert np.allclose(context_tree._log_rising(n), want, rtol=1e-12) and np.allclose(context_tree._log_factorial(n), [math.lgamma(x + 1) for x in n], rtol=1e-12)
    raw = bytes(random.Random(1).randrange(256) for _ in range(2000))
    grams = context_tree.grams_of(raw)
    monkeypatch.setattr(context_tree, "_PART", 10)
    unique = np.unique(grams)
    assert (context_tree.GramTable(unique, unique.astype(float)).look_up(raw) == grams).all()


def test_held_out_texts_cost_little_more_than_their_entropy(spark, make_docs):
    rng = random.Random(3)
    syllables = ["on", "the", "er", "ing", "sh", "ea"]
    rows = [(i, " ".join("".join(rng.choices(syllables, k=rng.randrange(4, 9))) for _ in range(60))) for i in range(120)]
    scored = [r for r in context_tree.score_texts(make_docs(rows).cache()).collect() if r.held_out]
    # Six syllables of 2.33 bytes on average carry 1.11 bits a byte, ends of words 0.2 more.
    assert 1.1 < -sum(r.score for r in scored) * math.log2(10) / sum(r.n_bytes for r in scored) < 1.5


def test_empty_table(spark, make_docs):
    assert context_tree.score_texts(make_docs([]).cache()).count() == 0


@pytest.mark.parametrize("n", [3256, 3257, 3258, 3259, 5011])
def test_words_that_training_texts_lack_are_not_known(spark, make_docs, tmp_path, crc, n):
    """Logs of the JVM and of numpy differ in the last bit for some totals, so counts decide."""
    ids = iter(range(1000))
    train = next(i for i in ids if crc(i) % 5 != 1)
    out = next(i for i in ids if crc(i) % 5 == 1)
    make_docs([(train, " ".join(["a"] * (n - 1))), (out, "zzz qqq a")], 2).write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in score_texts(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got[out].train_tokens == n
    assert (got[out].n_tokens, got[out].n_known) == (4, 2)
    assert got[train].n_known == n


def test_the_end_of_a_stream_begins_no_gram(monkeypatch):
    monkeypatch.setattr(context_tree, "_PART", 7)
    streams = [context_tree.stream_of(t.split()) for t in (b"", b"a", b"some words and a last one", b"zq \xc3\xa9t\xc3\xa9 xylophone")]
    known = context_tree.np.unique(context_tree.np.concatenate([context_tree.grams_of(s) for s in streams]))
    lookup = context_tree.GramTable(known, known.astype(float))
    for s in streams:
        assert (lookup.look_up(s) == context_tree.grams_of(s)).all()
    with pytest.raises(KeyError):
        lookup.look_up(context_tree.stream_of([b"never", b"counted"]))


def test_groups_from_the_data(spark, make_docs, monkeypatch):
    rows = texts(25, 4)
    monkeypatch.setattr(context_tree, "GROUP_GRAMS", 3)
    check(spark, make_docs(rows).cache(), rows)
