import random
import re

import xxhash

from sheetloom.llm import simhash
from sheetloom.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = dict.fromkeys(prints)
    for p in root:
        root[p] = p

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    keys = list(root)
    for i, p in enumerate(keys):
        for q in keys[:i]:
            if (p ^ q).bit_count() <= 4:
                root[max(find(p), find(q))] = min(find(p), find(q))
    return {p: find(p) for p in keys}


def near_copies(n=150, seed=3):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["É", "Ümlaut", " x", "A B"]
    texts = []
    for _ in range(n // 5):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 300, 900]))]
        texts.append(" ".join(base))
        for _ in range(4):
            other = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(other).upper() if rng.random() < 0.2 else " ".join(other))
    return texts + [None, "", " \n", "one", "one two three", "one two three four"]


def test_fingerprint_is_the_plain_one():
    for text in near_copies(60):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    long = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def test_groups_are_those_of_all_pairs(spark, make_docs):
    texts = near_copies()
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(make_docs(rows)).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_components(prints.values())
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    assert got == {i: (p, first[roots[p]]) for i, p in prints.items()}
    kept = simhash.drop_near(make_docs(rows))
    assert {r.doc_id for r in kept.collect()} == set(first.values())
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_split_cells_find_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(40)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp bigint")
    want = plain_components(prints)
    for limit in (1 << 22, 1 << 11):
        monkeypatch.setattr(simhash, "CELL_VARIANTS", limit)
        monkeypatch.setattr(simhash, "lead_bits", lambda n: 10)
        found = simhash.links(table, len(signed))
        assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 16 for r in found.collect())
        roots = {r.vertex: r.root for r in components(found).collect()}
        groups = {}
        for (s,) in signed:
            groups.setdefault(roots.get(s, s), set()).add(s % (1 << 64))
        plain = {}
        for p, r in want.items():
            plain.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values()))


def test_nulls_repeats_and_empty_tables(spark, make_docs):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v"), (None, None)]
    got = sorted((r.component_id is None, r.component_id, r.doc_id or 0) for r in simhash.near_groups(make_docs(rows)).collect())
    assert [g[1] for g in got] == [7, 7, 7, None, None]
    assert sorted(r.text or "" for r in simhash.drop_near(make_docs(rows)).collect()) == ["", "a b c d e", "a b c d e", "q r s t u v"]
    assert simhash.near_groups(make_docs([])).count() == 0
    assert simhash.drop_near(make_docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components(chain).collect()} == {0}
    assert components(chain.where("a < 0")).count() == 0


def plain_shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def copy_at(rng, base, similarity, lowest):
    """A copy of ``base`` with as many single words changed as keep its similarity from ``lowest`` to about ``similarity``."""
    own, copy = plain_shingles(" ".join(base)), list(base)
    for at in rng.sample(range(len(base)), len(base)):
        if plain_jaccard(own, plain_shingles(" ".join(copy))) <= similarity:
            break
        before = copy[at]
        copy[at] = f"new{rng.random()}"
        if plain_jaccard(own, plain_shingles(" ".join(copy))) < lowest:
            copy[at] = before
            break
    return " ".join(copy)


def test_planted_copies_are_found_by_similarity(make_docs):
    rng = random.Random(8)
    rows, apart = [], []
    for i in range(360):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([100, 200, 250, 500]))]
        level = [0.8, 0.9, 0.95][i % 3]
        rows += [(i, " ".join(base)), (1000 + i, copy_at(rng, base, level, level))]
        if i % 9 == 0:
            apart.append((2000 + i, copy_at(rng, base, 0.7, 0.6)))
    near = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows), 5, 0.8).collect()}
    for k in range(3):
        found = sum(near[1000 + i] == i for i in range(k, 360, 3))
        assert found >= 118, (k, found)
    assert all(near[i] == i for i in range(360))
    bits = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows)).collect()}
    assert sum(bits[1000 + i] == i for i in range(360)) < 180
    others = make_docs([r for r in rows if r[0] < 1000] + apart)
    assert simhash.near_groups(others, 5, 0.8).where("doc_id != component_id").count() == 0


def test_similarity_groups_are_those_of_all_pairs(make_docs):
    texts = near_copies() + ["one two three four five", "ONE two\tthree four FIVE", "a b c d e f", "a b c d e"]
    rng = random.Random(9)
    base = [f"c{i}" for i in range(120)]
    # Copies of one text that are further from each other than from it.
    texts += [copy_at(rng, base, level, level - 0.03) for level in [0.78, 0.85, 0.88] * 8] + [" ".join(base)]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and plain_jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows), 5, 0.8).collect()}
    assert got == {i: find(i) for i in sets}
    kept = [r.doc_id for r in simhash.drop_near(make_docs(rows), 5, 0.8).collect()]
    assert sorted(kept) == sorted({find(i) for i in sets})
    assert simhash.drop_near(make_docs([]), 5, 0.8).count() == 0


def test_one_id_in_two_groups_leaves_a_document_of_each(make_docs):
    one, other = ([f"{c}{i}" for i in range(100)] for c in "ab")
    rows = [(1, " ".join(one)), (2, " ".join(one) + " end"), (1, " ".join(other)), (3, " ".join(other) + " end")]
    for given in ((), (5, 0.8)):
        groups = simhash.near_groups(make_docs(rows), *given).collect()
        assert len({r.root for r in groups}) == 2 and {r.component_id for r in groups} == {1}
        kept = simhash.drop_near(make_docs(rows), *given).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[0], rows[2]])


def test_balls_connect_texts_with_a_close_fingerprint(spark):
    rng = random.Random(12)
    prints = {i: [rng.getrandbits(40) for _ in range(simhash.PRINTS)] for i in range(60)}
    for i in range(60, 120):
        prints[i] = [rng.getrandbits(40) for _ in range(simhash.PRINTS)]
        band, near = rng.randrange(simhash.PRINTS), rng.randrange(i)
        prints[i][band] = prints[near][band] ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(4)))
    found = simhash.ball_links(spark.createDataFrame(list(prints.items()), "fp bigint, prints array<bigint>"))
    roots = {r.vertex: r.root for r in components(found).collect()}
    plain = {i: i for i in prints}

    def find(i):
        while plain[i] != i:
            i = plain[i]
        return i

    for i in prints:
        for j in range(i):
            if any((a ^ b).bit_count() <= simhash.PRINT_RADIUS for a, b in zip(prints[i], prints[j])):
                low, high = sorted((find(i), find(j)))
                plain[high] = low
    assert {i: roots.get(i, i) for i in prints} == {i: find(i) for i in prints}


def test_far_copies_of_a_template_are_not_paired(spark):
    rng = random.Random(13)
    template = set(range(1, 147))
    sets = {}
    for i in range(300):
        lost = rng.sample(sorted(template), rng.choice([8, 30, 40]))
        sets[i] = sorted(template - set(lost)) + [1000 + 100 * i + k for k in range(len(lost))]
    sets[300], sets[301] = sets[7][:-2] + [5, 1], sets[299]
    sets = {i: sorted(set(s)) for i, s in sets.items()}
    rows = [(0, i, i, s) for i, s in sets.items()]
    got = {(r.a, r.b) for r in simhash.apart_pairs(spark.createDataFrame(rows, "group int, root int, fp bigint, hashes array<bigint>"), 0.8).collect()}
    close = {(i, j) for i in sets for j in sets if i < j and plain_jaccard(set(sets[i]), set(sets[j])) >= 0.8}
    assert close <= got and (299, 301) in close
    far = sum(len(set(s) & template) < 130 for s in sets.values())
    assert far > 150 and len(got - close) < 300


def test_copies_of_a_template_take_few_links_and_comparisons(make_docs, monkeypatch):
    rng = random.Random(14)
    base = [f"t{i}" for i in range(150)]
    rows = [(5000, " ".join(base))]
    for i in range(500):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = f"n{rng.randrange(400)}"
        rows.append((i, " ".join(copy)))
    linked, compared = [], []
    plain_components_of, plain_similar = simhash.components, simhash.similar
    monkeypatch.setattr(simhash, "components", lambda edges: linked.append(edges.distinct().count()) or plain_components_of(edges))
    monkeypatch.setattr(simhash, "similar", lambda pairs, *given: compared.append(pairs.count()) or plain_similar(pairs, *given))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(make_docs(rows), 5, 0.8).collect()}
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and plain_jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) > 100
    assert max(sum(linked), sum(compared)) < 10 * len(rows), (linked, compared)
