import hashlib
import math
import random
import re
from collections import Counter

from sheetloom.llm import secret_scan

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    added = []
    for rank, c in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(c.pattern, text):
            if any(re.search(a, m[0]) for a in secret_scan.ALLOWED):
                continue
            spans = []
            for i in range(len(m[0]) - c.window + 1):
                counts = Counter(m[0][i : i + c.window]).values()
                if sum(n / c.window * math.log2(c.window / n) for n in counts) >= c.bits - 1e-10:
                    a, b = m.start() + i, m.start() + i + c.window
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
            added += [(a, rank, b) for a, b in spans if not any(s <= a and e >= b for s, _, e in base)]
    return sorted(base), sorted(base + added)


def listed(spans):
    names = [*secret_scan.KINDS, *(c.name for c in secret_scan.CLASSES)]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def sample(n=250, seed=3):
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = lambda chars, k: "".join(rng.choices(chars, k=k))
    parts = [
        lambda: rng.choice(["password", "PassWd", "secret", "Token", "api_key", "APIKEY"]) + rng.choice([":", " = ", '": "', "'=='", ""]) + blob(letters, rng.randrange(5, 40)),
        lambda: "AKIA" + blob("ABCDEFGHIJ0123456789", rng.randrange(8, 24)), lambda: blob("0123456789abcdef", rng.randrange(10, 50)),
        lambda: blob("0123456789ABCDEF", rng.randrange(15, 60)), lambda: blob(letters, rng.randrange(20, 90)), lambda: "ab1" * rng.randrange(6, 20) + blob(letters, 30),
        lambda: "words and más wörter", lambda: "日本\n", lambda: "3f2504e0-4f89-11d3-9a0c-0305e82c3301", lambda: "token:secret:" + blob(letters, 14),
    ]
    return [(i, rng.choice([" ", "", "\n"]).join(rng.choice(parts)() for _ in range(rng.randrange(0, 9)))) for i in range(n)]


def test_spans_are_the_plain_ones(spark, make_docs, tmp_path):
    rows = sample() + [(None, None), (900, ""), (901, "x" * 70_000 + " token=" + "k9" * 9), (902, "tOKEN=ſecret12345678 paſſword=aaaaaaaaaaaa")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.op8_entropy_secrets(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    added = 0
    for i, text in rows:
        base, every = plain(text)
        r, kinds = got[i], Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2]), text
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert r.spans == listed(every), text
        added += len(every) - len(base)
    assert added > 50


def test_no_allow_list_and_empty_table(spark, make_docs):
    text = "abcdefghijklmnopqrstuvwxyzabcdef"
    docs = make_docs([(1, text)])
    assert secret_scan.secret_spans(docs).where("size(added) > 0").count() == 0
    assert secret_scan.secret_spans(docs, allowed=()).where("size(added) > 0").count() == 1
    assert secret_scan.secret_spans(make_docs([])).count() == 0


def test_filler_inside_a_string_takes_only_itself(make_docs):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = "".join(rng.sample(letters, 50)) + "7"
    ssh = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAB" + key
    texts = [f"é {ssh} ", f"v1/deploy/example/{key}", f"{key}xxxx{key}0123456789{key}", f"{key}PlaceHolder", f"example{key}", "your/example/key/0123456789/xxxx7", f"4{'x' * 40}"]
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secret_scan.secret_spans(make_docs(list(enumerate(texts)))).collect()}
    covered = lambda i, a: any(s <= a and e >= a + len(key) for s, e in got[i])
    assert covered(0, texts[0].index(key)) and covered(1, 18) and covered(3, 0) and covered(4, 7)
    assert got[2] == [(0, 51), (55, 106), (116, 167)]
    assert got[3] == [(0, 51)] and got[4] == [(7, 58)] and got[5] == got[6] == []
