import random
import re
from collections import Counter, defaultdict

from sheetloom.llm import host_trust

SCHEMA = "page_id bigint, url string, html string, host string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(pages):
    rows = []
    for i, url, html in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        hits = [r for r in host_trust.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rows.append((i, host, path, max(hits, key=lambda r: len(r[1] + r[2])) if hits else None, html or ""))
    edges, seeds = Counter(), [Counter(), Counter()]
    for _, host, _, rule, html in rows:
        if rule:
            seeds[rule[0] == "block"][host] += 1
        targets = set()
        for x in re.findall(r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)""", html, re.I | re.S):
            if "://" in x or x.startswith("//"):
                targets.add(lower(re.search(r"//([^/?#]*)", x if x.startswith("//") else x[x.index("://") :])[1]))
            elif not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x):
                targets.add(host)
        for t in targets:
            if host and t:
                edges[host, t] += 1
    values = []
    for way in (0, 1):
        out = defaultdict(Counter)
        for (a, b), n in edges.items():
            out[(a, b)[way]][(b, a)[way]] += n
        start = {h: (1 - host_trust.DAMPING) * n for h, n in seeds[way].items()}
        now = dict(start)
        for _ in range(host_trust.ROUNDS):
            after = Counter(start)
            for h, v in now.items():
                for t, n in out[h].items():
                    after[t] += host_trust.DAMPING * v * n / sum(out[h].values())
            now = dict(after)
        values.append(now)
    said = []
    for i, host, path, rule, _ in rows:
        t, d = values[0].get(host, 0), values[1].get(host, 0)
        said.append((i, host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if d > host_trust.BLOCK_SHARE * (t + d) else "allow"))
    return said


def sample(n=300, seed=5):
    rng = random.Random(seed)
    hosts = ["%s.example.%s" % (a, b) for a in ("a", "B", "m.c", "www.d", "e") for b in ("com", "net", "org")] + ["com", "Example.com", "notexample.com", "x.io", "y.io", "z.io"]
    pages = []
    for i in range(n):
        links = []
        for _ in range(rng.randrange(4)):
            h = rng.choice(hosts)
            links.append(rng.choice([f'<a href="http://{h}/p">', f"<A class=x HREF='//{h}?q'>", "<a href=/local>", '<a href="mailto:x@y">', "<a\nhref = page.html>", "<a>", '<a href="">']))
        path = rng.choice(["/en/7", "/en/x", "/de/8?x=1", "/de/7#y", "/es/1", "", "/", "?a=://b", "/fr"])
        pages.append((i, rng.choice(["http", "https"]) + "://" + rng.choice(hosts) + path, "".join(links)))
    return pages + [(None, None, None), (n, "no scheme", "<a href=x>"), (n + 1, "://", "<a href=x>"), (n + 2, "x\n://HÉ.com/en/", "<a href=//x.io>"), (2, pages[2][1], pages[2][2])]


def test_verdicts_are_the_plain_ones(spark):
    pages = sample()
    table = spark.createDataFrame([(*p, "clash") for p in pages], SCHEMA).repartition(3)
    got = [tuple(r) for r in host_trust.judge(table).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = plain(pages)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}


def test_empty_table(spark):
    assert host_trust.judge(spark.createDataFrame([], SCHEMA)).count() == 0
