"""URL verdicts by rules, and for the rest by trust and distrust spread over the graph of hosts.

Pages that a rule allows or blocks make their hosts seeds, weighted by their pages. Trust follows
the links (personalised PageRank), distrust follows them backwards, since a host that links to
blocked ones is doubtful itself. A page without a rule gets the verdict of its host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import forget, table, written

#: Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
ROUNDS = 20
#: Share of distrust in a host's trust and distrust from which it is blocked.
BLOCK_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]*)"""
_WRITE_EVERY = 5


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (verdict, text) that fits host and path; null if none. Of equally long ones the first in text order."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: the pages of host ``src`` that link to host ``dst``, itself included.

    Links with a host name it, links with another scheme have none, all others stay on their host.
    """
    link = lambda x: F.when(F.contains(x, F.lit("://")), url_host(x)).when(F.startswith(x, F.lit("//")), url_host(F.concat(F.lit("x:"), x))).when(
        x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")
    )
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: F.coalesce(link(x), F.col("host"))))
    return (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
        .where("dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def spread(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` after a fixed number of rounds; ``seeds`` has ``host, trust, distrust``.

    Trust is passed on along the links in proportion to their pages, distrust backwards. What
    reaches a host without links (or without links to it) goes no further.
    """
    forward = links.select(F.lit(0).alias("way"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    backward = links.select(F.lit(1).alias("way"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = forward.unionByName(backward)
    degree = both.groupBy("way", "host").agg(F.sum("n").alias("all"))
    edges = written(both.join(degree, ["way", "host"]).select("way", "host", "to", (F.col("n") / F.col("all") * damping).alias("w")))
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("trust").alias("v")), F.struct(F.lit(1).alias("way"), F.col("distrust").alias("v")))).alias("s"))
    start = written(start.select("s.way", "host", (F.col("s.v") * (1 - damping)).alias("v")).where("v > 0"))
    now, old = start, None
    for i in range(1, rounds + 1):
        moved = edges.join(now, ["way", "host"]).select("way", F.col("to").alias("host"), (F.col("w") * F.col("v")).alias("v"))
        now = start.unionByName(moved).groupBy("way", "host").agg(F.sum("v").alias("v"))
        if i % _WRITE_EVERY == 0 or i == rounds:
            now = written(now)
            if old is not None:
                forget(old)
            old = now
    side = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("v"))), F.lit(0.0))
    return now.groupBy("host").agg(side(0).alias("trust"), side(1).alias("distrust"))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, block_share: float = BLOCK_SHARE
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages (page_id, url, html)``.

    A page without a rule is blocked if distrust is more than ``block_share`` of its host's trust
    and distrust, else allowed; so are pages whose host neither reaches, and pages without host.
    Repeated rows count as pages of their own. An empty table gives an empty result; further
    columns are not read.
    """
    url = F.col("url").cast("string")
    own = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), F.col("html").cast("string").alias("html"))
    own = own.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    count = lambda v: F.count(F.when(F.col("hit.verdict") == v, 1)).cast("double")
    seeds = own.where("hit IS NOT NULL").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    hosts = spread(host_links(own), seeds, damping, rounds)
    blocked = written(hosts.where(F.col("distrust") > F.lit(block_share) * (F.col("trust") + F.col("distrust"))).select("host", F.lit(True).alias("blocked")))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return own.drop("html").join(blocked, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))


def op9_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = lambda name, start: f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(n, p)} THEN '{n}{p}'" for _, n, p in ranked)
    said = " ".join(f"WHEN {fits(n, p)} THEN '{v}'" for v, n, p in ranked)
    host = lambda x: f"translate(regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    parts = [
        f"u AS (SELECT page_id, html, {host('coalesce(url, chr(0))')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"o AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM u)",
        f"l AS (SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(html, '{_LINK.replace(chr(39), chr(39) * 2)}', 1)) AS x FROM o WHERE host <> '')",
        f"t AS (SELECT DISTINCT page_id, src, CASE WHEN contains(x, '://') THEN {host('x')} WHEN starts_with(x, '//') THEN {host("'x:' || x")} "
        "WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM l)",
        "e AS (SELECT src, dst, count(*)::DOUBLE AS n FROM t WHERE dst <> '' GROUP BY ALL)",
        "b AS (SELECT 0 AS way, src AS host, dst AS onto, n FROM e UNION ALL SELECT 1, dst, src, n FROM e)",
        f"w AS (SELECT way, host, onto, {DAMPING} * n / sum(n) OVER (PARTITION BY way, host) AS w FROM b)",
        f"r0 AS (SELECT 0 AS way, host, {1 - DAMPING} * count(*) AS v FROM o WHERE said = 'allow' GROUP BY host UNION ALL SELECT 1, host, {1 - DAMPING} * count(*) FROM o WHERE said = 'block' GROUP BY host)",
    ]
    for i in range(1, ROUNDS + 1):
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT way, host, sum(v) AS v FROM (SELECT * FROM r0 UNION ALL SELECT way, onto, w * v FROM w JOIN r{i - 1} USING (way, host)) GROUP BY ALL)"
        )
    parts.append(
        f"h AS (SELECT host FROM r{ROUNDS} GROUP BY host HAVING coalesce(sum(v) FILTER (way = 1), 0) > {BLOCK_SHARE} * sum(v))"
    )
    return f"WITH {', '.join(parts)} SELECT page_id, o.host, path, rule, coalesce(said, CASE WHEN h.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM o LEFT JOIN h ON o.host = h.host"


OP9_SQL = _sql()
