"""How filters of a corpus interact: forward and backward path counts over the lattice of applied filters.

A document's failures are one bit mask, so a part of the corpus is known by its counts of at most
``2 ** k`` masks. A state of the lattice is the set of filters applied so far; its survivors are
the documents whose mask is disjoint from it, and an edge adds one filter and removes the
difference of two states. The number of orders that run through an edge is the number of ways to
reach its state times the number of ways to leave the next one, which weighs its removals for the
Shapley sum; the steps of every order are read from the same edges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.shared import WORD, table, written

#: Orders grow with the factorial of the filters, and every part has a row for each step of each.
MAX_FILTERS = 7
#: Rows without an id are spread over so many keys where ids are joined.
_SALTS = 1 << 12

_words = lambda text: F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

#: Name and failure condition of each filter; None stands for a text that a smaller id has too.
FILTERS: tuple[tuple[str, Callable[[Column], Column] | None], ...] = (
    ("A", lambda text: F.size(_words(text)) < 50),
    ("B", lambda text: 100 * F.size(F.array_distinct(_words(text))) < 65 * F.size(_words(text))),
    ("C", lambda text: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text)),
    ("D", lambda text: text.rlike("[#$%&*|]")),
    ("E", None),
)


def path_counts(k: int) -> tuple[list[int], list[int]]:
    """Ways from the empty set to each subset of ``k`` filters, and from each subset to the whole set."""
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for state in range(1 << k):
        for i in range(k):
            if not state >> i & 1:
                forward[state | 1 << i] += forward[state]
    for state in reversed(range(1 << k)):
        for i in range(k):
            if not state >> i & 1:
                backward[state] += backward[state | 1 << i]
    return forward, backward


def lattice_edges(names: Sequence[str]) -> list[dict]:
    """Edges of the lattice: state, next state, filter, orders through it, and the steps of orders that are this edge."""
    k = len(names)
    forward, backward = path_counts(k)
    steps: dict[tuple[int, int], list[dict]] = {}
    for order in permutations(range(k)):
        state, name = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            steps.setdefault((state, i), []).append({"filter_order": name, "step": step})
            state |= 1 << i
    return [
        {"state": s, "after": s | 1 << i, "adds": 1 << i, "weight": forward[s] * backward[s | 1 << i], "steps": own} for (s, i), own in sorted(steps.items())
    ]


def failure_masks(docs: DataFrame, filters: Sequence[tuple[str, Callable[[Column], Column] | None]] = FILTERS, part: str = "source") -> DataFrame:
    """``doc_id, part, mask`` of every row: bit i is set where filter i fails.

    Null texts count as empty, null parts as the empty name. A row repeats a text when the same
    text stands under a smaller ``doc_id`` anywhere in the table; rows that share the smallest id
    do not, and rows without an id never do. An empty table gives an empty result; other columns
    are not read. The texts are read once: what goes on is a digest and a mask.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    bits = [F.when(test(F.col("_text")), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(filters) if test]
    rows = own.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))
    corpus_bits = sum(1 << i for i, (_, test) in enumerate(filters) if test is None)
    if not corpus_bits:
        return rows.drop("digest")
    rows = written(rows)
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    # An id and a digest together are nearly unique, so the copies of one text meet no common task here.
    repeats = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").select(
        "doc_id", "part", F.when(repeats, F.col("mask") + F.lit(corpus_bits)).otherwise(F.col("mask")).alias("mask")
    )


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents, and those labelled of quality 1 and toxic 1.

    A document with several label rows has a label if one of them has it.
    """
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS - 1)) + 1).otherwise(F.lit(0))
    given = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
    given = given.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.withColumn("_salt", salt.cast("bigint")).join(given.withColumn("_salt", F.lit(0).cast("bigint")), ["doc_id", "_salt"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def audit(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """All orders of the filters over ``counts`` (``part, mask, n, good, toxic``).

    One row per part, order and step: ``kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley``. A part is one row with its survivors by state until edges and then
    steps are spread from it, so nothing is joined.
    """
    k = len(names)
    if not 1 <= k <= MAX_FILTERS:
        raise ValueError(f"{k} filters; 1 to {MAX_FILTERS} can be audited")
    edges = lattice_edges(names)
    kind = "array<struct<state:int,after:int,adds:int,weight:bigint,steps:array<struct<filter_order:string,step:int>>>>"
    every = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda s: s.bitwiseAND(F.col("mask")) == 0)
    states = counts.select("part", "n", "good", "toxic", F.explode(every).alias("state"))
    states = states.groupBy("part", "state").agg(F.struct(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")).alias("left"))
    # At most 2 ** k entries a part.
    parts = states.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("state", "left"))).alias("at"))
    left = lambda state, what: F.coalesce(F.try_element_at("at", state)[what], F.lit(0))
    spread = parts.select("part", "at", F.explode(F.from_json(F.lit(json.dumps(edges)), kind)).alias("e"))
    lost = lambda what: (left(F.col("e.state"), what) - left(F.col("e.after"), what))
    alone = F.lit((1 << k) - 1) - F.col("e.adds")
    moved = spread.select(
        "part",
        "e.adds",
        "e.steps",
        left(F.col("e.after"), "n").alias("kept"),
        lost("n").alias("removed"),
        (left(F.lit(0), "n") - left(F.col("e.adds"), "n") - lost("n")).alias("redundant"),
        (left(alone, "n") - left(F.lit((1 << k) - 1), "n")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        (F.col("e.weight") * lost("n")).alias("_weighted"),
    )
    shapley = F.sum("_weighted").over(Window.partitionBy("part", "adds")).alias("shapley")
    told = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    summed = moved.select("part", "steps", *told, shapley)
    return summed.select("part", *told, "shapley", F.explode("steps").alias("s")).select("part", "s.filter_order", "s.step", *told, "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, by source."""
    masks = failure_masks(table(spark, sf_dir, "documents"))
    return audit(mask_counts(masks, table(spark, sf_dir, "labels")), [name for name, _ in FILTERS])


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
failing AS (
  SELECT part, doc_id, [
           CASE WHEN len(words) < 50 THEN 'A' END,
           CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' END,
           CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' END,
           CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
           CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END] AS fails
  FROM texts),
marked AS (
  SELECT part, list_filter(fails, lambda x: x IS NOT NULL) AS fails,
         count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
runs AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS l, n, good, toxic, fails,
         list_contains(fails, l) AS fails_here,
         len(list_filter(fails, lambda x: strpos(filter_order, x) < step)) > 0 AS gone
  FROM marked CROSS JOIN steps),
summed AS (
  SELECT part, filter_order, step, l,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_here), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails_here), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails_here), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE fails_here AND len(fails) = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails_here), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_here), 0) AS toxic_lost
  FROM runs GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM summed
"""
