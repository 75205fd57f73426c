"""Secrets in texts: three known forms, and strings of high entropy.

A string of one character class is walked over by a window. The window's Shannon entropy follows
from the sum of ``c * log2(c)`` over its character counts, and one step changes that sum by two
terms only: the count of the character that leaves and of the one that enters. Windows at or
above the threshold of their class are joined to spans. Strings of an allowed form are left out;
a placeholder inside a string is cut out, and what stands before and after it is walked over.
All of it is built-in column functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import table

#: Known forms: name, pattern, and what a match must meet.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A maximal run that is too short holds no shorter match, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class EntropyClass:
    """A character class: its candidate strings, window, and threshold in bits."""

    name: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("entropy_hex", r"[0-9A-F]{20,}", 20, 3.0),
    EntropyClass("entropy_base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 3.9),
)
#: Candidates of these forms are no secrets: words and paths without digits, numbers with
#: separators, and UUIDs.
ALLOWED = (
    r"^[A-Za-z/_=-]+$",
    r"^[0-9/_=+-]+$",
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Parts of candidates that are no secrets, whatever stands around them: placeholders, and runs of
#: one repeated character.
FILLER = r"(?i:example|placeholder|changeme|xxxx|0123456789)|(.)\1{7,}"


def found_spans(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: array of start, end (code points, end exclusive) and the match.

    What stands between the matches gives their places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,`end`:int,hit:string>>")
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"))
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
        F.concat(
            s["found"],
            F.array(F.struct((s["at"] + F.length(p["gap"])).alias("start"), (s["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("end"), p["hit"].alias("hit"))),
        ).alias("found"),
    )
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    walked = F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def pieces(start: Column, hit: Column, filler: str) -> Column:
    """What is left of a string that begins at ``start`` when the filler is cut out, in the form of ``found_spans``."""
    gap = lambda a, e: F.struct(a.alias("start"), e.alias("end"), F.substring(hit, a - start + 1, e - a).alias("hit"))
    cuts = found_spans(hit, filler)
    ends = F.concat(F.transform(cuts, lambda c: start + c["start"]), F.array(start + F.length(hit)))
    starts = F.concat(F.array(start), F.transform(cuts, lambda c: start + c["end"]))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("e")), lambda p: gap(p["a"], p["e"]))


def _term(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def dense_spans(start: Column, hit: Column, window: int, bits: float) -> Column:
    """Spans of a string whose windows reach ``bits``: array of start and end, counted from ``start``.

    The sum over counts changes by the two characters of a step; their counts are taken from
    the window, and windows that reach the threshold and touch are joined.
    """
    chars = F.split(hit, "")
    n = F.length(hit)
    limit = window * (F.log2(F.lit(float(window))) - bits)
    same = lambda a, at, size: F.size(F.filter(F.slice(a, at, size), lambda x: x == F.element_at(a, at + size)))
    back = lambda a, at, size: F.size(F.filter(F.slice(a, at, size), lambda x: x == F.element_at(a, at)))

    def entering(i: Column) -> Column:
        # Character i enters a window that holds those before it, at most window - 1.
        held = F.least(i - 1, F.lit(window - 1))
        count = F.when(held > 0, same(chars, F.greatest(i - held, F.lit(1)), F.greatest(held, F.lit(1)))).otherwise(F.lit(0))
        return _term(count + 1) - _term(count)

    def leaving(i: Column) -> Column:
        # Character i - window leaves; it is counted in the window that begins with it.
        count = F.when(i > window, back(chars, F.greatest(i - window, F.lit(1)), F.lit(window))).otherwise(F.lit(0))
        return F.when(i > window, _term(count - 1) - _term(count)).otherwise(F.lit(0.0))

    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), (entering(i) + leaving(i)).alias("d")))
    spans = "array<struct<start:int,`end`:int>>"
    begin = F.struct(F.lit(0.0).cast("double").alias("sum"), F.array().cast(spans).alias("found"))

    def step(s: Column, x: Column) -> Column:
        total = s["sum"] + x["d"]
        first, end = start + x["i"] - window, start + x["i"]
        last = F.try_element_at(s["found"], F.lit(-1))
        joined = F.when(
            last.isNotNull() & (last["end"] >= first),
            F.concat(F.slice(s["found"], 1, F.greatest(F.size(s["found"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), end.alias("end")))),
        ).otherwise(F.concat(s["found"], F.array(F.struct(first.alias("start"), end.alias("end")))))
        # Rounding in the running sum must not decide a window that is exactly at the threshold.
        return F.struct(total.alias("sum"), F.when((x["i"] >= window) & (total <= limit + 1e-9), joined).otherwise(s["found"]).alias("found"))

    return F.aggregate(steps, begin, step, lambda s: s["found"])


def secret_spans(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, filler: str = FILLER) -> DataFrame:
    """``doc_id, base, added`` for every row: arrays of kind, start and end, in order.

    ``base`` has the known forms, ``added`` the spans of high entropy outside of them. Null
    texts count as empty and have none. An empty table gives an empty result; further columns
    are not read.
    """
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    own = own.withColumn("assign", F.filter(found_spans(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= ASSIGN_LEAST))
    own = own.withColumn("access", found_spans(text, ACCESS)).withColumn("hex", found_spans(text, HEX))
    for c in classes:
        plain = lambda m: ~F.lit(False) if not allowed else ~F.greatest(*[m["hit"].rlike(a) for a in (*allowed, allowed[0])])
        held = F.filter(found_spans(text, c.pattern), plain)
        whole = F.flatten(F.transform(held, lambda m: pieces(m["start"], m["hit"], filler)))
        own = own.withColumn(c.name, F.filter(whole, lambda m: F.length(m["hit"]) >= c.window))  # noqa: B023
    own = own.drop("text")
    span = lambda rank: lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))
    base = F.sort_array(F.concat(*[F.transform(k, span(i)) for i, k in enumerate(KINDS)]))
    own = own.withColumn("base", base)
    dense = []
    for i, c in enumerate(classes):
        walk = lambda c: lambda m: dense_spans(m["start"], m["hit"], c.window, c.bits)
        spans = F.flatten(F.transform(c.name, walk(c)))
        dense.append(F.transform(spans, span(len(KINDS) + i)))
    outside = lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    own = own.withColumn("added", F.sort_array(F.filter(F.concat(*dense), outside)))
    names = F.array(*[F.lit(k) for k in (*KINDS, *(c.name for c in classes))])
    named = lambda a: F.transform(a, lambda s: F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
    return own.select("doc_id", named("base").alias("base"), named("added").alias("added"))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    spans = secret_spans(table(spark, sf_dir, "documents"))
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    order = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    both = F.sort_array(F.transform(F.concat("base", "added"), order))
    return spans.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed(both).alias("spans"),
    )
