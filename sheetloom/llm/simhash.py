"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at 4 or fewer differing bits have a common variant within 2 bits of each. Every
distinct fingerprint therefore stands for all its variants within half the radius. Variants meet
in a shuffle on their leading bits: a fingerprint is sent once for every *leading part* within the
radius, and the receiving task completes the variants of the other bits, finds equal ones and
checks the pairs. That is the whole ball, but 56 rows instead of 2,081 per fingerprint travel.

All fingerprints with a common variant are linked with each other, so a task returns one link per
member to the smallest one it is connected with, never all pairs.

One fingerprint of all shingles tells only almost identical texts from others. Groups by a
*similarity* of the shingle sets therefore take many fingerprints of a text, in each of which a bit
is that of a subset of the shingles: of the least one under a permutation. Two texts differ in such
a bit with half of what their similarity lacks to 1. Texts are candidates where the balls around
their fingerprints connect them, and the Jaccard similarity of their shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.components import components
from sheetloom.llm.shared import table, written

SHINGLE = 4
BITS = 64
RADIUS = 4
HALF = RADIUS // 2
#: Variants a task completes at a time; larger cells are split.
CELL_VARIANTS = 1 << 22
MIN_LEAD = 10
MAX_LEAD = 30
_CHUNK = 1 << 16
#: For groups by similarity: fingerprints of a text, bits of each, and differing bits up to which two
#: link. At a similarity of 0.8 one in ten bits differs, and 0.9997 of the pairs link in some fingerprint.
PRINTS = 32
PRINT_BITS = 40
PRINT_RADIUS = 2
MIN_PRINT_LEAD = 4
_PERMUTED = 16
_FACTORS = np.random.default_rng(64).integers(0, 1 << 32, PRINTS * PRINT_BITS, np.uint32) | np.uint32(1)
_EVEN = 1e-6
#: Bits that stand for the hashes of a text where pairs are ruled out before they are made, in words of 64.
SIGN_WORDS = 4


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text in turn, unsigned; no words: none.

    A-Z are lower-cased, words are cut at ASCII white space, and a text of fewer than ``shingle``
    words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, hash64, shingle = b" ".join(words), xxhash.xxh64_intdigest, min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    parts = []
    for at in range(0, len(starts), _CHUNK):
        pairs = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        parts.append(np.array([hash64(line[s:e], 42) for s, e in pairs], "<u8"))
    return np.concatenate(parts)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned 64-bit number; no words: 0.

    Shingles are those of ``shingle_hashes`` and count as often as they occur. A bit is set if it
    is set in more than half of the shingle hashes.
    """
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """By number of flips, 0 to ``most``: all masks over ``bits`` low bits."""
    return [np.array([sum(1 << i for i in c) for c in combinations(range(bits), n)], np.uint64) for n in range(most + 1)]


def _volume(bits: int, most: int) -> int:
    return sum(comb(bits, n) for n in range(most + 1))


def _spread(values: np.ndarray, sides: int) -> np.ndarray:
    """A linear map of 64 bits to ``sides`` bits: it cuts the variants of one ball evenly."""
    columns = np.random.default_rng(64).integers(0, 1 << sides, BITS, np.uint64)
    out = np.zeros(values.shape, np.uint64)
    for i in range(BITS):
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * columns[i]
    return out


def _meet(group: pd.DataFrame, lead: int, bits: int = BITS, radius: int = RADIUS) -> pd.DataFrame:
    """Links between the fingerprints of a cell that have a common variant in it, to the one of the highest ``rank`` if there is such a column."""
    half = radius // 2
    if "rank" in group:
        group = group.sort_values(["rank", "fp"], ascending=False)
    own, left = group["fp"].to_numpy(np.int64).view(np.uint64), group["flips"].to_numpy(np.int64)
    sides, side = int(group["sides"].iloc[0]), np.uint64(int(group["side"].iloc[0]))
    rest = bits - lead
    low = own & np.uint64((1 << rest) - 1)
    by_flips = _masks(rest, half)
    variants, owners = [], []
    for most in range(half + 1):
        rows = np.flatnonzero(left == most)
        if not rows.size:
            continue
        masks = np.concatenate(by_flips[: most + 1])
        if sides:
            wanted, have = _spread(low[rows], sides) ^ side, _spread(masks, sides)
            for value in np.unique(wanted):
                some, fit = rows[wanted == value], masks[have == value]
                variants.append((low[some][:, None] ^ fit[None, :]).ravel())
                owners.append(np.repeat(some, fit.size))
        else:
            variants.append((low[rows][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(rows, masks.size))
    flat, owner = np.concatenate(variants), np.concatenate(owners)
    ranked = np.sort(flat)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not twice.size:
        return none
    at = np.minimum(np.searchsorted(twice, flat), twice.size - 1)
    met = np.flatnonzero(twice[at] == flat)
    met = met[np.argsort(at[met], kind="stable")]
    owner, at = owner[met], at[met]
    starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    sizes = np.diff(np.concatenate((starts, [at.size])))
    # The check of the pairs: each member against the first one of its variant.
    close = np.bitwise_count(own[owner] ^ own[np.repeat(owner[starts], sizes)]) <= radius
    label = np.arange(own.size)
    while True:
        least = np.repeat(np.minimum.reduceat(np.where(close, label[owner], own.size), starts), sizes)
        after = label.copy()
        np.minimum.at(after, owner[close], least[close])
        after = after[after]
        if (after == label).all():
            break
        label = after
    member = np.flatnonzero(label != np.arange(own.size))
    pairs = np.unique(np.stack([own[member], own[label[member]]], axis=1), axis=0) if member.size else np.zeros((0, 2), np.uint64)
    return pd.DataFrame({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)}) if member.size else none


def lead_bits(fingerprints: int, bits: int = BITS, radius: int = RADIUS, least: int = MIN_LEAD) -> int:
    """Leading bits of the shuffle key, so that an even cell holds half of ``CELL_VARIANTS`` at most."""
    return min(MAX_LEAD, max(least, (2 * fingerprints * _volume(bits, radius // 2) // CELL_VARIANTS).bit_length()))


def links(distinct: DataFrame, count: int, keys: Sequence[str] = (), lead: int | None = None, bits: int = BITS, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect all of the ``count`` distinct fingerprints ``fp`` of ``bits`` bits within the ``radius``.

    With ``keys``, integers, only fingerprints link that are equal in them; ``count`` is that of one key then.
    With a column ``rank``, fingerprints link to those of a high rank rather than to any.
    """
    own = ["fp", *(c for c in distinct.columns if c == "rank")]
    lead, half = lead_bits(count) if lead is None else lead, radius // 2
    rest = bits - lead
    masks = [(int(m), half - n) for n, part in enumerate(_masks(lead, half)) for m in part]
    masks = F.explode(F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(f).alias("flips")) for m, f in masks]))
    sent = distinct.select(*keys, *own, masks.alias("m")).select(
        *keys, *own, F.shiftrightunsigned("fp", rest).bitwiseXOR(F.col("m.mask")).alias("cell"), F.col("m.flips").cast("tinyint").alias("flips")
    )
    volume = F.element_at(F.array(*[F.lit(_volume(rest, n)) for n in range(half + 1)]), (F.col("flips") + 1).cast("int"))
    large = sent.groupBy(*keys, "cell").agg(F.sum(volume).alias("v")).where(F.col("v") > CELL_VARIANTS)
    large = written(large.select(*keys, "cell", F.ceil(F.log2(F.col("v") / F.lit(CELL_VARIANTS))).cast("int").alias("sides")))
    if large.isEmpty():
        sent = sent.select(*keys, F.col("cell").alias("key"), *own, "flips", F.lit(0).alias("sides"), F.lit(0).alias("side"))
        by = [*keys, "key"]
    else:
        cut = sent.join(large, [*keys, "cell"], "left").withColumn("sides", F.coalesce("sides", F.lit(0)))
        cut = cut.withColumn("side", F.explode(F.expr("sequence(0, shiftleft(1, sides) - 1)")))
        sent = cut.select(*keys, F.xxhash64("cell", "side").alias("key"), *own, "flips", "sides", "side", "cell")
        by = [*keys, "key", "cell", "side"]

    def met(group: pd.DataFrame) -> pd.DataFrame:
        pairs = _meet(group, lead, bits, radius)
        return pairs.assign(**{k: group[k].iloc[0] for k in keys})[[*keys, "a", "b"]]

    return sent.groupBy(*by).applyInPandas(met, ", ".join([*[f"{k} bigint" for k in keys], "a bigint", "b bigint"])).distinct()


def prints_of(hashes: np.ndarray) -> list[int]:
    """The ``PRINTS`` fingerprints of a set of shingle hashes; of none: none.

    Each bit is one of the least shingle under a permutation of its own.
    """
    if not hashes.size:
        return []
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(_FACTORS.size, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, folded.size, _PERMUTED):
        np.minimum(least, (folded[at : at + _PERMUTED, None] * _FACTORS).min(axis=0), out=least)
    bits = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return (bits.reshape(PRINTS, PRINT_BITS).astype(np.int64) << np.arange(PRINT_BITS)).sum(axis=1).tolist()


def _set_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 42)).view(np.int64))


def jaccard(one: Column | str, other: Column | str) -> Column:
    """Jaccard similarity of two arrays without repeats; of two empty ones: 1."""
    both = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs (a, b)`` and whether the sets ``sets (fp, hashes)`` of both are similar enough: ``near``."""
    one, other = (sets.select(F.col("fp").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    # Row by row, so that a task never holds the sets of a whole batch of pairs.
    return pairs.join(one, "a").join(other, "b").select("a", "b", (jaccard("_a", "_b") >= similarity - 1e-12).alias("near"))


def ball_links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` between texts ``distinct (fp, prints)`` that connect all with a fingerprint within ``PRINT_RADIUS``.

    Texts that share a fingerprint link to one of them, which stands for it in the ball hashing: to the
    one whose fingerprints most texts share. Of the copies of a template that is the one most like it, in
    all fingerprints. So these repeat few links instead of making others, and most links hold.
    """
    entries = distinct.select("fp", F.posexplode("prints").alias("band", "print")).select("fp", F.col("band").cast("bigint").alias("band"), "print")
    counts = written(entries.groupBy("band", "print").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")))
    sharing = written(entries.join(counts.where("n > 1").drop("head"), ["band", "print"]))
    ranks = written(sharing.groupBy("fp").agg(F.sum("n").alias("rank")))
    ranked = sharing.join(ranks, "fp").groupBy("band", "print").agg(F.max(F.struct("rank", "fp")).alias("top"))
    ranked = written(ranked.select("band", "print", F.col("top.fp").alias("head"), F.col("top.rank").alias("rank")))
    heads = written(ranked.unionByName(counts.where("n = 1").drop("n").join(ranks.withColumnRenamed("fp", "head"), "head", "left").fillna(0, "rank")))
    shared = sharing.join(ranked, ["band", "print"]).where("fp != head").select(F.least("head", "fp").alias("a"), F.greatest("head", "fp").alias("b"))
    count = heads.where("band = 0").count()
    lead = lead_bits(count, PRINT_BITS, PRINT_RADIUS, MIN_PRINT_LEAD)
    near = written(links(heads.select("band", F.col("print").alias("fp"), "rank"), count, ["band"], lead, PRINT_BITS, PRINT_RADIUS))
    head = lambda c: heads.select("band", F.col("print").alias(c), F.col("head").alias(f"_{c}"))
    crossed = near.join(head("a"), ["band", "a"]).join(head("b"), ["band", "b"]).select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return shared.unionByName(crossed.where("a < b")).distinct()


def apart_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of one group but different roots that can be similar enough; ``members (group, root, fp, hashes)``.

    Hashes are put in order, the rare ones of the group first. Of two sets that are similar enough, the
    smaller has one of its first hashes, as many as it may lack, among the first of the larger.
    Hashes that no other member has can be in no pair. So texts that differ from all others in
    their own way meet none of them, however many have the same template. Each hash sets a bit of its
    text's signature: for a bit that the other text lacks, one hash at least is not shared.
    """
    tokens = members.select("group", "root", "fp", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    held = tokens.groupBy("group", "token").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    texts = tokens.join(held, ["group", "token"]).groupBy("group", "root", "fp", "n")
    words = [f"w{i}" for i in range(SIGN_WORDS)]
    bit = lambda i: F.expr(f"bit_or(if(pmod(shiftright(token, 6), {SIGN_WORDS}) = {i}, shiftleft(1L, int(token & 63)), 0L))")
    texts = texts.agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("shared"), *[bit(i).alias(w) for i, w in enumerate(words)])
    texts = texts.withColumn("s", F.size("shared"))
    # The hashes that no other has come first, n - s of them.
    least = lambda share: F.ceil(F.col("n") * share - _EVEN).cast("int")
    both = 2 * similarity / (1 + similarity)
    firsts = texts.withColumn("first", F.col("s") - least(similarity) + 1).where("first > 0")
    firsts = firsts.select("group", "root", "fp", "n", "s", *words, (F.col("s") - least(both) + 1).alias("own"), F.posexplode(F.slice("shared", 1, F.col("first"))).alias("at", "t"))
    rows = written(firsts.select("group", F.col("t.token").alias("token"), "root", "fp", "n", "s", *words, "at", (F.col("at") < F.col("own")).alias("own")))
    roots = rows.groupBy("group", "token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("group", "token")
    mixed = roots.agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    # Members of the most frequent root meet those of other roots only.
    side = lambda c: rows.select("group", "token", *[F.col(x).alias(f"{c}_{x}") for x in ("root", "fp", "n", "s", *words, "at", "own")])
    others = side("a").join(mixed, ["group", "token"]).where("a_root != main").drop("main")
    p, q = F.struct("a_n", "a_fp"), F.struct("b_n", "b_fp")
    need = (F.col("a_n") + F.col("b_n")) * (both / 2) - _EVEN
    most = F.least("a_at", "b_at") + F.least(F.col("a_s") - F.col("a_at"), F.col("b_s") - F.col("b_at"))
    lacks = lambda c, d: sum((F.bit_count(F.col(f"{c}_{w}").bitwiseAND(F.bitwise_not(F.col(f"{d}_{w}")))) for w in words), F.lit(0))
    fits = (
        (F.col("a_root") != F.col("b_root"))
        & F.when(p < q, F.col("a_own")).otherwise(F.col("b_own"))
        & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - _EVEN)
        & (most >= need)
        & (F.least(*[F.col(f"{c}_s") - lacks(c, d) for c, d in ("ab", "ba")]) >= need)
    )
    same = (F.col("a.group") == F.col("b.group")) & (F.col("a.token") == F.col("b.token"))
    pairs = others.alias("a").join(side("b").alias("b"), same & fits)
    return pairs.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()


def similar_roots(docs: DataFrame, distinct: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``components`` of the shingle sets ``distinct (fp, text_hash, prints)`` at ``similarity`` or more.

    Texts that balls link are compared first. In groups that balls connect but comparisons do not,
    ``apart_pairs`` finds the pairs left, so a large group of copies takes a few comparisons per member.
    """
    met = written(ball_links(distinct))
    hashed = F.pandas_udf(lambda text: pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in text], dtype=object), "array<bigint>")
    wanted = distinct.select("fp", "text_hash").join(met.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(wanted, "text_hash")
    sets = written(texts.groupBy("fp").agg(F.first("text").alias("text")).select("fp", hashed("text").alias("hashes")))
    first = written(similar(met, sets, similarity))
    roots = components(first.where("near"))
    linked = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    groups = components(linked.unionByName(first.where("not near").select("a", "b"))).select(F.col("vertex").alias("fp"), F.col("root").alias("group"))
    named = wanted.select("fp").join(groups, "fp", "left").join(roots.withColumnRenamed("vertex", "fp"), "fp", "left")
    named = named.select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("root", "fp").alias("root"))
    mixed = named.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("group")
    apart = written(named.join(mixed, "group", "left_semi").join(sets, "fp"))
    rest = apart_pairs(apart, similarity).join(first, ["a", "b"], "left_anti")
    second = written(similar(rest, sets, similarity).where("near"))
    return roots if second.isEmpty() else components(linked.unionByName(second.select("a", "b")))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, text_hash, root, component_id``; ``fp`` is signed.

    Without ``similarity``, texts link when their fingerprints differ in at most ``RADIUS`` bits;
    null and wordless texts have fingerprint zero and link like any other. With it, texts link
    when the Jaccard similarity of their sets of shingles is at least that, ``fp`` is a hash of the
    set, and null and wordless texts have the empty set and link with each other only; candidates
    are found by balls around ``PRINTS`` fingerprints. ``root`` is the smallest ``fp`` of a group, ``component_id``
    the smallest ``doc_id`` reachable (null if there is none). An empty table gives an empty result; further columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if similarity is None:
        prints = F.pandas_udf(lambda text: pd.Series(np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64)), "bigint")
        marked = written(docs.select("doc_id", prints(text).alias("fp"), F.xxhash64(text).alias("text_hash")))
        distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
        roots = components(links(distinct, distinct.count()))
    else:

        @F.pandas_udf("fp bigint, prints array<bigint>")
        def printed(text: pd.Series) -> pd.DataFrame:
            sets, prints = [], []
            for t in text:
                hashes = np.unique(shingle_hashes(t, shingle))
                sets.append(_set_id(hashes))
                prints.append(prints_of(hashes))
            return pd.DataFrame({"fp": np.array(sets, np.int64), "prints": prints})

        whole = docs.select("doc_id", printed(text).alias("_set"), F.xxhash64(text).alias("text_hash"))
        marked = written(whole.select("doc_id", "_set.fp", "_set.prints", "text_hash"))
        # Texts of one set differ in white space and letter case only, so any of them stands for it.
        some = F.min_by(F.struct("text_hash", "prints"), "text_hash").alias("some")
        distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), some).select("fp", "first_id", "some.*"))
        roots = similar_roots(docs, distinct, shingle, similarity)
    named = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "root", "component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def drop_near(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group of ``near_groups``: the one with the smallest ``doc_id``.

    Of several texts with that ``doc_id``, and in a group without any, the one with the smallest hash stays. Rows that repeat both
    ``doc_id`` and text are one document and stay or go together.
    """
    groups = written(near_groups(docs, shingle, similarity))
    # An id may stand in several groups, so the kept text is chosen by group.
    named = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keys = named.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash").distinct()
    keys = keys.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("text_hash").alias("_hash"))
    own = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.col("doc_id").isNull().alias("_none"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_hash"),
    )
    return own.join(keys, ["_id", "_none", "_hash"], "left_semi").select("_row.*")


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
