"""Context-tree weighting over bytes: code length of texts under a model of the training texts.

A byte is eight binary decisions. Each decision has a Krichevsky-Trofimov estimate in the contexts
of the last 0 to ``DEPTH`` bytes, and every context weighs its own estimate against that of its
longer contexts by how well each coded the training texts. Since the trained model stands still,
the probability of a byte after ``DEPTH`` bytes is one number per *gram* of ``DEPTH + 1`` bytes.

The work is one count of the grams and words of all blocks of documents, one pass over the counted
grams, and one pass over the texts, which meet the numbers of the grams and words of their own
block. Nothing that grows with the corpus is collected or broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.shared import table, tidy, written

DEPTH = 5
END = b""
_SEP, _CLOSE = b" ", b"\n"
#: Text bytes of a block, and entries of a count that a task holds before it passes them on.
BLOCK_BYTES = 24_000_000
HELD = 1_000_000
_CHUNK = 1_000_000
_PART = 1 << 18
#: Grams that are scored together, and parts of the contexts that share their last two bytes.
GROUP_GRAMS = 100_000
_SPLIT = 16
#: In place of a gram, of a word that training texts have.
_SEEN = -2


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; null has none."""
    return (text or "").encode().lower().split()


def stream_of(words: list[bytes]) -> bytes:
    """The bytes that stand for a text: its words with single spaces, closed, after a start context of closings."""
    return _CLOSE * DEPTH + _SEP.join(words) + _CLOSE


def grams_of(raw: bytes) -> np.ndarray:
    """Each byte of a stream with the ``DEPTH`` bytes before it, as one number, in order."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - DEPTH
    out = np.zeros(n, np.int64)
    for i in range(DEPTH + 1):
        out = (out << 8) | data[i : i + n]
    return out


class GramTable:
    """Numbers of the known grams, found by hashing with linear probing."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        # A gram that was passed on in parts comes several times with the same number.
        self.power = max(4, (2 * len(grams)).bit_length())
        self.keys, self.values = np.full(1 << self.power, -1, np.int64), np.zeros(1 << self.power)
        slot = self._slot(grams)
        while grams.size:
            free = self.keys[slot] < 0
            self.keys[slot[free]] = grams[free]
            own = self.keys[slot] == grams
            self.values[slot[own]] = values[own]
            grams, values, slot = grams[~own], values[~own], self._next(slot[~own])

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.power)).view(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.power) - 1)

    def _numbers(self, grams: np.ndarray) -> np.ndarray:
        slot = self._slot(grams)
        wrong = np.flatnonzero(self.keys[slot] != grams)
        while wrong.size:
            if (self.keys[slot[wrong]] < 0).any():
                raise KeyError("gram that was not counted")
            slot[wrong] = self._next(slot[wrong])
            wrong = wrong[self.keys[slot[wrong]] != grams[wrong]]
        return self.values[slot]

    def look_up(self, raw: bytes) -> np.ndarray:
        """Numbers of the grams of a stream, in order, a part of the stream at a time."""
        out = np.empty(len(raw) - DEPTH)
        for at in range(0, len(out), _PART):
            part = raw[at : at + _PART + DEPTH]
            out[at : at + _PART] = self._numbers(grams_of(part))
        return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_rising(n0) + _log_rising(n1) - _log_factorial(n0 + n1)


_TABLE_HALF = np.concatenate(([0.0], np.cumsum(np.log(np.arange(4096) + 0.5))))
_TABLE_ONE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(4096) + 1.0))))


def _stirling(z: np.ndarray) -> np.ndarray:
    """Log gamma of large arguments."""
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3)


def _log_rising(n: np.ndarray) -> np.ndarray:
    """Log of (1/2)(3/2)...(n - 1/2)."""
    small = _TABLE_HALF[np.minimum(n, 4096).astype(np.int64)]
    return np.where(n <= 4096, small, _stirling(n + 0.5) - 0.5 * np.log(np.pi))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    small = _TABLE_ONE[np.minimum(n, 4096).astype(np.int64)]
    return np.where(n <= 4096, small, _stirling(n + 1.0))


class _Level:
    """Decisions of all contexts of one depth: keys (context, node), counts, and their coding probabilities."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> None:
        """``below``: log probability of the longer contexts, by row; none at the full depth."""
        self.keys, at = np.unique(keys, return_inverse=True)
        size = len(self.keys)
        self.n0, self.n1 = np.bincount(at, n0, size), np.bincount(at, n1, size)
        own = _log_kt(self.n0, self.n1)
        if below is None:
            self.log_w, self.share = own, np.ones(size)
        else:
            longer = np.bincount(at, below, size)
            self.log_w = np.logaddexp(own, longer) - np.log(2)
            # Weight of the own estimate against that of the longer contexts.
            self.share = 1.0 / (1.0 + np.exp(np.clip(longer - own, -700, 700)))

    def mix(self, keys: np.ndarray, bit: np.ndarray, p: np.ndarray | None) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        n0, n1 = self.n0[at], self.n1[at]
        own = (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        return own if p is None else self.share[at] * own + (1.0 - self.share[at]) * p


def _decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, node and bit of the eight decisions of each gram, one decision after the other."""
    byte = grams & 255
    nodes = np.concatenate([(1 << j) | (byte >> (8 - j)) for j in range(8)])
    bits = np.concatenate([(byte >> (7 - j)) & 1 for j in range(8)])
    return np.tile(grams >> 8, 8), nodes, bits


def _key(context: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    return ((context & ((1 << (8 * depth)) - 1)) << 8) | node


def _lower_levels(context: np.ndarray, node: np.ndarray, bit: np.ndarray, n: np.ndarray, least: int) -> dict[int, _Level]:
    """Levels from the full depth down to ``least``."""
    levels: dict[int, _Level] = {}
    n0, n1, keys, below = np.where(bit == 0, n, 0.0), np.where(bit == 1, n, 0.0), _key(context, node, DEPTH), None
    for depth in range(DEPTH, least - 1, -1):
        level = levels[depth] = _Level(keys, n0, n1, below)
        n0, n1, below = level.n0, level.n1, level.log_w
        keys = _key(level.keys >> 8, level.keys & 255, max(depth - 1, 0))
    return levels


def gram_scores(counts: DataFrame, rows: int) -> DataFrame:
    """``gram, value``: log10 of the probability of each counted gram's byte in its context.

    ``counts`` has ``rows`` rows ``gram, n``; grams that were not met in training have 0. Contexts
    that share their last three bytes are worked on together, in as many groups as ``rows`` asks
    for, so that a frequent ending of two bytes is spread. Contexts of two bytes are summed up over
    the groups and sent back to those that hold them; shorter ones are at most 65,536 rows.
    """
    endings = max(1, -(-rows // (GROUP_GRAMS * _SPLIT)))
    ending = lambda context: F.pmod(F.hash(context.bitwiseAND(F.lit(0xFFFF))), F.lit(endings))
    part = F.pmod(F.hash(F.shiftright("gram", 24).bitwiseAND(F.lit(0xFF))), F.lit(_SPLIT))
    groups = counts.withColumn("ending", ending(F.shiftright("gram", 8))).withColumn("part", part).groupBy("ending", "part")
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "log_w")]
    kind = "key bigint, n0 double, n1 double, log_w double"

    def longer(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, _Level]]:
        context, node, bit = _decisions(group["gram"].to_numpy(np.int64))
        return context, node, bit, _lower_levels(context, node, bit, np.tile(group["n"].to_numpy(float), 8), 3)

    def shorter(rows: pd.DataFrame) -> _Level:
        return _Level(rows["key"].to_numpy(np.int64), rows["n0"].to_numpy(float), rows["n1"].to_numpy(float), rows["log_w"].to_numpy(float))

    def handed_on(level: _Level, depth: int) -> pd.DataFrame:
        # By what the next shorter context and the node leave of the key.
        return pd.DataFrame({"key": level.keys & ((1 << 8 * depth) - 1), "n0": level.n0, "n1": level.n1, "log_w": level.log_w})

    pairs = written(groups.applyInPandas(lambda group: handed_on(longer(group)[3][3], 3), kind).groupBy("key").agg(*sums))
    top = pairs.mapInPandas(lambda batches: (handed_on(shorter(b), 2) for b in batches), kind).groupBy("key").agg(*sums).toPandas()
    one = shorter(top)
    sent = counts.sparkSession.sparkContext.broadcast((one, _Level(one.keys & 255, one.n0, one.n1, one.log_w)))
    meeting = pairs.withColumn("ending", ending(F.shiftright("key", 8))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_SPLIT - 1))))

    def score(group: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        own, root = sent.value
        context, node, bit, levels = longer(group)
        levels |= {2: shorter(two), 1: own, 0: root}
        p = None
        for depth in range(DEPTH, -1, -1):
            p = levels[depth].mix(_key(context, node, depth), bit, p)
        return pd.DataFrame({"gram": group["gram"], "value": np.log10(p).reshape(8, -1).sum(axis=0)})

    # Parts without grams hold contexts only; their rows have nothing to score.
    either = lambda group, two: score(group, two) if len(group) else pd.DataFrame({"gram": [], "value": []})
    return groups.cogroup(meeting.groupBy("ending", "part")).applyInPandas(either, "gram bigint, value double")


def held_out(doc_id: Column | str) -> Column:
    """Whether CRC-32 of the id as text, modulo 5, is 1; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and summed counts of several lists."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


class _BlockCount:
    """Words and grams of a block, with how often training texts have them."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: dict[bool, list[bytes]] = {True: [], False: []}
        self.size = 0

    def add(self, tokens: list[bytes], out: bool) -> None:
        if out:
            for word in {*tokens, END}:
                self.words.setdefault(word, 0)
        else:
            self.words.update(tokens)
            self.words[END] += 1
        stream = stream_of(tokens)
        self.waiting[out].append(stream)
        self.size += len(stream)

    def settle(self) -> int:
        """Count the waiting streams; returns the number of words and grams."""
        for out, streams in self.waiting.items():
            if streams:
                keys, n = np.unique(np.concatenate([grams_of(s) for s in streams]), return_counts=True)
                self.grams.append((keys, n * (not out)))
        self.waiting, self.size = {True: [], False: []}, 0
        self.grams = [_together(self.grams)] if self.grams else []
        return len(self.words) + sum(len(k) for k, _ in self.grams)

    def batch(self, block: int) -> pa.RecordBatch:
        keys, counts = self.grams[0] if self.grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        words = pa.array(list(self.words), pa.binary())
        names = pa.concat_arrays([words, pa.nulls(len(keys), pa.binary())])
        numbers = np.concatenate([np.full(len(words), -1, np.int64), keys])
        n = np.concatenate([np.fromiter(self.words.values(), np.int64, len(words)), counts])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block, np.int64)), names, pa.array(numbers), pa.array(n)], names=["block", "word", "gram", "n"])


def _count_blocks(batches: Iterator[pa.RecordBatch], most: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Counts of each block. A block may be passed on in parts; sums and numbers of a key stay the same."""
    blocks: dict[int, _BlockCount] = {}
    for batch in batches:
        column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
        for block, out, text in zip(column("block").to_numpy().tolist(), column("held").to_pylist(), column("text"), strict=True):
            own = blocks.setdefault(block, _BlockCount())
            own.add(words_of(text.as_py()), out)
            if (own.size >= chunk or len(own.words) >= most) and own.settle() >= most:
                yield blocks.pop(block).batch(block)
    for block, own in blocks.items():
        own.settle()
        yield own.batch(block)


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` for every row of ``docs``.

    The model learns from the rows that are not held out; null texts count as empty and have the
    end as their only token. Scores are log10 probabilities: ``base_score`` of the tokens by
    their counts, ``score`` of the byte stream by context-tree weighting; code length per byte
    is ``-score * log2(10) / n_bytes``. An empty table gives an empty result; further columns are
    not read. ``docs`` must be a stored table, as its partitions are the blocks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(1, docs.select("text").rdd.getNumPartitions())
    fold = max(1, round(size / parts / BLOCK_BYTES))
    block = (F.spark_partition_id() * F.lit(fold) + F.pmod(F.hash("doc_id", F.length(text)), F.lit(fold))).cast("int")
    own = docs.select("doc_id", text.alias("text"), held_out("doc_id").alias("held"), block.alias("block"))

    most, chunk = HELD, _CHUNK
    counted = own.select("block", "held", "text").mapInArrow(tidy(lambda b: _count_blocks(b, most, chunk)), "block bigint, word binary, gram bigint, n bigint")
    same = Window.partitionBy("word", "gram")
    ranked = Window.partitionBy("word", "gram").orderBy("block")
    summed = written(counted.withColumn("c", F.sum("n").over(same)).withColumn("first", F.row_number().over(ranked) == 1).select("block", "word", "gram", "c", "first"))
    once = summed.where("first")
    word = F.col("gram") < 0
    totals = once.agg(
        F.coalesce(F.sum(F.when(word, F.col("c"))), F.lit(0)).alias("n"), F.count(F.when(word & (F.col("c") > 0), 1)).alias("v"), F.count(F.when(~word, 1)).alias("grams")
    ).first()
    n_all, n_kinds = int(totals["n"]), int(totals["v"])
    values = gram_scores(once.where("gram >= 0").select("gram", F.col("c").alias("n")), int(totals["grams"]))
    gram_rows = summed.where("gram >= 0").select("block", "gram").join(values, "gram").select("block", F.lit(None).cast("binary").alias("word"), "gram", "value")
    word_value = F.log10((F.col("c") + F.lit(0.5)) / F.lit(n_all + 0.5 * (n_kinds + 1)))
    # Words of training texts have another number, as equal logs need not be equal to the last bit.
    seen = F.when(F.col("c") > 0, F.lit(_SEEN)).otherwise(F.col("gram")).alias("gram")
    word_rows = summed.where("gram < 0").select("block", "word", seen, word_value.alias("value"))
    numbers = gram_rows.unionByName(word_rows).withColumn("kind", F.lit(0))
    id_type = dict(docs.dtypes)["doc_id"]
    texts = own.select(F.col("block").cast("bigint").alias("block"), F.lit(1).alias("kind"), "doc_id", "text", "held")
    # One task for each block.
    both = numbers.unionByName(texts, allowMissingColumns=True)
    together = both.repartitionById(parts * fold, F.col("block").cast("int")).sortWithinPartitions("block", "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known, unseen, grams, logs, lookup = None, {}, set(), [], [], None
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            of_block, kinds = column("block").to_numpy(), column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(of_block) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(of_block)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if of_block[a] != now:
                    now, known, unseen, grams, logs, lookup = of_block[a], {}, set(), [], [], None
                if kinds[a] == 0:
                    gram, value = column("gram").slice(a, b - a).to_numpy(), column("value").slice(a, b - a).to_numpy()
                    is_gram = gram >= 0
                    grams.append(gram[is_gram])
                    logs.append(value[is_gram])
                    words = column("word").slice(a, b - a).to_pylist()
                    known.update((w, v) for w, v in zip(words, value.tolist(), strict=True) if w is not None)
                    unseen.update(w for w, n in zip(words, gram.tolist(), strict=True) if w is not None and n != _SEEN)
                    continue
                if lookup is None:
                    lookup = GramTable(np.concatenate(grams), np.concatenate(logs))
                    grams, logs = [], []
                out = []
                for text in column("text").slice(a, b - a):
                    tokens = words_of(text.as_py())
                    stream = stream_of(tokens)
                    tokens.append(END)
                    each = np.fromiter(map(known.__getitem__, tokens), float, len(tokens))
                    out.append((len(tokens), len(tokens) - sum(map(unseen.__contains__, tokens)), float(each.sum()), float(lookup.look_up(stream).sum()), len(stream) - DEPTH))
                n_tokens, n_known, base, model, n_bytes = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        column("doc_id").slice(a, b - a), column("held").slice(a, b - a), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                        pa.array([n_all] * (b - a), pa.int64()), pa.array(base), pa.array(model), pa.array(n_bytes, pa.int64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
                )

    return together.mapInArrow(
        tidy(score), f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
    )


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
