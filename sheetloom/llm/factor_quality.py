"""Quality of texts by a factorisation machine.

A text's features are its hashed words, statistics of its structure, and columns that describe it,
the latter two as steps of a logarithmic scale. Every feature has a weight and a vector of
``FACTORS`` numbers; the score adds the weights and the dot products of the vectors of all pairs of
features. The pairs are never formed: for each factor, half the difference of the square of the
sum and the sum of the squares gives the same in time linear in the features.

The model is learnt from a bounded sample of labelled rows in rounds. In each round every block of
the sample goes through some steps of its own, and the blocks' parameters are averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import table, written

#: Bound of the labelled rows of each class that the model is fitted on, and rows of a block.
SAMPLE_PER_CLASS = 8_000
BLOCK_ROWS = 2_000
WORD_BUCKETS = 1 << 13
STEPS = 24
FACTORS = 6
ROUNDS = 4
EPOCHS = 3
RATE = 0.15
SHRINK = 2e-3
KEEP = 0.7
_KNOWN_WORDS = 200_000
_PLAIN = b".,;:!?'\"()-"
_STAT_NAMES = (
    "upper digits spaces symbols plain foreign repeated_words top_word neighbours repeated_lines word_length line_length ends words exclaims".split()
)


def _shares() -> np.ndarray:
    """For each of the 256 bytes, whether it is upper case, digit, space, other symbol, plain mark, or not ASCII."""
    code = np.arange(256)
    upper, digit = (code >= 65) & (code <= 90), (code >= 48) & (code <= 57)
    letter = upper | (code >= 97) & (code <= 122)
    space = (code == 32) | (code >= 9) & (code <= 13)
    plain = np.isin(code, list(_PLAIN))
    foreign = code >= 128
    return np.stack([upper, digit, space, ~(letter | digit | space | plain | foreign), plain, foreign], axis=1).astype(float)


_SHARES = _shares()


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Statistics of a text in the order of ``_STAT_NAMES``: shares from 0 to 1, and means and sizes from 0 up."""
    raw = text.encode("utf-8", "replace")
    of_bytes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _SHARES / max(1, len(raw))
    n = max(1, len(words))
    lines = text.split("\n")
    return [
        *of_bytes.tolist(),
        1.0 - len(counts) / n if words else 0.0,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1.0 - len(set(lines)) / len(lines),
        sum(map(len, words)) / n,
        n / len(lines),
        sum(not w[-1].isalnum() for w in words) / n,
        float(len(words)),
        sum(w.endswith("!") for w in words) / n,
    ]


_IS_SIZE = np.array([name in ("word_length", "line_length", "words") for name in _STAT_NAMES])


def scale_steps(stats: list[float]) -> np.ndarray:
    """The step of each statistic: shares by doublings from a thousandth, sizes by half doublings."""
    value = np.array(stats)
    step = np.where(_IS_SIZE, 2 * np.log2(1 + value), 2 * np.log2(1 + 1023 * np.where(_IS_SIZE, 0, value)))
    return np.minimum(step.astype(np.int64), STEPS - 1)


def _metadata_step(value: float | None) -> int:
    """Null, zero or less, or a doubling of a column's value."""
    if value is None or value != value:
        return 0
    return min(STEPS - 1, 1 + int(np.log2(1 + max(0.0, float(value)))))


class Features:
    """Feature numbers and values of texts; words are hashed once while they are remembered."""

    def __init__(self, n_metadata: int) -> None:
        from xxhash import xxh32_intdigest

        class Known(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= _KNOWN_WORDS:
                    self.clear()
                self[word] = at = xxh32_intdigest(word.encode("utf-8", "replace")) % WORD_BUCKETS
                return at

        self.known = Known()
        own = len(_STAT_NAMES) + n_metadata
        self.base = WORD_BUCKETS + STEPS * np.arange(own)
        self.value = np.full(own, 1.0 / np.sqrt(own))

    def __call__(self, text: str, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
        """All features of a text: the words' values have the length 1, and so have the others'."""
        words = text.split()
        counts = Counter(map(str.lower, words))
        at = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        size = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        size /= max(1e-9, float(np.sqrt(size @ size)))
        steps = np.concatenate([scale_steps(structure(text, words, counts)), [_metadata_step(m) for m in metadata]]).astype(np.int64)
        return np.concatenate([at, self.base + steps]), np.concatenate([size, self.value])


@dataclass
class Machine:
    """Bias, weights and factors (one row per feature)."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    @classmethod
    def empty(cls, n_features: int, bias: float) -> Machine:
        # Factors must start apart from each other, and alike in every run.
        start = np.random.default_rng(1).normal(0.0, 0.05, (n_features, FACTORS))
        return cls(bias, np.zeros(n_features), start)

    def raw(self, at: np.ndarray, value: np.ndarray) -> float:
        """The score before the logistic function, of one text."""
        own = self.factor[at] * value[:, None]
        total = own.sum(axis=0)
        return float(self.bias + self.weight[at] @ value + 0.5 * (total @ total - (own * own).sum()))

    def probability(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(at, value), -30.0, 30.0))))


def train_block(start: Machine, at: list[np.ndarray], value: list[np.ndarray], label: np.ndarray, share: np.ndarray, epochs: int, seed: int) -> Machine:
    """Steps of adaptive gradient descent over the rows of a block; ``share`` weighs the rows."""
    machine = Machine(start.bias, start.weight.copy(), start.factor.copy())
    n, k = len(machine.weight), FACTORS
    sums_w, sums_f, sum_b = np.full(n, 1e-2), np.full((n, k), 1e-2), 1e-2
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for chosen in np.array_split(order.permutation(len(label)), max(1, len(label) // 100)):
            row = np.repeat(np.arange(len(chosen)), [len(at[i]) for i in chosen])
            a, x = np.concatenate([at[i] for i in chosen]), np.concatenate([value[i] for i in chosen])
            used, a = np.unique(a, return_inverse=True)
            w, f = machine.weight[used], machine.factor[used]
            own = f[a] * x[:, None]
            total = np.stack([np.bincount(row, own[:, j], len(chosen)) for j in range(k)], axis=1)
            raw = machine.bias + np.bincount(row, w[a] * x, len(chosen)) + 0.5 * ((total * total).sum(axis=1) - np.bincount(row, (own * own).sum(axis=1), len(chosen)))
            off = share[chosen] * (1.0 / (1.0 + np.exp(-np.clip(raw, -30, 30))) - label[chosen])
            each = off[row] * x
            grad_w = np.bincount(a, each, len(used)) + SHRINK * w
            inner = each[:, None] * (total[row] - own)
            grad_f = np.stack([np.bincount(a, inner[:, j], len(used)) for j in range(k)], axis=1) + SHRINK * f
            grad_b = float(off.sum())
            sums_w[used] += grad_w**2
            sums_f[used] += grad_f**2
            sum_b += grad_b**2
            machine.weight[used] = w - RATE * grad_w / np.sqrt(sums_w[used])
            machine.factor[used] = f - RATE * grad_f / np.sqrt(sums_f[used])
            machine.bias -= RATE * grad_b / np.sqrt(sum_b)
    return machine


def held_out(doc_id: Column | str) -> Column:
    """Whether CRC-32 of the id as text, modulo 4, is 2; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` outside the held-out quarter; the largest of several labels counts, nulls do not."""
    given = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    return given.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))


def _inputs(docs: DataFrame, metadata: tuple[str, ...]) -> list[Column]:
    """The only columns that a score depends on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    return [text, F.array(*(F.col(c).cast("double") for c in metadata)).cast("array<double>").alias("_metadata")]


def labelled_features(docs: DataFrame, given: DataFrame, metadata: tuple[str, ...], per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``order, label, at, value`` of at most ``per_class`` documents of each class of ``labelled``, chosen by a hash of the id."""
    by_class = [given.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = written(by_class[0].unionByName(by_class[1]))
    own = docs.select(F.col("doc_id").alias("_id"), *_inputs(docs, metadata))
    # At most 2 * per_class rows of two numbers.
    sample = own.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select(F.xxhash64("doc_id", "_text").alias("order"), "label", "_text", "_metadata")
    n_metadata = len(metadata)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(n_metadata)
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            found = [features(t.as_py(), m.as_py()) for t, m in zip(column("_text"), column("_metadata"), strict=True)]
            at, value = pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column("order"), column("label"), at, value], names=["order", "label", "at", "value"])

    return sample.mapInArrow(describe, "order bigint, label int, at array<int>, value array<double>")


def _trainer(sent: Broadcast, share: np.ndarray, r: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a block of the sample does in round ``r`` from the sent machine on."""

    def train(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # The order of arrival differs between runs.
        rows = rows.sort_values("order", kind="stable")
        label = rows["label"].to_numpy(float)
        out = train_block(sent.value, list(rows["at"]), list(rows["value"]), label, share[label.astype(int)], EPOCHS, 1_000 * r + int(key[0]))
        return pd.DataFrame({"block": [key[0]], "bias": [out.bias], "weight": [out.weight.tobytes()], "factor": [out.factor.tobytes()]})

    return train


def fit(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), per_class: int = SAMPLE_PER_CLASS, rounds: int = ROUNDS) -> Machine:
    """A machine learnt from at most ``per_class`` labelled rows of each class.

    Rows count as much as their class has among all labels, so that scores are probabilities.
    Without labels of both classes every text has nearly the share of label 1 as its score, and
    without any label 0.9.
    """
    given = labelled(labels)
    seen = given.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    rate = (seen["n1"] + 0.9) / (seen["n"] + 1.0)
    machine = Machine.empty(WORD_BUCKETS + STEPS * (len(_STAT_NAMES) + len(metadata)), float(np.log(rate / (1.0 - rate))))
    sample = written(labelled_features(docs, given, metadata, per_class))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        machine.factor[:] = 0.0
        return machine
    n = sum(sizes.values())
    share = np.array([(1.0 - rate) * n / sizes[0], rate * n / sizes[1]])
    blocked = sample.withColumn("block", F.pmod("order", F.lit(max(1, round(n / BLOCK_ROWS)))).cast("int"))
    for r in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(machine)

        # A row of fixed size per block, of which the bound of the sample allows few.
        done = sorted(blocked.groupBy("block").applyInPandas(_trainer(sent, share, r), "block int, bias double, weight binary, factor binary").collect())
        mean = lambda column, rows=done: np.mean([np.frombuffer(row[column]) for row in rows], axis=0)
        machine = Machine(float(np.mean([row["bias"] for row in done])), mean("weight"), mean("factor").reshape(-1, FACTORS))
        sent.unpersist()
    return machine


def score_with(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ("n_chars",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and ``score``, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names, kinds, n_metadata = [f"_k{i}" for i in range(len(keep))], dict(docs.dtypes), len(metadata)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, features = sent.value, Features(n_metadata)
        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            found = [own.probability(*features(t.as_py(), m.as_py())) for t, m in zip(column("_text"), column("_metadata"), strict=True)]
            yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(found, pa.float64())], names=[*names, "score"])

    inputs = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), *_inputs(docs, metadata))
    scored = inputs.mapInArrow(score, ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keep, strict=True)), "score double"]))
    return scored.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "score")


def score_documents(docs: DataFrame, labels: DataFrame, metadata: tuple[str, ...] = ("n_chars",), per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, with a machine fitted on ``labels``.

    Null texts count as empty, null numbers of ``metadata`` as unknown. Rows with equal texts and
    equal metadata have equal scores, and no other column is read. Repeated rows are scored each;
    an empty table gives an empty result.
    """
    scored = score_with(docs, fit(docs, labels, metadata, per_class), metadata)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def op13_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labelled ones."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
