"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is its log-odds ratio between toxic and other documents under a Dirichlet prior
taken from both; tokens without clear evidence score a little below zero. Every maximal segment
of a text is found in one scan, its chance under clean text follows the extreme-value law of
segment scores, and a document's probability is a logistic function of these chances.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sheetloom.llm.shared import table, tidy, written

#: Bound of the labelled rows of each class that the model is fitted on.
SAMPLE_PER_CLASS = 8_000
PRIOR = 50.0
#: Clear evidence: standard errors above zero, and log-odds left after two of them.
MIN_Z = 3.5
MIN_LOW = 0.7
#: Documents that must hold a feature before it decides over a token.
MIN_DOCS = 5
DRIFT = 0.15
MAX_E = 0.01
PREFIXES = (4, 5, 6)
_KNOWN_TOKENS = 100_000
_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _TOKEN.findall(text.lower())


def token_features(token: str) -> list[str]:
    """The token itself and its first letters, longest first, so that unseen forms of a known stem are known."""
    return [token] + [token[:n] + "^" for n in reversed(PREFIXES) if len(token) > n]


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass.

    A list of candidates is kept; each remembers the nearest earlier one that began at a lower
    running sum, so a candidate is looked at a bounded number of times.
    """
    sums = np.concatenate(([0.0], np.cumsum(values)))
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(values > 0).tolist():
        start, low, high = i, float(sums[i]), float(sums[i + 1])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                found.append((start, i + 1, low, high, at))
                break
            start, _, low, _, link = found[at]
            del found[at:]
            at = link
    return [(s, e, high - low) for s, e, low, high, _ in found]


@dataclass
class Model:
    """Feature scores and the constants of the extreme-value law and of the logistic function."""

    features: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def token_scores(self) -> dict[str, float]:
        """A growing table of token scores; it is emptied when it holds very many.

        The most specific feature that was seen often enough decides.
        """
        features = self.features

        class Known(dict):
            def __missing__(self, token: str) -> float:
                score = next((features[f] for f in token_features(token) if f in features), -DRIFT)
                if len(self) >= _KNOWN_TOKENS:
                    self.clear()
                self[token] = score
                return score

        return Known()

    def passages(self, words: list[str], known: dict[str, float]) -> list[tuple[int, int, float, float]]:
        """Segments of a token list: start, end, score, and log of the expected number by chance."""
        if not words:
            return []
        values = np.fromiter(map(known.__getitem__, words), float, len(words))
        return [(s, e, v, self.log_k + float(np.log(len(words))) - self.rate * v) for s, e, v in maximal_segments(values)]

    def evidence(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """How surprising the best segment is, and all surprising ones together."""
        surprise = [-log_e for *_, log_e in found]
        return max(surprise, default=-10.0), float(np.log1p(sum(max(0.0, s) for s in surprise)))

    def probability(self, found: list[tuple[int, int, float, float]]) -> float:
        best, total = self.evidence(found)
        at = self.weights[0] + self.weights[1] * best + self.weights[2] * total
        return float(1.0 / (1.0 + np.exp(-np.clip(at, -30.0, 30.0))))


def _logistic(x: np.ndarray, y: np.ndarray, share1: float, shrink: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression where class 1 has the share ``share1``, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, share1 / max(1, y.sum()), (1 - share1) / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (y - p)) - shrink * w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + (shrink + 1e-6) * np.eye(len(w)), gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def remainder(doc_id: Column | str) -> Column:
    """CRC-32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` outside the held-out fifth; the largest of several labels counts, nulls do not."""
    given = labels.where((F.col("toxic").isNotNull()) & F.col("doc_id").isNotNull() & (remainder("doc_id") != 0))
    return given.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def labelled_sample(docs: DataFrame, given: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``order, text, toxic`` of at most ``per_class`` documents of each class of ``labelled``, chosen by a hash of the id."""
    by_class = [given.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = written(by_class[0].unionByName(by_class[1]))
    # At most 2 * per_class rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("order"), "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit the model on a bounded sample of labelled rows (see ``labelled_sample``).

    Three quarters of the sample give the token scores, one quarter the calibration. Of texts
    that share their smallest hash of five words, thus of nearly all copies, one counts.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for order, text, toxic in zip(batch["order"], batch["text"], batch["toxic"], strict=True):
                words = tokens(text or "")
                marks = [xxh64_intdigest(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))]
                least = min(marks)
                rows.append((least >> 1, int(order), int(toxic), len(words), least % 4 == 0, list({f for w in set(words) for f in token_features(w)}), words if least % 4 == 0 else []))
            yield pd.DataFrame(rows, columns=["mark", "order", "toxic", "n", "late", "features", "words"])

    given = labelled(labels)
    share = given.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("n1")).first()
    rate = ((share["n1"] or 0) + 0.5) / (share["n"] + 2.0)
    prior_only = (float(np.log(rate / (1 - rate))), 0.0, 0.0)
    sample = labelled_sample(docs, given, per_class).mapInPandas(
        tidy(describe), "mark bigint, order bigint, toxic int, n bigint, late boolean, features array<string>, words array<string>"
    )
    one = F.min_by(F.struct("toxic", "n", "late", "features", "words"), F.struct("order", "toxic"))
    sample = written(sample.groupBy("mark").agg(one.alias("one")).select("one.*"))
    early = sample.where("NOT late")
    sizes = {r["toxic"]: (r["docs"], r["tokens"]) for r in early.groupBy("toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens")).collect()}
    n1, n0, clean_tokens = sizes.get(1, (0, 0))[0], *sizes.get(0, (0, 0))
    if not n1 or not n0:
        return Model(weights=prior_only)
    counts = early.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("y1"), F.count(F.lit(1)).alias("y"))
    prior = F.lit(PRIOR) * F.col("y") / F.lit(n0 + n1)
    y0 = F.col("y") - F.col("y1")
    log_odds = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y - prior))
    scored = counts.where("y > 2").withColumn("delta", log_odds(F.col("y1"), n1) - log_odds(y0, n0))
    error = F.sqrt(1 / (F.col("y1") + prior) + 1 / (y0 + prior))
    scored = scored.withColumn("low", F.col("delta") - 2 * error).withColumn("clear", (F.col("delta") >= MIN_Z * error) & (F.col("low") >= MIN_LOW))
    scored = written(scored.select("feature", "low", "clear", y0.alias("y0"), "y", F.substring(F.rtrim(F.col("feature"), F.lit("^")), 1, PREFIXES[0]).alias("stem")))
    # Features of a bounded sample: the clear ones, and the others of their stems, which decide that a token is none.
    clear = scored.where("clear").collect()
    if not clear:
        return Model(weights=prior_only)
    stems = scored.where("clear").select("stem").distinct()
    others = scored.where(~F.col("clear") & (F.col("y") >= MIN_DOCS)).join(stems, "stem", "left_semi").select("feature").collect()
    model = Model({r["feature"]: -DRIFT for r in others} | {r["feature"]: float(r["low"]) for r in clear})
    delta = np.array([r["low"] for r in clear])
    chance = (np.array([r["y0"] for r in clear]) + 0.5) / (clean_tokens + 1.0)
    none = max(1e-9, 1.0 - chance.sum())
    low, high = 1e-6, 200.0 / float(delta.max())
    for _ in range(200):
        middle = (low + high) / 2
        over = none * np.exp(-middle * DRIFT) + (chance * np.exp(np.minimum(middle * delta, 700.0))).sum() > 1.0
        low, high = (low, middle) if over else (middle, high)
    model.rate = low
    late = sample.where("late")
    held = model

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.token_scores()
        for batch in batches:
            rows = []
            for words, toxic in zip(batch["words"], batch["toxic"], strict=True):
                found = held.passages(list(words), known)
                rows.append((int(toxic), len(words), [v for _, _, v, _ in found]))
            yield pd.DataFrame(rows, columns=["toxic", "n", "scores"])

    seen = late.mapInPandas(tidy(calibrate), "toxic int, n bigint, scores array<double>").toPandas()
    clean = seen[seen["toxic"] == 0]
    least = float(delta.min())
    model.log_k = float(np.log((sum(map(len, clean["scores"])) + 0.5) / ((clean["n"].sum() + 1.0) * np.exp(-model.rate * least))))
    evidence = [
        model.evidence([(0, 0, v, model.log_k + float(np.log(max(1, n))) - model.rate * v) for v in scores]) for n, scores in zip(seen["n"], seen["scores"], strict=True)
    ]
    y = seen["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        model.weights = tuple(_logistic(np.array(evidence), y, rate).tolist())
    else:
        model.weights = prior_only
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``passages``: start, end (code points, end exclusive), score and expected chance number.

    Only segments expected less than ``MAX_E`` times by chance are listed; null and empty texts have none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        known = own.token_scores()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                # Lower case can change a text's length, so tokens are found in the text itself.
                spans = [m.span() for m in _TOKEN.finditer(text or "")]
                words = [text[a:b].lower() for a, b in spans]
                found = own.passages(words, known)
                rows.append([(spans[s][0], spans[e - 1][1], v, float(np.exp(c))) for s, e, v, c in found if c < np.log(MAX_E)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "passages": rows})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(
        tidy(find), f"doc_id {dict(docs.dtypes)['doc_id']}, passages array<struct<start:int, `end`:int, score:double, expected:double>>"
    )


def probability_column(text: Column, model: Model, spark: SparkSession) -> Column:
    """Probability that a text is toxic; null and empty texts have the value of no evidence."""
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        known = own.token_scores()
        for batch in batches:
            yield pd.Series([own.probability(own.passages(tokens(t or ""), known)) for t in batch], dtype="float64")

    run = tidy(score)
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, DoubleType())(text)


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, with a model fitted on ``labels``.

    Null texts count as empty. Without labels of both classes every score is the share of toxic
    rows, below one half. An empty table gives an empty result.
    """
    model = fit(docs, labels, per_class)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scored = docs.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), probability_column(text, model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``docs`` without the rows whose text scores one half or more; all columns stay."""
    model = fit(docs, labels, per_class)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(probability_column(text, model, docs.sparkSession) < 0.5)


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labelled ones."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
