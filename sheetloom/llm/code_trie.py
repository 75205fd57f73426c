"""Compact codes of vectors: each part of a vector is replaced by the number of its nearest codebook entry.

The distinct parts of a block of vectors are a trie over their components in lexicographic order.
A node holds the distances of its prefix to all entries of the codebook, so parts with a common
prefix share that work: going down an edge adds one component's squared difference. At the leaves
the least distance gives the code, and the number of vectors weighs the leaf in its entry's sums.

Tasks send the sums of at most ``parts * entries`` entries, so no vector is shuffled; the codebooks
are of a fixed size and travel with the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.shared import table, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Scaled components beyond this are set to it, so that squared distances stay whole 64-bit numbers.
BOUND = 1 << 27
#: Vectors of one trie, and leaves whose distances are held at a time.
BLOCK = 1 << 16
LEAVES = 1 << 12


def whole_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """All columns of the rows whose vector has only finite components, and these as whole numbers in ``_whole``.

    A component x becomes floor(scale * x), within ``BOUND``. Null vectors and vectors with null,
    infinite or undefined components are dropped.
    """
    number = lambda x: x.cast("double")
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < F.lit(float("inf"))))
    bounded = lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.floor(number(x) * F.lit(float(scale))))).cast("bigint")
    return vectors.where(F.col(column).isNotNull() & finite).withColumn("_whole", F.transform(column, bounded))


def _changes(rows: np.ndarray) -> np.ndarray:
    """For sorted rows, the first column in which each differs from the row before; the first row differs from the start."""
    differs = rows[1:] != rows[:-1]
    first = np.full(len(rows), 0 if rows.shape[1] else -1, np.int64)
    if rows.shape[1]:
        first[1:] = differs.argmax(axis=1)
    return first


def _subtrie(rows: np.ndarray, entries: np.ndarray, depth: int, above: np.ndarray) -> np.ndarray:
    """Distances to all entries of sorted distinct rows that share the prefix of ``depth`` components with the distances ``above``."""
    node_distance, node_of = above[None, :], np.zeros(len(rows), np.int64)
    changes = _changes(rows[:, depth:]) + depth
    for d in range(depth, rows.shape[1]):
        starts = np.flatnonzero(changes <= d)
        step = rows[starts, d, None] - entries[None, :, d]
        node_distance = node_distance[node_of[starts]] + step * step
        node_of = np.zeros(len(rows), np.int64)
        node_of[starts[1:]] = 1
        node_of = np.cumsum(node_of)
    return node_distance[node_of]


def trie_distances(rows: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of sorted distinct rows to all entries, depth first: first row of a run, and its distances.

    Nodes with many leaves are descended; runs of smaller children are worked on at once.
    """
    waiting = [(0, len(rows), 0, np.zeros(len(entries), np.int64))] if len(rows) else []
    while waiting:
        low, high, depth, above = waiting.pop()
        if high - low <= leaves:
            yield low, _subtrie(rows[low:high], entries, depth, above)
            continue
        cuts = [low, *(low + 1 + np.flatnonzero(np.diff(rows[low:high, depth]))).tolist(), high]
        children, at = [], 0
        while at < len(cuts) - 1:
            end = at + 1
            while end < len(cuts) - 1 and cuts[end + 1] - cuts[at] <= leaves:
                end += 1
            if cuts[end] - cuts[at] <= leaves:
                children.append((cuts[at], cuts[end], depth, above))
            else:
                step = rows[cuts[at], depth] - entries[:, depth]
                children.append((cuts[at], cuts[end], depth + 1, above + step * step))
            at = end
        waiting.extend(reversed(children))


@dataclass
class Leaves:
    """Distinct parts of a block in order: components, number of vectors, nearest entry, distance, and each vector's leaf."""

    rows: np.ndarray
    weight: np.ndarray
    entry: np.ndarray
    distance: np.ndarray
    leaf_of: np.ndarray


def nearest(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> Leaves:
    """The nearest entry of every part, ties to the lower number, by a walk over the trie of the distinct parts."""
    order = np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    rows = ordered[new]
    leaf_of = np.empty(len(parts), np.int64)
    leaf_of[order] = np.cumsum(new) - 1
    entry, distance = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for low, found in trie_distances(rows, entries, leaves):
        best = found.argmin(axis=1)
        entry[low : low + len(found)] = best
        distance[low : low + len(found)] = found[np.arange(len(found)), best]
    return Leaves(rows, np.bincount(leaf_of, minlength=len(rows)), entry, distance, leaf_of)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of a task in blocks, and their vectors as a matrix."""
    held, size = [], 0

    def block() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        flat = rows.column("_whole").chunk(0).flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, np.int64)
        return rows, flat.reshape(rows.num_rows, dim)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield block()
            held, size = [], 0
    if size:
        yield block()


def _refined(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the componentwise floor of the mean of the parts it is nearest to; entries without parts stay."""
    n_parts, n_entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((n_parts, n_entries, width), np.int64), np.zeros((n_parts, n_entries), np.int64)
        for _, matrix in _blocks(batches, n_parts * width):
            for p in range(n_parts):
                own = nearest(matrix[:, p * width : (p + 1) * width], books[p])
                # Sums of a block are below 2 ** 43 and thus exact as doubles.
                count[p] += np.bincount(own.entry, own.weight, n_entries).astype(np.int64)
                for d in range(width):
                    total[p, :, d] += np.bincount(own.entry, own.weight * own.rows[:, d].astype(float), n_entries).astype(np.int64)
        at = np.flatnonzero(np.repeat(count.ravel() > 0, width))
        if at.size:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at]), pa.array(np.repeat(count.ravel(), width)[at])], names=["at", "total", "n"])

    summed = whole.select("_whole").mapInArrow(sums, "at bigint, total bigint, n bigint").groupBy("at")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    flat = books.ravel().copy()
    # One row per component of the codebooks at most.
    for row in summed.agg(exact("total"), exact("n")).collect():
        flat[row["at"]] = int(row["total"]) // int(row["n"])
    return flat.reshape(books.shape)


def fit_codebooks(whole: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of the rows of ``whole_vectors``.

    They start as the parts of the vectors with the smallest keys (nulls last, equal keys by
    their components) and are refined over all rows in each round. Rows whose length is not that
    of the first vector must have been dropped (``compress`` does so).
    """
    first = [row["_whole"] for row in whole.orderBy(F.col(key).asc_nulls_last(), "_whole").select("_whole").limit(entries).collect()]
    dim = len(first[0]) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    books = np.array(first, np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        books = _refined(whole, books)
    return books


def encode(whole: DataFrame, books: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``whole``, with ``code`` (a byte per part) and ``error`` (squared distances, summed up)."""
    n_parts, n_entries, width = books.shape
    if n_entries > 256:
        raise ValueError("a code has one byte per part, thus at most 256 entries")
    names = [f"_k{i}" for i in range(len(keep))]

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, matrix in _blocks(batches, n_parts * width):
            code, error = np.empty((len(matrix), n_parts), np.uint8), np.zeros(len(matrix), np.int64)
            for p in range(n_parts):
                own = nearest(matrix[:, p * width : (p + 1) * width], books[p])
                code[:, p] = own.entry[own.leaf_of]
                error += own.distance[own.leaf_of]
            kept = [rows.column(n).combine_chunks() for n in names]
            raw = code.tobytes()
            each = pa.array([raw[i : i + n_parts] for i in range(0, len(raw), n_parts)], pa.binary())
            for batch in pa.table([*kept, each, pa.array(error)], names=[*names, "code", "error"]).to_batches():
                yield batch

    kinds = dict(whole.dtypes)
    schema = ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(names, keep, strict=True)), "code binary, error bigint"])
    coded = whole.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), "_whole").mapInArrow(codes, schema)
    return coded.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "code", "error")


def compress(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """``key``, the columns ``keep``, ``code`` and ``error`` of every kept row, and the codebooks.

    Rows without a whole finite vector are dropped, and so are rows whose vector is not as long as
    that of the smallest key; vectors without components have a code of zeros. Rows that repeat a
    key each count. An empty table gives an empty result and codebooks without entries. A length
    that ``parts`` does not divide is an error.
    """
    whole = whole_vectors(vectors, key, column)
    lead = whole.orderBy(F.col(key).asc_nulls_last(), "_whole").select(F.size("_whole").alias("n")).first()
    whole = whole.where(F.size("_whole") == (lead["n"] if lead else 0))
    books = fit_codebooks(whole, key, parts, entries, rounds)
    return encode(whole, books, [key, *keep]), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decode(coded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``coded`` with the vectors that the codes stand for, in ``vector``."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(batch.column(batch.schema.get_field_index("code")).to_pylist())
            code = np.frombuffer(raw, np.uint8).reshape(batch.num_rows, len(books))
            flat = books[np.arange(len(books)), code].reshape(batch.num_rows, -1) / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(flat), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return coded.mapInArrow(vectors, ", ".join([*(f"`{n}` {t}" for n, t in coded.dtypes), "vector array<double>"]))


def op12_code_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and the errors of each label."""
    coded, books = compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    coded = written(coded)
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _sql_round(n: int) -> str:
    """Codebooks after one more round."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT vec_id, p, c, min(struct_pack(d := list_sum(list_transform(list_zip(c, k), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cut JOIN book{n} USING (p) GROUP BY ALL),
sums{n} AS (
  SELECT p, best.e AS e, count(*) AS n,
         sum(c[1])::BIGINT AS s1, sum(c[2])::BIGINT AS s2, sum(c[3])::BIGINT AS s3, sum(c[4])::BIGINT AS s4
  FROM near{n} GROUP BY ALL),
book{n + 1} AS MATERIALIZED (
  SELECT p, e, CASE WHEN n IS NULL THEN k
    ELSE list_transform([s1, s2, s3, s4], lambda s: (s - ((s % n) + n) % n) // n) END AS k
  FROM book{n} LEFT JOIN sums{n} USING (p, e)),"""


OP12_SQL = (
    """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (
  SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS c FROM (SELECT vec_id, v, unnest(range(16)) AS p FROM kept)),
book0 AS MATERIALIZED (
  SELECT p, e, c AS k FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),"""
    + _sql_round(0)
    + _sql_round(1)
    + """
near2 AS MATERIALIZED (
  SELECT vec_id, p, c, min(struct_pack(d := list_sum(list_transform(list_zip(c, k), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM cut JOIN book2 USING (p) GROUP BY ALL),
digest AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(k) AS x, unnest(range(4)) AS i FROM book2)),
coded AS (
  SELECT vec_id, string_agg(format('{:02x}', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id) CROSS JOIN digest
"""
)
