"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece of text has exactly one last token. It is found among the tokens that end
there, which an automaton with suffix links lists: a token is the last one if it can stand beside
the last token of the prefix before it. The links back from the end of the piece give its ids.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sheetloom.llm.shared import KEPT, table, tidy

_PIECE = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# The same pattern for texts of Latin-1 characters only, where the classes can be written out.
_LETTERS, _NUMBERS, _SPACES = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN_PIECE = re.compile(
    rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
#: Entries of the tables of pieces and of pairs; a full table is emptied.
_PIECES = 200_000
_PAIRS = 300_000
#: Rows of a result that a task builds at a time.
_ROWS = 500


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of byte-level encodings.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level vocabulary with ranked merges."""

    def __init__(self, spec: dict) -> None:
        self.letters = byte_letters()
        values = {letter: bytes([b]) for b, letter in enumerate(self.letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = spec.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        self.bytes_of: dict[int, bytes] = {i: b"".join(values[c] for c in word) for word, i in vocab.items()}
        self.bytes_of |= {i: word.encode() for word, i in self.special.items()}
        self.merge: dict[tuple[int, int], int] = {}
        #: By token: rank of the merge that makes it (-1: a byte) and its two parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge.setdefault((a, b), rank)
            self.made.setdefault(whole, (rank, a, b))
        self.fit: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        reached: set[int] = {vocab[letter] for letter in self.letters}
        for whole, (rank, a, b) in sorted(self.made.items(), key=lambda m: m[1][0]):
            if a in reached and b in reached and self._apart(a, b, rank, rank):
                reached.add(whole)
        self.ends = ahocorasick.Automaton()
        self.whole: dict[bytes, int] = {}
        for i in reached:
            self.whole[self.bytes_of[i]] = i
            self.ends.add_word(self.bytes_of[i].decode("latin-1"), (i, len(self.bytes_of[i])))
        self.ends.make_automaton()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _apart(self, a: int, b: int, a_until: float, b_until: float) -> bool:
        """No merge joins the right edge of ``a`` with the left edge of ``b`` before the given ranks.

        The two are taken apart from their last merge backwards. At each step the inner parts
        stand beside each other until one of them is merged with its own neighbour; of equal
        ranks the merge further left goes first.
        """
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            a_made, b_made = self.made.get(a), self.made.get(b)
            a_rank, b_rank = a_made[0] if a_made else -1, b_made[0] if b_made else -1
            if a_rank < 0 and b_rank < 0:
                return True
            if a_rank > b_rank:
                a_until, a = a_rank, a_made[2]
            else:
                b_until, b = b_rank, b_made[1]

    def fits(self, a: int, b: int) -> bool:
        """Tokens ``a`` and ``b`` can stand beside each other."""
        key = a << 24 | b
        known = self.fit.get(key)
        if known is None:
            if len(self.fit) >= _PAIRS:
                self.fit.clear()
            known = self.fit[key] = self._apart(a, b, inf, inf)
        return known

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that no merge leaves."""
        raw = piece.encode()
        one = self.whole.get(raw)
        if one is not None:
            return (one,)
        last, back, fits = [-1] * len(raw), [0] * len(raw), self.fits
        for end, (token, length) in self.ends.iter(raw.decode("latin-1")):
            if last[end] < 0:
                before = end - length
                if before < 0 or fits(last[before], token):
                    last[end], back[end] = token, before
        ids, at = [], len(raw) - 1
        while at >= 0:
            ids.append(last[at])
            at = back[at]
        return tuple(reversed(ids))

    def split(self, text: str) -> list[str]:
        """Pieces of a text without special tokens.

        A text with characters that this Python's Unicode tables do not know is cut by the
        tokenizers library, as the character classes of ``regex`` may be of another version.
        """
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                from tokenizers.pre_tokenizers import ByteLevel

                return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False).pre_tokenize_str(text)]
            return _PIECE.findall(text)
        return _LATIN_PIECE.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; special tokens in it count as such."""
        if self.cut is not None and (parts := self.cut.split(text))[1:]:
            own = [np.array([self.special[p]], np.int32) if p in self.special else self._plain(p) for p in parts if p]
            return np.concatenate(own) if own else np.zeros(0, np.int32)
        return self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        pieces, known = self.split(text), self.pieces
        try:
            # Nearly always all pieces are known after the first texts.
            return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32)
        except KeyError:
            new = {p for p in pieces if p not in known}
            if len(known) + len(new) > _PIECES:
                known.clear()
                new = set(pieces)
            if len(new) > _PIECES:
                return np.fromiter(chain.from_iterable(map(self.encode_piece, pieces)), np.int32)
            for p in new:
                known[p] = self.encode_piece(p)
            return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, unknown ids nothing."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode("utf-8", "replace")


def codec(spec: bytes) -> Codec:
    """The codec of a vocabulary file's content; kept by a worker until a task of another operator runs."""
    held = KEPT.get("bpe")
    if held is None or held[0] != spec:
        held = KEPT["bpe"] = (spec, Codec(json.loads(spec)))
    return held[1]


def vocabulary(path: str | None = None) -> bytes:
    """Content of a vocabulary file, by default of the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        return file.read()


def encode_column(docs: DataFrame, spec: bytes, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``text`` replaced by its ``ids``; null and empty texts have none.

    With ``decoded``, a further column has the text decoded from the ids. Clashing columns of
    ``docs`` are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    keep = [c for c in docs.columns if c not in (text, ids, decoded)]
    own = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    names = [*keep, ids, *([decoded] if decoded else [])]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                found = [coder.encode(t.as_py()) for t in batch.column(batch.num_columns - 1)]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found), pa.int32()))]
                if decoded:
                    made.append(pa.array([coder.decode(f.tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    kinds = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return own.mapInArrow(tidy(encode, "bpe"), StructType([*own.select(*keep).schema.fields, *kinds]))


def decode_column(docs: DataFrame, spec: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a further column ``text``, decoded from ``ids``; null and empty lists give an empty text."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    keep = [c for c in docs.columns if c != text]
    at = keep.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(sent.value)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                found = pa.array([coder.decode(i.values.to_numpy().tolist() if i.is_valid else []) for i in batch.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*keep, text])

    own = docs.select(*keep)
    return own.mapInArrow(tidy(decode, "bpe"), StructType([*own.schema.fields, StructField(text, StringType())]))


def op7_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, and the texts decoded from them, as digests."""
    spec = vocabulary()
    coded = encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), spec, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
