"""GIF images as a media column: LZW streams, palettes, disposal, transparency and timed frames.

``decode`` turns a file into the pictures a viewer shows, one after the other. ``store_texts``
keeps the bytes of texts as grey samples of such files, and ``frames`` lists the frames of a media
column with their times and colour histograms.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from sheetloom.llm.shared import table, tidy

MAX_CODES = 4096
#: Layout of stored payloads: samples in a row, rows of a frame, and how long a frame is shown.
ROW = 64
FRAME_ROWS = 4096
FRAME_MS = 100
#: Bytes of files that a task builds before it passes them on.
_PART_BYTES = 8_000_000
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3
GREY = bytes(v for i in range(256) for v in (i, i, i))


@lru_cache
def _widths(bits: int, count: int) -> np.ndarray:
    """Bits of the codes that follow a clear code; the table grows from the second code on."""
    entries = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(12, np.floor(np.log2(entries)).astype(np.int64) + 1)


@lru_cache
def _offsets(bits: int) -> np.ndarray:
    """Where the codes that follow a clear code begin, in bits."""
    return np.concatenate(([0], np.cumsum(_widths(bits, MAX_CODES))))


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """Code stream of samples below ``2 ** bits``; a full table is followed by a clear code."""
    clear = 1 << bits
    # Codes are kept eight bits higher, so that the next sample can be put below them.
    codes, free = [clear << 8], (clear + 2) << 8
    if samples:
        known: dict[int, int] = {}
        find, put = known.get, codes.append
        prefix = samples[0] << 8
        for sample in samples[1:]:
            code = find(prefix | sample)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            known[prefix | sample] = free
            free += 256
            prefix = sample << 8
            if free == MAX_CODES << 8:
                put(clear << 8)
                known.clear()
                free = (clear + 2) << 8
        put(prefix)
    codes.append((clear + 1) << 8)
    # After the first clear code, a clear code follows each time the table is full.
    period = _widths(bits, MAX_CODES - clear - 1)
    at = np.zeros(len(codes) + 1, np.int64)
    at[1] = bits + 1
    at[2:] = np.resize(period, len(codes) - 1)
    np.cumsum(at, out=at)
    # Codes do not overlap, so the sums of their bits by byte put them together.
    shifted, byte, size = (np.array(codes, np.int64) >> 8) << (at[:-1] & 7), at[:-1] >> 3, int(at[-1] >> 3) + 3
    packed = sum(np.bincount(byte + i, shifted >> (8 * i) & 255, size) for i in range(3))
    return packed.astype(np.uint8)[: int(at[-1] + 7) >> 3].tobytes()


def _expand(codes: list[int], table: list[bytes], parts: list[bytes]) -> bool:
    """Append the strings of codes to ``parts`` and what they teach to ``table``; true if a code cannot be known.

    A table that is not full is a fresh one. It gets an entry with each code but the first.
    """
    if not codes:
        return False
    put, grow, room = parts.append, table.append, MAX_CODES - len(table)
    if room:
        if codes[0] >= len(table):
            return True
        prev = table[codes[0]]
        put(prev)
        for code in codes[1 : room + 1]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    return True
                entry = prev + prev[:1]
            put(entry)
            grow(prev + entry[:1])
            prev = entry
        codes = codes[room + 1 :]
    parts.extend([table[code] for code in codes])
    return False


def lzw_decode(stream: bytes, bits: int, count: int) -> bytes:
    """At most ``count`` samples of a code stream; a broken or cut stream gives what comes before the fault."""
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    width, offset = _widths(bits, MAX_CODES), _offsets(bits)
    parts, size, at = [], 0, 0
    fresh, table = True, single[:]
    while size < count:
        # All codes up to the next clear code have known widths, so they are read at once.
        span = offset[:-1] if fresh else np.arange(MAX_CODES) * 12
        wide = width if fresh else np.full(MAX_CODES, 12)
        fits = int(np.searchsorted(at + span + wide, total, "right"))
        if not fits:
            break
        where = at + span[:fits]
        byte = where >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (where & 7) & ((1 << wide[:fits]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        used = int(stop[0]) if stop.size else fits
        fault = _expand(codes[:used].tolist(), table, parts)
        size = sum(map(len, parts))
        if size:
            parts = [b"".join(parts)]
        if fault:
            break
        if stop.size:
            if codes[used] == end:
                break
            at += int(span[used] + wide[used])
            fresh, table = True, single[:]
        else:
            at += int(span[fits - 1] + wide[fits - 1])
            fresh = False
    return b"".join(parts)[:count]


def _blocks(data: bytes) -> bytes:
    """Data as sub-blocks of at most 255 bytes."""
    whole = len(data) // 255
    head = np.frombuffer(data[: whole * 255], np.uint8).reshape(whole, 255)
    full = np.concatenate((np.full((whole, 1), 255, np.uint8), head), axis=1).tobytes()
    rest = data[whole * 255 :]
    return full + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


@dataclass
class Picture:
    """One image of a file before it is put on the screen."""

    samples: np.ndarray
    x: int = 0
    y: int = 0
    delay_ms: int = 0
    disposal: int = KEEP
    transparent: int | None = None
    palette: bytes | None = None


def encode(width: int, height: int, pictures: list[Picture], palette: bytes = GREY) -> bytes:
    """A GIF file; palettes are red, green and blue of 2 to 256 colours, padded to a power of two."""
    short = lambda *v: b"".join(int(i).to_bytes(2, "little") for i in v)

    def sized(colours: bytes) -> tuple[int, bytes]:
        power = max(1, (len(colours) // 3 - 1).bit_length())
        return power - 1, colours.ljust(3 << power, b"\0")

    size, colours = sized(palette)
    out = [b"GIF89a", short(width, height), bytes([0xF0 | size, 0, 0]), colours]
    for p in pictures:
        flags = p.disposal << 2 | (p.transparent is not None)
        out += [b"\x21\xf9\x04", bytes([flags]), short(p.delay_ms // 10), bytes([p.transparent or 0]), b"\0"]
        rows, columns = p.samples.shape
        own = sized(p.palette) if p.palette else None
        out += [b"\x2c", short(p.x, p.y, columns, rows), bytes([0x80 | own[0]]) + own[1] if own else b"\0"]
        bits = max(2, (own or (size,))[0] + 1)
        out += [bytes([bits]), _blocks(lzw_encode(p.samples.tobytes(), bits))]
    return b"".join([*out, b"\x3b"])


def _interlaced(rows: int) -> np.ndarray:
    """Order in which an interlaced image stores its rows."""
    return np.concatenate([np.arange(first, rows, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


@dataclass
class Shown:
    """A picture as shown: red, green, blue and opacity of the whole screen, and the place that changed."""

    screen: np.ndarray
    start_ms: int
    delay_ms: int
    disposal: int
    box: tuple[int, int, int, int]


def decode(file: bytes) -> Iterator[Shown]:
    """The pictures of a GIF file as shown one after the other.

    The screen starts transparent. A picture covers its box but where it has its transparent
    colour; after its time its box stays, is made transparent, or gets back what it covered. A file
    that ends too early gives the pictures before; one that is no GIF gives none. Parts of a
    picture outside of the screen are not shown.
    """
    if file[:6] not in (b"GIF87a", b"GIF89a") or len(file) < 13:
        return
    width, height = int.from_bytes(file[6:8], "little"), int.from_bytes(file[8:10], "little")
    at = 13
    palette = None
    if file[10] & 0x80:
        palette, at = file[at : at + (6 << (file[10] & 7))], at + (6 << (file[10] & 7))
    screen = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent, clock = 0, 0, None, 0

    def block_data(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(file) and file[at]:
            parts.append(file[at + 1 : at + 1 + file[at]])
            at += 1 + file[at]
        return b"".join(parts), at + 1

    while at < len(file):
        mark = file[at]
        if mark == 0x21 and at + 2 <= len(file):
            label = file[at + 1 : at + 2]
            data, at = block_data(at + 2)
            if label == b"\xf9" and len(data) >= 4:
                delay, disposal = int.from_bytes(data[1:3], "little") * 10, data[0] >> 2 & 7
                transparent = data[3] if data[0] & 1 else None
        elif mark == 0x2C and at + 11 <= len(file):
            x, y, w, h = (int.from_bytes(file[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
            flags, at = file[at + 9], at + 10
            own = palette
            if flags & 0x80:
                own, at = file[at : at + (6 << (flags & 7))], at + (6 << (flags & 7))
            if at >= len(file):
                return
            bits = file[at]
            data, at = block_data(at + 1)
            if not 2 <= bits <= 8 or own is None or len(own) < 6:
                continue
            raw = lzw_decode(data, bits, w * h)
            samples = np.frombuffer(raw.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            there = (np.arange(w * h) < len(raw)).reshape(h, w)
            if flags & 0x40:
                order = _interlaced(h)
                straight, there_too = np.empty_like(samples), np.empty_like(there)
                straight[order], there_too[order] = samples, there
                samples, there = straight, there_too
            box = (slice(y, min(y + h, height)), slice(x, min(x + w, width)))
            part = screen[box]
            rows, columns = part.shape[:2]
            samples, there = samples[:rows, :columns], there[:rows, :columns]
            before = part.copy() if disposal == PREVIOUS else None
            colours = np.zeros((256, 4), np.uint8)
            known = np.frombuffer(own[: len(own) // 3 * 3], np.uint8).reshape(-1, 3)
            colours[: len(known), :3], colours[: len(known), 3] = known, 255
            drawn = there & (samples < len(known)) & (samples != (-1 if transparent is None else transparent))
            if drawn.all():
                part[:] = colours[samples]
            else:
                part[drawn] = colours[samples[drawn]]
            yield Shown(screen.copy(), clock, delay, disposal, (x, y, columns, rows))
            clock += delay
            if disposal == BACKGROUND:
                part[:] = 0
            elif disposal == PREVIOUS:
                part[:] = before
            delay, disposal, transparent = 0, 0, None
        elif mark == 0x3B:
            return
        else:
            at += 1


def histogram(screen: np.ndarray) -> list[int]:
    """Opaque pixels by the two high bits of red, green and blue: 64 counts."""
    pixels = screen[screen[..., 3] > 0]
    keys = (pixels[:, 0] >> 6).astype(np.int64) << 4 | (pixels[:, 1] >> 6) << 2 | pixels[:, 2] >> 6
    return np.bincount(keys, minlength=64).tolist()


_FRAME = StructType(
    [
        StructField("frame", IntegerType()), StructField("start_ms", IntegerType()), StructField("delay_ms", IntegerType()),
        StructField("x", IntegerType()), StructField("y", IntegerType()), StructField("width", IntegerType()), StructField("height", IntegerType()),
        StructField("disposal", IntegerType()), StructField("histogram", ArrayType(IntegerType())), StructField("pixels_sha256", StringType()),
    ]
)


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per frame: ``key``, its number, times, place, disposal, colour histogram and digest of the screen.

    Null media, and binaries that are no GIF, have no frames.
    """

    def listed(files: pd.Series) -> pd.Series:
        rows = []
        for file in files:
            own = []
            for i, s in enumerate(decode(file) if file is not None else ()):
                own.append((i, s.start_ms, s.delay_ms, *s.box, s.disposal, histogram(s.screen), hashlib.sha256(s.screen.tobytes()).hexdigest()))
            rows.append(own)
        return pd.Series(rows)

    listed.__annotations__ = {"files": pd.Series, "return": pd.Series}
    found = F.pandas_udf(listed, ArrayType(_FRAME))
    return media.select(key, F.explode(found(column)).alias("f")).select(key, "f.*")


def store(payload: bytes) -> bytes:
    """A GIF whose grey samples are the payload, zero-filled to a positive multiple of ``ROW``."""
    rows = max(1, -(-len(payload) // ROW))
    samples = np.frombuffer(payload.ljust(rows * ROW, b"\0"), np.uint8).reshape(rows, ROW)
    cuts = [samples[i : i + FRAME_ROWS] for i in range(0, rows, FRAME_ROWS)]
    return encode(ROW, min(rows, FRAME_ROWS), [Picture(c, delay_ms=FRAME_MS) for c in cuts])


def read(file: bytes) -> tuple[bytes, str]:
    """The payload of a stored file, and its features: frames, screen, time, and pixels by the 16 steps of grey."""
    parts, steps, n, end, shape = [], np.zeros(16, np.int64), 0, 0, (0, 0)
    for shown in decode(file):
        x, y, w, h = shown.box
        grey = shown.screen[y : y + h, x : x + w, 0]
        parts.append(grey.tobytes())
        steps += np.bincount((grey >> 4).ravel(), minlength=16)
        n, end, shape = n + 1, shown.start_ms + shown.delay_ms, shown.screen.shape
    return b"".join(parts), f"{n}f {shape[1]}x{shape[0]} {end}ms " + "-".join(map(str, steps.tolist()))


_READ = StructType([StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("feature", StringType())])


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every row: the text's UTF-8 bytes (null: none) stored as a GIF."""

    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([store(t.encode()) for t in texts])

    stored.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.pandas_udf(stored, BinaryType())(text).alias("media"))


def _features(file: bytes | None) -> tuple[int | None, str | None, int | None, str | None]:
    """Size, digest and tail of the payload of a stored file, and its features; of null all are null."""
    if file is None:
        return None, None, None, None
    payload, feature = read(file)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), feature


def read_media(media: DataFrame) -> DataFrame:
    """``media`` and the column ``stored``: size, digest and tail of the payload read back, and its features.

    Null media have nulls there. Repeated rows are read each, an empty table gives an empty
    result, and a column ``stored`` of ``media`` is replaced.
    """

    def features(files: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([_features(f) for f in files], columns=["payload_bytes", "payload_sha256", "tail_crc32", "feature"])
        return found.astype({"payload_bytes": "Int64", "tail_crc32": "Int64"})

    features.__annotations__ = {"files": pd.Series, "return": pd.DataFrame}
    return media.withColumn("stored", F.pandas_udf(features, _READ)("media"))


def store_and_read(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, stored`` as of ``store_texts`` and ``read_media``, with each text encoded once.

    A task passes its files on in parts of bounded size. Null texts have the media of an empty
    one; other columns are not read; an empty table gives an empty result.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                payload = texts[i].as_py().encode()
                file = store(payload)
                rows.append((len(payload), file, *_features(file)))
                size += len(file)
                if size >= _PART_BYTES or i == batch.num_rows - 1:
                    lengths, files, *stored = zip(*rows, strict=True)
                    struct = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(stored, kinds, strict=True)], names)
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), pa.array(lengths, pa.int64()), pa.array(files, pa.binary()), struct], names=["doc_id", "n_bytes", "media", "stored"])
                    start, size, rows = i + 1, 0, []

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes bigint, media binary, stored struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,feature:string>"
    return docs.select("doc_id", text).mapInArrow(tidy(both), schema)


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as GIF files, read back."""
    kept = store_and_read(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        "stored.payload_bytes",
        "stored.payload_sha256",
        "stored.tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "stored.feature",
    )
