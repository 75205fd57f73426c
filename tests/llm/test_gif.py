import hashlib
import random
import zlib

import numpy as np
import pytest

from sheetloom.llm import gif


def plain_codes(stream, bits):
    """Codes of a stream, read bit by bit."""
    clear, value, have, out = 1 << bits, 0, 0, []
    width, free, last = bits + 1, clear + 2, None
    for byte in stream:
        value |= byte << have
        have += 8
        while have >= width:
            code, value, have = value & ((1 << width) - 1), value >> width, have - width
            out.append(code)
            if code == clear:
                width, free, last = bits + 1, clear + 2, None
                continue
            if code == clear + 1:
                return out
            if last is not None and free < 4096:
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
            last = code
    return out


def plain_decode(stream, bits):
    clear, out, table, prev = 1 << bits, b"", {}, b""
    for code in plain_codes(stream, bits):
        if code == clear:
            table, prev = {i: bytes([i]) for i in range(clear)}, b""
            free = clear + 2
        elif code == clear + 1:
            return out
        else:
            entry = table[code] if code in table else prev + prev[:1]
            if prev and free < 4096:
                table[free] = prev + entry[:1]
                free += 1
            out, prev = out + entry, entry
    return out


def pack(codes, bits):
    """A stream of given codes, which need not come from an encoder that clears in time."""
    clear, width, free, last, value, have, out = 1 << bits, bits + 1, (1 << bits) + 2, None, 0, 0, bytearray()
    for code in codes:
        value |= code << have
        have += width
        while have >= 8:
            out.append(value & 255)
            value, have = value >> 8, have - 8
        if code == clear:
            width, free, last = bits + 1, clear + 2, None
        else:
            if last is not None and free < 4096:
                free += 1
                if free == 1 << width and width < 12:
                    width += 1
            last = code
    return bytes(out) + bytes([value & 255])


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 3, 63, 500, 9000, 60_000):
        for letters in (1, 2, 1 << bits):
            samples = bytes(rng.randrange(letters) for _ in range(n))
            stream = gif.lzw_encode(samples, bits)
            assert plain_decode(stream, bits) == samples
            assert gif.lzw_decode(stream, bits, n) == samples
            assert gif.lzw_decode(stream, bits, n // 2) == samples[: n // 2]


def test_lzw_streams_of_other_encoders():
    rng = random.Random(9)
    # Never cleared: the table is full after some time and stays as it is.
    codes, free = [256, 65], 258
    while len(codes) < 12_000:
        codes.append(rng.randrange(256) if rng.random() < 0.3 else min(rng.randrange(258, free + 1), 4095) if free > 258 else 66)
        free = min(free + 1, 4096)
    stream = pack([*codes, 257], 8)
    want = plain_decode(stream, 8)
    assert gif.lzw_decode(stream, 8, len(want)) == want
    # Cleared at odd times, and without a first clear code.
    codes = [c for _ in range(300) for c in (256, *[rng.randrange(256) for _ in range(rng.randrange(40))])]
    stream = pack([*codes, 257], 8)
    assert gif.lzw_decode(stream, 8, 10**6) == bytes(c for c in codes if c < 256)
    assert gif.lzw_decode(pack([1, 2, 3, 257], 8), 8, 9) == bytes([1, 2, 3])
    # A code that cannot be known yet ends the samples.
    assert gif.lzw_decode(pack([256, 5, 300, 257], 8), 8, 9) == bytes([5])


def test_disposal_and_transparency():
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    full = lambda v: np.full((4, 4), v, np.uint8)
    dot = np.array([[1, 3], [3, 2]], np.uint8)
    shown = list(
        gif.decode(
            gif.encode(
                4, 4,
                [
                    gif.Picture(full(0), delay_ms=30),
                    gif.Picture(dot, 1, 1, 40, gif.PREVIOUS, transparent=3),
                    gif.Picture(dot, 0, 0, 50, gif.BACKGROUND, palette=bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4])),
                    gif.Picture(dot, 3, 3, 60, gif.KEEP, transparent=3),
                ],
                colours,
            )
        )
    )
    assert [(s.start_ms, s.delay_ms, s.disposal, s.box) for s in shown] == [
        (0, 30, 1, (0, 0, 4, 4)), (30, 40, 3, (1, 1, 2, 2)), (70, 50, 2, (0, 0, 2, 2)), (120, 60, 1, (3, 3, 1, 1)),
    ]
    red = [255, 0, 0, 255]
    assert shown[0].screen.tolist() == [[red] * 4] * 4
    second = [[red] * 4 for _ in range(4)]
    second[1][1], second[2][2] = [0, 255, 0, 255], [0, 0, 255, 255]
    assert shown[1].screen.tolist() == second
    third = [[red] * 4 for _ in range(4)]
    third[0][:2], third[1][:2] = [[2, 2, 2, 255], [4, 4, 4, 255]], [[4, 4, 4, 255], [3, 3, 3, 255]]
    assert shown[2].screen.tolist() == third
    fourth = [[red] * 4 for _ in range(4)]
    fourth[0][:2], fourth[1][:2] = [[0, 0, 0, 0]] * 2, [[0, 0, 0, 0]] * 2
    fourth[3][3] = [0, 255, 0, 255]
    assert shown[3].screen.tolist() == fourth
    assert gif.histogram(shown[3].screen)[48] == 11 and sum(gif.histogram(shown[3].screen)) == 12


def test_interlaced_rows_and_cut_files():
    samples = np.arange(13 * 5, dtype=np.uint8).reshape(13, 5)
    file = gif.encode(5, 13, [gif.Picture(samples[[0, 8, 4, 12, 2, 6, 10, 1, 3, 5, 7, 9, 11]])])
    at = file.index(b"\x21\xf9") + 8
    file = file[: at + 9] + bytes([0x40]) + file[at + 10 :]
    (shown,) = gif.decode(file)
    assert (shown.screen[..., 0] == samples).all()
    for n in range(len(file)):
        assert len(list(gif.decode(file[:n]))) <= 1
    assert list(gif.decode(b"no picture")) == [] and list(gif.decode(b"")) == []


def test_texts_stored_and_read(spark, make_docs, tmp_path):
    texts = [None, "", "a", "x" * 64, "é" * 40, "long " * 120_000, "\x00", "a", "tie\n" * 17]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in gif.op1_gif_media(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        media = gif.store(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[2].feature == rows[7].feature and rows[5].feature.startswith("3f 64x4096 300ms")
    stored = gif.store_texts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    listed = gif.frames(stored).where("doc_id = 5").orderBy("frame").collect()
    assert [(f.frame, f.start_ms, f.height, sum(f.histogram)) for f in listed] == [(0, 0, 4096, 64 * 4096), (1, 100, 4096, 64 * 4096), (2, 200, 1183, 64 * 4096)]
    assert gif.frames(stored.withColumn("media", stored.media.substr(3, 9))).count() == 0
    assert gif.store_texts(make_docs([])).count() == 0


def test_one_pass_gives_the_same_as_two(spark, make_docs, monkeypatch):
    texts = ["", None, "a", "some text " * 400, "é" * 63, "same", "same", "\x00\U0001f600", "long " * 60_000]
    docs = make_docs([(i, t) for i, t in enumerate(texts)]).selectExpr("*", "'x' AS media", "1 AS stored")
    monkeypatch.setattr(gif, "_PART_BYTES", 2_000)
    once = gif.store_and_read(docs)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    got = {r.doc_id: tuple(r) for r in once.collect()}
    want = {r.doc_id: tuple(r) for r in gif.read_media(gif.store_texts(docs)).select("doc_id", "n_bytes", "media", "stored").collect()}
    assert len(got) == len(texts) and got == want
    assert gif.store_and_read(make_docs([])).collect() == []


def test_null_media_have_no_features(spark):
    rows = gif.read_media(spark.createDataFrame([(1, None), (2, gif.store(b"x"))], "doc_id int, media binary")).orderBy("doc_id").collect()
    assert tuple(rows[0].stored) == (None, None, None, None)
    assert rows[1].stored.payload_bytes == 64


def test_each_file_is_encoded_once(monkeypatch):
    calls = []
    whole = gif.encode
    monkeypatch.setattr(gif, "encode", lambda *a, **k: calls.append(1) or whole(*a, **k))
    assert gif._features(gif.store(b"payload"))[0] == 64
    assert len(calls) == 1
