import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sheetloom.llm import bpe

ODD = [
    None, "", " ", "  \n\t x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "é" * 40, "日本語テキスト", "🙂🙃" * 9,
    "don't I'll WE'VE 123 4567", "a" * 3000, "ab" * 999, "՘࢏꟎ new", "\x00\x1c\x1f\x85\xa0x", "  " * 500, "x" + " " * 33 + "y\r\n\r\n", "=" * 200 + "!?" * 77,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def made_up(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghilmnorstu ETA.,'0123\n\té日🙂-_"
    return ["".join(rng.choice(letters[: rng.choice([3, 8, len(letters)])]) for _ in range(rng.randrange(1, 400))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    coder = bpe.codec(bpe.vocabulary())
    for text in [t or "" for t in ODD] + made_up(1500, 1):
        want = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == want, text
        assert coder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_pieces_of_every_latin_character_and_samples_of_others(library):
    coder = bpe.codec(bpe.vocabulary())
    for c in [*map(chr, range(0x250)), *map(chr, range(0x250, 0xD800, 37)), *map(chr, range(0x10000, 0x40000, 997)), *"՘࢏꟎"]:
        text = f"a{c}1{c}!{c} {c}{c}  {c}b'{c}s"
        assert coder.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_every_token_alone_and_in_pairs(library):
    coder = bpe.codec(bpe.vocabulary())
    rng, tokens = random.Random(2), [b.decode("utf-8", "ignore") for b in coder.whole]
    for text in [*tokens[::7], *("".join(rng.choices(tokens, k=rng.randrange(2, 6))) for _ in range(3000))]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_broken_bytes_decode_like_the_library(library):
    coder, rng = bpe.codec(bpe.vocabulary()), random.Random(3)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 12))]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_columns(spark, make_docs, library):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)]
    docs = make_docs(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    spec = bpe.vocabulary()
    out = bpe.decode_column(bpe.encode_column(docs, spec), spec)
    assert out.columns == ["doc_id", "n_chars", "ids", "decoded"]
    got = {r.doc_id: (list(r.ids), r.decoded) for r in out.collect()}
    assert got == {i: (library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows}
    both = bpe.encode_column(docs, spec, decoded="decoded")
    assert both.columns == out.columns and {r.doc_id: (list(r.ids), r.decoded) for r in both.collect()} == got
    assert bpe.encode_column(make_docs([]), spec).count() == 0


def test_query(spark, make_docs, library, tmp_path):
    texts = [*ODD, *made_up(30, 4)]
    make_docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in bpe.op7_prefix_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[row.doc_id] or ""))


def test_tables_stay_small(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 20)
    monkeypatch.setattr(bpe, "_PAIRS", 20)
    coder, plain = bpe.Codec(__import__("json").loads(bpe.vocabulary())), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in made_up(40, 5):
        assert coder.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(coder.pieces) <= 20 and len(coder.fit) <= 20 and sys.getsizeof(coder.pieces) < 10_000
