import hashlib
import math
import zlib

from sheetloom.llm import sharding


def plain_shard(doc_id, weights):
    key = "null" if doc_id is None else str(doc_id)
    cost = [-math.log((int(hashlib.md5(f"{key}/{i}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / w for i, w in enumerate(weights)]
    return cost.index(min(cost))


def test_rows_against_plain_hashing(spark, make_docs, tmp_path):
    rows = [(i, "é" * (i % 7)) for i in range(400)] + [(None, None), (None, "x"), (3, "x"), (3, "x"), (400, "long " * 50_000)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op3_rendezvous_shards(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t in rows
    )
    for r in got:
        assert (r.law, r.shard, r.grown_shard) == ("key", plain_shard(r.doc_id, [1] * 40), plain_shard(r.doc_id, [1] * 41))
        assert r.grown_shard in (r.shard, 40)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_share_the_keys(spark):
    placed = sharding.rendezvous(spark.range(20_000), "id", [1.0, 2.0, 5.0], "shard", "grown", 2.0)
    counts = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert all(abs(counts[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate([1, 2, 5]))
    moved = placed.where("grown <> shard")
    assert abs(moved.count() / 20_000 - 0.2) < 0.015 and moved.where("grown <> 3").count() == 0
    assert sharding.rendezvous(spark.range(3), "id", [1.0], "shard").where("shard = 0").count() == 3


def test_empty_table(spark, make_docs):
    assert sharding.shard_documents(make_docs([])).count() == 0
