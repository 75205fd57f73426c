import random

import corpus_pipeline
from sheetloom.llm import bpe, mixture
from test_bloom_dedup import plain_groups
from test_simhash import plain_components, plain_fingerprint


def corpus(seed=11):
    rng = random.Random(seed)
    common = ["w%d" % i for i in range(300)]
    texts, toxic = [], []
    for i in range(240):
        words = rng.choices(common, k=rng.choice([20, 60, 200]))
        bad = i % 4 == 0
        if bad:
            words[rng.randrange(len(words) - 3) :][:2] = []
            at = rng.randrange(len(words) - 3)
            words[at : at + 3] = rng.choices(["vilething", "dreadword", "nastyterm"], k=3)
        texts.append(" ".join(words))
        toxic.append(int(bad))
    rows = [(i, t, "s%d" % (i % 4)) for i, t in enumerate(texts)]
    labels = [(i, 1, y) for i, y in enumerate(toxic)]
    clean = [i for i, y in enumerate(toxic) if not y]
    for n, i in enumerate(clean[:40]):
        text = texts[i] if n % 2 else texts[i].replace(" ", "  ", 3)
        if n % 4 == 0 and len(text.split()) > 150:
            text = text + " tail"
        rows.append((1000 + n, text, "s1"))
    return rows + [(5000, None, None), (5001, "", "s1"), (None, "lone words of no id at all", "s2")], labels, toxic


def test_stages_against_plain_ones(spark, make_docs, tmp_path):
    rows, labels, toxic = corpus()
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixture", "bpe"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "bpe":
            assert docs.columns == columns
            kept.append([tuple(r) for r in docs.collect()])
    bad = {i for i, y in enumerate(toxic) if y}
    assert sorted((r[0] is not None, r[0] or 0) for r in kept[0]) == sorted((r[0] is not None, r[0] or 0) for r in rows if r[0] not in bad)
    keep = {g[1] for g in plain_groups([(r[0], r[1]) for r in kept[0]])}
    assert {r[0] for r in kept[1]} == keep and len(kept[1]) == len(keep)
    prints = {r[0]: plain_fingerprint(r[1]) for r in kept[1]}
    roots = plain_components(list(prints.values()))
    groups = {}
    for i, p in prints.items():
        groups.setdefault(roots[p], []).append(i)
    assert {r[0] for r in kept[2]} == {min((i for i in g if i is not None), default=None) for g in groups.values()}
    assert len(kept[2]) == len(groups)
    again = spark.read.parquet(f"{tmp_path}/2")
    copies = {r.doc_id: r.copies for r in mixture.mix(again).collect()}
    assert sorted(i or -1 for i, *_ in kept[3]) == sorted(i or -1 for i, n in copies.items() for _ in range(n))
    coder = bpe.codec(bpe.vocabulary())
    texts = {r[0]: r[1] or "" for r in kept[3]}
    final = docs.collect()
    assert len(final) == len(kept[3]) and all(r.exact and list(r.ids) == coder.encode(texts[r.doc_id]).tolist() and r.n_tokens == len(r.ids) for r in final)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    short = lambda rows: sorted((r.doc_id or -1, r.n_tokens) for r in rows)
    assert short(whole.collect()) == short(final)


def test_empty_tables(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
