"""The pipeline against its stages' decisions made by brute force."""

import numpy as np

import corpus_pipeline
from folioq.llm import decontaminate, langid, pii, registry, tokens
from folioq.llm._spark import stash
from test_decontaminate import brute
from test_neardup import all_pairs, closed


def test_stages_and_registry():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = langid.fitted(docs)
    best = langid.predict(model, [t for _, t in rows])[0]
    rows = [r for r, b in zip(rows, best, strict=True) if model["labels"][b] != "und"]
    gone = {x for g in closed(all_pairs(rows)).values() for x in g[1:]}
    rows = [r for r in rows if r[0] not in gone]
    leaked = {d for d, _ in brute(rows, items)}
    found = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id").distinct().collect()}
    assert found <= leaked and len(found) >= 0.9 * len(leaked)
    rows = [r for r in rows if r[0] not in found]
    weights = pii.fitted(spark.createDataFrame(rows, "doc_id long, text string"))
    clean = [(d, pii.redact(t, s)) for (d, t), s in zip(rows, pii.entities([t for _, t in rows], weights), strict=True)]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    counts = tokens.token_counts([t for _, t in clean], tokens.counter(tokens.VOCABULARY)).tolist()
    assert words == {d: n for (d, _), n in zip(clean, counts, strict=True) if n}
    assert max(np.bincount([r.bin for r in got], [r.length for r in got])) <= 2048


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = stash(out, name)
    assert docs.count() > 0


def test_odd_rows_pass_through(spark, sf_dir):
    docs = spark.createDataFrame([(None, "The on of and that is ering tion", "en", "s", 5), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "The other of the and is", "en", "s", 3)] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.collect() == []
        docs = stash(stage(spark, docs, sf_dir), "odd")
    # The texts are so short that only the null ones have no token.
    assert {r.length > 0 for r in docs.collect()} <= {True}
