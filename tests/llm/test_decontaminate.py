"""Alignment and contaminated documents against brute force."""

import numpy as np

from folioq.llm import decontaminate as D


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (D._MATCH if a[i] == b[j] else D._MISS), h[i, j + 1] - D._GAP, h[i + 1, j] - D._GAP)
    return h.max() / (D._MATCH * len(a))


def test_alignment():
    rng = np.random.default_rng(0)
    items = [rng.integers(0, 6, n).astype(np.uint64) for n in (5, 12, 30, 8)]
    passages = [rng.integers(0, 6, n).astype(np.uint64) for n in (9, 40, 25, 1)]
    value, end = D.align(items, passages)
    assert np.allclose(value, [smith_waterman(a, b) for a, b in zip(items, passages, strict=True)])
    assert (end < [9, 40, 25, 1]).all()


def brute(rows, items):
    """All (doc, item) whose alignment over the whole text scores enough."""
    w = D._words([t for _, t in rows])
    v = D._words([t for _, t in items])
    texts = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    tests = [v.hash[a:b] for a, b in zip(v.first[:-1], v.first[1:], strict=True)]
    out = set()
    for k, x in enumerate(tests):
        full = [i for i, t in enumerate(texts) if len(t)]
        if len(x) >= D.LEAST and full:
            value, _ = D.align([x] * len(full), [texts[i] for i in full])
            out |= {(rows[i][0], items[k][0]) for i, s in zip(full, value, strict=True) if s >= D.SCORE}
    return out


def test_table_has_all_that_brute_force_finds(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in D.op3_decontaminate(spark, sf_dir).collect()}
    want = brute(rows, items)
    assert got <= want and len(got & want) >= 0.9 * len(want)


def fixture(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
    items = [(k, " ".join(word(30))) for k in range(6)] + [(6, "too short"), (7, None), (None, " ".join(word(30)))]
    rows = []
    for d in range(40):
        text = word(100)
        if d < 18:
            copy = items[d % 6][1].split()
            if d >= 6:
                for k in rng.integers(0, 30, 4):
                    copy[k] = "edited"
            if d >= 12:
                del copy[10:12]
                copy.insert(20, "inserted")
            text[50:50] = copy
        rows.append((d, " ".join(text)))
    return rows, items


def test_edited_copies(spark):
    rows, items = fixture()
    more = [(None, rows[0][1]), (100, None), (101, ""), (102, rows[0][1].upper()), (0, rows[0][1])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows + more], "doc_id long, text string, score int, item_id string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items + items[:1]], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id): r for r in D.contaminated(docs, bench).collect()}
    assert set(found) == {(d, d % 6) for d in range(18)} | {(102, 0)}
    assert all(r.start >= 0 and r.end > r.start for r in found.values())
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*range(18, 40), None, 100, 101]))


def test_parts_of_the_index_change_nothing(spark, monkeypatch):
    rows, items = fixture(2)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "PART", 50)
    assert [x[:2] for x in sorted(map(tuple, D.contaminated(docs, bench).collect()))] == [x[:2] for x in whole]


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, bench).collect() == [] and D.drop_contaminated(docs, bench).count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame(fixture()[1], "item_id long, text string")).collect() == []


def test_copies_with_a_long_insertion(spark):
    rng = np.random.default_rng(3)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
    items = [(k, " ".join(word(40))) for k in range(3)]
    rows = []
    for d, inserted in enumerate((20, 25, 30, 60)):
        copy = items[d % 3][1].split()
        copy[8] = copy[30] = "edited"
        rows.append((d, " ".join(word(70) + copy[:20] + word(inserted) + copy[20:] + word(70))))
    assert brute(rows, items) == {(0, 0), (1, 1), (2, 2)}
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.score, 3), r.start, r.end) for r in D.contaminated(docs, bench).collect()}
    assert found == {(0, 0): (0.675, 70, 130), (1, 1): (0.613, 70, 135), (2, 2): (0.55, 70, 140)}
    assert [r.doc_id for r in D.drop_contaminated(docs, bench).collect()] == [3]


def test_short_items_are_found_word_for_word(spark):
    rng = np.random.default_rng(4)
    items = [(0, "What is the capital?"), (1, "Who wrote the play of two brothers?"), (2, "Name it"), (3, "?!"), (4, "eight words make one item of usual size"), (5, "what is the capital")]
    noise = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 3000, k))
    rows = [(0, f"{noise(20)} what is THE capital {noise(5)}"), (1, f"Who wrote the play of two brothers? {noise(9)}"), (2, "name, it"), (3, f"what is a capital {noise(9)} name of it"), (4, "what is the"), (5, noise(40)), (6, None), (7, "?!")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    assert got == [(0, 0, 1.0, 20, 24), (0, 5, 1.0, 20, 24), (1, 1, 1.0, 0, 7), (2, 2, 1.0, 0, 2)]
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, bench).collect()) == [3, 4, 5, 6, 7]


def test_the_filter_searches_items_without_id(spark):
    rows, items = fixture(5)
    rows.append((40, f"before it {items[8][1]} after it"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == set(range(18, 40))
    assert {r.doc_id for r in D.contaminated(docs, bench).collect()} == set(range(18))


def test_the_items_grams_start_no_python_processes(spark, sf_dir, monkeypatch):
    """Lists of rows are unpickled by Python processes of their own, which stay beside those of the scan."""
    lists, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *more, **named: (lists.append(type(data)) if isinstance(data, list) and data else None, make(self, data, *more, **named))[1])
    assert D.op3_decontaminate(spark, sf_dir).count() > 0 and not lists
