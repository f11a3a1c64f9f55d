"""Suffix construction and repeated passages against brute force."""

import re

import numpy as np
import pytest

from folioq.llm import passages as P


@pytest.fixture
def files(tmp_path):
    made = P.Rounds(f"file://{tmp_path}")
    yield made
    made.close()


@pytest.mark.parametrize("seed", range(12))
def test_suffixes(seed, files):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 12))
    size = rng.integers(1, 15, m)
    codes = np.zeros((m, size.max()), np.int32)
    for i in range(m):
        codes[i, : size[i]] = rng.integers(1, 4, size[i])
    row, length, common, before = P.suffixes(codes, size, files)
    want = sorted(([(c, 0) for c in codes[i, size[i] - n : size[i]].tolist()] + [(0, i)], i, n) for i in range(m) for n in range(size[i] + 1))
    assert [(i, n) for _, i, n in want] == list(zip(row.tolist(), length.tolist(), strict=True))

    def shared(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    assert common.tolist() == [0] + [shared(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]
    assert before.tolist() == [codes[i, size[i] - n - 1] if n < size[i] else 0 for _, i, n in want]


def test_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 200, 777).astype(np.uint8)
    a = rng.integers(0, 776, 500)
    b = np.array([rng.integers(x + 1, 778) for x in a])
    assert P.Minima(values)(a, b).tolist() == [values[x:y].min() for x, y in zip(a, b, strict=True)]


def brute(rows):
    """Maximal runs of words covered by passages that two different rows hold."""
    rows = list(dict.fromkeys((d, t) for d, t in rows if t is not None))
    words = [[w for w in re.split("[\x00-\x20\x7f]+", t) if w] for _, t in rows]
    holders = {}
    for k, w in enumerate(words):
        for i in range(len(w) - P.PASSAGE + 1):
            holders.setdefault(tuple(w[i : i + P.PASSAGE]), set()).add(k)
    out = []
    for k, w in enumerate(words):
        hit = [i for i in range(len(w) - P.PASSAGE + 1) if len(holders[tuple(w[i : i + P.PASSAGE])]) > 1]
        spans = []
        for i in hit:
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + P.PASSAGE
            else:
                spans.append([i, i + P.PASSAGE])
        out += [(rows[k][0], a, b) for a, b in spans]
    return sorted(out, key=str)


def made_rows(seed, n=40, vocabulary=300):
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, vocabulary, k)]
    passages = [word(int(k)) for k in (49, 50, 51, 75, 76, 120, 300)]
    rows = []
    for d in range(n):
        parts = word(int(rng.integers(0, 60)))
        for p in rng.choice(len(passages), int(rng.integers(0, 3)), replace=False):
            lo = int(rng.integers(0, 20)) if rng.random() < 0.5 else 0
            parts += passages[p][lo:] + word(int(rng.integers(0, 60)))
        rows.append((d, " ".join(parts)))
    rows += [(100, " ".join(["again"] * 200)), (101, "x " + " ".join(["again"] * 60)), (102, rows[5][1]), (5, rows[5][1]), (3, "another text of the same id"), (None, rows[6][1]), (103, None), (104, ""), (105, rows[7][1] + " " + rows[7][1])]
    return rows


@pytest.mark.parametrize("large", [P.LARGE, 0, 2])
def test_planted_passages(spark, large):
    rows = made_rows(3)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, place int")
    got = sorted(((r.doc_id, r.start, r.end) for r in P.repeats(df, large).collect()), key=str)
    assert got == brute(rows) and len(got) > 20


def test_collections_keep_an_anchor_together(spark, monkeypatch):
    monkeypatch.setattr(P, "COLLECTION", 2)
    rows = made_rows(4, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.start, r.end) for r in P.repeats(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert P.repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.start, r.end) for r in P.op8_repeated_passages(spark, sf_dir).collect()), key=str) == brute(rows)


def test_very_long_texts(spark):
    shared = " ".join(f"s{k}" for k in range(80))
    long = " ".join(f"w{k}" for k in range(200_000))
    df = spark.createDataFrame([(1, f"{long} {shared}"), (2, f"{shared} end"), (3, "x" * 1_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.end) for r in P.repeats(df).collect()) == [(1, 200_000, 200_080), (2, 0, 80)]
