"""Near-duplicate pairs against all pairs of signatures."""

import numpy as np
import pytest

from folioq.llm import neardup as N


def all_pairs(rows):
    ids = [d for d, t in rows if d is not None and t and t.split()]
    sig, _ = N.signatures([t for d, t in rows if d is not None and t and t.split()])
    return {(min(a, b), max(a, b)) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and a != b and (sig[i] == sig[j]).sum() >= N.MATCHES}


def closed(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in sorted(pairs):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    groups = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    return {k: sorted(v) for k, v in groups.items()}


def rows_with_copies(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(30):
        rows.append((d, " ".join(f"w{x}" for x in rng.integers(0, 5000, 120))))
    for d in range(30, 60):
        words = rows[int(rng.integers(0, 10))][1].split()
        for k in rng.integers(0, 120, int(rng.integers(0, 12))):
            words[k] = "changed"
        rows.append((d, " ".join(words)))
    return rows + [(60, "two words"), (61, "Two  WORDS"), (62, ""), (63, None), (64, " \n "), (None, rows[0][1]), (None, rows[0][1]), (65, "x"), (7, rows[7][1]), (66, rows[1][1])]


def grouped(found):
    groups = {}
    for r in found:
        groups.setdefault(r.group_doc_id, []).append(r.doc_id)
    return {k: sorted(v) for k, v in groups.items()}


@pytest.mark.parametrize("hot", [N.HOT_ROWS, 3])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, hot):
    """Also where every token list and class counts as hot."""
    monkeypatch.setattr(N, "HOT_ROWS", hot)
    rows = rows_with_copies()
    df = spark.createDataFrame([(d, t, "k", 3) for d, t in rows], "doc_id long, text string, key string, rep int")
    found = N.near_groups(df).collect()
    assert grouped(found) == closed(all_pairs(rows)) and len({r.doc_id for r in found}) == len(found) and len(grouped(found)) >= 5
    pairs = all_pairs(rows)
    assert {r.doc_id: r.links for r in found} == {d: sum(d in p for p in pairs) for d in {x for p in pairs for x in p}}


def test_a_doc_id_with_two_texts_joins_their_groups(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    df = spark.createDataFrame([(5, one), (6, one), (6, two), (9, two), (9, two), (1, "all alone with this")], "doc_id long, text string")
    assert grouped(N.near_groups(df).collect()) == {5: [5, 6, 9]}


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short one")], "doc_id long, text string")
    assert grouped(N.near_groups(df).collect()) == {1: [1, 2]}


def test_one_stays_of_each_group(spark):
    rows = rows_with_copies(1)
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, _gone int")
    gone = {x for group in closed(all_pairs(rows)).values() for x in group[1:]}
    kept = N.drop_near(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(d), str(t)) for d, t in rows if d not in gone)


def test_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert grouped(N.op4_minhash_near_dedup(spark, sf_dir).collect()) == closed(all_pairs(rows))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in N.components(edges, "a", "b").collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_groups(df).collect() == [] and N.drop_near(df).collect() == []


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_collisions_estimate_resemblance(share):
    rng = np.random.default_rng(2)
    error = []
    for _ in range(40):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        keep = round(400 * 2 * share / (1 + share))
        sig, _ = N.signatures([" ".join(a), " ".join(a[:keep] + [f"v{x}" for x in rng.integers(0, 10**6, 400 - keep)])])
        error.append((sig[0] == sig[1]).mean() - share)
    assert abs(np.mean(error)) < 0.04
