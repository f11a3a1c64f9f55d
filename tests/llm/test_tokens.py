"""Token counts against the tokenizer library itself."""

import base64
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioq.llm import tokens as T
from folioq.llm._spark import map_texts

tiktoken = pytest.importorskip("tiktoken")
if not Path(T.VOCABULARY).exists():
    pytest.skip("no vocabulary file", allow_module_level=True)

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(T.VOCABULARY).read_bytes().splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t or "")) for t in texts]


@pytest.fixture(scope="module")
def model():
    return T.Counter(T.VOCABULARY)


def test_every_short_string_of_a_hard_alphabet(library, model):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abstmdrevl'' \n\t  01,.!é漢字 　ⅷ²") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", "'", "'r", "it's we'll they've 'tis", " " * 5, "a" + " " * 300 + "b", "don''t"]
    assert T.token_counts(texts, model).tolist() == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_any_text(library, model, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert T.token_counts(texts, model).tolist() == library(texts)


def test_long_texts_across_chunks(library, model):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the ", "can't ", "\n\n  ", "x" * 50, "12345 ", "--- "]) for _ in range(3000)), "y" * 5000, " " * 2000]
    assert T.token_counts(texts, model).tolist() == library(texts)


def test_restart_changes_nothing(library):
    texts = ["some words that fill the table and make it start afresh"] * 3 + ["other ones"]
    small = T.Counter(T.VOCABULARY, most=5)
    assert T.token_counts(texts, small).tolist() == T.token_counts(texts, small).tolist() == library(texts)


def test_scan_composes_in_order():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 9, (9, 37)).astype(np.uint8)
    now, got = np.arange(9), T.scan(maps)
    for k in range(37):
        now = maps[now, k]
        assert got[:, k].tolist() == now.tolist()


def test_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = T.op6_token_counts(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    assert [r.tokens for r in rows] == library([texts[r.doc_id] for r in rows])


def test_nulls_repeats_and_other_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1, "x"), (1, None, 2, "x"), (1, "", 3, None), (2, "a b", 4, "x"), (2, "a b", 4, "x")], "doc_id long, text string, tokens int, piece string")
    assert sorted((r.doc_id or 0, r.tokens) for r in T.counted(df).collect()) == [(0, 2), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert T.counted(df.limit(0)).collect() == []
    assert re.match("bigint", dict(T.counted(df).dtypes)["tokens"])


def test_long_pieces_in_chunks_and_a_small_table(library, model):
    rng = random.Random(3)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    texts = ["x" * 100_001, letters, "漢字" * 3000, "a1" + letters[:5000] + "'s", "=" * 70_000, " " * 50_000, "ab" * 2000 + letters[:3000], letters[:1024], letters[:1025]]
    assert T.token_counts(texts, model).tolist() == library(texts)
    small = T.Counter(T.VOCABULARY, most=300)
    assert T.token_counts(texts[1:5], small).tolist() == library(texts[1:5])
    assert len(small.open) < 300 + 5000


def test_a_piece_of_ten_megabytes(library, model):
    """As one run of one letter and as one of repeated blocks; the table stays within its bound."""
    rng = random.Random(4)
    block = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4096))
    got = T.token_counts(["z" * 10_000_000, block * 2500], model).tolist()
    assert got[0] == library(["z" * 10_000])[0] * 1000
    four, five, six = library([block * k for k in (4, 5, 6)])
    assert five - four == six - five and got[1] == four + (2500 - 4) * (five - four)
    assert len(model.open) <= model.most + 20_000


def test_the_table_takes_what_its_transitions_need(library):
    """The memory kept is in proportion to the transitions met; a row of all columns a state took three times that."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randint(3, 9))) for _ in range(8000))]
    fresh = T.Counter(T.VOCABULARY)
    T.token_counts(["x"], fresh)
    tracemalloc.start()
    got = T.token_counts(texts, fresh).tolist()
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert got == library(texts) and len(fresh.open) > 20_000
    assert kept < 450 * len(fresh.open)


def test_other_tasks_find_no_counter_left_in_their_process(spark):
    df = spark.range(40).selectExpr("id AS doc_id", "'some words' AS text").repartition(8)
    assert {r.tokens for r in T.counted(df).collect()} == {2}
    left = map_texts(df, lambda texts: (None, {"left": [T.counter.cache_info().currsize] * len(texts)}), "left long")
    assert {r.left for r in left.collect()} == {0}
