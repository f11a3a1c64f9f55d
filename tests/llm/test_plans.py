"""Packing, sharding and chat formatting: exactness, bounds and round trips."""

import heapq

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioq.llm import chat, packing, sharding
from oracle import both, connect


def best_fit(lengths, capacity):
    """Bins of best-fit decreasing."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize(("seed", "n", "most"), [(0, 300, 64), (1, 3000, 64), (2, 1, 64), (3, 500, 8), (4, 2000, 40), (5, 200, 1)])
def test_plan_places_all_within_capacity(seed, n, most):
    lengths = np.random.default_rng(seed).integers(1, most + 1, n)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    first, steps, bins = packing.plan(counts, capacity=64)
    ranked = np.sort(lengths)[::-1]
    rank = np.arange(n)
    row = steps[np.searchsorted(steps[:, 0], rank, "right") - 1]
    where = row[:, 1] + (rank - row[:, 0]) // row[:, 2]
    load = np.bincount(where, ranked, bins)
    assert where.min() >= 0 and where.max() < bins and load.max() <= 64
    assert bins <= 1.2 * best_fit(lengths.tolist(), 64) + packing.GROUPS
    assert all(ranked[at] == size for size, at in first.items())


def test_packed_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(d, " ".join(["w"] * int(rng.integers(0, 400)))) for d in range(120)] + [(1, "again"), (None, "no id here"), (7, None), (8, "  "), (9, "w " * 1000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, piece int, bin string")
    out = packing.packed(df, capacity=256, vocabulary=None).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.bin, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    words = sum(len((t or "").split()) for _, t in rows)
    assert sum(r.length for r in out) == words and len(bins) <= 1.1 * words / 256 + 12
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 9 and r.length + r.start > 400 or r.doc_id == 9 and r.length == 256)
    assert (3, 768, 232) in long
    assert packing.packed(df.limit(0)).collect() == []


def test_packed_tokens(spark):
    """Lengths are those that operator 6 counts."""
    from folioq.llm import tokens

    rng = np.random.default_rng(2)
    rows = [(d, "some words, " * int(rng.integers(0, 300))) for d in range(60)] + [(None, "x"), (3, None), (4, ""), (5, "long text here " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.packed(df).collect()
    counts = sorted((d, int(n)) for (d, t), n in zip(rows, tokens.token_counts([t for _, t in rows], tokens.counter(tokens.VOCABULARY)), strict=True) if d is not None and n)
    held = {}
    for r in out:
        held.setdefault(r.bin, []).append((r.offset, r.length))
    assert all(sum(n for _, n in h) <= packing.CAPACITY for h in held.values())
    by = {}
    for r in out:
        if r.doc_id is not None:
            by[r.doc_id] = by.get(r.doc_id, 0) + r.length
    want = {}
    for d, n in counts:
        want[d] = want.get(d, 0) + n
    assert by == want


def test_configurations_are_all_that_fit():
    sizes = np.array([7, 5, 3])
    got = {tuple(c) for c in packing.configurations(sizes, 16).tolist()}
    want = {(a, b, c) for a in range(4) for b in range(5) for c in range(7) if 0 < 7 * a + 5 * b + 3 * c <= 16}
    assert got == want


@pytest.mark.parametrize("seed", range(8))
def test_bins_come_close_to_the_fewest(seed):
    """Against an exhaustive search: the linear program's bound holds, and the counts rounded up exceed it by one a size at most."""
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(3, 12, 3))[::-1]
    need = rng.integers(0, 4, len(sizes))
    chosen = packing.fewest_bins(sizes, need.astype(float), 12)
    assert (sum(n * c for c, n in chosen) >= need).all() if chosen else not need.any()
    configs = [tuple(c) for c in packing.configurations(sizes, 12).tolist()]
    best = {tuple(need.tolist()): 0}
    now, steps = {tuple(need.tolist())}, 0
    while not any(not any(x) for x in now):
        steps += 1
        now = {tuple(max(0, a - b) for a, b in zip(x, c, strict=True)) for x in now for c in configs}
    assert steps <= sum(n for _, n in chosen) <= steps + len(sizes) and best


@pytest.mark.parametrize(("seed", "shards"), [(0, 1), (1, 3), (2, 16), (3, 64)])
def test_schedule_is_the_heap_s(seed, shards):
    rng = np.random.default_rng(seed)
    sizes = [(int(s), int(c)) for s, c in {int(s): int(c) for s, c in zip(rng.integers(1, 500, 30), rng.integers(1, 2000, 30), strict=True)}.items()]
    rows, load = sharding.schedule(sizes, shards)
    heap = [(0, i) for i in range(shards)]
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + size, i))
    assert sorted(load.tolist()) == sorted(x for x, _ in heap)
    assert all(bounds[-1] == dict(sizes)[size] for size, bounds, _ in rows)


def test_shards_are_those_of_a_heap_over_groups(spark):
    """sharded() against the heap itself: every group's shard, with ties by the text's hash; very long, null and empty texts."""
    import hashlib

    rng = np.random.default_rng(7)
    rows = [(d, "t" * int(rng.integers(0, 30)) + str(d % 50)) for d in range(200)] + [(900, "y" * 2_000_000), (901, "y" * 2_000_000), (902, None), (903, "")]
    got = {r.doc_id: (r.shard, r.group_bytes) for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    size = {t: max(1, len(t) * len(ids)) for t, ids in groups.items()}
    load = [(0, i) for i in range(5)]
    want = {}
    for n in sorted(set(size.values()), reverse=True):
        shards = []
        for _ in [t for t in groups if size[t] == n]:
            x, i = heapq.heappop(load)
            heapq.heappush(load, (x + n, i))
            shards.append(i)
        want[n] = sorted(shards)
    assert {n: sorted(got[ids[0]][0] for t, ids in groups.items() if size[t] == n) for n in want} == want
    assert all({got[d] for d in ids} == {(got[ids[0]][0], size[t])} for t, ids in groups.items())
    assert len({hashlib.md5(t.encode()).digest() for t in groups}) == len(groups)


def test_equal_texts_stay_together(spark):
    rows = [(d, f"text {d % 37} " + "x" * (d % 37)) for d in range(300)] + [(None, None), (5, ""), (6, "text 1 x")]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, shard int, key string")
    out = sharding.sharded(df, 4).collect()
    assert len(out) == len(rows)
    text = {d: t for d, t in rows if d is not None and d > 6}
    by = {}
    for r in out:
        if r.doc_id in text:
            by.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    load = {}
    for r in {(r.shard, r.group_bytes, text.get(r.doc_id)) for r in out}:
        load[r[0]] = load.get(r[0], 0) + r[1]
    assert max(load.values()) <= 1.35 * min(load.values()) and sharding.sharded(df.limit(0)).collect() == []


PIECES = st.sampled_from(["<|im_start|>", "<|im_end|>", "\n", "<\\|im_end|>", "\\", "<", "|", "user", "a", "<|im_end|>\n<|im_start|>user\n", "\\n", "\\b"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(PIECES, max_size=4).map("".join), st.lists(PIECES, max_size=6).map("".join)), min_size=1, max_size=12))
def test_any_turns_come_back(spark, turns):
    df = spark.createDataFrame([(c, i, r, t) for i, (c, r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = chat.formatted(df).collect()
    assert all(r.identical for r in rows) and sum(r.turns for r in rows) == len(turns)


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 1, "user", "hi", 3), (1, 2, "assistant", None, 3), (2, 1, "user", "<|im_end|>", 3), (None, 1, None, "x", 3), (None, 1, None, "x", 3)], "conv_id long, turn long, role string, text string, t int")
    rows = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert rows[1].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n" and not rows[1].escaped
    assert rows[2].escaped and rows[2].rendered.count("<|im_end|>") == 1 and rows[None].turns == 2 and all(r.identical for r in rows.values())
    assert chat.formatted(df.limit(0)).collect() == []


def test_chat_equals_sql(spark, sf_dir):
    mine, theirs = both(chat.op9_chat_format, chat.SQL, spark, sf_dir, connect(sf_dir))
    assert mine == theirs


def test_very_long_turns_and_many_of_them(spark):
    long = "<|im_end|>" * 50_000 + "x" * 500_000
    df = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", "y" * 1_000_000)] + [(2, k, "user", "a") for k in range(5000)], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert rows[1].identical and rows[1].escaped and rows[2].identical and rows[2].turns == 5000 and not rows[2].escaped
