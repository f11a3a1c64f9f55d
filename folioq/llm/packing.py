"""Best-fit packing of documents into fixed-size sequences by linear grouping (operator 5).

Lengths are tokens, as operator 6 counts them. A text longer than the capacity is cut into full pieces and a rest. The plan is made on the
histogram of piece lengths, which has at most `capacity` entries whatever the corpus size:

* pieces over capacity / SMALL are large: in order of falling length they form GROUPS groups of equal cardinality, and
  each group's lengths are rounded up to its greatest;
* with so few sizes, the bins' possible contents (configurations) are enumerated and a linear program over them is
  solved by the simplex method; its counts are rounded up;
* the actual pieces take the slots of their group, which leaves each bin at least the planned room;
* the small pieces then go, longest first, to the bin with the least room that holds them.

Bins alike in room are handled as ranges, so no step is per document; each piece finds its bin from its rank by length.

The simplex method stops after `STEPS` exchanges at the latest; as every basis on the way is a feasible plan, the result is
then whole too, only less tight.

Defined results: null and empty texts have no piece; a text may be of any length. Every row is packed, also with a null or repeated
doc_id. Pieces of equal length are interchangeable; which gets which bin follows doc_id and piece. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.llm import tokens
from folioq.llm._spark import map_arrow, ranked, stash, table
from folioq.llm.tokens import VOCABULARY

CAPACITY = 2048
SMALL = 8
GROUPS = 10
STEPS = 2000


def configurations(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All non-empty multisets of `sizes` that fit, one row each: how often each size occurs."""
    found = np.zeros((1, len(sizes)), np.int64)
    for g, size in enumerate(sizes):
        room = capacity - found @ sizes
        most = room // size
        rows = np.repeat(found, most + 1, axis=0)
        rows[:, g] = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(most + 1)[:-1]], most + 1)
        found = rows
    return found[found.any(1)]


def fewest_bins(sizes: np.ndarray, need: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many bins of each: the linear program's optimum, rounded up."""
    choices = configurations(sizes, capacity).astype(float)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(STEPS):
        inverse = np.linalg.inv(basis)
        x = inverse @ need
        price = np.ones(len(sizes)) @ inverse
        worth = choices @ price
        best = int(worth.argmax())
        if worth[best] <= 1 + 1e-9:
            break
        step = inverse @ choices[best]
        ratio = np.where(step > 1e-12, x / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = choices[best]
    x = np.linalg.inv(basis) @ need
    return [(basis[:, k].astype(np.int64), int(np.ceil(x[k] - 1e-7))) for k in range(len(sizes)) if x[k] > 1e-7]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[dict[int, int], np.ndarray, int]:
    """Plan for pieces given as {length: count}.

    Returns the first rank of each length (rank 0 is the longest piece); rows (rank, bin, each): from that rank on,
    `each` consecutive ranks share a bin, starting with `bin`; and the number of bins.
    """
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    count = np.array([counts[n] for n in lengths], np.int64)
    begin = np.r_[0, np.cumsum(count)]
    first = dict(zip(lengths, begin.tolist(), strict=False))
    entries: list[tuple[int, int, int]] = []
    bins = 0
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def free(left: int, at: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((at, n))

    if first.get(capacity) is not None:
        entries.append((0, 0, 1))
        bins = counts[capacity]
    size = np.array(lengths, np.int64)
    large = int(np.searchsorted(-size, -(capacity // small)))  # lengths[:large] are over capacity / small
    lo, hi = bins, int(begin[large])
    if hi > lo:
        cut = np.unique(np.linspace(lo, hi, min(groups, hi - lo) + 1).astype(np.int64))
        top = size[np.searchsorted(begin, cut[:-1], "right") - 1]
        need = np.diff(cut)
        # Groups that round to one size are one.
        head = np.flatnonzero(np.diff(top, prepend=-1))
        top, need, cut = top[head], np.add.reduceat(need, head), np.r_[cut[:-1][head], hi]
        used = np.zeros(len(top), np.int64)
        for config, n in fewest_bins(top, need.astype(float), capacity):
            breaks, taken = [np.zeros(1, np.int64)], []
            for g in np.flatnonzero(config):
                a, from_, end = int(config[g]), int(cut[g] + used[g]), int(cut[g + 1])
                if from_ < end:
                    entries.append((from_, bins, a))
                for j in range(a):
                    edge = np.r_[begin[1 : large + 1], end]
                    at = -((from_ + j - edge[(edge > from_ + j) & (edge <= end)]) // a)
                    breaks.append(at[at < n])
                    taken.append((from_ + j, a, end))
                used[g] += min(n * a, int(need[g] - used[g]))
            at = np.unique(np.concatenate(breaks))
            full = np.zeros(len(at), np.int64)
            for from_, a, end in taken:
                rank = from_ + at * a
                full += np.where(rank < end, size[np.minimum(np.searchsorted(begin, rank, "right") - 1, len(size) - 1)], 0)
            for k, width in zip(range(len(at)), np.diff(np.r_[at, n]).tolist(), strict=True):
                free(capacity - int(full[k]), bins + int(at[k]), width)
            bins += n
    for i in range(large, len(lengths)):
        n, rank, left = lengths[i], int(begin[i]), int(count[i])
        while left:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                wide = -(-left // (capacity // n))
                free(capacity, bins, wide)
                bins += wide
                k = bisect_left(rooms, n)
            r = rooms[k]
            at, m = room[r].pop()
            if not room[r]:
                del room[r], rooms[k]
            each = r // n
            whole = min(m, left // each)
            if whole:
                entries.append((rank, at, each))
                rank, left = rank + whole * each, left - whole * each
                free(r - each * n, at, whole)
            rest = m - whole
            if rest and left:  # fewer than `each` are left: they share the next bin
                entries.append((rank, at + whole, each))
                free(r - left * n, at + whole, 1)
                rest, left = rest - 1, 0
                free(r, at + whole + 1, rest)
            else:
                free(r, at + whole, rest)
    return first, np.array(sorted(entries), np.int64).reshape(-1, 3), bins


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length) in tokens, or in white-space words for no vocabulary, for every text that has any."""
    if vocabulary is None:
        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))
    else:
        counted = tokens.counted(docs, vocabulary).select("doc_id", F.col("tokens").alias("n"))
    counted = counted.where("n > 0")
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece") * F.lit(capacity).cast("long")
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length"))


def packed(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, bin, offset): where each piece goes; start and offset count tokens."""
    cut = stash(pieces(docs, capacity, vocabulary), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    first, steps, _ = plan(counts, capacity, groups, small)
    begin = np.zeros(capacity + 1, np.int64)
    for n, at in first.items():
        begin[n] = at

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            at = begin[length] + rank
            row = steps[np.searchsorted(steps[:, 0], at, "right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(row[:, 1] + (at - row[:, 0]) // row[:, 2]), pa.array(at)], ["doc_id", "piece", "start", "length", "bin", "at"])

    placed = map_arrow(ranked(cut, "length", ["doc_id", "piece"]).select("doc_id", "piece", "start", "length", "rank"), place, "doc_id long, piece int, start long, length int, bin long, at long")
    before = Window.partitionBy("bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("int")).drop("at")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)
