"""Sharding by longest-processing-time scheduling (operator 10).

Documents with equal text form a group that must stay together. Groups, largest first, go to the least-loaded shard
through a heap. Groups of one size are interchangeable, so the schedule is made on the histogram of group sizes: a size
held by many groups is placed in one step as far as the heap surely goes, and by the heap from there. The documents then look up
their shard by their group's size and its rank among the groups of that size.

Defined results: a null text counts as empty, so null and empty texts form one group; a group's size is the sum of its
texts' bytes, 1 at least. Every row gets a shard, also with a null or repeated doc_id; ties between sizes are broken by
the text's hash, ties between shards by the lower number. Texts may be of any length. The driver holds the histogram, whose
different sizes are at most the square root of twice the table's bytes. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm._spark import ranked, stash, table

SHARDS = 64


def schedule(sizes: list[tuple[int, int]], shards: int = SHARDS) -> tuple[list[tuple[int, list[int], list[int]]], np.ndarray]:
    """For (size, count) of the groups: rows (size, bounds, shards), where the ranks before bounds[0] go to shards[0],
    the next ones before bounds[1] to shards[1], and so on; and the shards' loads."""
    load, rows = np.zeros(shards, np.int64), []
    for size, count in sorted(sizes, reverse=True):
        # The heap hands out the `count` least of load + 0, size, 2 size, ... Those below a level that it surely passes are
        # counted at once, the rest goes through the heap itself.
        lo, hi = int(load.min()), int(load.max()) + size * (count // shards + 2)
        while hi - lo > 1:
            level = (lo + hi) // 2
            lo, hi = (level, hi) if np.maximum(0, -((load - level) // size)).sum() <= count else (lo, level)
        given = np.maximum(0, -((load - lo) // size))
        heap = [(int(x), i) for i, x in enumerate(load + given * size)]
        heapq.heapify(heap)
        for _ in range(count - int(given.sum())):
            x, i = heap[0]
            heapq.heapreplace(heap, (x + size, i))
            given[i] += 1
        load += given * size
        used = np.flatnonzero(given)
        rows.append((size, np.cumsum(given[used]).tolist(), used.tolist()))
    return rows, load


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, shard, group_bytes) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), F.octet_length(text).alias("bytes")), "texts")
    groups = stash(rows.groupBy("key").agg(F.greatest(F.sum("bytes"), F.lit(1)).alias("size")), "groups")
    sizes = [(r.size_, r.n) for r in groups.groupBy(F.col("size").alias("size_")).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    placed, _ = schedule(sizes, shards)
    frame = pd.DataFrame(placed, columns=["size", "bounds", "shards"])
    steps = stash(spark.createDataFrame(frame, "size long, bounds array<long>, shards array<int>"), "schedule")
    at = F.size(F.filter("bounds", lambda b: b <= F.col("rank"))) + 1
    lookup = ranked(groups, "size", ["key"]).join(steps, "size").select("key", F.col("size").alias("group_bytes"), F.element_at("shards", at).alias("shard"))
    return rows.join(lookup, "key").select("doc_id", "shard", "group_bytes")


def op10_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
