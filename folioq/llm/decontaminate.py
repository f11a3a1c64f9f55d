"""Benchmark decontamination by seeded local alignment (operator 3).

Words are runs of letters, digits and non-ASCII characters, lower-cased. One scan over the documents looks up every
n-gram of every text among those of the test items; hits of one item that one alignment of `SCORE` can hold are joined,
and where at least `HITS` different ones are, the passage around them is a candidate. An alignment pays for each inserted
word, so it is no longer than `reach` words; a passage that has too few of the item's words in any `reach` words is left
out, which loses nothing. The same scan counts in how many documents each n-gram occurs.
The candidates are then joined with the seeds, the rarest share `RARE` of each item's n-grams, and those with `HITS` seeds
or more are aligned with their items (Smith-Waterman, linear gaps). The score is a share of the item's alignment with
itself; passages from `SCORE` on are reported.

Rarity is relative to the item, so an item that leaked into thousands of documents keeps its seeds. The index of the
items is sent to the tasks in parts of at most `PART` n-grams, one scan a part, so its size is bounded.

Items of fewer than `LEAST` words are too short for n-gram seeds and are searched whole: a text that has all their words
in a row holds them, with score 1; edited copies of them are not searched for.

Defined results: null items and items without words are ignored. Null and empty texts have no passage; texts and items may
be of any length (a pair's alignment takes memory in proportion to the passage). Items with a null item_id are not reported, but count for
the filter. Rows with a null doc_id are not reported and are kept by the filter; of rows that repeat a doc_id
each is searched. Repeated item rows count once. Of an item's passages in a document the best is reported, the first of
equals. Extra columns are ignored by the report and kept by the filter; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.llm._spark import map_arrow, stash, table, without
from folioq.llm._text import SLICE, SPACE, Words, grams, slices, words

GRAM = 3
HITS = 2
RARE = 0.75
SCORE = 0.5
LEAST = 8
PART = 2_000_000
CELLS = 1 << 18
_MATCH, _MISS, _GAP = 2, -1, 1

_APART = SPACE.copy()
_APART[[c for c in range(33, 128) if not chr(c).isalnum()]] = True


def _words(texts: list) -> Words:
    return words(texts, space=_APART)


class Index:
    """The n-grams of some test items: sorted hashes, each with its item's number and place. Of items under LEAST words
    instead, by their number of words: sorted hashes of all the words, and the items' numbers."""

    def __init__(self, texts: list):
        w = _words(texts)
        length = np.diff(w.first)
        self.short = {}
        for n in np.unique(length[(length > 0) & (length < LEAST)]).tolist():
            h, at = grams(w, n)
            whole = length[w.doc[at]] == n
            order = np.argsort(h[whole], kind="stable")
            self.short[n] = h[whole][order], w.doc[at][whole][order]
        h, at = grams(w, GRAM)
        long = length[w.doc[at]] >= LEAST
        h, at = h[long], at[long]
        order = np.argsort(h, kind="stable")
        self.gram, self.item, self.place = h[order], w.doc[at][order], (at - w.first[w.doc[at]])[order]
        self.items = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.size = np.diff(w.first)
        self.known = np.unique(self.gram)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known & np.uint64((1 << 20) - 1)] = True


def reach(size: int) -> int:
    """The most words of text that an alignment of SCORE with an item of `size` words spans."""
    return size + int((1 - SCORE) * _MATCH * size / _GAP)


def find(index: Index, texts: list) -> tuple[np.ndarray, np.ndarray, list, list]:
    """N-grams of the index and in how many of the texts each occurs; candidate passages (text, item, first word, hashes
    of the passage's words, hashes of the n-grams hit); copies of short items (text, item, first word, words)."""
    w = _words(texts)
    h, at = grams(w, GRAM)
    hit = np.flatnonzero(index.maybe[h & np.uint64((1 << 20) - 1)])
    k = np.minimum(np.searchsorted(index.known, h[hit]), max(0, len(index.known) - 1))
    hit = hit[index.known[k] == h[hit]] if len(index.known) else hit[:0]
    h, at = h[hit], at[hit]
    doc = w.doc[at]
    seen = np.unique(np.stack([h, doc.astype(np.uint64)], 1), axis=0)[:, 0] if len(h) else h
    gram, count = np.unique(seen, return_counts=True)
    lo, hi = np.searchsorted(index.gram, h, "left"), np.searchsorted(index.gram, h, "right")
    n = hi - lo
    src = np.repeat(np.arange(len(h)), n)
    row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[src]
    d, item = doc[src], index.item[row]
    start, g = at[src] - w.first[d], h[src]
    order = np.lexsort((g, start, item, d))
    d, item, start, g = d[order], item[order], start[order], g[order]
    far = np.array([reach(int(n)) for n in index.size], np.int64)
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > far[item[1:]])
    bounds = np.r_[np.flatnonzero(new), len(d)].tolist()
    found = []
    for a, b in itertools.pairwise(bounds):
        if b - a < HITS or len(hits := np.unique(g[a:b])) < HITS:
            continue
        x, k = int(d[a]), int(item[a])
        size, span = int(w.first[x + 1] - w.first[x]), int(far[k])
        left, right = max(0, int(start[a]) - span), min(size, int(start[b - 1]) + span)
        passage = w.hash[w.first[x] + left : w.first[x] + right]
        same = np.r_[0, np.cumsum(np.isin(passage, index.items[k]))]
        begin = np.arange(max(1, len(passage) - span + 1))
        full = np.flatnonzero(same[np.minimum(begin + span, len(passage))] - same[begin] >= SCORE * index.size[k])
        if len(full):
            found.append((x, k, left + int(full[0]), passage[full[0] : full[-1] + span], hits))
    return gram, count, found, verbatim(index, w)


def aligned(items: list, passages: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each pair as a share of the item's own, and the passage's words where it starts and
    ends. A cell is the score, and below it the start: of equal scores the later start counts."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), cols), np.uint64)
    inside = np.zeros((len(items), cols), bool)
    size = np.array([len(x) for x in items])
    for k, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[k, : len(x)], b[k, : len(y)], inside[k, : len(y)] = x, y, True
    match, miss, gap = (np.int64(v << 32) for v in (_MATCH, _MISS, _GAP))
    here = np.arange(cols, dtype=np.int64)
    ramp = here * gap
    last = np.broadcast_to(here + 1, (len(items), cols)).copy()  # score 0: an alignment starts at the next word
    best, start, end = (np.zeros(len(items), np.int64) for _ in range(3))
    for i in range(rows):
        now = np.where((a[:, i : i + 1] == b) & inside, match, miss)
        now[:, 1:] += last[:, :-1]
        now = np.maximum(np.maximum(now, last - gap), here + 1)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        now[i >= size] = here + 1
        last = now
        score = last >> 32
        top = score.argmax(1)
        at = np.arange(len(items)), top
        more = score[at] > best
        start, end = np.where(more, last[at] & 0xFFFFFFFF, start), np.where(more, top, end)
        best = np.where(more, score[at], best)
    return best / (_MATCH * size), start, end


def align(items: list, passages: list) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair as a share of the item's own, and the passage's word where it ends."""
    value, _, end = aligned(items, passages)
    return value, end


def lots(lengths: list) -> Iterator[np.ndarray]:
    """Numbers of the passages by length, in lots of up to 256 and of bounded size when padded to the longest."""
    lot: list = []
    for k in np.argsort(lengths, kind="stable").tolist():
        if lot and (len(lot) == 256 or (len(lot) + 1) * lengths[k] > CELLS):
            yield np.array(lot)
            lot = []
        lot.append(k)
    if lot:
        yield np.array(lot)


def verbatim(index: Index, w: Words) -> list:
    """(text, item, first word, words) of the first verbatim copy of each short item in each text."""
    found: dict = {}
    for n, (known, item) in index.short.items():
        h, at = grams(w, n)
        lo, hi = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            x = int(w.doc[at[k]])
            for i in item[lo[k] : hi[k]].tolist():
                found.setdefault((x, i), (x, i, int(at[k] - w.first[x]), n))
    return list(found.values())


def candidates(docs: DataFrame, index: Index, names: list) -> DataFrame:
    """Rows of three kinds from one scan: (gram, n) counts, passages with all other columns, and copies of short items,
    n words from start on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(np.array([len(t or "") for t in texts], np.int64), SLICE):
                gram, count, found, copies = find(index, texts[part])
                none, none_too, none_either = [None] * len(gram), [None] * len(found), [None] * len(copies)
                both = found + copies
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*gram.view(np.int64).tolist(), *none_too, *none_either], pa.int64()),
                        pa.array([*count.tolist(), *none_too, *(c[3] for c in copies)], pa.int64()),
                        pa.array([*none, *(ids[part.start + f[0]].as_py() for f in both)], pa.int64()),
                        pa.array([*none, *(names[f[1]] for f in both)], pa.int64()),
                        pa.array([*none, *(f[2] for f in both)], pa.int64()),
                        pa.array([*none, *(f[3].view(np.int64) for f in found), *none_either], pa.list_(pa.int64())),
                        pa.array([*none, *(f[4].view(np.int64) for f in found), *none_either], pa.list_(pa.int64())),
                    ],
                    ["gram", "n", "doc_id", "item_id", "start", "passage", "hits"],
                )

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return map_arrow(known, run, "gram long, n long, doc_id long, item_id long, start long, passage array<long>, hits array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start, end): each document's best passage for each item it holds, in words."""
    spark = docs.sparkSession
    columns = "doc_id long, item_id long, score double, start long, end long"
    rows = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    parts, part, held = [], [], 0
    for r in rows.orderBy("i", "t").toLocalIterator():
        size = len(_words([r.t]).hash)
        if not size:
            continue
        if held + size > PART:
            parts, part, held = [*parts, part], [], 0
        part, held = [*part, (r.i, r.t)], held + size
    parts = [p for p in (*parts, part) if p]
    if not parts:
        return spark.createDataFrame([], columns)
    found = None
    for part in parts:
        names = [i for i, _ in part]
        index = Index([t for _, t in part])
        scan = stash(candidates(docs, index, names), "candidates")
        counts = scan.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("df"))
        pairs = np.unique(np.stack([index.gram.view(np.int64), index.item.astype(np.int64)], 1), axis=0)
        # As Arrow: lists would start a second set of Python processes on the executors, which stay.
        own = spark.createDataFrame(pa.table({"gram": pairs[:, 0], "item_id": np.array(names, np.int64)[pairs[:, 1]]}))
        by_item = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram")
        order = F.row_number().over(by_item) / F.count(F.lit(1)).over(Window.partitionBy("item_id"))
        seeds = own.join(counts, "gram", "left").withColumn("order", order).where(F.col("order") <= RARE).select("gram", "item_id")
        passages = scan.where("passage IS NOT NULL").select("doc_id", "item_id", "start", "passage", "hits")
        hit = passages.select("doc_id", "item_id", "start", F.size("passage").alias("size"), F.explode("hits").alias("gram")).join(seeds, ["gram", "item_id"])
        enough = hit.groupBy("doc_id", "item_id", "start", "size").agg(F.count_distinct("gram").alias("seeds")).where(F.col("seeds") >= HITS)
        chosen = passages.withColumn("size", F.size("passage")).join(enough.drop("seeds"), ["doc_id", "item_id", "start", "size"], "left_semi")
        items = {i: x for i, x in zip(names, index.items, strict=True) if len(x) >= LEAST}

        def score(batches: Iterator[pa.RecordBatch], items: dict = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                who, item, start = (batch.column(k) for k in (0, 1, 2))
                texts = [np.asarray(p, np.int64).view(np.uint64) for p in batch.column(3).to_pylist()]
                tests = [items[i] for i in item.to_pylist()]
                value, first, end = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                for lot in lots([len(t) for t in texts]):
                    value[lot], first[lot], end[lot] = aligned([tests[k] for k in lot], [texts[k] for k in lot])
                begin = start.to_numpy()
                yield pa.RecordBatch.from_arrays([who, item, pa.array(value), pa.array(begin + first), pa.array(begin + end + 1)], ["doc_id", "item_id", "score", "start", "end"])

        scored = map_arrow(chosen.select("doc_id", "item_id", "start", "passage"), score, columns).where(F.col("score") >= SCORE)
        copies = scan.where("gram IS NULL AND passage IS NULL").select("doc_id", "item_id", F.lit(1.0).alias("score"), "start", (F.col("start") + F.col("n")).alias("end"))
        scored = scored.union(copies)
        found = scored if found is None else found.union(scored)
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.start", "b.end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a passage of a test item, items without item_id among them."""
    text = F.col("text").cast("string")
    items = benchmark.select(F.xxhash64(text).alias("item_id"), text.alias("text"))
    return without(docs, stash(contaminated(docs, items).select("doc_id").distinct(), "contaminated"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))
