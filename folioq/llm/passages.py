"""Repeated passages by column-wise suffix-array construction (operator 8).

A passage of `PASSAGE` words or more that occurs in two documents is found whole, at every place where it occurs:

* every text is winnowed: of each WINDOW consecutive grams of GRAM words the one of least hash is an anchor. GRAM +
  WINDOW - 1 = PASSAGE, so each such passage holds an anchor at the same place in all its copies;
* an anchor that occurs in one document only is done with. Of the others the segment around the anchor, at most
  PASSAGE - GRAM words more on either side, is taken; equal segments of an anchor enter once, with the least and the
  greatest of the documents that hold them. A segment is wide enough to tell whether the anchor lies in a repeated passage;
* segments are brought together by anchor. A collection of them is sorted column by column: each round inserts, for
  each segment, the suffix that is one word longer. Its place follows from the Burrows-Wheeler transform (the word before
  the previous suffix, and how many equal words stand before that one); the common prefix with its new neighbours is one
  more than the least common prefix between the suffixes without their first word. Transform, common prefixes, links and
  suffixes are read from one sequential file a round and written to the next, in the shared folder;
* runs of suffixes with common prefixes of PASSAGE words that belong to different documents are repeated passages. Each
  segment's part is carried back to all its places, and overlapping parts are merged.

A text may be of any length. An anchor with over `LARGE` different segments would fill one task; these are resolved by grouping their passages of
exactly PASSAGE words instead, with equal results.

Words are runs of bytes other than ASCII white space and control characters, compared as they stand. Defined results:
rows that are equal in doc_id and text are one document; rows that share a doc_id but not the text are different ones.
Rows with a null doc_id take part and are reported with a null doc_id. Null, empty and short texts have no passage;
a passage that repeats within one document only is none. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.llm._spark import drop_stash, map_arrow, shared_dir, stash, table
from folioq.llm._text import _GRAM as BASE
from folioq.llm._text import grams, mix, range_hash, slices, words

PASSAGE = 50
GRAM = 25
WINDOW = PASSAGE - GRAM + 1
ARM = PASSAGE - GRAM
#: Segments that are sorted together, at least, and from which an anchor is resolved by grouping.
COLLECTION = 12_000
LARGE = 60_000
_LINK = (1 << 32) - 1


def anchors(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: text, place of its first word in the text, hash, and hash of its segment."""
    w = words(texts, lower=False)
    h, at = grams(w, GRAM)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, place, width = h, np.arange(len(h)), 1

    def join(step: int) -> None:  # of equals the right one counts
        nonlocal least, place
        a, b = least[:-step], least[step:]
        right = b <= a
        least, place = np.where(right, b, a), np.where(right, place[step:], place[:-step])

    while 2 * width <= WINDOW:
        join(width)
        width *= 2
    if width < WINDOW:
        join(WINDOW - width)
    whole = w.doc[at[:n]] == w.doc[at[WINDOW - 1 :]]
    chosen = np.unique(place[whole])
    first = at[chosen]
    doc = w.doc[first]
    lo, hi = np.maximum(w.first[doc], first - ARM), np.minimum(w.first[doc + 1], first + GRAM + ARM)
    segment = mix(range_hash(w.hash, lo, hi, BASE) + (first - lo).astype(np.uint64))
    return doc, first - w.first[doc], h[chosen].view(np.int64), segment.view(np.int64)


class Minima:
    """Least values of ranges of an array, by a table over blocks of 8."""

    def __init__(self, values: np.ndarray):
        self.values = values
        n = -(-len(values) // 8) * 8
        padded = np.full(n, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        level = padded[::8].copy()
        for k in range(1, 8):
            np.minimum(level, padded[k::8], out=level)
        levels, width = [level], 1
        while 2 * width <= n // 8:
            level = np.minimum(level[:-width], level[width:])
            levels.append(level)
            width *= 2
        self.offset = np.r_[0, np.cumsum([len(x) for x in levels])]
        self.levels = np.concatenate(levels)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(values[a:b]) of each pair a < b."""
        out = self.values[a]
        for k in range(8):
            np.minimum(out, self.values[np.minimum(a + k, b - 1)], out=out)
            np.minimum(out, self.values[np.maximum(b - 1 - k, a)], out=out)
        lo, hi = (a + 7) // 8, b // 8
        far = np.flatnonzero(hi > lo)
        if len(far):
            lo, hi = lo[far], hi[far]
            level = np.frexp((hi - lo).astype(float))[1] - 1
            at = self.offset[level]
            out[far] = np.minimum(out[far], np.minimum(self.levels[at + lo], self.levels[at + hi - (1 << level)]))
        return out


class Rounds:
    """The sequential file that each round leaves to the next: arrays one after the other."""

    KINDS = (np.int32, np.uint8, np.int64, np.int32)

    def __init__(self, folder: str):
        self.fs, base = fs.FileSystem.from_uri(folder)
        self.folder = f"{base}/columns-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder)
        self.at = 0

    def write(self, arrays: tuple) -> None:
        """Leave the arrays to the next round, and drop what this round read."""
        with self.fs.open_output_stream(f"{self.folder}/{self.at + 1}", compression=None) as out:
            for a in arrays:
                out.write(np.ascontiguousarray(a).data)
        if self.at:
            self.fs.delete_file(f"{self.folder}/{self.at}")
        self.at += 1

    def read(self, n: int) -> list[np.ndarray]:
        with self.fs.open_input_stream(f"{self.folder}/{self.at}", compression=None) as f:
            return [np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind).copy() for kind in self.KINDS]

    def close(self) -> None:
        self.fs.delete_dir(self.folder)


def suffixes(codes: np.ndarray, size: np.ndarray, files: Rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes, in order, of rows of words (codes from 1 on; row i has size[i] of them): row, length, common prefix with the
    one before, and the word before it (0: none). Each row ends with a mark of its own, less than any word, in row order."""
    m = len(size)
    rows = np.arange(m)
    where = rows.copy()  # of each row's longest suffix so far
    n = m
    files.write((np.where(size > 0, codes[rows, size - 1], 0).astype(np.int32), np.zeros(m, np.uint8), rows, (rows * 128).astype(np.int32)))
    for length in range(1, int(size.max()) + 1 if m else 0):
        before, common, link, suffix = files.read(n)
        row = np.flatnonzero(size >= length)
        tail = where[row]
        word = before[tail].astype(np.int64)
        new = (word << 32) | tail
        order = np.argsort(new, kind="stable")
        row, tail, word, new = row[order], tail[order], word[order], new[order]
        at = np.searchsorted(link, new)
        previous = link[at - 1]
        together = at[1:] == at[:-1]
        previous[1:][together] = new[:-1][together]
        least = Minima(common)
        prefix = np.zeros(len(row), np.uint8)
        same = np.flatnonzero(previous >> 32 == word)
        prefix[same] = 1 + least((previous[same] & _LINK) + 1, tail[same] + 1)
        last = np.flatnonzero(np.r_[~together, True])
        last = last[at[last] < n]
        following = link[at[last]]
        last, following = (x[following >> 32 == word[last]] for x in (last, following))
        common[at[last]] = 1 + least(tail[last] + 1, (following & _LINK) + 1)
        moved = np.arange(n) + np.cumsum(np.bincount(at, minlength=n + 1))[:n]
        link = (link & ~_LINK) | moved[link & _LINK]
        place = at + np.arange(len(row))
        where[row] = place
        old = np.ones(n + len(row), bool)
        old[place] = False
        rest = size[row] - 1 - length
        made = (np.where(rest >= 0, codes[row, np.maximum(rest, 0)], 0), prefix, (word << 32) | moved[tail], row * 128 + length)
        merged = []
        for had, add in zip((before, common, link, suffix), made, strict=True):
            both = np.empty(len(old), had.dtype)
            both[old], both[place] = had, add
            merged.append(both)
        n = len(old)
        files.write(tuple(merged))
    before, common, _, suffix = files.read(n)
    return suffix // 128, suffix % 128, common, before


def repeated(hashes: np.ndarray, size: np.ndarray, least: np.ndarray, greatest: np.ndarray, files: Rounds) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment (its words' hashes one after the other in `hashes`; documents from `least` to `greatest` hold it): the
    bounds of the part that repeats across documents, 0 and 0 if none does."""
    m = len(size)
    codes = np.zeros((m, int(size.max())), np.int32)
    codes[np.arange(codes.shape[1]) < size[:, None]] = np.unique(hashes, return_inverse=True)[1] + 1
    row, length, common, _ = suffixes(codes, size, files)
    start = np.flatnonzero(common < PASSAGE)
    several = np.minimum.reduceat(least[row], start) < np.maximum.reduceat(greatest[row], start)
    hit = np.flatnonzero(np.repeat(several, np.diff(np.r_[start, len(row)])) & (length >= PASSAGE))
    lo, hi = np.full(m, 1 << 30), np.zeros(m, np.int64)
    first = size[row[hit]] - length[hit]
    # A segment's passages overlap, as it is under twice as long, so together they are one part.
    np.minimum.at(lo, row[hit], first)
    np.maximum.at(hi, row[hit], first + PASSAGE)
    return np.where(hi > 0, lo, 0), hi


def _row_id() -> Column:
    return F.xxhash64("doc_id", "text")


def _anchored(docs: DataFrame) -> DataFrame:
    """(row, place, anchor, segment) of every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in slices(np.array([len(t or "") for t in texts], np.int64), 2 << 20):
                doc, place, anchor, segment = anchors(texts[part])
                yield pa.RecordBatch.from_arrays([pa.array(ids[part.start + doc]), pa.array(place.astype(np.int32)), pa.array(anchor), pa.array(segment)], ["row", "place", "anchor", "segment"])

    return map_arrow(docs.select("row", "text"), run, "row long, place int, anchor long, segment long")


def _worded(texts: DataFrame) -> DataFrame:
    """From texts with the list of their segments: the segments with their words' hashes."""
    kind = "anchor long, segment long, least long, greatest long, large boolean, words array<long>"
    names = ["anchor", "segment", "least", "greatest", "large"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column(0).to_pylist(), batch.column(1)
            for part in slices(np.array([len(t) for t in texts], np.int64), 2 << 20):
                w = words(texts[part], lower=False)
                lists = wanted[part.start : part.stop]
                flat = lists.flatten()
                place = flat.field("place").to_numpy() + np.repeat(w.first[:-1], pa.compute.list_value_length(lists).to_numpy())
                doc = w.doc[place]
                lo, hi = np.maximum(w.first[doc], place - ARM), np.minimum(w.first[doc + 1], place + GRAM + ARM)
                ends = np.cumsum(hi - lo)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - (hi - lo)), hi - lo)
                hashes = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(w.hash[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in names), hashes], [*names, "words"])

    return map_arrow(texts, run, kind)


def _sorted_out(segments: DataFrame, folder: str) -> DataFrame:
    """(anchor, segment, lo, hi): the repeated part of each segment, from collections in which an anchor's segments are
    together."""

    def batches_by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < COLLECTION:
                continue
            whole = pa.Table.from_batches(held)
            anchor = whole.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on in the next batch
            begin = 0
            while cut - begin >= COLLECTION:
                end = min(cut, int(np.searchsorted(anchor, anchor[min(begin + COLLECTION, cut) - 1], "right")))
                yield whole.slice(begin, end - begin)
                begin = end
            held = whole.slice(begin).to_batches()
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches_by_anchor(batches):
            if not found.num_rows:
                continue
            lists = found.column("words").combine_chunks()
            files = Rounds(folder)
            try:
                lo, hi = repeated(lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64), found.column("least").to_numpy(), found.column("greatest").to_numpy(), files)
            finally:
                files.close()
            keep = pa.array(hi > 0)
            columns = [*(found.column(n).combine_chunks() for n in ("anchor", "segment")), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["anchor", "segment", "lo", "hi"])

    together = segments.select("anchor", "segment", "least", "greatest", "words").repartition("anchor").sortWithinPartitions("anchor")
    return map_arrow(together, run, "anchor long, segment long, lo int, hi int")


def _grouped_out(segments: DataFrame) -> DataFrame:
    """The same by grouping the segments' passages of PASSAGE words."""
    starts = F.when(F.size("words") >= PASSAGE, F.sequence(F.lit(0), F.size("words") - PASSAGE))
    each = segments.select("anchor", "segment", "least", "greatest", "words", F.explode(starts).alias("at"))
    each = each.withColumn("passage", F.xxhash64("anchor", F.slice("words", F.col("at") + 1, F.lit(PASSAGE)))).drop("words")
    several = each.groupBy("passage").agg(F.min("least").alias("a"), F.max("greatest").alias("b")).where("a < b").select("passage")
    return each.join(several, "passage").groupBy("anchor", "segment").agg(F.min("at").alias("lo"), (F.max("at") + PASSAGE).alias("hi"))


def repeats(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(doc_id, start, end): maximal runs of words covered by passages that occur in several documents too."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("row", _row_id())
    # Grouped with partial sums and joined, never windowed: an anchor in many documents is spread over tasks.
    every = stash(_anchored(docs), "every")
    several = every.groupBy("anchor").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("anchor")
    shared = stash(every.join(several, "anchor", "left_semi"), "anchors")
    drop_stash(spark, every)
    one = shared.groupBy("anchor", "segment").agg(F.min("row").alias("least"), F.max("row").alias("greatest"), F.min(F.struct("row", "place")).alias("r"))
    crowded = one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).select("anchor", F.lit(True).alias("large"))
    one = one.join(crowded, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    wanted = one.groupBy(F.col("r.row").alias("row")).agg(F.collect_list(F.struct(F.col("r.place").alias("place"), "anchor", "segment", "least", "greatest", "large")).alias("wanted"))
    segments = stash(_worded(docs.join(wanted, "row").select("text", "wanted")), "segments")
    parts = _sorted_out(segments.where("NOT large"), shared_dir(spark)).union(_grouped_out(segments.where("large")))
    left = F.least(F.col("place"), F.lit(ARM))
    spans = shared.join(parts, ["anchor", "segment"]).select("row", (F.col("place") - left + F.col("lo")).alias("start"), (F.col("place") - left + F.col("hi")).alias("end"))
    in_row = Window.partitionBy("row").orderBy("start", "end")
    opened = F.coalesce(F.col("start") > F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    island = F.sum(opened.cast("int")).over(in_row.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.distinct().withColumn("opened", opened).withColumn("island", island).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.join(docs.select("row", "doc_id").distinct(), "row").select("doc_id", "start", "end")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH texts AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
listed AS (
  SELECT doc_id, md5(text) AS t, list_filter(regexp_split_to_array(text, '[\x00-\x20\x7f]+'), lambda w: w <> '') AS w FROM texts),
passages AS (
  SELECT doc_id, t, pos, md5(array_to_string(w[pos + 1 : pos + {PASSAGE}], ' ')) AS p
  FROM (SELECT *, unnest(range(len(w) - {PASSAGE - 1})) AS pos FROM listed WHERE len(w) >= {PASSAGE})),
several AS (
  SELECT p FROM passages GROUP BY p HAVING count(DISTINCT (doc_id, t)) > 1),
hits AS (
  SELECT DISTINCT doc_id, t, pos FROM passages WHERE p IN (SELECT p FROM several)),
opened AS (
  SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY doc_id, t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {PASSAGE}, true) AS opens FROM hits),
islands AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, t ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM opened)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + {PASSAGE} AS INTEGER) AS "end" FROM islands GROUP BY doc_id, t, island
"""
