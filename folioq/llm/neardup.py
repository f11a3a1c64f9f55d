"""Near-duplicate search by a signature-coordinate inverted join (operator 4).

Every document gets `coordinates` MinHash values over word shingles. Documents are posted under each
(coordinate, value) token, and a pair is kept when it collides on at least `matches` coordinates. Three exact
reductions keep the join small:

* documents with one and the same signature are a class, which enters once and is named by its least doc_id;
* prefix merging: tokens are ordered by how many signatures hold them; two signatures with `matches` common tokens share
  one among each one's first `coordinates - matches + 1` tokens, so only these are posted. Tokens held once fill the
  prefix but are never posted, so a document without a partner posts nothing;
* skip merging: the longer lists (the rest of the tokens) are never merged. A post carries how many tokens follow it in its
  document's order; a pair whose collisions so far, and all that may follow its last one, stay below `matches` is skipped,
  and for the others the rest is probed, coordinate by coordinate.

The result has a row a document, with its group and the number of its links, so copies aren't expanded into pairs. Classes
are known by 64-bit hashes of their signatures.

Defined results: a null doc_id, null text and a text without words have no partner. A text of fewer words than a shingle
is one shingle. Rows that repeat a doc_id count as one document (each of the row's signatures is searched).
A text of any length has one signature. Extra columns (also of the names used here) are ignored by the search and kept by
the filter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.llm._spark import drop_stash, map_arrow, stash, table, without
from folioq.llm._text import SLICE, grams, range_hash, slices, words

COORDINATES = 64
MATCHES = 30
SHINGLE = 3


def signatures(texts: list, coordinates: int = COORDINATES, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values, one row a text, and a mask of the texts that have any word."""
    mult = np.random.default_rng(7).integers(1, 1 << 31, coordinates).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(texts), coordinates), np.uint32)
    w = words(texts)
    count = np.diff(w.first)
    h, at = grams(w, shingle)
    doc = w.doc[at]
    short = np.flatnonzero((count > 0) & (count < shingle))
    h = np.concatenate([h, range_hash(w.hash, w.first[short], w.first[short + 1])])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    h, doc = (h[order] >> np.uint64(32)).astype(np.uint32), doc[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(first):
        for k in range(coordinates):
            v = h * mult[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            out[doc[first], k] = np.minimum.reduceat(v, first)
    return out, count > 0


def signed(docs: DataFrame, coordinates: int = COORDINATES, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sig) of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(np.array([len(t or "") for t in texts], np.int64), SLICE):
                sig, any_word = signatures(texts[part], coordinates, shingle)
                flat = pa.array(sig[any_word].view(np.int32).ravel())
                offsets = pa.array(np.arange(int(any_word.sum()) + 1, dtype=np.int32) * coordinates)
                yield pa.RecordBatch.from_arrays([ids[part.start : part.stop].filter(pa.array(any_word)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "sig"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return map_arrow(known, run, "doc_id long, sig array<int>")


#: Tokens that share one of HASH_BUCKETS buckets with more than HOT_ROWS posts are counted in two levels, and classes of more
#: than HOT_ROWS documents looked up by broadcast: there are rows / HOT_ROWS of either at most.
HASH_BUCKETS = 1 << 14
HOT_ROWS = 1_000_000


@dataclass
class Near:
    """Classes (key, rep, n) of equal signatures, members (doc_id, key), and pairs (ka, kb, ra, rb, matches) of classes."""

    classes: DataFrame
    members: DataFrame
    pairs: DataFrame


def _counted(tokens: DataFrame) -> DataFrame:
    """(key, token, df) of the tokens that several keys hold. Only buckets known to be of bounded size are counted in a window; the
    others' tokens are counted in parts by salt, which are then summed."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(HASH_BUCKETS))
    hot = [r.b for r in tokens.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ROWS).collect()]  # HASH_BUCKETS at most
    light = tokens.where(~bucket.isin(hot)) if hot else tokens
    counted = light.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    if not hot:
        return counted
    heavy = tokens.where(bucket.isin(hot)).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    parts = heavy.groupBy("token", "salt").agg(F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("token").agg(F.sum("n").alias("df"), F.collect_list("salt").alias("salts")).where("df > 1")  # 64 salts at most
    return counted.unionByName(heavy.join(sums.select("token", "df", F.explode("salts").alias("salt")), ["token", "salt"]).drop("salt"))


def near(docs: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES, shingle: int = SHINGLE) -> Near:
    """All pairs of distinct signatures with enough collisions, and who has which signature."""
    sigs = stash(signed(docs, coordinates, shingle).withColumn("key", F.xxhash64("sig")), "signatures")
    members = stash(sigs.select("doc_id", "key").distinct(), "members")
    classes = stash(members.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    one = stash(sigs.groupBy("key").agg(F.first("sig").alias("sig")), "one")
    token = F.shiftleft(F.col("value").cast("long"), 8).bitwiseOR(F.col("pos").cast("long"))
    tokens = one.select("key", F.posexplode("sig").alias("pos", "value")).select("key", token.alias("token"))
    lists = _counted(tokens).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).where(F.size("t") >= matches)
    # A post knows how many of its document's tokens come after it in the common order.
    posts = lists.select("key", F.size("t").alias("m"), F.posexplode(F.slice("t", F.lit(1), F.size("t") - (matches - 1))).alias("at", "p"))
    posts = stash(posts.select("key", F.col("p.token").alias("token"), (F.col("m") - F.col("at") - 1).alias("rest")), "posts")
    a, b = posts.alias("a"), posts.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("ka"), F.col("b.key").alias("kb"), F.least("a.rest", "b.rest").alias("rest"))
    # The rest of a pair's lists is skipped where even full agreement there can't reach `matches`; else it is probed.
    found = met.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"), F.min("rest").alias("rest")).where(F.col("n") + F.col("rest") >= matches).select("ka", "kb")
    left, right = (one.join(classes.select("key", "rep"), "key").select(F.col("key").alias(f"k{x}"), F.col("rep").alias(f"r{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    hits = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    pairs = found.join(left, "ka").join(right, "kb").withColumn("matches", hits).where(F.col("matches") >= matches)
    return Near(classes, members, stash(pairs.select("ka", "kb", "ra", "rb", "matches"), "pairs"))


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root): the least node that each node of an undirected graph is connected with. Nodes without an edge are
    absent. Alternates large-star and small-star steps, each written to the shared folder, until nothing changes; least
    neighbours are found by grouping with partial minima, and the step before is deleted."""
    spark = edges.sparkSession
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u != v").distinct()
    now, mark = stash(now, "edges"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("v"))).groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = least.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, stash(small, "edges")
        drop_stash(spark, last)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()


def near_groups(docs: DataFrame, **params) -> DataFrame:
    """One row a document that has a near-duplicate: (doc_id, group_doc_id, links). Pairs are closed transitively; a group is
    named by its least doc_id; links counts the documents whose signature is the same or collides often enough."""
    found = near(docs, **params)
    # A doc_id with several texts joins their classes.
    several = found.members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("ka")).where("c > 1").select("doc_id", "ka")
    reps = found.classes.select("key", "rep")
    ties = found.members.join(several, "doc_id").select("ka", F.col("key").alias("kb")).where("ka != kb")
    ties = ties.join(reps.select(F.col("key").alias("ka"), F.col("rep").alias("ra")), "ka").join(reps.select(F.col("key").alias("kb"), F.col("rep").alias("rb")), "kb").select("ra", "rb")
    roots = stash(components(found.pairs.select("ra", "rb").union(ties), "ra", "rb"), "roots")
    sides = found.pairs.select(F.col("ka").alias("key"), F.col("kb").alias("other")).union(found.pairs.select("kb", "ka"))
    far = sides.join(found.classes.select(F.col("key").alias("other"), "n"), "other").groupBy("key").agg(F.sum("n").alias("far"))
    known = found.classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").join(far, "key", "left").where("n > 1 OR root IS NOT NULL")
    known = stash(known.select("key", "n", F.coalesce("root", "rep").alias("group_doc_id"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links")), "known")
    hot = F.broadcast(known.where(F.col("n") > HOT_ROWS))
    rest = found.members.join(hot.select("key"), "key", "left_anti").join(known.where(F.col("n") <= HOT_ROWS), "key")
    both = found.members.join(hot, "key").unionByName(rest)
    # Rows that share a doc_id and differ in text are one document.
    return both.groupBy("doc_id").agg(F.min("group_doc_id").alias("group_doc_id"), F.sum("links").alias("links"))


def drop_near(docs: DataFrame, **params) -> DataFrame:
    """`docs` without all but the least doc_id of each near-duplicate group. Documents in no group stay as they are,
    those without doc_id or words among them; rows that share a doc_id stay or go together."""
    return without(docs, stash(near_groups(docs, **params).where("doc_id != group_doc_id").select("doc_id"), "gone"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)
