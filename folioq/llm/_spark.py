"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from folioq.llm._text import SLICE, slices
from folioq.sources.shared import shared_dir, stash  # noqa: F401


def drop_stash(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bound of the Arrow batches that go to Python: rows, and bytes (one row may be longer).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


#: Cached functions whose results a Python process keeps for its next tasks of the same kind.
KEPT: list = []


def forget(but: Callable | None = None) -> None:
    """Empty the caches that tasks of other kinds have left in this process."""
    for cached in KEPT:
        if cached is not but:
            cached.cache_clear()


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType, keeps: Callable | None = None) -> DataFrame:
    """df.mapInArrow in batches of bounded size; a task gives its memory back to the system when it ends, as its Python
    process serves other tasks after it. Of the caches in KEPT, it begins with `keeps` alone."""
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(bounded, schema)


def ranked(df: DataFrame, key: str, tie: list[str], rank: str = "rank", salts: int = 64) -> DataFrame:
    """Add `rank`, 0, 1, ... among the rows of equal integer `key`, without one task per key.

    Rows are ranked in sub-groups (key, salt of the tie columns); the sub-groups' counts, `salts` a key at most,
    give each its first rank. The order among equal keys is arbitrary but repeatable.
    """
    salt = F.pmod(F.xxhash64(*tie), F.lit(salts)).cast("int")
    df = df.withColumn("_salt", salt)
    sizes = df.groupBy(key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    local = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*tie)) - 1
    return df.withColumn("_local", local).join(sizes, [key, "_salt"]).withColumn(rank, F.col("_from") + F.col("_local")).drop("_salt", "_from", "_local")


def map_texts(docs: DataFrame, fn: Callable, schema: str, most: int = SLICE, keeps: Callable | None = None) -> DataFrame:
    """Apply fn(texts) -> (keep mask or None, {column: array}) to slices of (doc_id, text) of about `most` characters.

    The result has doc_id and fn's columns, for the rows that the mask keeps. A null text reaches fn as None.
    """
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(np.array([len(t or "") for t in texts], np.int64), most):
                mask, columns = fn(texts[part])
                arrays = [batch.column(0)[part.start : part.stop], *(c if isinstance(c, pa.Array) else pa.array(c) for c in (columns[n] for n in names))]
                yield pa.RecordBatch.from_arrays([a if mask is None else a.filter(pa.array(mask)) for a in arrays], ["doc_id", *names])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(known, run, f"doc_id long, {schema}", keeps)


def keep_texts(docs: DataFrame, fn: Callable, most: int = SLICE) -> DataFrame:
    """Rows of `docs`, with all their columns, for which fn(texts) gives True; fn sees slices of about `most` characters."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [fn(texts[part]) for part in slices(np.array([len(t or "") for t in texts], np.int64), most)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return map_arrow(docs, run, docs.schema)


def sampled(df: DataFrame, mark: str, most: int) -> list:
    """The rows of the `most` least values of the hash column `mark`, one row a value, in that order. Hashes alone are gathered
    first, so that no task sends more texts than the sample has."""
    marks = df.select(mark).distinct().orderBy(mark).limit(most).collect()
    return df.where(F.col(mark) <= marks[-1][0]).dropDuplicates([mark]).orderBy(mark).collect() if marks else []


#: Up to so many ids travel to every executor (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id is in `ids` (one column, written before); rows without doc_id stay."""
    ids = ids.toDF("_gone")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs["doc_id"].cast("long") == ids["_gone"], "left_anti")
