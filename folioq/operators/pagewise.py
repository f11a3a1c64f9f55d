"""Folds over pages in Arrow: whole pages together, as many as a batch holds, instead of one call a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_pages(rows: DataFrame, order: list[Column], run: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """run(columns) of whole pages at a time, their rows by page_id and `order`; `columns` are arrays by name. A page is never
    parted, so no more is held than a batch and one page. Columns must be numbers or texts; rows without page_id are one page, as -1."""
    names = rows.columns
    rows = rows.withColumn("page_id", F.coalesce(F.col("page_id").cast("long"), F.lit(-1)))
    fields = [part.split() for part in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}

    def made(columns: list[np.ndarray]) -> pa.RecordBatch:
        found = run(dict(zip(names, columns, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(found[n], kinds[k]) for n, k in fields], [n for n, _ in fields])

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            page = columns[names.index("page_id")]
            last = int(np.searchsorted(page, page[-1]))
            if last or (kept and kept[0][names.index("page_id")][0] != page[-1]):
                # Pages before the batch's last one are complete.
                kept.append([c[:last] for c in columns])
                yield made([np.concatenate(c) for c in zip(*kept, strict=True)])
                kept = []
            kept.append([c[last:] for c in columns])
        if kept:
            yield made([np.concatenate(c) for c in zip(*kept, strict=True)])

    return rows.repartition("page_id").sortWithinPartitions("page_id", *order).select(*names).mapInArrow(pages, schema)
