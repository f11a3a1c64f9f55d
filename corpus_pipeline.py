"""Corpus preparation over `documents`: the stages in order, each fed with all that its predecessor kept.

Defined results: rows with null or empty text are rejected by the first stage, as no language can be told; rows with a null
or repeated doc_id are judged as the stages' docstrings say and end in the packing with that doc_id. Texts may be of any
length; of equal or similar documents the least doc_id stays. Extra columns, also of names that stages use, are carried
to the last stage, whose result has its own columns only (doc_id, piece, start, length, bin, offset in tokens). An empty
table gives an empty result. What a stage wrote is deleted when its successor has been written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioq.llm import decontaminate, langid, neardup, packing, pii
from folioq.llm._spark import drop_stash, stash, table

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", neardup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: No SQL: signatures, alignment, trained models and loopy inference have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k:
            last, written = written, stash(docs, name)
            if last is not None:
                drop_stash(spark, last)
            docs = written
        docs = stage(spark, docs, sf_dir)
    return docs
