"""Collections of points as tables: upsert, deletion, scrolling, lookup, run state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """`stored` with the batch's rows in place of those of equal key. The batch has one row a key (see `latest`)."""
    return stored.join(batch.select(key), key, "left_anti").unionByName(batch)


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def delete(stored: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number of rows deleted. Rows for which the condition is null stay."""
    gone = F.coalesce(condition, F.lit(False))
    return stored.where(~gone), stored.where(gone).agg(F.count(F.lit(1)).alias("deleted"))


def scroll(stored: DataFrame, condition: Column, key: str, limit: int) -> DataFrame:
    """The first `limit` rows that meet the condition, by key."""
    return stored.where(condition).orderBy(key).limit(limit)


def retrieve(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids, each once."""
    return stored.join(ids.select(key), key, "left_semi")


def run_state(events: DataFrame) -> DataFrame:
    """State of each document from events (doc, page, status, seq), status one of done, failed, complete: pages whose last
    word is done or failed, and whether the document was completed after its last failure."""
    pages = events.where("status IN ('done', 'failed')").groupBy("doc", "page").agg(F.max_by("status", "seq").alias("status"))
    per = pages.groupBy("doc").agg(F.count_if(F.col("status") == "done").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    last = events.groupBy("doc").agg(F.max(F.when(F.col("status") == "complete", F.col("seq"))).alias("c"), F.max(F.when(F.col("status") == "failed", F.col("seq"))).alias("f"))
    done = F.col("c").isNotNull() & (F.col("c") > F.coalesce("f", F.lit(-1)))
    return last.join(per, "doc", "left").select("doc", F.coalesce("completed", F.lit(0)).alias("completed"), F.coalesce("failed", F.lit(0)).alias("failed"), done.alias("document_complete"))


def pending(documents: DataFrame, state: DataFrame, key: str = "doc") -> DataFrame:
    """Documents that a run has still to do: a document begun but not completed is done anew."""
    return documents.join(state.where("document_complete").select(key), key, "left_anti")


def create(spark: SparkSession, name: str, schema: str, by: str, recreate: bool = False) -> None:
    """A collection as a table partitioned by `by`; an existing one is kept unless it is to be made anew."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    if not spark.catalog.tableExists(name):
        empty = spark.createDataFrame([], schema)
        empty.write.partitionBy(by).format("parquet").saveAsTable(name)


def resolve(name: str, known: dict[str, str]) -> str:
    """The table of a collection's short name; an error for one that isn't known."""
    if name not in known:
        raise ValueError(f"unknown collection {name!r}; known are {', '.join(sorted(known))}")
    return known[name]


def info(stored: DataFrame, key: str) -> DataFrame:
    """One row: points, different keys, and points without one."""
    return stored.agg(F.count(F.lit(1)).alias("points"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("without_key"))


def envelope(points: DataFrame, key: str, score: str | None = None, vector: str | None = None) -> DataFrame:
    """Rows as a search returns them: with _id, _score (0 where there is none), and _dense_vector if wanted."""
    rows = points.withColumn("_id", F.col(key).cast("string")).withColumn("_score", F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0))
    return rows.withColumn("_dense_vector", F.coalesce(F.col(vector), F.array().cast("array<double>"))) if vector else rows


def to_json(state: DataFrame) -> DataFrame:
    """(doc, state) with the state as a JSON text, keys in a fixed order."""
    return state.select("doc", F.to_json(F.struct("completed", "failed", "document_complete")).alias("state"))


def from_json(stored: DataFrame) -> DataFrame:
    """States read from their JSON texts; a text that can't be read is a state with nothing done."""
    s = F.from_json("state", "completed long, failed long, document_complete boolean")
    return stored.select("doc", s.alias("s")).select("doc", F.coalesce("s.completed", F.lit(0)).alias("completed"), F.coalesce("s.failed", F.lit(0)).alias("failed"), F.coalesce("s.document_complete", F.lit(False)).alias("document_complete"))
