"""Queries of the point store and of ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.operators import store as S
from folioq.operators.retrieval import payload_filter
from folioq.sources.corpus import table


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.lit(0).cast("long").alias("version"))


def _batch(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.col("event_id").alias("version"))


def upsert_latest(spark, sf_dir):
    """Points, with each replaced by its latest event's where it has one; events of other ids add points."""
    return S.upsert(_points(spark, sf_dir), S.latest(_batch(spark, sf_dir), "id", ["version"]), "id")


UPSERT_LATEST = """
WITH b AS (SELECT user_id AS id, event_type AS type, event_id AS version FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT * FROM b UNION ALL SELECT vec_id AS id, label::VARCHAR AS type, 0 AS version FROM embeddings WHERE vec_id NOT IN (SELECT id FROM b)"""


def delete_counts(spark, sf_dir):
    """What stays of each source, and how many points went, when the points of two sources are deleted."""
    kept, gone = S.delete(table(spark, sf_dir, "documents"), F.col("source").isin("src3", "src7"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept")).crossJoin(F.broadcast(gone))  # one row


DELETE_COUNTS = """SELECT source, count(*) AS kept, (SELECT count(*) FROM documents WHERE source IN ('src3', 'src7')) AS deleted FROM documents WHERE source NOT IN ('src3', 'src7') OR source IS NULL GROUP BY source"""


def scroll_page(spark, sf_dir):
    """The first 100 points that are not of type 0, by id."""
    return S.scroll(_points(spark, sf_dir), payload_filter(must_not={"type": ["0"]}), "id", 100).select("id", "type")


SCROLL_PAGE = "SELECT vec_id AS id, label::VARCHAR AS type FROM embeddings WHERE coalesce(label <> 0, true) ORDER BY vec_id LIMIT 100"


def retrieve_points(spark, sf_dir):
    """The documents that labels name."""
    return S.retrieve(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "n_chars")


RETRIEVE_POINTS = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"


def _chunks(spark, sf_dir) -> DataFrame:
    page = F.floor(F.col("doc_id") / 20) + 1
    kinds = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 3 == 0, "table_text").otherwise("paragraph")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_file"), page.alias("page_start"), (page + F.col("doc_id") % 2).alias("page_end"), kinds.alias("chunk_type"), F.array("lang", F.when(F.col("doc_id") % 4 == 0, "sa").otherwise("hi")).alias("languages"))


def filter_pages_overlap(spark, sf_dir):
    return _chunks(spark, sf_dir).where(payload_filter(overlap=(10, 20))).select("doc_id", "page_start", "page_end")


FILTER_PAGES_OVERLAP = "SELECT doc_id, CAST(doc_id // 20 + 1 AS BIGINT) AS page_start, doc_id // 20 + 1 + doc_id % 2 AS page_end FROM documents WHERE doc_id // 20 + 1 + doc_id % 2 >= 10 AND doc_id // 20 + 1 <= 20"


def filter_array_any(spark, sf_dir):
    return _chunks(spark, sf_dir).where(payload_filter(any_of={"languages": ["fr", " sa ", ""]}, one_of={"chunk_type": ["paragraph"]})).select("doc_id", "chunk_type")


FILTER_ARRAY_ANY = "SELECT doc_id, 'paragraph' AS chunk_type FROM documents WHERE (lang = 'fr' OR doc_id % 4 = 0) AND doc_id % 10 <> 0 AND doc_id % 3 <> 0"


def filter_must_not(spark, sf_dir):
    return _chunks(spark, sf_dir).where(payload_filter(source_file=" src3 ", must_not={"chunk_type": ["table_text"]})).select("doc_id", "chunk_type")


FILTER_MUST_NOT = "SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN 'paragraph' END AS chunk_type FROM documents WHERE source = 'src3' AND (doc_id % 10 = 0 OR doc_id % 3 <> 0)"


def page_events(events: DataFrame) -> DataFrame:
    """Events as a run's log: an error fails a page, a purchase completes the document, all others finish a page."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "complete").otherwise("done")
    return events.select(F.col("user_id").alias("doc"), F.floor("value").cast("long").alias("page"), status.alias("status"), F.col("event_id").alias("seq"))


def run_state(spark, sf_dir):
    return S.run_state(page_events(table(spark, sf_dir, "events")))


_STATE = """
e AS (SELECT user_id AS doc, CAST(floor(value) AS BIGINT) AS page, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' ELSE 'done' END AS status, event_id AS seq FROM events),
p AS (SELECT doc, page, max_by(status, seq) AS status FROM e WHERE status <> 'complete' GROUP BY doc, page),
c AS (SELECT doc, count(*) FILTER (WHERE status = 'done') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM p GROUP BY doc),
l AS (SELECT doc, max(seq) FILTER (WHERE status = 'complete') AS c, max(seq) FILTER (WHERE status = 'failed') AS f FROM e GROUP BY doc),
state AS (SELECT doc, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, c IS NOT NULL AND c > coalesce(f, -1) AS document_complete FROM l LEFT JOIN c USING (doc))"""
RUN_STATE = f"WITH {_STATE} SELECT * FROM state"


def pending_documents(spark, sf_dir):
    todo = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source")
    return S.pending(todo, run_state(spark, sf_dir))


PENDING_DOCUMENTS = f"WITH {_STATE} SELECT doc_id AS doc, source FROM documents WHERE doc_id NOT IN (SELECT doc FROM state WHERE document_complete)"

QUERIES = {f.__name__: f for f in (upsert_latest, delete_counts, scroll_page, retrieve_points, filter_pages_overlap, filter_array_any, filter_must_not, run_state, pending_documents)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
