"""Queries of the retrieval flow. Questions are the users' turns with vectors of the table by their number; a document that has a
vector is a text, every vector also a figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.operators import flow as L
from folioq.operators import retrieval as R
from folioq.operators import seams
from folioq.plans import retrieval as P
from folioq.plans._sql import BOOKS, compact
from folioq.sources.corpus import table, vectors

#: Vectors that every size of the table has.
VECTORS = 500


def asked(spark, sf_dir) -> DataFrame:
    v = vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "vec")
    b = P.query_bundle(spark, sf_dir).withColumn("terms", P.terms(F.col("query"))).withColumn("nterms", P.terms(F.col("normalized")))
    b = b.withColumn("_a", F.pmod("query_id", F.lit(VECTORS))).withColumn("_b", F.pmod(F.col("query_id") * 7 + 3, F.lit(VECTORS)))
    with_first = b.join(v.select(F.col("vec_id").alias("_a"), F.col("vec").alias("qvec")), "_a")
    return with_first.join(v.select(F.col("vec_id").alias("_b"), F.col("vec").alias("nvec")), "_b").drop("_a", "_b")


def texts(spark, sf_dir) -> DataFrame:
    # Documents without a vector go before their words are taken apart.
    v = vectors(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "vec")
    held = table(spark, sf_dir, "documents").join(R.small(v.select(F.col("id").alias("doc_id")), 1_000_000), "doc_id", "left_semi")
    docs = held.select(
        F.col("doc_id").alias("id"), P.terms(F.col("text")).alias("terms"), F.col("source").alias("book"), (F.floor(F.col("doc_id") / BOOKS) + 1).alias("page_number"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.concat(F.lit("v"), (F.col("doc_id") + 7).cast("string")))).otherwise(F.array().cast("array<string>")).alias("image_ids"),
    )
    return docs.join(v, "id")


def figures(spark, sf_dir) -> DataFrame:
    v = vectors(table(spark, sf_dir, "embeddings")).select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_id"), F.col("vec_id").alias("id"), "vec")
    return P.images(spark, sf_dir).join(v, "image_id")


def _vec(x: str) -> str:
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {x})"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def _terms(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN ({P._STOP}))"


ASKED = f"""{P._ASKED},
bundle AS (SELECT *, {P._norm("query")} AS normalized, route = 'fast' OR tokens < 4 AS skip_sparse, CASE WHEN route = 'deep' AND intent = 'visual' THEN 6 WHEN route = 'deep' THEN 4 ELSE 0 END AS image_k FROM r),
q AS (SELECT b.*, lower({compact("normalized")}) <> lower(query) AS dual, e.embedding AS qvec, f.embedding AS nvec FROM bundle b
  JOIN embeddings e ON e.vec_id = ((query_id % {VECTORS}) + {VECTORS}) % {VECTORS} JOIN embeddings f ON f.vec_id = (((query_id * 7 + 3) % {VECTORS}) + {VECTORS}) % {VECTORS}),
w AS (SELECT query_id, 0 AS variant, query_id * 2 AS wording, qvec AS vec, {_terms("query")} AS terms, skip_sparse FROM q UNION ALL
  SELECT query_id, 1, query_id * 2 + 1, nvec, {_terms("normalized")}, skip_sparse FROM q WHERE dual),
texts AS (SELECT doc_id AS id, {_terms("text")} AS terms, source AS book, CAST(doc_id // {BOOKS} + 1 AS BIGINT) AS page_number, CASE WHEN doc_id % 3 = 0 THEN ['v' || doc_id, 'v' || (doc_id + 7)] ELSE [] END AS image_ids, embedding AS vec
  FROM documents JOIN embeddings ON vec_id = doc_id),
images AS (SELECT 'v' || vec_id AS image_id, vec_id AS id, 'src' || (vec_id % {BOOKS}) AS book, CAST(vec_id // {BOOKS} + 1 AS BIGINT) AS page, CASE label WHEN 0 THEN 'decorative' WHEN 1 THEN 'table_like' WHEN 2 THEN NULL ELSE 'diagram' END AS image_type, embedding AS vec FROM embeddings),
dense AS (SELECT * FROM (SELECT wording, skip_sparse, id, score, row_number() OVER (PARTITION BY wording ORDER BY score DESC, id) AS rank FROM (SELECT wording, skip_sparse, id, round({_dot("w.vec", "texts.vec")}, 6) AS score FROM w, texts)) WHERE rank <= 24),
qt AS (SELECT wording, term, count(*) AS n FROM (SELECT wording, unnest(terms) AS term FROM w WHERE NOT skip_sparse) GROUP BY ALL), dt AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(terms) AS term FROM texts) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY dot DESC, id) AS rank FROM (SELECT wording, id, sum(qt.n * dt.n) AS dot FROM qt JOIN dt USING (term) GROUP BY ALL)) WHERE rank <= 24),
mixed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wording ORDER BY score DESC, id) AS rank FROM (
  SELECT wording, id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) AS score FROM (SELECT wording, id, rank FROM dense WHERE NOT skip_sparse UNION ALL SELECT wording, id, rank FROM sparse) GROUP BY ALL)) WHERE rank <= 12),
hyb AS (SELECT wording, id, score, rank FROM mixed UNION ALL SELECT wording, id, score, rank FROM dense WHERE skip_sparse AND rank <= 12),
direct AS (SELECT * FROM (SELECT query_id, image_id, score, image_k, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, image_k, image_id, id, round({_dot("qvec", "images.vec")}, 6) AS score FROM q, images WHERE image_k > 0 AND image_type IS DISTINCT FROM 'decorative')) WHERE rank <= image_k)"""


def hybrid_topk(spark, sf_dir):
    return L.hybrid(L.wordings(asked(spark, sf_dir)), texts(spark, sf_dir))


HYBRID_TOPK = f"WITH {ASKED} SELECT wording, id, score, rank FROM hyb"


def image_topk(spark, sf_dir):
    return L.image_topk(asked(spark, sf_dir), figures(spark, sf_dir))


IMAGE_TOPK = f"WITH {ASKED} SELECT query_id, image_id, score, rank FROM direct"


def found(spark, sf_dir, route: str | None = None) -> DataFrame:
    """Candidates of all questions, or of those of one route: no question's candidates depend on another question."""
    questions = asked(spark, sf_dir)
    return L.search(questions if route is None else questions.where(F.col("route") == route), texts(spark, sf_dir), figures(spark, sf_dir))


def search_flow(spark, sf_dir):
    return found(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


FLOW = f"""{ASKED},
rows_ AS (SELECT query_id, 't' || id AS cid, 'text' AS kind, id AS text, score, variant AS seq, CASE variant WHEN 0 THEN 'text_original' ELSE 'text_normalized' END AS reason FROM hyb JOIN w USING (wording)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cid) AS rank FROM (SELECT query_id, cid, max(text) AS id, max(score) AS score FROM rows_ GROUP BY ALL)) WHERE rank <= 2),
tops AS (SELECT query_id, rank, best.id, score, book, page_number, image_ids FROM best JOIN texts USING (id)),
ids AS (SELECT query_id, rank, id, score, unnest(image_ids) AS image_id, unnest(range(len(image_ids))) AS pos FROM tops),
first_ AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY query_id, image_id ORDER BY rank, pos) = 1),
fresh AS (SELECT * FROM first_ f WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.query_id = f.query_id AND d.image_id = f.image_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 3),
linked AS (SELECT query_id, image_id, greatest(round(score * 0.92::DOUBLE, 6), 0.01::DOUBLE) AS score, 'linked_from:' || fresh.id AS reason FROM fresh JOIN images USING (image_id)),
spots AS (SELECT query_id, rank, id, score, book, page_number, unnest([0, -1, 1]) AS off, unnest([0, 1, 2]) AS pos FROM tops WHERE len(image_ids) = 0 AND (SELECT count(*) FROM direct d WHERE d.query_id = tops.query_id) < 2),
uniq AS (SELECT *, page_number + off AS page FROM spots WHERE page_number + off >= 1 QUALIFY row_number() OVER (PARTITION BY query_id, book, page_number + off ORDER BY rank, pos) = 1),
looked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS scan FROM uniq QUALIFY scan <= 2),
plates AS (SELECT * FROM images WHERE image_type IS DISTINCT FROM 'decorative' QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY image_id) <= 6),
near_ AS (SELECT l.query_id, image_id, l.id, l.score, off, l.page FROM looked l JOIN plates p ON p.book = l.book AND p.page = l.page
  WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.query_id = l.query_id AND d.image_id = p.image_id) AND NOT EXISTS (SELECT 1 FROM linked d WHERE d.query_id = l.query_id AND d.image_id = p.image_id)
  QUALIFY row_number() OVER (PARTITION BY l.query_id, image_id ORDER BY scan) = 1),
every AS (SELECT * FROM rows_ UNION ALL SELECT query_id, image_id, 'image', NULL, score, 2, 'image_direct' FROM direct UNION ALL SELECT query_id, image_id, 'image', NULL, score, 3, reason FROM linked
  UNION ALL SELECT query_id, image_id, 'image', NULL, greatest(round(score * CASE WHEN off = 0 THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END, 6), 0.01::DOUBLE), 4, 'page_proximity:' || id || ':' || page FROM near_),
merged AS (SELECT query_id, cid, kind, max(score) AS score, string_agg(reason, ',' ORDER BY seq) AS reasons FROM every GROUP BY query_id, cid, kind),
vecs AS (SELECT 't' || id AS cid, vec FROM texts UNION ALL SELECT image_id, vec FROM images),
flow AS (SELECT query_id, cid AS candidate_id, kind, score, CASE WHEN route = 'deep' THEN round({_dot("qvec", "vec")}, 6) END AS cosine, reasons,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN route = 'deep' THEN round({_dot("qvec", "vec")}, 6) ELSE 0 END DESC, score DESC, cid DESC) AS place
  FROM merged JOIN vecs USING (cid) JOIN q USING (query_id) QUALIFY place <= 12)"""
SEARCH_FLOW = f"WITH {FLOW} SELECT query_id, place, candidate_id, kind, score, cosine, reasons FROM flow"


def _dressed(spark, sf_dir, route: str) -> DataFrame:
    c = found(spark, sf_dir, route)
    number = F.substr("candidate_id", F.lit(2)).cast("long")
    url = F.when((F.col("kind") == "image") & (number % 3 != 0), F.concat(F.lit("u"), number.cast("string")))
    return c.select("query_id", "candidate_id", "kind", "score", F.when((F.col("kind") == "text") & (number % 4 == 0), "table_text").otherwise("").alias("chunk_type"), url.alias("url"), F.lit(0).alias("table_rows"))


def fast_evidence(spark, sf_dir):
    """Evidence of the questions of the fast route, which aren't reranked."""
    return L.fast_evidence(_dressed(spark, sf_dir, "fast")).select("query_id", "candidate_id", "place", "citation", "image", "table")


FAST_EVIDENCE = f"""WITH {FLOW},
d AS (SELECT query_id, candidate_id, kind, score, CASE WHEN kind = 'text' AND substr(candidate_id, 2)::BIGINT % 4 = 0 THEN 1 END AS t, CASE WHEN kind = 'image' AND substr(candidate_id, 2)::BIGINT % 3 <> 0 THEN 1 END AS u FROM flow JOIN q USING (query_id) WHERE route = 'fast'),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS place FROM d),
n AS (SELECT *, count(CASE WHEN kind = 'text' THEN 1 END) OVER s AS c, count(u) OVER s AS i, count(t) OVER s AS b FROM o WINDOW s AS (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING))
SELECT query_id, candidate_id, place, CASE WHEN kind = 'text' AND c <= 6 THEN c END AS citation, CASE WHEN u = 1 AND i <= 2 THEN i END AS image, CASE WHEN t = 1 AND b <= 2 THEN b END AS "table" FROM n"""


def rerank_scores(spark, sf_dir):
    """The reranking stage: the first eight candidates of the deep route that are texts, scored by the stand-in model on at most
    320 words, with both scores kept."""
    deep = asked(spark, sf_dir).where("route = 'deep'").select("query_id", "query")
    c = found(spark, sf_dir, "deep").where("kind = 'text'").join(deep, "query_id").withColumn("id", F.substr("candidate_id", F.lit(2)).cast("long"))
    pool = R.top(c, ["query_id"], [F.asc("place")], 8, "pool").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    scored = seams.scored(pool.select("query_id", "candidate_id", "pool", F.col("score").alias("retrieval_score"), "query", "text"), seams.overlap_scorer)
    return scored.select("query_id", "candidate_id", "pool", "retrieval_score", F.round("score", 6).alias("rerank_score"))


_ASCII_WORDS = r"list_filter(string_split_regex(lower({0}), '\s+'), lambda x: x <> '')"
RERANK_SCORES = f"""WITH {FLOW},
p AS (SELECT query_id, query, candidate_id, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS pool, substr(candidate_id, 2)::BIGINT AS id FROM flow JOIN q USING (query_id) WHERE kind = 'text' AND route = 'deep' QUALIFY pool <= 8)
SELECT query_id, candidate_id, pool, score AS retrieval_score, round(len(list_intersect(list_distinct({_ASCII_WORDS.format("query")}), {_ASCII_WORDS.format("coalesce(text, '')")}[:320]))::DOUBLE / len(list_distinct({_ASCII_WORDS.format("query")})), 6) AS rerank_score
FROM p JOIN documents ON doc_id = id"""

QUERIES = {f.__name__: f for f in (hybrid_topk, image_topk, search_flow, fast_evidence, rerank_scores)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
