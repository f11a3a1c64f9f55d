"""Queries of question understanding, filters and retrieval.

Every vector asks for its neighbours; every benchmark passage is a question to all documents. Lexical weights stand in
for a learned sparse model: how often a keyword occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import query as Q
from folioq.operators import retrieval as R
from folioq.plans._sql import BOOKS, compact, count, frame, values
from folioq.sources.corpus import questions, table, vectors
from folioq.sources.shared import stash

K = 12
CANONICAL = [
    (-1, "show me the figure"), (-2, "what is rasa"), (-3, "palika yantra diagram"), (-4, "hello"), (-5, "plain query"), (-6, "Hello there"),
    (-7, "vegetable diet"), (-8, "adverse effects"), (-9, "paragraph style"), (-10, "thank you"), (-11, "define   agni in digestion of the body today"),
    (-12, "verse about ṣaḍrasa"), (-13, "compare values of both samples"), (-14, "one two three four five six seven"), (-15, "one two three four five six"), (-16, "   "),
]


def query_bundle(spark, sf_dir):
    asked = questions(table(spark, sf_dir, "conversations")).union(frame(spark, CANONICAL, "query_id BIGINT, query VARCHAR"))
    return Q.bundles(asked)


_ASKED = f"""
asked AS (SELECT query_id, {compact("query")} AS query FROM (
  SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM {values(CANONICAL, "query_id BIGINT, query VARCHAR")})
  WHERE {compact("query")} <> ''),
i AS (SELECT *, CAST({count("query")} AS INTEGER) AS tokens, CASE WHEN lower(query) IN ({", ".join(f"'{g}'" for g in Q.GREETINGS)}) OR regexp_matches(lower(query), '^(hi|hello|hey) ') THEN 'chitchat'
  WHEN regexp_matches(lower(query), '{Q.VERSE}') THEN 'shloka' WHEN regexp_matches(lower(query), '{Q.TABLE}') THEN 'table' WHEN regexp_matches(lower(query), '{Q.VISUAL}') THEN 'visual'
  WHEN regexp_matches(lower(query), '{Q.DEFINITION}') THEN 'definition' ELSE 'general' END AS intent FROM asked),
r AS (SELECT *, CASE WHEN intent = 'chitchat' THEN 'simple' WHEN regexp_matches(lower(query), '{Q.DEEP}') THEN 'deep' WHEN intent IN ('general', 'definition') AND tokens <= 6 THEN 'fast' ELSE 'deep' END AS route FROM i)"""


def _norm(x: str) -> str:
    out = f"translate(nfc_normalize({x}), '{T._PLAIN_FROM + T._DROPPED}', '{T._PLAIN_TO.replace(chr(39), chr(39) * 2)}')"
    for a, b in T._SPELLED.items():
        out = f"replace({out}, '{a}', '{b}')"
    return rf"regexp_replace(translate({out}, '{T._MARKED + T._MARKED.upper()}', '{T._BARE + T._BARE.upper()}'), '\s+\\\s+', ' ', 'g')"


QUERY_BUNDLE = f"""
WITH {_ASKED}
SELECT query_id, query, {_norm("query")} AS normalized, intent, route, tokens, route = 'fast' OR tokens < 4 AS skip_sparse,
  CASE WHEN route = 'deep' AND intent = 'visual' THEN 6 WHEN route = 'deep' THEN 4 ELSE 0 END AS image_k, 12 AS text_k,
  CASE WHEN route = 'deep' THEN 8 ELSE 0 END AS rerank_k, 12 AS search_k, lower({compact(_norm("query"))}) <> lower(query) AS dual FROM r"""


def route_counts(spark, sf_dir):
    return query_bundle(spark, sf_dir).groupBy("intent", "route").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most_tokens"))


ROUTE_COUNTS = f"WITH {_ASKED} SELECT intent, route, count(*) AS n, max(tokens) AS most_tokens FROM r GROUP BY intent, route"


def dense_topk(spark, sf_dir):
    v = vectors(table(spark, sf_dir, "embeddings"))
    hits = R.dense_topk(v.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), v.select(F.col("vec_id").alias("id"), "vec"), K)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.snippet(F.col("text")).alias("snippet"))
    return hits.join(docs, "id", "left").select("query_id", "rank", F.col("id").alias("vec_id"), "score", "snippet")


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_SNIP = compact("coalesce(text, '')")
DENSE_TOPK = f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank, r.vec_id, score, CASE WHEN doc_id IS NULL THEN NULL WHEN length({_SNIP}) <= 320 THEN {_SNIP} ELSE rtrim(substr({_SNIP}, 1, 317)) || '...' END AS snippet
FROM r LEFT JOIN documents ON doc_id = r.vec_id WHERE rank <= {K}"""


def filtered_topk(spark, sf_dir):
    """Neighbours among vectors of the labels 0 and 1 only: the filter comes before the search."""
    v = vectors(table(spark, sf_dir, "embeddings"))
    wanted = v.withColumn("kind", F.col("label").cast("string")).where(R.payload_filter(one_of={"kind": ["0", " 1 ", ""]}))
    return R.dense_topk(v.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), wanted.select(F.col("vec_id").alias("id"), "vec"), 6)


FILTERED_TOPK = f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND b.label IN (0, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p)
SELECT query_id, id, score, rank FROM r WHERE rank <= 6"""


def terms(text) -> Column:
    """The words of a text that count for the lexical leg."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(T.STOPWORDS))


def _legs(spark, sf_dir, k: int, *measures: str) -> DataFrame:
    """The first k documents of every benchmark passage by each measure, with their ranks."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), terms(F.col("text")).alias("terms"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), terms(F.col("text")).alias("terms"))
    return R.ranked_legs(R.sparse_hits(asked, docs, k, measures), k)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _terms_sql(name: str, key: str, to: str) -> str:
    return rf"(SELECT {to}, term, count(*) AS n FROM (SELECT {key} AS {to}, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))) AS term FROM {name}) GROUP BY ALL)"


SCORES = f"""
qt AS {_terms_sql("benchmark", "item_id", "query_id")}, dt AS {_terms_sql("documents", "doc_id", "id")},
scores AS (SELECT query_id, id, CAST(sum(qt.n * dt.n) AS BIGINT) AS dot, count(*) AS shared FROM dt JOIN qt USING (term) GROUP BY query_id, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank FROM scores) WHERE rank <= {2 * K}),
ovl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, id) AS rank FROM scores) WHERE rank <= {2 * K}),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT query_id, id, round(sum(1.0::DOUBLE / (2 + rank - 1)), 6) AS score FROM (SELECT query_id, id, rank FROM lex UNION ALL SELECT query_id, id, rank FROM ovl) GROUP BY query_id, id)) WHERE rank <= {K})"""


def sparse_topk(spark, sf_dir):
    return _legs(spark, sf_dir, K, "dot").select("query_id", F.col("rank_dot").alias("rank"), "id", "dot")


SPARSE_TOPK = f"WITH {SCORES} SELECT query_id, rank, id, dot FROM lex WHERE rank <= {K}"


def fused_hits(spark, sf_dir) -> DataFrame:
    """Fused hits, written once: later steps read them several times. There are K a question at most."""
    return R.small(stash(R.fuse_ranked(_legs(spark, sf_dir, 2 * K, "dot", "shared"), K), "hits"), 1_000_000)


def rrf_fusion(spark, sf_dir):
    return fused_hits(spark, sf_dir).select("query_id", "rank", "id", "score")


RRF_FUSION = f"WITH {SCORES} SELECT query_id, rank, id, score FROM fused"


def hit_pages(spark, sf_dir) -> DataFrame:
    """Fused hits with their page and the figures linked with them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"), (F.floor(F.col("doc_id") / BOOKS) + 1).alias("page_number"))
    linked = F.when(F.col("id") % 3 == 0, F.array(F.concat(F.lit("v"), F.col("id").cast("string")), F.concat(F.lit("v"), (F.col("id") + 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    return fused_hits(spark, sf_dir).join(docs, "id").withColumn("image_ids", linked)


def images(spark, sf_dir) -> DataFrame:
    """The vectors as figures: of book src(vec_id mod 20), with a type by label."""
    kind = F.when(F.col("label") == 0, "decorative").when(F.col("label") == 1, "table_like").when(F.col("label") == 2, F.lit(None).cast("string")).otherwise("diagram")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("image_id"), F.concat(F.lit("src"), (F.col("vec_id") % BOOKS).cast("string")).alias("book"),
        (F.floor(F.col("vec_id") / BOOKS) + 1).alias("page"), kind.alias("image_type"),
    )


HITS = f"""
hits AS (SELECT query_id, rank, id, score, source AS book, CAST(doc_id // {BOOKS} + 1 AS BIGINT) AS page_number,
  CASE WHEN id % 3 = 0 THEN ['v' || id, 'v' || (id + 7)] ELSE [] END AS image_ids FROM fused JOIN documents ON doc_id = id),
images AS (SELECT 'v' || vec_id AS image_id, 'src' || (vec_id % {BOOKS}) AS book, CAST(vec_id // {BOOKS} + 1 AS BIGINT) AS page,
  CASE label WHEN 0 THEN 'decorative' WHEN 1 THEN 'table_like' WHEN 2 THEN NULL ELSE 'diagram' END AS image_type FROM embeddings)"""


def _known(spark, sf_dir, hits: DataFrame) -> DataFrame:
    return hits.where("rank = 1").select("query_id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("image_id"))


def linked_rescue(spark, sf_dir):
    hits = hit_pages(spark, sf_dir)
    return R.linked_rescue(hits, _known(spark, sf_dir, hits), images(spark, sf_dir))


LINKED_RESCUE = f"""
WITH {SCORES}, {HITS},
ids AS (SELECT query_id, rank, id, score, unnest(image_ids) AS image_id, unnest(range(len(image_ids))) AS pos FROM hits WHERE rank <= 2),
first AS (SELECT * FROM ids QUALIFY row_number() OVER (PARTITION BY query_id, image_id ORDER BY rank, pos) = 1),
fresh AS (SELECT * FROM first f WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.rank = 1 AND h.query_id = f.query_id AND 'v' || h.id = f.image_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) <= 3)
SELECT query_id, image_id, greatest(round(score * 0.92::DOUBLE, 6), 0.01::DOUBLE) AS score, 'linked_from:' || id AS reason FROM fresh JOIN images USING (image_id)"""


def page_proximity(spark, sf_dir):
    hits = hit_pages(spark, sf_dir)
    return R.page_proximity(hits, _known(spark, sf_dir, hits), images(spark, sf_dir))


PAGE_PROXIMITY = f"""
WITH {SCORES}, {HITS},
spots AS (SELECT query_id, rank, id, score, book, page_number, unnest([0, -1, 1]) AS off, unnest([0, 1, 2]) AS pos FROM hits WHERE rank <= 2 AND len(image_ids) = 0),
uniq AS (SELECT *, page_number + off AS page FROM spots WHERE page_number + off >= 1 QUALIFY row_number() OVER (PARTITION BY query_id, book, page_number + off ORDER BY rank, pos) = 1),
looked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS scan FROM uniq QUALIFY scan <= 2),
plates AS (SELECT * FROM images WHERE image_type IS DISTINCT FROM 'decorative' QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY image_id) <= 6),
found AS (SELECT l.*, image_id FROM looked l JOIN plates p ON p.book = l.book AND p.page = l.page
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.rank = 1 AND h.query_id = l.query_id AND 'v' || h.id = image_id)
  QUALIFY row_number() OVER (PARTITION BY query_id, image_id ORDER BY scan) = 1)
SELECT query_id, image_id, greatest(round(score * CASE WHEN off = 0 THEN 0.86::DOUBLE ELSE 0.72::DOUBLE END, 6), 0.01::DOUBLE) AS score, 'page_proximity:' || id || ':' || page AS reason FROM found"""


def candidate_merge(spark, sf_dir):
    """Text hits of two legs, and figures of both rescues, as one candidate list."""
    found = stash(_legs(spark, sf_dir, K, "dot", "shared"), "legs")
    legs = []
    for seq, (c, reason) in enumerate((("dot", "text_original"), ("shared", "text_normalized"))):
        leg = found.where(F.col(f"rank_{c}").isNotNull()).withColumn("rank", F.col(f"rank_{c}"))
        url = F.when(F.col("id") % 2 == seq, F.concat(F.lit("u"), F.col("id").cast("string"), F.lit(reason))).otherwise("")
        legs.append(leg.select("query_id", "id", F.lit(seq).alias("seq"), (1 / F.col("rank")).alias("score"), F.lit(reason).alias("reason"), url.alias("url"), F.array((F.col("id") % 5).cast("string"), F.lit(str(seq))).alias("linked")))
    merged = R.merge(legs[0].union(legs[1]))
    return merged.select("query_id", "id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"), "url", F.array_join("linked", ",").alias("linked"))


CANDIDATE_MERGE = f"""
WITH {SCORES},
h AS (SELECT query_id, id, 0 AS seq, 1.0::DOUBLE / rank AS score, 'text_original' AS reason, CASE WHEN id % 2 = 0 THEN 'u' || id || 'text_original' END AS url FROM lex WHERE rank <= {K}
  UNION ALL SELECT query_id, id, 1, 1.0::DOUBLE / rank, 'text_normalized', CASE WHEN id % 2 = 1 THEN 'u' || id || 'text_normalized' END FROM ovl WHERE rank <= {K})
SELECT query_id, id, round(max(score), 6) AS score, string_agg(reason, ',' ORDER BY seq) AS reasons, min_by(url, seq) FILTER (WHERE url IS NOT NULL) AS url,
  array_to_string(list_filter([(id % 5)::VARCHAR, CASE WHEN min(seq) = 0 AND id % 5 <> 0 THEN '0' END, CASE WHEN max(seq) = 1 AND id % 5 <> 1 THEN '1' END], lambda x: x IS NOT NULL), ',') AS linked
FROM h GROUP BY query_id, id"""


def prefilter(spark, sf_dir):
    """Neighbours of each vector, cut by (cosine, score, id), where every third candidate has no vector at hand."""
    v = vectors(table(spark, sf_dir, "embeddings"))
    hits = R.dense_topk(v.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), v.select(F.col("vec_id").alias("id"), "vec"), 2 * K)
    cosine = F.when(F.col("id") % 3 != 0, F.round("score", 2))
    return R.prefilter(hits.withColumn("cosine", cosine).drop("rank"), K).select("query_id", "rank", "id", "score", "cosine")


PREFILTER = f"""
WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
h AS (SELECT *, CASE WHEN id % 3 <> 0 THEN round(score, 2) END AS cosine FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {2 * K}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(cosine, 0) DESC, score DESC, id DESC) AS rank FROM h)
SELECT query_id, rank, id, score, cosine FROM r WHERE rank <= {K}"""

QUERIES = {f.__name__: f for f in (query_bundle, route_counts, dense_topk, filtered_topk, sparse_topk, rrf_fusion, linked_rescue, page_proximity, candidate_merge, prefilter)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
