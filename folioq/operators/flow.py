"""From questions to candidates in one plan: both wordings of a question, dense and sparse legs, figures, rescues, cuts.

Questions have query_id, qvec and terms, nvec and nterms (of the normalised wording), dual (whether that differs), skip_sparse,
route, image_k, search_k, text_k and rerank_k. Texts have id, vec, terms, book, page_number and image_ids; figures image_id,
id (a number), vec, book, page and image_type. Every leg is cut per question before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.operators import retrieval as R
from folioq.sources.shared import stash

#: Most texts that a question may ask for.
MOST = 12


def wordings(questions: DataFrame) -> DataFrame:
    """(query_id, variant, wording, qvec, terms, skip_sparse, search_k): the original as variant 0, and the normalised as variant 1
    where it differs. wording is query_id * 2 + variant."""
    first = F.struct(F.lit(0).alias("variant"), F.col("qvec").alias("qvec"), F.col("terms").alias("terms"))
    second = F.struct(F.lit(1).alias("variant"), F.col("nvec").alias("qvec"), F.col("nterms").alias("terms"))
    both = questions.select("query_id", "skip_sparse", "search_k", F.explode(F.when(F.col("dual"), F.array(first, second)).otherwise(F.array(first))).alias("w"))
    return both.select("query_id", "w.variant", (F.col("query_id") * 2 + F.col("w.variant")).alias("wording"), "w.qvec", "w.terms", "skip_sparse", "search_k")


def hybrid(asked: DataFrame, texts: DataFrame, most: int = MOST) -> DataFrame:
    """(wording, id, score, rank): dense and sparse leg, 2 * most each, fused by reciprocal ranks and cut to search_k; the dense leg
    alone where skip_sparse."""
    asked = stash(asked.select(F.col("wording").alias("query_id"), "qvec", "terms", "skip_sparse", "search_k"), "wordings")
    dense = R.dense_by_vector(asked.select("query_id", "qvec"), texts.select("id", "vec"), 2 * most)
    hits = R.sparse_hits(asked.where("NOT skip_sparse").select("query_id", "terms"), texts.select("id", "terms"), 2 * most)
    sparse = R.top(hits, ["query_id"], [F.desc("dot"), F.asc("id")], 2 * most)
    how = R.small(asked.select("query_id", "skip_sparse", "search_k"))
    mixed = R.fuse([dense.join(how.where("NOT skip_sparse"), "query_id"), sparse], most)
    alone = dense.join(how.where("skip_sparse"), "query_id").select("query_id", "id", "score", "rank")
    cut = mixed.select("query_id", "id", "score", "rank").unionByName(alone).join(how.select("query_id", "search_k"), "query_id").where("rank <= search_k")
    return cut.select(F.col("query_id").alias("wording"), "id", "score", "rank")


def image_topk(asked: DataFrame, images: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, image_id, score, rank): figures that aren't decorative, by the original wording, cut to image_k."""
    plates = images.where("NOT image_type <=> 'decorative'").select("id", "image_id", "vec")
    asked = stash(asked.where("image_k > 0").select("query_id", "qvec", "image_k"), "asked")
    hits = R.dense_by_vector(asked.select("query_id", "qvec"), plates.select("id", "vec"), most)
    cut = hits.join(R.small(asked.select("query_id", "image_k")), "query_id").where("rank <= image_k")
    return cut.join(plates.select("id", "image_id"), "id").select("query_id", "image_id", "score", "rank")


def text_id(column: str = "id") -> Column:
    """Texts and figures share one name space of candidates."""
    return F.concat(F.lit("t"), F.col(column).cast("string"))


def search(questions: DataFrame, texts: DataFrame, images: DataFrame) -> DataFrame:
    """(query_id, place, candidate_id, kind, score, cosine, reasons): the candidates that go on to reranking, in order."""
    # What several of the later steps read is made once.
    questions = stash(questions, "questions")
    asked = wordings(questions)
    found = stash(hybrid(asked, texts), "hybrid").join(asked.select("wording", "query_id", "variant"), "wording")
    reason = F.when(F.col("variant") == 0, "text_original").otherwise("text_normalized")
    text_rows = found.select("query_id", text_id().alias("candidate_id"), F.lit("text").alias("kind"), F.col("id").alias("text"), "score", F.col("variant").alias("seq"), reason.alias("reason"))
    direct = stash(image_topk(questions, images), "direct")
    none = F.lit(None).cast("long")
    image_rows = direct.select("query_id", F.col("image_id").alias("candidate_id"), F.lit("image").alias("kind"), none.alias("text"), "score", F.lit(2).alias("seq"), F.lit("image_direct").alias("reason"))
    best = R.top(text_rows.groupBy("query_id", "candidate_id").agg(F.max("text").alias("id"), F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.asc("candidate_id")], 2)
    tops = best.join(texts.select("id", "book", "page_number", "image_ids"), "id").select("query_id", "rank", "id", "score", "book", "page_number", "image_ids")
    known = direct.select("query_id", "image_id")
    linked = R.linked_rescue(tops, known, images)
    few = questions.select("query_id").join(direct.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where("coalesce(n, 0) < 2")
    near = R.page_proximity(tops.join(few.select("query_id"), "query_id", "left_semi"), known.union(linked.select("query_id", "image_id")), images)
    rescued = [rows.select("query_id", F.col("image_id").alias("candidate_id"), F.lit("image").alias("kind"), none.alias("text"), "score", F.lit(seq).alias("seq"), "reason") for seq, rows in ((3, linked), (4, near))]
    rows = text_rows.unionByName(image_rows).unionByName(rescued[0]).unionByName(rescued[1])
    listed = F.array_sort(F.collect_list(F.struct("seq", "reason")))
    merged = rows.groupBy("query_id", "candidate_id", "kind").agg(F.max("text").alias("text"), F.max("score").alias("score"), F.array_distinct(F.transform(listed, lambda x: x["reason"])).alias("reasons"))
    vectors = texts.select(text_id().alias("candidate_id"), "vec").union(images.select(F.col("image_id").alias("candidate_id"), "vec"))
    deep = questions.select("query_id", "qvec", "text_k", (F.col("route") == "deep").alias("deep"), F.least(F.greatest("search_k", F.greatest(F.lit(1), "rerank_k")), F.lit(MOST)).alias("prefilter_k"))
    judged = merged.join(vectors, "candidate_id", "left").join(deep, "query_id").withColumn("cosine", F.when(F.col("deep"), F.round(R.cosine(F.col("qvec"), F.col("vec")), 6)))
    cut = R.top(judged, ["query_id"], [F.coalesce("cosine", F.lit(0.0)).desc(), F.desc("score"), F.desc("candidate_id")], MOST, "place").where("place <= prefilter_k AND place <= text_k")
    return cut.select("query_id", "place", "candidate_id", "kind", "score", "cosine", "reasons")


def fast_evidence(candidates: DataFrame) -> DataFrame:
    """Roles without reranking (citation, image, table: their rank in that role, null without one), by (score desc, candidate_id):
    six texts, two figures with a url, two table texts. Candidates have kind, chunk_type, url and table_rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("candidate_id"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    c = candidates.withColumn("place", F.row_number().over(order))
    for name, flag, most in (
        ("citation", F.col("kind") == "text", 6), ("image", (F.col("kind") == "image") & F.col("url").isNotNull() & (F.col("url") != ""), 2),
        ("table", (F.col("kind") == "text") & ((F.col("chunk_type") == "table_text") | (F.col("table_rows") > 0)), 2),
    ):
        nth = F.count_if(flag).over(so_far)
        c = c.withColumn(name, F.when(flag & (nth <= most), nth))
    return c
