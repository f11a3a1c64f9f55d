"""Queries from scored candidates to answers. The candidates are the fused hits of every benchmark passage, dressed as
text, tables, verses, bridges and figures by their id; the fused score stands in for a model's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.functions import text as T
from folioq.operators import evidence as E
from folioq.plans._sql import compact, count, words
from folioq.plans.retrieval import SCORES, _norm, fused_hits
from folioq.sources.corpus import table

INTENTS = ["general", "table", "visual", "shloka", "definition", "visual"]


def candidates(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    intent = F.element_at(F.array(*map(F.lit, INTENTS)), (F.col("query_id") % 6 + 1).cast("int"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    image, seven = F.col("id") % 5 == 4, F.col("id") % 7
    kind = F.when(image, "").when(seven == 0, "table_text").when(seven == 1, "shloka").when(seven == 2, "page_bridge").otherwise("paragraph")
    top = F.max(F.when(F.col("rank") == 1, F.col("id"))).over(Window.partitionBy("query_id"))
    c = fused_hits(spark, sf_dir).withColumn("top", top).join(docs, "id").join(asked, "query_id").withColumn("intent", intent)
    return c.select(
        "query_id", "id", "rank", F.round(F.col("score") - 0.3, 6).alias("score"), F.when(image, "image").otherwise("text").alias("kind"), kind.alias("chunk_type"), "text",
        F.when(image, F.concat(F.lit("Figure "), F.col("id").cast("string"))).alias("caption"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("section"),
        F.when(image & (F.col("id") % 2 == 0), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"), F.when(kind == "table_text", (F.col("id") % 4).cast("int")).otherwise(0).alias("table_rows"),
        F.when(image, F.array(F.col("id") - 1, F.col("top"))).otherwise(F.array().cast("array<bigint>")).alias("linked"), F.array("id", "top").alias("bridge"),
        "query", T.normalize_text(F.col("query")).alias("normalized"), "intent", T.keywords(F.col("query")).alias("terms"),
        F.concat(F.lit("heading"), (F.col("id") % 3).cast("string")).alias("heading"), F.when(image & (F.col("id") % 3 == 0), "plate, the onin").alias("labels"), F.when(kind == "table_text", F.concat(F.lit("| erer | "), F.col("id").cast("string"), F.lit(" |"))).alias("markdown"),
        (F.col("id") % 17 == 0).alias("is_shloka"), F.when(F.col("id") % 19 == 0, "1.2").alias("shloka_number"), F.when(F.col("id") % 3 == 0, F.array(F.lit("Deva"))).otherwise(F.array(F.lit("Latn"))).alias("scripts"),
        F.concat(F.lit("book"), (F.col("id") % 20).cast("string"), F.when(F.col("id") % 2 == 0, ".pdf").otherwise("")).alias("source_file"), (F.floor(F.col("id") / 20) + 1).alias("page"),
    )


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _keys(x: str) -> str:
    w = rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\p{{Nd}}+$'))"
    return f"({w} || list_transform(list_filter({w}, lambda v: ends_with(v, 's') AND length(v) >= 5), lambda v: left(v, length(v) - 1)) || list_transform(list_filter({w}, lambda v: ends_with(v, 'es') AND length(v) >= 6), lambda v: left(v, length(v) - 2)))"


_LINES = "list_filter(list_transform(string_split(trim(coalesce(text, '')), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
VERSE = f"(chunk_type = 'shloka' OR id % 17 = 0 OR id % 19 = 0 OR (id % 3 = 0 AND coalesce(regexp_matches(text, '[।॥|]'), false)) OR (len({_LINES}) >= 2 AND len(list_filter({_LINES}, lambda x: {count('x')} > 16)) = 0))"
_CANDIDATES = f"""
dressed AS (SELECT f.query_id, f.id, rank, round(score - 0.3::DOUBLE, 6) AS score, CASE WHEN f.id % 5 = 4 THEN 'image' ELSE 'text' END AS kind,
  CASE WHEN f.id % 5 = 4 THEN '' ELSE CASE f.id % 7 WHEN 0 THEN 'table_text' WHEN 1 THEN 'shloka' WHEN 2 THEN 'page_bridge' ELSE 'paragraph' END END AS chunk_type, d.text,
  CASE WHEN f.id % 5 = 4 THEN 'Figure ' || f.id END AS caption, 'S' || (f.id % 3) AS section, CASE WHEN f.id % 5 = 4 AND f.id % 2 = 0 THEN 'u' || f.id END AS url,
  CASE WHEN f.id % 5 <> 4 AND f.id % 7 = 0 THEN f.id % 4 ELSE 0 END AS table_rows, first_value(f.id) OVER (PARTITION BY f.query_id ORDER BY rank) AS top, b.text AS query, {_norm("b.text")} AS normalized,
  'heading' || f.id % 3 AS heading, CASE WHEN f.id % 5 = 4 AND f.id % 3 = 0 THEN 'plate, the onin' END AS labels, CASE WHEN f.id % 5 <> 4 AND f.id % 7 = 0 THEN '| erer | ' || f.id || ' |' END AS markdown,
  'book' || (f.id % 20) || CASE WHEN f.id % 2 = 0 THEN '.pdf' ELSE '' END AS source_file, CAST(f.id // 20 + 1 AS BIGINT) AS page,
  CASE f.query_id % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'table' WHEN 2 THEN 'visual' WHEN 3 THEN 'shloka' WHEN 4 THEN 'definition' ELSE 'visual' END AS intent
  FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id),
pool AS (SELECT * FROM dressed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 8),
ids AS (SELECT query_id, list(id) AS ids FROM pool GROUP BY query_id),
boosted AS (SELECT p.* EXCLUDE (score), p.score AS base, round(p.score + (CASE WHEN chunk_type = 'table_text' AND intent = 'table' THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN chunk_type = 'shloka' AND intent = 'shloka' THEN 0.18::DOUBLE ELSE 0 END
    + CASE WHEN intent = 'shloka' AND {VERSE} THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN kind = 'image' AND intent = 'visual' THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN chunk_type = 'page_bridge' AND id <> top AND list_contains(ids, top) THEN 0.12::DOUBLE ELSE 0 END), 6) AS score
  FROM pool p JOIN ids USING (query_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM boosted),
cited AS (SELECT *, CASE WHEN kind = 'text' THEN row_number() OVER (PARTITION BY query_id, kind ORDER BY place) END AS c FROM placed),
cids AS (SELECT query_id, list(id) AS cids FROM cited WHERE c <= 6 GROUP BY query_id),
useful AS (SELECT d.*, CASE WHEN c <= 6 THEN c END AS citation,
    kind = 'image' AND (place = 1 OR (url IS NOT NULL AND score >= -2.5 AND CASE WHEN intent = 'visual' THEN linked OR hit OR score >= 0.92 ELSE linked OR (hit AND score >= 0.2) END)) AS i,
    chunk_type = 'table_text' AND table_rows > 0 AND (intent = 'table' OR (score >= 0 AND table_rows >= 2)) AS t
  FROM (SELECT e.*, kind = 'image' AND (list_contains(coalesce(cids, []), id - 1) OR list_contains(coalesce(cids, []), top)) AS linked,
      len(list_filter({words("lower(normalized)")}, lambda w: length(w) >= 4 AND w NOT IN ('show', 'image', 'images', 'figure', 'figures', 'diagram', 'diagrams') AND contains(lower(concat_ws(' ', caption, labels, text, section)), w))) > 0 AS hit
    FROM cited e LEFT JOIN cids USING (query_id)) d),
ranked AS (SELECT *, CASE WHEN i AND count(*) FILTER (WHERE i) OVER w <= 2 THEN count(*) FILTER (WHERE i) OVER w END AS image, CASE WHEN t AND count(*) FILTER (WHERE t) OVER w <= 2 THEN count(*) FILTER (WHERE t) OVER w END AS tab
  FROM useful WINDOW w AS (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING))"""


def post_boosts(spark, sf_dir):
    return E.roles(candidates(spark, sf_dir)).select("query_id", "id", "base", "score", "place")


POST_BOOSTS = f"WITH {SCORES}, {_CANDIDATES} SELECT query_id, id, base, score, place FROM ranked"


def evidence_roles(spark, sf_dir):
    return E.roles(candidates(spark, sf_dir)).select("query_id", "id", "place", "citation", "image", F.col("table").alias("tab"))


EVIDENCE_ROLES = f"WITH {SCORES}, {_CANDIDATES} SELECT query_id, id, place, citation, image, tab FROM ranked"


def _cards(spark, sf_dir) -> DataFrame:
    return E.labelled(E.roles(candidates(spark, sf_dir)))


def citation_filter(spark, sf_dir):
    shown = _cards(spark, sf_dir).where("shown = 'citation'")
    return shown.select("query_id", "id", "label", F.coalesce(F.nullif(F.col("chunk_type"), F.lit("")), F.col("kind")).alias("kind"), T.snippet(F.col("text")).alias("snippet"))


_SNIP = compact("coalesce(text, '')")
_SNIPPET = f"CASE WHEN length({_SNIP}) <= 320 THEN {_SNIP} ELSE rtrim(substr({_SNIP}, 1, 317)) || '...' END"
_SAID = f"concat_ws(' ', heading, section, text, caption, labels, markdown, {_SNIPPET})"
_OVERLAP = f"len(list_intersect({_keys('query')}, {_keys(_SAID)})) > 0"
_CITES = f"CASE WHEN intent = 'shloka' AND {VERSE} THEN score >= -0.15 WHEN score >= 0.45 THEN true WHEN (intent = 'table' AND chunk_type = 'table_text') OR intent = 'visual' THEN {_OVERLAP} AND score >= -0.1 ELSE {_OVERLAP} AND score >= 0.05 END"
CITATION_FILTER = f"""
WITH {SCORES}, {_CANDIDATES}
SELECT query_id, id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY place) AS label, CASE WHEN chunk_type = '' THEN kind ELSE chunk_type END AS kind, CASE WHEN length({_SNIP}) <= 320 THEN {_SNIP} ELSE rtrim(substr({_SNIP}, 1, 317)) || '...' END AS snippet
FROM ranked WHERE citation IS NOT NULL AND {_CITES}"""


def enough_evidence(spark, sf_dir):
    return E.enough(E.roles(candidates(spark, sf_dir)))


_ENOUGH = f"""
shown AS (SELECT *, citation IS NOT NULL AND {_CITES} AS cites, image IS NOT NULL AND url IS NOT NULL AS card,
  tab IS NOT NULL AND table_rows > 0 AND score >= -0.25 AND CASE WHEN intent = 'table' THEN table_rows >= 1 ELSE table_rows >= 3 AND score >= 0.15 END AS shows FROM ranked),
summed AS (SELECT query_id, intent, count(*) FILTER (WHERE cites) AS citations, count(*) FILTER (WHERE card) AS images, count(*) FILTER (WHERE shows) AS tables, max(kind) FILTER (WHERE place = 1) AS top_kind,
  bool_or(trim(concat(text, caption)) <> '') FILTER (WHERE place = 1) AS ctx, max(score) FILTER (WHERE citation = 1) AS cs, max(score) FILTER (WHERE image = 1) AS isc, max(score) FILTER (WHERE tab = 1) AS ts,
  coalesce(bool_or(citation IS NOT NULL AND {VERSE}), false) AS verse FROM shown GROUP BY query_id, intent),
decided AS (SELECT query_id, intent, citations, images, tables, top_kind, CASE WHEN top_kind = 'image' THEN images > 0 AND ctx WHEN citations > 0 AND cs >= 0.1 THEN true
  WHEN intent = 'visual' THEN images > 0 AND (citations > 0 OR coalesce(isc, -999) >= 0.35) WHEN intent = 'shloka' THEN verse AND citations > 0
  WHEN intent = 'table' THEN tables > 0 AND (citations > 0 OR coalesce(ts, -999) >= 0.2) ELSE false END AS enough FROM summed)"""
ENOUGH_EVIDENCE = f"WITH {SCORES}, {_CANDIDATES}, {_ENOUGH} SELECT * FROM decided"


def _questions(ranked: DataFrame) -> DataFrame:
    return ranked.where("place = 1").select("query_id", "query", "intent", F.col("kind").alias("top_kind"))


def _parts(spark, sf_dir) -> DataFrame:
    ranked = E.roles(candidates(spark, sf_dir))
    return E.prompt_parts(_questions(ranked), E.blocks(E.labelled(ranked)))


def prompt_blocks(spark, sf_dir):
    """The block of every citation, figure and table that is shown."""
    return E.blocks(_cards(spark, sf_dir)).select("query_id", "id", "shown", "label", F.array_join("cited", ",").alias("cited"), "block")


_TITLE = "CASE WHEN ends_with(source_file, '.pdf') THEN left(source_file, length(source_file) - 4) ELSE source_file END"
_CARDS = f"""
cards AS (SELECT *, 'citation' AS shown_, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY place) AS label FROM shown WHERE cites
  UNION ALL SELECT *, 'image', 'F' || image FROM shown WHERE card UNION ALL SELECT *, 'table', 'T' || tab FROM shown WHERE shows),
marks AS (SELECT query_id, id, label FROM cards WHERE shown_ = 'citation'),
linked_ AS (SELECT c.query_id, c.id, c.shown_, string_agg(m.label, ',' ORDER BY o) AS cited FROM (
    SELECT query_id, id, shown_, unnest(CASE WHEN shown_ = 'image' THEN [id - 1, top] WHEN shown_ = 'table' THEN [id] ELSE [] END) AS x, unnest(CASE WHEN shown_ = 'image' THEN [1, 2] WHEN shown_ = 'table' THEN [1] ELSE [] END) AS o FROM cards) c
  JOIN marks m ON m.query_id = c.query_id AND m.id = c.x GROUP BY ALL),
blocks AS (SELECT c.query_id, c.id, c.shown_ AS shown, label, coalesce(cited, '') AS cited, regexp_replace(CASE c.shown_
    WHEN 'citation' THEN '[' || label || '] Source: ' || {_TITLE} || ', p.' || page || chr(10) || 'Section: ' || section || chr(10) || {_SNIPPET}
    WHEN 'image' THEN '[' || label || '] Source: ' || source_file || ' page ' || page || chr(10) || 'Primary context: ' || coalesce(nullif(trim(coalesce(text, '')), ''), caption) || chr(10) || 'Caption: ' || caption
      || chr(10) || 'Diagram token: [Diagram: ' || c.id || '_page' || page || '.png]' || CASE WHEN labels IS NOT NULL THEN chr(10) || 'Labels: ' || labels ELSE '' END || CASE WHEN cited IS NOT NULL THEN chr(10) || 'Linked citations: ' || replace(cited, ',', ', ') ELSE '' END
    ELSE '[' || label || '] Source: ' || source_file || ' p[' || page || ']' || chr(10) || 'Caption: ' || CASE WHEN cited IS NOT NULL THEN chr(10) || 'Linked citations: ' || replace(cited, ',', ', ') ELSE '' END || chr(10) || coalesce(markdown, '') END, '^\\s+|\\s+$', '', 'g') AS block
  FROM cards c LEFT JOIN linked_ l ON l.query_id = c.query_id AND l.id = c.id AND l.shown_ = c.shown_)"""
PROMPT_BLOCKS = f"WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS} SELECT * FROM blocks"


def prompt_sections(spark, sf_dir):
    """The sections of each prompt that fit the budget of 2,800 words."""
    return E.fit_sections(_parts(spark, sf_dir))


_W = words("content")
_SECTIONS = f"""
head AS (SELECT query_id, query, intent, kind AS top_kind FROM ranked WHERE place = 1),
parts AS (SELECT query_id, 0 AS seq, 'Question' AS title, query AS content FROM head UNION ALL SELECT query_id, 1, 'Intent', intent FROM head
  UNION ALL SELECT query_id, CASE shown WHEN 'citation' THEN 3 WHEN 'table' THEN 5 ELSE CASE WHEN top_kind = 'image' THEN 2 ELSE 4 END END, CASE shown WHEN 'citation' THEN 'Text Evidence' WHEN 'image' THEN 'Figure Evidence' ELSE 'Table Evidence' END,
    string_agg(block, chr(10) || chr(10) ORDER BY label) FROM blocks JOIN head USING (query_id) GROUP BY query_id, shown, top_kind),
n AS (SELECT *, {count("title || ':' || chr(10) || content")} AS n FROM parts),
s AS (SELECT *, sum(n) OVER w AS total FROM n WINDOW w AS (PARTITION BY query_id ORDER BY seq)),
o AS (SELECT *, total > 2800 AS cut, sum((total > 2800)::INT) OVER (PARTITION BY query_id ORDER BY seq) AS overs, CAST(greatest(64, 2800 - (total - n) - {count("title")} - 4) AS INTEGER) AS room FROM s),
fit AS (SELECT query_id, seq, title, CASE WHEN NOT cut OR len({_W}) <= room THEN content ELSE array_to_string(({_W})[1:room], ' ') || ' ...' END AS content, cut FROM o WHERE overs <= 1)"""
PROMPT_SECTIONS = f"WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}, {_SECTIONS} SELECT query_id, seq, title, content, cut FROM fit"


def prompt_text(spark, sf_dir):
    """The whole prompt, as a writer gets it."""
    return E.prompts(E.fit_sections(_parts(spark, sf_dir))).select("query_id", F.array_join("sections", ",").alias("sections"), "prompt")


PROMPT_TEXT = f"""WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}, {_SECTIONS}
SELECT query_id, string_agg(title, ',' ORDER BY seq) AS sections, string_agg(title || ':' || chr(10) || content, chr(10) || chr(10) ORDER BY seq) AS prompt FROM fit WHERE content <> '' GROUP BY query_id"""


def _answers(ranked: DataFrame, cards: DataFrame) -> DataFrame:
    labels = cards.where("shown = 'citation'").groupBy("query_id").agg(F.array_sort(F.collect_list("label")).alias("ids"))
    q = E.enough(ranked).join(labels, "query_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    route = F.when(F.col("query_id") % 9 == 0, "simple").otherwise("deep")
    model = F.col("query_id") % 2 == 0
    return q.withColumn("answer", E.answer(route, F.col("enough"), model, F.col("ids"), F.concat(F.lit("According to "), F.array_join("ids", " and "))))


def answer_fallback(spark, sf_dir):
    """Answers of all rungs; every other question has a model, whose stand-in names its evidence."""
    ranked = E.roles(candidates(spark, sf_dir))
    return _answers(ranked, E.labelled(ranked)).select("query_id", "answer")


_ANSWERS = f"""
l AS (SELECT query_id, list(label ORDER BY label) AS ids FROM cards WHERE shown_ = 'citation' GROUP BY query_id),
answers AS (SELECT query_id, CASE WHEN query_id % 9 = 0 THEN 'Hello! Ask me about the indexed books.' WHEN NOT enough THEN 'The indexed books do not hold enough evidence for an answer.'
  WHEN query_id % 2 = 1 THEN 'No language model is configured. Evidence: ' || coalesce(array_to_string(ids, ', '), '') ELSE 'According to ' || coalesce(array_to_string(ids, ' and '), '') END AS answer FROM decided LEFT JOIN l USING (query_id))"""
ANSWER_FALLBACK = f"WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}, {_ANSWERS} SELECT query_id, answer FROM answers"


def response(spark, sf_dir):
    """The response to each question, evidence hidden where it isn't enough."""
    ranked = E.roles(candidates(spark, sf_dir))
    cards = E.labelled(ranked)
    made = E.responses(E.enough(ranked), cards, _answers(ranked, cards).select("query_id", "answer"))
    return made.select("query_id", "answer", *(F.array_join(c, ",").alias(c) for c in ("citations", "images", "tables")), "enough", "intent", "model")


RESPONSE = f"""WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}, {_ANSWERS},
seen AS (SELECT query_id, string_agg(label, ',' ORDER BY label) FILTER (WHERE shown_ = 'citation') AS c, string_agg(label, ',' ORDER BY label) FILTER (WHERE shown_ = 'image') AS i, string_agg(label, ',' ORDER BY label) FILTER (WHERE shown_ = 'table') AS t FROM cards GROUP BY query_id)
SELECT query_id, answer, CASE WHEN enough THEN coalesce(c, '') ELSE '' END AS citations, CASE WHEN enough THEN coalesce(i, '') ELSE '' END AS images, CASE WHEN enough THEN coalesce(t, '') ELSE '' END AS tables, enough, intent, 'none' AS model
FROM decided JOIN answers USING (query_id) LEFT JOIN seen USING (query_id)"""


def public_images(spark, sf_dir):
    """Figure cards without the text around them."""
    return E.public_cards(E.blocks(_cards(spark, sf_dir))).withColumn("cited", F.array_join("cited", ","))


PUBLIC_IMAGES = f"""WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}
SELECT c.query_id, c.label AS id, c.id AS image_id, page AS page_number, coalesce(caption, '') AS caption, coalesce(labels, '') AS labels, url, source_file, coalesce(cited, '') AS cited
FROM cards c LEFT JOIN linked_ l ON l.query_id = c.query_id AND l.id = c.id AND l.shown_ = c.shown_ WHERE c.shown_ = 'image'"""


def debug_candidates(spark, sf_dir):
    """Every ranked candidate as a debug envelope shows it."""
    return E.debug_rows(E.roles(candidates(spark, sf_dir))).withColumn("linked", F.array_join(F.col("linked").cast("array<string>"), ","))


DEBUG_CANDIDATES = f"""WITH {SCORES}, {_CANDIDATES}
SELECT query_id, id, kind, score, source_file, page, chunk_type, section, {_SNIPPET} AS snippet, CASE WHEN kind = 'image' THEN (id - 1) || ',' || top ELSE '' END AS linked, markdown, caption, url FROM ranked"""


def answer_events(spark, sf_dir):
    """The ordered events of each answer: status, a token a word, final."""
    a = answer_fallback(spark, sf_dir)
    status = a.select("query_id", F.lit(0).alias("seq"), F.lit("status").alias("event"), F.lit('{"stage":"retrieval"}').alias("data"))
    tokens = a.select("query_id", F.posexplode(T.word_list(F.col("answer"))).alias("p", "w")).select("query_id", (F.col("p") + 1).alias("seq"), F.lit("token"), F.col("w"))
    final = a.select("query_id", (T.word_count(F.col("answer")) + 1).alias("seq"), F.lit("final"), F.col("answer"))
    return status.union(tokens).union(final)


ANSWER_EVENTS = f"""WITH {SCORES}, {_CANDIDATES}, {_ENOUGH}, {_CARDS}, {_ANSWERS}, a AS (SELECT * FROM answers),
w AS (SELECT *, {words("answer")} AS ws FROM a)
SELECT query_id, 0 AS seq, 'status' AS event, '{{"stage":"retrieval"}}' AS data FROM w
UNION ALL SELECT query_id, CAST(unnest(range(len(ws))) + 1 AS INTEGER), 'token', unnest(ws) FROM w UNION ALL SELECT query_id, CAST(len(ws) + 1 AS INTEGER), 'final', answer FROM w"""

QUERIES = {f.__name__: f for f in (post_boosts, evidence_roles, citation_filter, enough_evidence, prompt_blocks, prompt_sections, prompt_text, answer_fallback, response, public_images, debug_candidates, answer_events)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
