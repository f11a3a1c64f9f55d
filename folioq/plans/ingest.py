"""Queries of the steps around parsing: figures and chunks, routes, caches, frames, placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import ingest as I
from folioq.plans._sql import UNITS, compact, count, gone, times, words
from folioq.plans.text import OCR_DECISION
from folioq.sources.corpus import book_pages, table, units


def _units(spark, sf_dir) -> DataFrame:
    return units(book_pages(table(spark, sf_dir, "documents")))


def figure_links(spark, sf_dir):
    """Every document has a figure whose caption is its lines 1 and 4; three lines make a chunk."""
    u = _units(spark, sf_dir).select("page_id", "reading_order", F.concat_ws(":", F.col("page_id").cast("string"), F.col("reading_order").cast("string")).alias("unit_id"))
    chunks = u.groupBy(F.concat_ws(":", F.col("page_id").cast("string"), F.lit("c"), F.floor(F.col("reading_order") / 3).cast("string")).alias("chunk_id")).agg(F.collect_list("unit_id").alias("source_unit_ids"))
    docs = table(spark, sf_dir, "documents")
    unit = lambda k: F.concat(F.col("doc_id").cast("string"), F.lit(f":{k}"))
    images = docs.select(F.concat(F.lit("img:"), F.col("doc_id").cast("string")).alias("image_id"), F.array(unit(1), unit(4)).alias("caption_unit_ids"))
    linked = I.link_figures(images, chunks)
    return linked.select("image_id", F.array_join("linked", ",").alias("linked"))


FIGURE_LINKS = f"""
WITH {UNITS}, c AS (SELECT DISTINCT page_id, page_id || ':c:' || (reading_order // 3) AS chunk_id FROM units WHERE reading_order IN (1, 4))
SELECT 'img:' || page_id AS image_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS linked FROM c GROUP BY page_id"""


def candidate_rows(spark, sf_dir):
    """Texts of candidates: documents as text rows, with a heading for every third and no text for every fifth."""
    i = F.col("doc_id")
    heading, text, grid = F.when(i % 3 == 0, F.concat(F.lit(" H"), i.cast("string"))), F.when(i % 5 != 0, F.col("text")), F.when(i % 4 == 0, F.lit("| a |"))
    c = I.text_candidate(heading, text, grid)
    m = I.image_candidate(F.when(i % 3 == 0, "Cap"), F.when(i % 2 == 0, F.col("source")), F.when(i % 7 == 0, F.array(F.lit("l1"), F.lit("l2"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("s"), F.col("lang")))
    md5 = lambda x: F.md5(x.cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", c["snippet"].alias("snippet"), md5(c["rerank_text"]).alias("rerank"), m["snippet"].alias("image_snippet"), m["rerank_text"].alias("image_rerank"))


_S = lambda x: f"CASE WHEN length({compact(x)}) <= 320 THEN {compact(x)} ELSE rtrim(substr({compact(x)}, 1, 317)) || '...' END"
CANDIDATE_ROWS = f"""
WITH p AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN 'H' || doc_id END AS h, CASE WHEN doc_id % 5 <> 0 THEN nullif(trim(coalesce(text, '')), '') END AS t, CASE WHEN doc_id % 4 = 0 THEN '| a |' END AS g FROM documents)
SELECT doc_id, {_S("coalesce(t, g, h, '')")} AS snippet, md5(concat_ws(chr(10) || chr(10), h, t, g)) AS rerank,
  coalesce(CASE WHEN doc_id % 3 = 0 THEN 'Cap' END, CASE WHEN doc_id % 2 = 0 THEN source END, CASE WHEN doc_id % 7 = 0 THEN 'l1 l2' END, '') AS image_snippet,
  concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Cap' END, CASE WHEN doc_id % 7 = 0 THEN 'l1 l2' END, CASE WHEN doc_id % 2 = 0 THEN source END, 's / ' || lang) AS image_rerank FROM p"""


def page_route(spark, sf_dir):
    """Way in of every document as a page, every tenth of which a large image covers."""
    m = I.page_measures(_units(spark, sf_dir))
    text, image = F.col("text"), F.when(F.col("doc_id") % 10 == 0, 0.9).otherwise(0.1)
    docs = table(spark, sf_dir, "documents").withColumn("reason", T.ocr_reason(text))
    docs = docs.select("doc_id", "reason", T.page_type(text, image, F.col("reason")).alias("page_type"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    joined = docs.join(m, docs.doc_id == m.page_id, "left").withColumn("structure", F.coalesce("structure", F.lit("no_native_text")))
    way = I.route(F.col("blank"), F.col("page_type"), F.col("reason"), F.col("structure"))
    return joined.select("doc_id", "structure", "two_columns", "mixed", "garbled", way.alias("route"))


_N = count("text")
_NUM = times("text", r"\d+(?:\.\d+)?")
_BAD = r"(length(text) >= 5 AND (length(regexp_replace(text, '[\p{L}\p{N}\p{M}\s|.,;:!?()\[\]{}''\"/।॥-]', '', 'g')) / greatest(length(text), 1) > 0.30 OR (regexp_matches(text, 'Ãƒ|Ã‚|ï¿½|�') AND NOT regexp_matches(text, '[ऀ-ॿ؀-ۿఀ-౿]'))))"
PAGE_ROUTE = rf"""
WITH {UNITS},
k AS (SELECT *, (x0 + x1) / 2 AS c, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY (x0 + x1) / 2) AS k FROM units),
d AS (SELECT *, max(CASE WHEN k = n // 2 + 1 THEN c END) OVER (PARTITION BY page_id) AS mid FROM k),
m AS (SELECT page_id, max(n) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), '\btable\b|\bs\.?\s*no\b|sample no|parameter')) AS anchors,
  count(*) FILTER (WHERE regexp_matches(text, '^\d{{1,3}}[.)]?\s+') OR contains(text, '|') OR ({_NUM} >= 2 AND {_N} <= 12)) AS rows,
  count(*) FILTER (WHERE length({gone("text", r"[^\p{Nd}\p{L}]")}) > 0 AND length({gone("text", r"[^\p{Nd}]")}) / greatest(length({gone("text", r"[^\p{Nd}\p{L}]")}), 1) >= 0.35 AND {_N} <= 14) AS dense,
  count(*) FILTER (WHERE c <= mid) AS lefts, max(c) - min(c) AS spread, count(*) FILTER (WHERE {_BAD} AND length(text) >= 40) AS bl, count(*) FILTER (WHERE length(text) >= 40) AS l,
  count(*) FILTER (WHERE {_BAD}) AS s, count(*) FILTER (WHERE length(text) >= 5) AS sub FROM d GROUP BY page_id),
t AS (SELECT *, n >= 6 AND spread >= 120 AND lefts >= greatest(2, floor(n * 0.25)) AND n - lefts >= greatest(2, floor(n * 0.25)) AS two_columns FROM m),
f AS (SELECT page_id, two_columns, CASE WHEN anchors >= 1 AND rows >= 1 THEN 'table_anchor' WHEN rows >= 3 THEN 'table_rows' WHEN two_columns AND (rows >= 1 OR dense >= 2) THEN 'complex_layout' ELSE 'simple_layout' END AS structure,
  sub >= 2 AND s > 0 AND s < sub AND s / greatest(sub, 1) < 0.75 AS mixed, bl >= 1 AND bl / greatest(l, 1) >= 0.30 AS garbled FROM t),
o AS (SELECT doc_id AS k, reason, CASE WHEN page_type = '' THEN '' ELSE page_type END AS page_type FROM ({OCR_DECISION.replace("abs(doc_id) % 100 / 100 AS image", "CASE WHEN doc_id % 10 = 0 THEN 0.9 ELSE 0.1 END AS image")}))
SELECT doc_id, coalesce(structure, 'no_native_text') AS structure, two_columns, mixed, garbled, CASE WHEN trim(coalesce(text, '')) = '' THEN 'blank' WHEN reason = 'empty_native' OR starts_with(reason, 'quality:') OR reason = 'parser_garbled' THEN 'ocr'
  WHEN page_type IN ('scanned', 'ocr_fallback') THEN 'ocr' WHEN coalesce(structure, '') <> 'simple_layout' THEN 'structured' ELSE 'native' END AS route
FROM documents LEFT JOIN f ON page_id = doc_id JOIN o ON k = doc_id"""


def page_cache(spark, sf_dir):
    """Even documents are cached pages; the others come from a parse whose pages count from 1 in windows of eight."""
    docs = table(spark, sf_dir, "documents").withColumn("page", F.col("doc_id") + 1)
    unit = lambda p: F.concat(F.lit("book:p"), p.cast("string"), F.lit(":u1"))
    cached = docs.where("page % 2 = 0").select("page", unit(F.col("page")).alias("unit_id"), F.md5(F.col("text").cast("binary")).alias("text"))
    first = F.floor((F.col("page") - 1) / 8) * 8 + 1
    parsed = docs.where("page % 3 <> 0").select((F.col("page") - first + 1).alias("local_page"), first.alias("first"), unit(F.col("page") - first + 1).alias("unit_id"), F.md5(F.col("text").cast("binary")).alias("text"))
    return I.fill_cache(cached, parsed, docs.select("page"))


PAGE_CACHE = """
SELECT doc_id + 1 AS page, CASE WHEN (doc_id + 1) % 2 = 0 OR (doc_id + 1) % 3 <> 0 THEN 'book:p' || (doc_id + 1) || ':u1' END AS unit_id, CASE WHEN (doc_id + 1) % 2 = 0 OR (doc_id + 1) % 3 <> 0 THEN md5(text) END AS text FROM documents"""


def table_rows(spark, sf_dir):
    """Rows of the documents that hold bars, read as Markdown."""
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|")))
    return docs.select("doc_id", F.posexplode(I.markdown_rows(F.col("text"))).alias("row", "r")).select("doc_id", "row", F.array_join("r", "~").alias("cells"))


TABLE_ROWS = r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[|:\s-]+$')),
  lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) > 0) AS rs FROM documents WHERE contains(text, '|'))
SELECT doc_id, CAST(unnest(range(len(rs))) AS INTEGER) AS row, array_to_string(unnest(rs), '~') AS cells FROM l"""


def stream_frames(spark, sf_dir):
    """Conversations as a server's stream, read back."""
    c = table(spark, sf_dir, "conversations")
    frame = F.concat(F.lit("event: "), "role", F.lit("\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))
    bodies = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("body"))
    return bodies.select("conv_id", F.posexplode(I.frames(F.col("body"))).alias("seq", "e")).select("conv_id", "seq", "e.event", "e.data")


STREAM_FRAMES = """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role AS event, text AS data FROM conversations"""


def text_slots(spark, sf_dir):
    """Lines of every document spread over 1 to 6 slots."""
    lines = _units(spark, sf_dir).select(F.col("page_id").alias("key"), F.col("reading_order").alias("seq"))
    return I.slots(lines, (F.col("key") % 6 + 1).cast("int"))


TEXT_SLOTS = f"""
WITH {UNITS}, n AS (SELECT page_id AS key, reading_order AS seq, page_id % 6 + 1 AS n, count(*) OVER (PARTITION BY page_id) AS m, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS i FROM units),
s AS (SELECT key, seq, CASE WHEN m >= n THEN t ELSE i END AS slot FROM (SELECT *, list_filter(range(n), lambda b: i > b * (m // n) + least(b, m % n))[-1] + 1 AS t FROM n))
SELECT key, seq, CAST(slot - 1 AS INTEGER) AS slot FROM s"""


def page_boxes(spark, sf_dir):
    """Boxes of lines from pixels, and from a scale that counts from the bottom."""
    u = _units(spark, sf_dir)
    box = I.to_page(*(F.col(c) * 3.0 for c in ("x0", "y0", "x1", "y1")), (F.lit(1500.0), F.lit(2400.0)), (F.lit(500.0), F.lit(800.0)))
    top, bottom = I.flip(F.col("y0"), F.col("y1"), F.lit(800.0))
    return u.select("page_id", "reading_order", *(F.round(c, 6).alias(n) for c, n in zip(box, ("bx0", "by0", "bx1", "by1"), strict=True)), top.alias("top"), bottom.alias("bottom"))


PAGE_BOXES = f"""
WITH {UNITS} SELECT page_id, reading_order, round(least(x0 * 3.0::DOUBLE * (500.0::DOUBLE / 1500), 500), 6) AS bx0, round(least(y0 * 3.0::DOUBLE * (800.0::DOUBLE / 2400), 800), 6) AS by0,
  round(least(x1 * 3.0::DOUBLE * (500.0::DOUBLE / 1500), 500), 6) AS bx1, round(least(y1 * 3.0::DOUBLE * (800.0::DOUBLE / 2400), 800), 6) AS by1, 800.0::DOUBLE - y1 AS top, 800.0::DOUBLE - y0 AS bottom FROM units"""


def request_checks(spark, sf_dir):
    """User turns as requests with page ranges by their turn."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, "  ").otherwise(F.col("text")).alias("query"), (F.col("conv_id") % 5).alias("page_start"), (F.col("turn") + F.col("conv_id") % 3).alias("page_end"), F.array(F.lit(" en"), F.lit(""), F.lit("en"), F.lit("sa")).alias("languages"))
    return I.validated(asked).select("conv_id", "turn", F.length("query").alias("chars"), F.array_join("languages", ",").alias("languages"), "error")


REQUEST_CHECKS = f"""
WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE {compact("text")} END AS query, conv_id % 5 AS s, turn + conv_id % 3 AS e FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CAST(length(query) AS INTEGER) AS chars, 'en,sa' AS languages, CASE WHEN query = '' THEN 'query is empty' WHEN s < 1 OR e < 1 THEN 'pages begin at 1' WHEN e < s THEN 'page_end is before page_start' END AS error FROM q"""


def _placements(spark, sf_dir) -> DataFrame:
    """Lines as placements: the box moves with the line's length, the xref is its number of words."""
    u = _units(spark, sf_dir)
    x = (F.col("x1") * 7) % 400
    return u.select("page_id", F.col("reading_order").cast("long").alias("id"), T.word_count(F.col("text")).alias("xref"), x.alias("x0"), (F.col("reading_order") * 3.0).alias("y0"), (x + 40).alias("x1"), (F.col("reading_order") * 3.0 + 20).alias("y1"), (F.col("x1") % 10).alias("score"))


def placement_dedupe(spark, sf_dir):
    """Placements of every page without repeats. Boxes of an xref creep by 0.4 points, so that the first kept one decides."""
    creep = F.col("id") * 0.4
    p = _placements(spark, sf_dir).withColumn("xref", F.col("xref") % 3).withColumns({"x0": creep, "x1": creep + 40, "y0": F.lit(5.0), "y1": F.lit(25.0)})
    return I.dedupe_placements(p).select("page_id", "id", "xref")


PLACEMENT_DEDUPE = f"""
WITH {UNITS}, p AS (SELECT page_id, CAST({_N} % 3 AS INTEGER) AS xref, list([struct_pack(id := CAST(reading_order AS BIGINT), x := reading_order * 0.4::DOUBLE)] ORDER BY reading_order) AS l FROM units GROUP BY ALL),
k AS (SELECT page_id, xref, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: abs(e.x - x[1].x) <= 0.5::DOUBLE)) > 0 THEN acc ELSE acc || x END) AS kept FROM p)
SELECT page_id, unnest(kept).id AS id, xref FROM k"""

_PLACED = f"placed AS (SELECT page_id, CAST(reading_order AS BIGINT) AS id, (x1 * 7) % 400 AS x0, reading_order * 3.0::DOUBLE AS y0, (x1 * 7) % 400 + 40 AS x1, reading_order * 3.0::DOUBLE + 20 AS y1, x1 % 10 AS score, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) - 1 AS at_ FROM units)"


def placement_groups(spark, sf_dir):
    """Connected placements of every page."""
    return I.components(_placements(spark, sf_dir))


PLACEMENT_GROUPS = f"""
WITH RECURSIVE {UNITS}, {_PLACED},
near_ AS (SELECT a.page_id, a.at_ AS a, b.at_ AS b FROM placed a JOIN placed b ON a.page_id = b.page_id AND a.x0 - 10 <= b.x1 + 10 AND a.x1 + 10 >= b.x0 - 10 AND a.y0 - 10 <= b.y1 + 10 AND a.y1 + 10 >= b.y0 - 10),
reached AS (SELECT page_id, at_ AS a, at_ AS b FROM placed UNION SELECT r.page_id, r.a, n.b FROM reached r JOIN near_ n ON n.page_id = r.page_id AND n.a = r.b)
SELECT r.page_id, p.id, min(r.b) AS component FROM reached r JOIN placed p ON p.page_id = r.page_id AND p.at_ = r.a GROUP BY ALL"""


def figure_suppression(spark, sf_dir):
    """Boxes that stay after greedy suppression."""
    return I.suppress(_placements(spark, sf_dir))


FIGURE_SUPPRESSION = f"""
WITH {UNITS}, {_PLACED},
p AS (SELECT page_id, list([struct_pack(id := id, x0 := x0, y0 := y0, x1 := x1, y1 := y1)] ORDER BY score DESC, id) AS l FROM placed GROUP BY page_id),
k AS (SELECT page_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: greatest(0, least(e.x1, x[1].x1) - greatest(e.x0, x[1].x0)) * greatest(0, least(e.y1, x[1].y1) - greatest(e.y0, x[1].y0))
  / (1600 - greatest(0, least(e.x1, x[1].x1) - greatest(e.x0, x[1].x0)) * greatest(0, least(e.y1, x[1].y1) - greatest(e.y0, x[1].y0))) >= 0.60::DOUBLE)) > 0 THEN acc ELSE acc || x END) AS kept FROM p)
SELECT page_id, unnest(kept).id AS id FROM k"""

QUERIES = {f.__name__: f for f in (figure_links, candidate_rows, page_route, page_cache, table_rows, stream_frames, text_slots, page_boxes, request_checks, placement_dedupe, placement_groups, figure_suppression)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
