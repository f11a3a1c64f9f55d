"""Queries of the page model and of chunking, over every line of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import chunking as C
from folioq.operators import layout as L
from folioq.plans._sql import UNITS, compact, count, frame, gone, times, values, words
from folioq.sources.corpus import book_pages, html_units, table, units


def _units(spark, sf_dir) -> DataFrame:
    return units(book_pages(table(spark, sf_dir, "documents")))


_N = count("text")
_NUM = times("text", r"\d+(?:\.\d+)?")
_SER = rf"regexp_matches(text, '^\d{{1,3}}[.)]?\s+')"
_ROW = rf"(regexp_matches(lower(text), '^(table |table no|s\.no|sample no)') OR (SPARED AND (({_SER} AND ({_N} <= 4 OR ({_NUM} >= 2 AND {_N} <= 12))) OR ({_NUM} >= 3 AND {_N} <= 12))))"
ROW = _ROW.replace("SPARED", "true")
TITLE = r"(NOT regexp_matches(text, '(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}') AND NOT regexp_matches(text, '[\p{Lu}\p{Ll}\p{Lt}]\p{Lu}'))"
_NUMBER = r"regexp_matches(trim(text), '^[(\[]?\d{1,4}[)\]]?$')"


def noise_lines(spark, sf_dir):
    return L.mark_noise(_units(spark, sf_dir)).where("noise").select("page_id", "reading_order", "text")


_FORM = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s*\d{1,4}\s*', ''), '\s*\d{1,4}\s*$', ''), '^[ |.-]+|[ |.-]+$', '', 'g')"
NOISE_LINES = rf"""
WITH {UNITS},
h AS (SELECT *, greatest(max(y1) OVER (PARTITION BY page_id), 1) AS h, {_FORM} AS norm FROM units),
z AS (SELECT *, y1 <= h * 0.14::DOUBLE AS above, y0 >= h * 0.84::DOUBLE AS below FROM h),
k AS (SELECT *, {_NUMBER} AND (above OR below) AS number, CASE WHEN norm = '' OR length(text) > 140 OR NOT (above OR below) THEN NULL
  WHEN regexp_matches(norm, '{T.FURNITURE.replace(chr(92) + chr(92), chr(92))}') OR {_NUMBER} THEN 'strong'
  WHEN above AND {count("norm")} <= 12 AND (contains(text, ':') OR regexp_matches(norm, '\bet\s*al\b|etal')) THEN 'generic'
  WHEN below AND {count("norm")} <= 8 AND length(norm) <= 70 THEN 'generic' END AS kind FROM z),
r AS (SELECT book, norm FROM k WHERE kind IS NOT NULL GROUP BY book, norm
  HAVING count(DISTINCT page_id) FILTER (WHERE kind = 'strong') >= 2 OR count(DISTINCT page_id) FILTER (WHERE kind = 'generic') >= 3)
SELECT page_id, reading_order, text FROM k WHERE number OR (book, norm) IN (SELECT (book, norm) FROM r)"""


def layout_type(spark, sf_dir):
    return L.lay_out(_units(spark, sf_dir)).select("page_id", "reading_order", "layout", "column_id", "position")


LAYOUT_TYPE = f"""
WITH {UNITS},
c AS (SELECT *, (x0 + x1) / 2 AS c FROM units),
m AS (SELECT *, count(*) OVER p AS n, min(c) OVER p AS lo, max(c) OVER p AS hi, row_number() OVER (PARTITION BY page_id ORDER BY c, reading_order) AS nth FROM c WINDOW p AS (PARTITION BY page_id)),
l AS (SELECT *, count(*) FILTER (WHERE c <= (lo + hi) / 2) OVER (PARTITION BY page_id) AS lefts, max(CASE WHEN nth = n // 2 + 1 THEN c END) OVER (PARTITION BY page_id) AS mid FROM m),
t AS (SELECT *, CASE WHEN n >= 4 AND hi > lo AND lefts > 0 AND n - lefts > 0 AND abs(lefts - (n - lefts)) <= greatest(2, n // 2) THEN 'two_column' ELSE 'single' END AS layout FROM l),
o AS (SELECT *, CASE WHEN layout = 'two_column' AND c > mid THEN 1 ELSE 0 END AS column_id FROM t)
SELECT page_id, reading_order, layout, column_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY column_id, y0, x0, reading_order) - 1 AS INTEGER) AS position FROM o"""


def section_path(spark, sf_dir):
    return L.sections(_units(spark, sf_dir)).select("page_id", "reading_order", "kind", "section")


_LEAD = r"(?i)^\s*(\d+(\.\d+)?|[IVXLCDM]+)"
_COLON = "ends_with(text, ':')"
_SECTIONED = rf"""
s1 AS (SELECT *, {ROW} AS is_row FROM units),
s2 AS (SELECT *, count(*) FILTER (WHERE is_row) OVER (PARTITION BY page_id) >= 5 AS heavy FROM s1),
s3 AS (SELECT *, CASE WHEN is_row THEN 'table_row' WHEN length(text) > 120 OR regexp_matches(lower(text), '{T.FURNITURE.replace(chr(92) + chr(92), chr(92))}') THEN 'paragraph'
  WHEN heavy AND NOT regexp_matches(lower(text), '^({T.SECTIONS})') AND NOT {_COLON} AND {_N} <= 6 THEN 'paragraph' WHEN regexp_matches(text, '^[(\[]?\d{{1,4}}[)\]]?$') THEN 'paragraph'
  WHEN regexp_matches(text, '{_LEAD}([^\p{{L}}\p{{N}}_]|$)') THEN CASE WHEN regexp_matches(trim(regexp_replace(lower(text), '{_LEAD}[.)\-: ]*', '')), '^({T.SECTIONS})') OR {_COLON} THEN 'heading' ELSE 'paragraph' END
  WHEN {_N} BETWEEN 2 AND 10 AND ({TITLE} OR {_COLON}) THEN 'heading' ELSE 'paragraph' END AS kind FROM s2),
sectioned AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page_number, page_id, reading_order ROWS UNBOUNDED PRECEDING) AS section FROM s3)"""
SECTION_PATH = f"WITH {UNITS}, {_SECTIONED} SELECT page_id, reading_order, kind, section FROM sectioned"


def kind_counts(spark, sf_dir):
    kinds = L.sections(_units(spark, sf_dir)).groupBy("book", "kind")
    return kinds.agg(F.count(F.lit(1)).alias("units"), F.count_distinct("page_id").alias("pages"), F.round(F.avg(T.word_count(F.col("text"))), 6).alias("mean_words"))


KIND_COUNTS = f"WITH {UNITS}, {_SECTIONED} SELECT book, kind, count(*) AS units, count(DISTINCT page_id) AS pages, round(avg({_N}), 6) AS mean_words FROM sectioned GROUP BY book, kind"


def block_kind(spark, sf_dir):
    return L.block_kind(_units(spark, sf_dir)).select("page_id", "reading_order", "kind")


_WIDE = "((x1 - x0) / w)"
BLOCK_KIND = rf"""
WITH {UNITS},
e AS (SELECT *, greatest(max(x1) OVER (PARTITION BY page_id), 1) AS w, greatest(max(y1) OVER (PARTITION BY page_id), 1) AS h FROM units),
z AS (SELECT *, y1 <= h * 0.14::DOUBLE AS above, y0 >= h * 0.86::DOUBLE AS below FROM e)
SELECT page_id, reading_order, CASE WHEN (above OR below) AND ({_NUMBER} OR regexp_matches(lower(text), '{T.FURNITURE.replace(chr(92) + chr(92), chr(92))}')
    OR (above AND contains(text, ':') AND regexp_matches(lower(text), '\bet\s*al\b|etal')) OR ((x0 <= w * 0.15::DOUBLE OR x1 >= w * 0.85::DOUBLE) AND regexp_matches(lower(text), '^\d{{1,4}}\s+[a-z]'))
    OR (regexp_matches(text, '^[. ]*\d+[. ]*$') AND length(text) <= 6)) THEN 'noise'
  WHEN {_ROW.replace("SPARED", f"NOT regexp_matches(lower(text), '^" + chr(92) + "d{1,3}[.)]?" + chr(92) + f"s+({T.SECTIONS})')")} THEN 'table_row'
  WHEN {_N} <= 16 AND ((upper(text) = text AND {_WIDE} < 0.9) OR (regexp_matches(replace(trim(left(text, 6)), '.', ''), '^\d+$') AND {_N} >= 2) OR ({_COLON} AND {_N} <= 12 AND {_WIDE} < 0.9)
    OR (abs((x0 + x1) / 2 - w / 2) <= w * 0.12::DOUBLE AND {_WIDE} < 0.65 AND {_N} >= 2 AND (upper(text) = text OR {_COLON})) OR ({TITLE} AND {_N} BETWEEN 2 AND 10 AND {_WIDE} < 0.6)) THEN 'heading'
  ELSE 'paragraph' END AS kind FROM z"""

#: Pages with a table's anchor, which the documents lack: (page_id, reading_order, text).
ANCHORED = [(-1 - k // 18, k % 18, t) for k, t in enumerate((
    "Some words about the plan|Table no. 3 Values of the paste|Appearance smooth|Colour pale brown|Loss on drying 4.5|taste sweet|a b c|the end of it was with this|"
    "Weight 12|pH 7|soft|Odour none|Hardness good|x y|p q|r s|t u|v w|"
    "Table 4|one two three|a long line of prose that goes on and says the method of what was prepared here and was written in this book; it ends|four 5|Table 7 again|six|seven|Table 8|Consistency thick|"
    "nine ten|This sentence has more than eight words and ends here now.|eleven|12|13|14|15|16|17").split("|"))]


def table_promotion(spark, sf_dir):
    extra = frame(spark, ANCHORED, "page_id BIGINT, reading_order INTEGER, text VARCHAR")
    rows = _units(spark, sf_dir).select("page_id", "reading_order", "text").union(extra)
    return L.promote_rows(rows).where("promoted").select("page_id", "reading_order", "text")


_CONTEXT = rf"""CASE WHEN {ROW} THEN true WHEN {_N} > 18 THEN false WHEN regexp_matches(text, '[.!?]\s*$') AND {_N} >= 8 THEN false
  WHEN regexp_matches(lower(text), '^({T.ROW_LABELS})') THEN true WHEN {_NUM} >= 1 THEN true
  ELSE {_N} <= 6 AND NOT regexp_matches(lower(text), '\b(the|and|with|were|was|is|are|this|that|from|into|over|under)\b') END"""
TABLE_PROMOTION = rf"""
WITH RECURSIVE {UNITS},
f AS (SELECT page_id, reading_order, text, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS n, regexp_matches(lower(text), '\btable\s*(no\.?\s*\d+|\d+)\b') AS a, {_CONTEXT} AS r,
  {_N} >= 16 AND regexp_matches(text, '[.!?;]') AND regexp_matches(lower(text), '\b(method|observations|prepared|adopting|objective|analysis|discussion|conclusion)\b') AS e
  FROM (SELECT page_id, reading_order, text FROM units UNION ALL SELECT * FROM {values(ANCHORED, "page_id BIGINT, reading_order INTEGER, text VARCHAR")})),
p AS (SELECT * FROM f WHERE page_id IN (SELECT page_id FROM f WHERE a)),
w AS (SELECT page_id, reading_order, text, n, false AS promoted, CASE WHEN a THEN 12 ELSE 0 END AS remaining FROM p WHERE n = 1
  UNION ALL SELECT p.page_id, p.reading_order, p.text, p.n, w.remaining > 0 AND NOT p.a AND p.r,
    CASE WHEN p.a THEN greatest(w.remaining, 12) WHEN w.remaining > 0 THEN CASE WHEN p.e THEN 0 ELSE w.remaining - 1 END ELSE 0 END FROM w JOIN p ON p.page_id = w.page_id AND p.n = w.n + 1)
SELECT page_id, reading_order, text FROM w WHERE promoted"""


def unit_duplicates(spark, sf_dir):
    """Lines of pages of two columns at one height: the right one is the next line of the same page."""
    u = _units(spark, sf_dir)
    paired = u.withColumn("y0", F.floor(F.col("reading_order") / 2) * 12.0).withColumn("y1", F.col("y0") + 10)
    return L.near_duplicate_units(paired)


UNIT_DUPLICATES = f"""
WITH {UNITS},
u AS (SELECT page_id, reading_order, lower(text) AS t, reading_order // 2 AS y FROM units WHERE length(text) >= 30)
SELECT a.page_id, a.reading_order AS a, b.reading_order AS b FROM u a JOIN u b ON a.page_id = b.page_id AND a.reading_order < b.reading_order AND a.y = b.y WHERE contains(a.t, b.t) OR contains(b.t, a.t)"""


def page_windows(spark, sf_dir):
    """Windows over the pages whose document holds a bar or more than 300 words: the ones for a structured parser."""
    pages = book_pages(table(spark, sf_dir, "documents"))
    return L.page_windows(pages.where(F.col("text").contains("|") | (T.word_count(F.col("text")) > 300)), 8)


PAGE_WINDOWS = rf"""
WITH p AS (SELECT DISTINCT source AS book, doc_id // 20 + 1 AS page_number FROM documents WHERE contains(text, '|') OR {count("text")} > 300),
r AS (SELECT *, page_number - row_number() OVER (PARTITION BY book ORDER BY page_number) AS run FROM p),
q AS (SELECT *, (page_number - min(page_number) OVER (PARTITION BY book, run)) // 8 AS part FROM r)
SELECT book, min(page_number) AS first, max(page_number) AS last FROM q GROUP BY book, run, part"""


def html_blocks(spark, sf_dir):
    return html_units(table(spark, sf_dir, "pages"))


HTML_BLOCKS = r"""
WITH e AS (SELECT page_id, unnest(x) AS element, unnest(range(len(x))) AS reading_order FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>|<h3\b[^>]*>.*?</h3>|<p\b[^>]*>.*?</p>|<li\b[^>]*>.*?</li>|<figcaption\b[^>]*>.*?</figcaption>|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>') AS x FROM pages)),
t AS (SELECT page_id, CAST(reading_order AS INTEGER) AS reading_order, lower(regexp_extract(element, '(?is)^<([a-z0-9]+)', 1)) AS tag,
  trim(regexp_replace(regexp_replace(element, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM e)
SELECT page_id, reading_order, CASE WHEN tag IN ('h1', 'h2', 'h3') THEN 'heading' WHEN tag = 'figcaption' THEN 'caption' WHEN tag IN ('nav', 'footer') THEN 'noise' ELSE 'paragraph' END AS kind, text FROM t WHERE text <> ''"""


def packed(spark, sf_dir) -> DataFrame:
    return C.pack(L.sections(_units(spark, sf_dir)).drop("section"))


def chunk_packing(spark, sf_dir):
    """Every chunk with its type; chunks over the cap are cut into windows."""
    typed = packed(spark, sf_dir).withColumn("chunk_type", C.chunk_type(F.col("kinds"), F.col("text"), F.col("units")))
    cut = C.word_windows(typed)
    return cut.select("page_id", "chunk", "part", "chunk_type", "units", T.word_count(F.col("text")).alias("words"), F.md5(F.col("text").cast("binary")).alias("digest"))


_LOOSE_F, _LOOSE_L = compact("x"), f"lower({compact('x')})"
_LOOSE = rf"""CASE WHEN regexp_matches(lower(x), '^(table |fig|s\.no|sample no)') THEN true WHEN regexp_matches(x, '^\d{{1,3}}[.)]?\s+') AND {count("x")} <= 4 THEN true
  WHEN len(list_filter({words("lower(x)")}, lambda w: w IN ('nil', 'na', 'n/a', 'nd'))) > 0 THEN {count("x")} <= 12
  WHEN regexp_matches(x, '[%°]') THEN {count("x")} <= 12 AND ({times("x", r"\d+(?:\.\d+)?")} >= 1 OR len(list_filter({words("x")}, lambda w: regexp_matches(w, '^\p{{L}}+$'))) > 0)
  WHEN {times("x", r"\d+(?:\.\d+)?")} >= 2 AND {count("x")} <= 12 THEN true ELSE {times("x", r"\d")} >= 6 AND {count("x")} <= 12 END"""
_PACKED = rf"""
k AS (SELECT page_id, book, page_number, reading_order, text, kind, {_N} AS n, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS at_ FROM sectioned),
g AS (SELECT page_id, at_, 1 AS chunk, CASE WHEN n <= {C.CAP} AND n >= {C.TARGET} THEN 0 ELSE n END AS held, kind = 'table_row' AS was_row FROM k WHERE at_ = 1
  UNION ALL SELECT k.page_id, k.at_, CASE WHEN held0 = 0 OR held0 + k.n > {C.CAP} THEN chunk + 1 ELSE chunk END,
    CASE WHEN held0 + k.n > {C.CAP} THEN k.n WHEN held0 + k.n >= {C.TARGET} THEN 0 ELSE held0 + k.n END, k.kind = 'table_row'
  FROM (SELECT g.*, k2.at_ AS next_at, CASE WHEN held > 0 AND (k2.kind = 'table_row') <> was_row THEN 0 ELSE held END AS held0 FROM g JOIN k k2 ON k2.page_id = g.page_id AND k2.at_ = g.at_ + 1) s
  JOIN k ON k.page_id = s.page_id AND k.at_ = s.next_at),
packed AS (SELECT k.page_id, book, page_number, chunk, CAST(count(*) AS INTEGER) AS units, list(kind ORDER BY g.at_) AS kinds, list(text ORDER BY g.at_) AS texts, string_agg(text, chr(10) || chr(10) ORDER BY g.at_) AS text
  FROM k JOIN g ON g.page_id = k.page_id AND g.at_ = k.at_ GROUP BY k.page_id, book, page_number, chunk),
typed AS (SELECT *, CASE WHEN starts_with(lower({compact("text")}), 'table ') OR len(list_filter(kinds, lambda x: x = 'table_row')) >= greatest(1, units // 2)
    OR (len(list_filter(texts, lambda x: {_LOOSE})) >= greatest(2, units // 2)) THEN 'table_text' WHEN kinds[1] = 'heading' THEN 'section_intro' ELSE 'paragraph' END AS chunk_type FROM packed)"""
CHUNK_PACKING = rf"""
WITH RECURSIVE {UNITS}, {_SECTIONED}, {_PACKED},
w AS (SELECT *, {words("text")} AS ws FROM typed),
c AS (SELECT *, unnest(range(CASE WHEN len(ws) <= {C.CAP} THEN 1 ELSE CAST(ceil((len(ws) - {C.CAP}) / {C.CAP - C.OVERLAP}) AS INTEGER) + 1 END)) AS part FROM w),
x AS (SELECT *, CASE WHEN len(ws) <= {C.CAP} THEN text ELSE array_to_string(ws[part * {C.CAP - C.OVERLAP} + 1 : part * {C.CAP - C.OVERLAP} + {C.CAP}], ' ') END AS t FROM c)
SELECT page_id, chunk, CAST(part AS INTEGER) AS part, chunk_type, units, CAST({count("t")} AS INTEGER) AS words, md5(t) AS digest FROM x"""


def chunk_stats(spark, sf_dir):
    """Chunks a page by book, with the warning that many of them give."""
    per = packed(spark, sf_dir).groupBy("book").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("page_id").alias("pages"), F.sum("units").alias("units"))
    ratio = F.round(F.col("chunks") / F.col("pages"), 6)
    return per.select("book", "chunks", "pages", "units", ratio.alias("per_page"), F.when(ratio >= 40, "critical").when(ratio >= 30, "high").otherwise("fine").alias("warning"))


CHUNK_STATS = f"""
WITH RECURSIVE {UNITS}, {_SECTIONED}, {_PACKED},
s AS (SELECT book, count(*) AS chunks, count(DISTINCT page_id) AS pages, CAST(sum(units) AS BIGINT) AS units FROM packed GROUP BY book)
SELECT *, round(chunks / pages, 6) AS per_page, CASE WHEN chunks / pages >= 40 THEN 'critical' WHEN chunks / pages >= 30 THEN 'high' ELSE 'fine' END AS warning FROM s"""


def bridge_chunks(spark, sf_dir):
    """Whole pages as chunks; the section is the last one of the page."""
    docs = book_pages(table(spark, sf_dir, "documents")).where("text IS NOT NULL")
    kind = F.when(F.col("page_id") % 11 == 0, "table_text").when(F.col("page_id") % 13 == 0, "section_intro").otherwise("paragraph")
    whole = docs.select("book", "page_number", "page_id", F.lit(1).alias("chunk"), kind.alias("chunk_type"), F.when(F.col("page_id") % 4 > 0, F.floor(F.col("page_id") / 400).cast("string")).alias("section"), F.trim("text").alias("text"))
    return C.bridges(whole)


BRIDGE_CHUNKS = rf"""
WITH d AS (SELECT source AS book, doc_id // 20 + 1 AS page_number, doc_id AS page_id, CASE WHEN doc_id % 11 = 0 THEN 'table_text' WHEN doc_id % 13 = 0 THEN 'section_intro' ELSE 'paragraph' END AS kind,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id // 400)::VARCHAR END AS section, trim(text) AS text FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, lead(page_number) OVER o AS np, lead(page_id) OVER o AS ni, lead(kind) OVER o AS nk, lead(section) OVER o AS ns, lead(text) OVER o AS nt FROM d WINDOW o AS (PARTITION BY book ORDER BY page_number, page_id))
SELECT book, page_id || ':1' AS first, ni || ':1' AS second, array_to_string(({words("text || ' ' || nt")})[1:300], ' ') AS text FROM n
WHERE np - page_number = 1 AND kind <> 'table_text' AND nk NOT IN ('table_text', 'section_intro') AND NOT coalesce(section <> ns, false) AND text <> '' AND nt <> '' AND NOT regexp_matches(text, '[.:?!]$')"""


def table_markdown(spark, sf_dir):
    """Documents with bars as tables: a line is a row, a row like the one before is left out."""
    u = _units(spark, sf_dir).withColumn("cells", C.cells(F.col("text"))).where("size(cells) > 0")
    before = F.lag("cells").over(L.page().orderBy("reading_order"))
    rows = u.withColumn("before", before).where("before IS NULL OR before <> cells")
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "cells"))).alias("r"), F.max(F.size("cells")).alias("columns")).where("columns > 1")
    return pages.select("page_id", "columns", F.size("r").alias("rows"), C.markdown(F.transform("r", lambda x: x["cells"])).alias("markdown"))


_CELLS = "list_filter(list_transform(string_split(text, '|'), lambda c: trim(c)), lambda c: c <> '')"
TABLE_MARKDOWN = rf"""
WITH {UNITS},
c AS (SELECT page_id, reading_order, {_CELLS} AS cells FROM units WHERE len({_CELLS}) > 0),
b AS (SELECT *, lag(cells) OVER (PARTITION BY page_id ORDER BY reading_order) AS before FROM c),
p AS (SELECT page_id, list(cells ORDER BY reading_order) AS r, CAST(max(len(cells)) AS INTEGER) AS columns FROM b WHERE before IS NULL OR before <> cells GROUP BY page_id HAVING max(len(cells)) > 1),
k AS (SELECT *, len(r[1]) = 1 AND starts_with(lower(r[1][1]), 'table') AS captioned FROM p),
d AS (SELECT *, CASE WHEN captioned THEN r[2:] ELSE r END AS body FROM k),
l AS (SELECT *, list_transform(body, lambda x: '| ' || array_to_string(x || list_transform(range(columns - len(x)), lambda i: ''), ' | ') || ' |') AS lines FROM d)
SELECT page_id, columns, CAST(len(r) AS INTEGER) AS rows, CASE WHEN captioned THEN r[1][1] || chr(10) ELSE '' END || array_to_string(lines[1:1] || ['| ' || array_to_string(list_transform(range(columns), lambda i: '---'), ' | ') || ' |'] || lines[2:], chr(10)) AS markdown FROM l"""

QUERIES = {f.__name__: f for f in (noise_lines, layout_type, section_path, kind_counts, block_kind, table_promotion, unit_duplicates, page_windows, html_blocks, chunk_packing, chunk_stats, bridge_chunks, table_markdown)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
