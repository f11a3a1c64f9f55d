"""Queries of recognition results, parses, repair, figure boxes and small checks. Words of `documents` stand in for recognised ones;
boxes follow from their place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import geometry as G
from folioq.operators import ingest as I
from folioq.operators import reading as R
from folioq.operators import retrieval as V
from folioq.operators import seams
from folioq.operators import store as S
from folioq.plans import retrieval as P
from folioq.plans._sql import SAMPLES, TEXTS, UNITS, compact, count, frame, values, words
from folioq.plans.pages import _units
from folioq.sources import corpus as C
from folioq.sources.corpus import table, vectors
from folioq.streaming.ingest import event_counts

TOKENS = [(-1, "doṣa"), (-2, "Ã¤x"), (-3, "x!"), (-4, "--"), (-5, None), (-6, "a1"), (-7, "à¤®a"), (-8, "à³ok"), (-9, "दोष"), (-10, "¶"), (-11, "12"), (-12, "x"), (-13, "")]
CELLS = [(-1, " nan "), (-2, "a |b|  c"), (-3, None), (-4, "NaN"), (-5, "  two   words "), (-6, "|")]
NAMES = [
    (-1, "Doc One", "books/Some File.v2.pdf", 3, 2, "A/ b?/"), (-2, None, "books/Some File.v2.pdf", 0, None, " .hidden. "), (-3, "  ", ".pdf", -4, 0, "///"), (-4, "éé", "", 1, 1, 'x<y>:"z'), (-5, None, None, None, None, None),
]
FILTERS = [(-1, " a ,b,, a ,c", " 12 "), (-2, "", "x"), (-3, None, None), (-4, "one", "-3"), (-5, " , ", "3.5")]
BLOCKS = [
    (1, 0, "has a box", 10.0, 10.0, 100.0, 40.0, 200.0, 300.0), (1, 1, "no box", None, None, None, None, 200.0, 300.0), (1, 2, "  ", 1.0, 1.0, 9.0, 9.0, 200.0, 300.0), (1, 3, "too thin", 10.0, 10.0, 10.5, 40.0, 200.0, 300.0),
    (1, 4, "over the edge", 150.0, 290.0, 400.0, 500.0, 200.0, 300.0), (2, 0, "alone", None, 1.0, 2.0, 3.0, 100.0, 10.0), (2, 1, "outside", 300.0, 300.0, 400.0, 400.0, 100.0, 10.0), (3, 0, None, 0.0, 0.0, 9.0, 9.0, 50.0, 50.0),
]


def ocr_words(spark, sf_dir):
    """Nested results made of the documents' lines and words, taken apart again and joined to paragraphs."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    symbol = lambda c, i: F.struct(c.alias("text"), (F.length(c) * 0.5 + (i % 4) / 8).alias("confidence"))
    word = lambda w, i: F.struct(F.transform(F.split(w, ""), symbol).alias("symbols"), F.when(i % 3 == 0, (F.length(w) % 5) / 4).alias("confidence"))
    line = lambda x: F.struct(F.transform(T.word_list(x), word).alias("words"))
    blocks = F.transform(F.split("text", "\n"), lambda x: F.struct(F.array(line(x)).alias("paragraphs")))
    found = R.read_paragraphs(docs.select(F.col("doc_id").alias("page_id"), blocks.alias("blocks")))
    return found.select("page_id", "block", "paragraph", F.md5(F.col("text").cast("binary")).alias("digest"), F.round("confidence", 6).alias("confidence"), F.round("best", 6).alias("best"), "words")


OCR_WORDS = rf"""
WITH l AS (SELECT doc_id AS page_id, unnest(range(len(string_split(text, chr(10))))) AS block, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
w AS (SELECT page_id, block, unnest(range(len({words("line")}))) AS i, unnest({words("line")}) AS w FROM l),
c AS (SELECT *, CASE WHEN i % 3 = 0 THEN (length(w) % 5) / 4 ELSE list_sum(list_transform(range(length(w)), lambda k: 0.5::DOUBLE + (k % 4) / 8)) / length(w) END AS c FROM w)
SELECT page_id, CAST(block AS INTEGER) AS block, 0 AS paragraph, md5(string_agg(w, ' ' ORDER BY i)) AS digest, round(avg(c), 6) AS confidence, round(max(c), 6) AS best, count(*) AS words FROM c GROUP BY page_id, block"""


def ocr_lines(spark, sf_dir):
    """Words of every page in lines (no SQL: the fold's means move). Boxes: seven words a line, with jitter."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.posexplode(T.word_list(F.col("text"))).alias("id", "w"))
    y = F.floor(F.col("id") / 7) * 14.0 + F.pmod(F.col("id") * 5, F.lit(7)) * 0.9
    return R.word_lines(w.select("page_id", F.col("id").cast("long").alias("id"), ((F.col("id") % 7) * 40.0).alias("x0"), y.alias("y0"), ((F.col("id") % 7) * 40.0 + 30).alias("x1"), (y + 8 + F.length("w") % 5).alias("y1")))


def parse_choice(spark, sf_dir):
    """Two parses of every page; the structured one lacks every third page, and has only blanks for every fifth."""
    native = _units(spark, sf_dir).select("page_id", "reading_order", "text")
    structured = native.where("page_id % 3 > 0").withColumn("text", F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit("S: "), "text")))
    return R.either_parse(structured, native)


PARSE_CHOICE = f"""WITH {UNITS}
SELECT page_id, reading_order, CASE WHEN page_id % 3 > 0 AND page_id % 5 > 0 THEN 'S: ' || text ELSE text END AS text, CASE WHEN page_id % 3 > 0 AND page_id % 5 > 0 THEN 'structured' ELSE 'native' END AS parser FROM units"""


def unit_repair_order(spark, sf_dir):
    """Suspect units (every fourth line) of three kinds of pages: those a font map decodes, those with matching recognised units,
    and those with the page's recognised text only."""
    u = _units(spark, sf_dir).select("page_id", "reading_order", F.lit("paragraph").alias("kind"), "text", (F.col("reading_order") % 4 == 1).alias("suspect"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 == 2, F.replace("text", F.lit("e"), F.lit("E"))).alias("ocr_text"))
    m = u.where("suspect AND page_id % 3 = 1 AND reading_order % 8 = 1").select("page_id", "reading_order", F.explode(F.array(F.lit(2), F.lit(1))).alias("o_id"))
    m = m.select("page_id", "reading_order", "o_id", F.concat(F.lit("read "), F.col("o_id").cast("string")).alias("o_text"), (F.col("o_id") / 4).alias("confidence"), F.lit("vision").alias("engine"))
    decoded = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("decoded "), F.col("text")))
    r = R.repaired(u, m, docs, decoded)
    return r.select("page_id", "reading_order", F.md5(F.col("text").cast("binary")).alias("digest"), "engine", "confidence", "script")


_LINES = f"list_filter(list_transform(string_split(replace(d.text, 'e', 'E'), chr(10)), lambda x: {compact('x')}), lambda x: x <> '')"
UNIT_REPAIR_ORDER = rf"""WITH {UNITS},
u AS (SELECT page_id, reading_order, text, reading_order % 4 = 1 AS suspect FROM units),
t AS (SELECT *, 'decoded ' || text AS d, suspect AND page_id % 3 = 0 AND NOT (length(trim('decoded ' || text)) >= 5 AND (length(regexp_replace(trim('decoded ' || text), '[\p{{L}}\p{{N}}\p{{M}}\s|.,;:!?()\[\]{{}}''"/।॥-]', '', 'g')) / length(trim('decoded ' || text)) > 0.30 OR (regexp_matches(text, 'Ãƒ|Ã‚|ï¿½|�') AND NOT regexp_matches(text, '[ऀ-ॿ؀-ۿఀ-౿]')))) AS fonts FROM u),
s AS (SELECT *, suspect AND NOT fonts AS left_, row_number() OVER (PARTITION BY page_id, suspect AND NOT fonts ORDER BY reading_order) - 1 AS slot, count(*) FILTER (WHERE suspect AND NOT fonts) OVER (PARTITION BY page_id) AS slots FROM t),
x AS (SELECT s.*, left_ AND page_id % 3 = 1 AND reading_order % 8 = 1 AS m, CASE WHEN page_id % 3 = 2 THEN {_LINES} ELSE [] END AS ls FROM s JOIN documents d ON d.doc_id = page_id),
y AS (SELECT *, CASE WHEN left_ AND len(ls) > 0 THEN nullif(array_to_string(ls[slot * (len(ls) // slots) + least(slot, len(ls) % slots) + 1 : (slot + 1) * (len(ls) // slots) + least(slot + 1, len(ls) % slots)], ' '), '') END AS share FROM x)
SELECT page_id, reading_order, md5(CASE WHEN fonts THEN {compact("d")} WHEN m THEN 'read 1 read 2' ELSE coalesce(share, text) END) AS digest, CASE WHEN fonts THEN 'legacy_font_map' WHEN m THEN 'vision' WHEN share IS NOT NULL THEN 'vision' ELSE 'native' END AS engine,
  CASE WHEN m THEN 0.5::DOUBLE END AS confidence, 'latin' AS script FROM y"""

_RECT = "page_id BIGINT, reading_order INTEGER, text VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, width DOUBLE, height DOUBLE"


def _boxed(spark, sf_dir) -> DataFrame:
    u = _units(spark, sf_dir).select((F.col("page_id") + 100).alias("page_id"), "reading_order", "text", "x0", "y0", F.when(F.col("reading_order") % 2 == 0, F.col("x1")).alias("x1"), "y1", F.lit(100.0).alias("width"), F.lit(200.0).alias("height"))
    return frame(spark, BLOCKS, _RECT).union(u)


def figure_blocks(spark, sf_dir):
    return R.block_rects(_boxed(spark, sf_dir))


_BOXED = f"boxed AS (SELECT * FROM {values(BLOCKS, _RECT)} UNION ALL SELECT page_id + 100, reading_order, text, x0, y0, CASE WHEN reading_order % 2 = 0 THEN x1 END, y1, 100.0, 200.0 FROM units)"
FIGURE_BLOCKS = f"""WITH {UNITS}, {_BOXED},
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) - 1 AS i, greatest(18.0, greatest(1.0, height) / count(*) OVER (PARTITION BY page_id)) AS band,
  coalesce(x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL AND least(x1, width) - greatest(x0, 0.0) > 1 AND least(y1, height) - greatest(y0, 0.0) > 1, false) AS own FROM boxed WHERE trim(text) <> '')
SELECT page_id, reading_order, CASE WHEN own THEN greatest(x0, 0.0) ELSE 0.0 END AS x0, CASE WHEN own THEN greatest(y0, 0.0) ELSE least(height - 1, i * band) END AS y0, CASE WHEN own THEN least(x1, width) ELSE width END AS x1,
  CASE WHEN own THEN least(y1, height) ELSE least(height, greatest(least(height - 1, i * band) + 18.0, least(height - 1, i * band) + band)) END AS y1, own FROM b"""


def page_texts(spark, sf_dir):
    t = R.page_text(_boxed(spark, sf_dir))
    return t.select("page_id", F.md5(F.col("text").cast("binary")).alias("digest"))


PAGE_TEXTS = f"""WITH {UNITS}, {_BOXED}
SELECT page_id, md5(coalesce(string_agg({compact("text")}, ' ' ORDER BY y0 NULLS FIRST, x0 NULLS FIRST, reading_order) FILTER (WHERE {compact("coalesce(text, '')")} <> ''), '')) AS digest FROM boxed GROUP BY page_id"""


def _regions(spark, sf_dir) -> DataFrame:
    r = F.col("reading_order")
    return _units(spark, sf_dir).select("page_id", r.cast("long").alias("id"), (F.col("x1") % 90 + 5).alias("w"), (r * 7 % 150 + 2.0).alias("h"), F.lit(100.0).alias("width"), F.lit(200.0).alias("height"), (r % 8 / 10).alias("overlap"), (r % 5 / 100).alias("edges"))


def contour_filter(spark, sf_dir):
    return R.contours(_regions(spark, sf_dir))


CONTOUR_FILTER = f"""WITH {UNITS}, r AS (SELECT page_id, CAST(reading_order AS BIGINT) AS id, x1 % 90 + 5 AS w, reading_order * 7 % 150 + 2.0::DOUBLE AS h, (reading_order % 8)::DOUBLE / 10 AS o, (reading_order % 5)::DOUBLE / 100 AS e FROM units)
SELECT page_id, id, round(e + (0.5 - o), 6) AS score FROM r WHERE w * h / 20000 >= 0.015::DOUBLE AND w * h / 20000 < 0.70::DOUBLE AND w / 100 >= 0.10::DOUBLE AND h / 200 >= 0.08::DOUBLE AND o <= 0.60::DOUBLE AND NOT (e < 0.012::DOUBLE AND o > 0.30::DOUBLE)"""


def figure_unions(spark, sf_dir):
    """Boxes around the placements of each page and third, thin ones left out before and after, with the largest's share of the page."""
    p = R.placements(_units(spark, sf_dir).withColumn("y1", F.when(F.col("reading_order") % 4 == 0, F.col("y0") + 2).otherwise(F.col("y1"))).withColumn("part", (F.col("reading_order") % 3).cast("int")))
    u = R.union_boxes(p, ["page_id", "part"])
    ratio = R.image_ratio(u.withColumn("width", F.lit(200.0)).withColumn("height", F.lit(150.0)))
    return u.join(ratio, "page_id")


FIGURE_UNIONS = f"""WITH {UNITS}, p AS (SELECT page_id, reading_order % 3 AS part, x0, y0, x1, CASE WHEN reading_order % 4 = 0 THEN y0 + 2 ELSE y1 END AS y1 FROM units),
u AS (SELECT page_id, CAST(part AS INTEGER) AS part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM p WHERE x1 - x0 > 2 AND y1 - y0 > 2 GROUP BY page_id, part HAVING max(x1) - min(x0) > 2 AND max(y1) - min(y0) > 2)
SELECT u.*, ratio, ratio >= 0.75 AS heavy FROM u JOIN (SELECT page_id, round(least(1.0, max((x1 - x0) * (y1 - y0) / 30000)), 6) AS ratio FROM u GROUP BY page_id) r USING (page_id)"""


def text_checks(spark, sf_dir):
    """Page tests on every text, with a kind and an image by its number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").union(frame(spark, SAMPLES, "doc_id BIGINT, text VARCHAR"))
    kind, heavy = F.when(F.col("doc_id") % 9 == 0, "blank").otherwise("digitized"), F.col("doc_id") % 5 == 0
    return d.select("doc_id", T.too_little_text(F.col("text")).alias("too_little"), T.is_blank_like(F.col("text"), kind, heavy).alias("blank_like"), F.md5(T.clean_structured(F.col("text")).cast("binary")).alias("structured"))


_FLAT = compact("coalesce(text, '')")
TEXT_CHECKS = rf"""
SELECT doc_id, length(trim(coalesce(text, ''))) < 40 OR length(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]', '', 'g')) < 20 AS too_little,
  CASE WHEN doc_id % 9 = 0 THEN true WHEN doc_id % 5 = 0 THEN false ELSE {_FLAT} = '' OR (length({_FLAT}) <= 24 AND NOT regexp_matches({_FLAT}, '\p{{L}}')) OR (length({_FLAT}) <= 8 AND {count(_FLAT)} <= 2) END AS blank_like,
  md5({compact(rf"regexp_replace({_FLAT}, '\s*\|\s*', ' | ', 'g')")}) AS structured FROM {TEXTS}"""


def token_checks(spark, sf_dir):
    w = frame(spark, TOKENS, "id BIGINT, token VARCHAR")
    return w.select("id", T.is_meaningful(F.col("token")).alias("meaningful"), F.coalesce(T.is_weird_symbol(F.left("token", F.lit(1))), F.lit(False)).alias("weird"), T.has_indic(F.col("token")).alias("indic"))


TOKEN_CHECKS = rf"""
WITH t AS (SELECT id, token, regexp_replace(coalesce(token, ''), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') AS c FROM {values(TOKENS, "id BIGINT, token VARCHAR")})
SELECT id, length(c) >= 2 AND regexp_matches(c, '\p{{L}}') AND NOT regexp_matches(c, 'Ã.|Â.|ï.|à¤|à¥|à¦|à¨|àª|à³') AS meaningful,
  coalesce(token <> '' AND NOT regexp_matches(left(token, 1), '^[\p{{L}}\p{{N}}\p{{M}}\s.,:;!?()\[\]{{}}''"/\-_%+&*#°₹$=|।॥]$'), false) AS weird, regexp_matches(coalesce(token, ''), '[{T.INDIC}]') AS indic FROM t"""


def cell_cleaner(spark, sf_dir):
    return frame(spark, CELLS, "id BIGINT, cell VARCHAR").select("id", T.clean_cell(F.col("cell")).alias("cell"), T.clean_structured(F.col("cell")).alias("structured"))


CELL_CLEANER = rf"""
SELECT id, CASE WHEN lower(trim(coalesce(cell, ''))) = 'nan' THEN '' ELSE {compact("coalesce(cell, '')")} END AS cell, {compact(rf"regexp_replace({compact('coalesce(cell, chr(32))')}, '\s*\|\s*', ' | ', 'g')")} AS structured FROM {values(CELLS, "id BIGINT, cell VARCHAR")}"""


def public_names(spark, sf_dir):
    n = frame(spark, NAMES, "id BIGINT, doc VARCHAR, source VARCHAR, page INTEGER, figure INTEGER, raw VARCHAR")
    return n.select("id", T.public_id(F.lit("root"), F.col("doc"), F.col("source"), F.col("page"), F.col("figure")).alias("public_id"), T.folder(F.col("raw"), "images").alias("folder"), T.safe_path(F.col("raw")).alias("path"))


def _slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_STEM = "regexp_replace(regexp_extract(coalesce(source, ''), '[^/]*$'), '(.)\\.[^.]*$', '\\1')"
PUBLIC_NAMES = rf"""
WITH n AS (SELECT * FROM {values(NAMES, "id BIGINT, doc VARCHAR, source VARCHAR, page INTEGER, figure INTEGER, raw VARCHAR")}),
c AS (SELECT *, regexp_replace(trim(regexp_replace(coalesce(raw, ''), '[<>:"/\\|?*]+', '_', 'g')), '^[ .]+|[ .]+$', '', 'g') AS p FROM n)
SELECT id, 'root/' || coalesce(nullif({_slug("coalesce(doc, '')")}, ''), nullif({_slug(_STEM)}, ''), 'unknown_source') || '/page_' || greatest(1, coalesce(page, 1)) || '/figure_' || greatest(1, coalesce(figure, 1)) AS public_id,
  coalesce(nullif(array_to_string(list_filter(list_transform(string_split(coalesce(raw, ''), '/'), lambda x: {_slug("x")}), lambda x: x <> ''), '/'), ''), 'images') AS folder, CASE WHEN p = '' THEN 'untitled' ELSE p END AS path FROM c"""


def filter_values(spark, sf_dir):
    f = frame(spark, FILTERS, "id BIGINT, listed VARCHAR, number VARCHAR")
    return f.select("id", F.array_join(T.cleaned_list(F.split("listed", ",")), "|").alias("listed"), T.cleaned_int(F.col("number")).alias("number"))


FILTER_VALUES = f"""
WITH f AS (SELECT *, list_filter(list_transform(string_split(coalesce(listed, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM {values(FILTERS, "id BIGINT, listed VARCHAR, number VARCHAR")})
SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS listed, CASE WHEN regexp_matches(trim(number), '^[+-]?[0-9]+$') THEN CAST(trim(number) AS INTEGER) END AS number FROM f"""


def collection_info(spark, sf_dir):
    return S.info(table(spark, sf_dir, "documents"), "doc_id")


COLLECTION_INFO = "SELECT count(*) AS points, count(DISTINCT doc_id) AS keys, count(*) FILTER (WHERE doc_id IS NULL) AS without_key FROM documents"


def point_rows(spark, sf_dir):
    """Points as a search returns them; every third has no score."""
    v = vectors(table(spark, sf_dir, "embeddings")).withColumn("found", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") / 4))
    e = S.envelope(v, "vec_id", "found", "vec")
    return e.select("_id", "_score", F.size("_dense_vector").alias("width"), "label")


POINT_ROWS = "SELECT vec_id::VARCHAR AS _id, CASE WHEN vec_id % 3 > 0 THEN vec_id / 4 ELSE 0 END AS _score, CAST(len(embedding) AS INTEGER) AS width, label FROM embeddings"


def state_round_trip(spark, sf_dir):
    """Run states written as JSON and read again; every tenth text is broken."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), (F.col("event_id") % 7).alias("page"), F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 11 == 0, "complete").otherwise("done").alias("status"))
    written = S.to_json(S.run_state(e)).withColumn("state", F.when(F.col("doc") % 10 == 0, F.lit("{broken")).otherwise(F.col("state")))
    return S.from_json(written)


STATE_ROUND_TRIP = """
WITH e AS (SELECT user_id AS doc, event_id AS seq, event_id % 7 AS page, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 11 = 0 THEN 'complete' ELSE 'done' END AS status FROM events),
p AS (SELECT doc, page, max_by(status, seq) AS status FROM e WHERE status <> 'complete' GROUP BY doc, page),
n AS (SELECT doc, count(*) FILTER (WHERE status = 'done') AS c, count(*) FILTER (WHERE status = 'failed') AS f FROM p GROUP BY doc),
l AS (SELECT doc, max(seq) FILTER (WHERE status = 'complete') AS done, max(seq) FILTER (WHERE status = 'failed') AS failed FROM e GROUP BY doc)
SELECT doc, CASE WHEN doc % 10 = 0 THEN 0 ELSE coalesce(c, 0) END AS completed, CASE WHEN doc % 10 = 0 THEN 0 ELSE coalesce(f, 0) END AS failed, doc % 10 <> 0 AND done IS NOT NULL AND done > coalesce(failed, -1) AS document_complete FROM l LEFT JOIN n USING (doc)"""

HTML = [
    (-1, "<p>x</p><table class='a'><caption>Table 1 <b>Doses</b></caption><tr><td>Table 1 Doses</td></tr><TR><th>name</th><th> dose </th></TR><tr><td>ghee\n</td><td>2 <i>ml</i></td></tr><tr></tr></table>"), (-2, "<table><tr><td>only</td></tr></table><table><tr><td>a</td><td></td></tr></table>"),
    (-3, "no table"), (-4, None),
]


def html_tables(spark, sf_dir):
    """Cells of every table, those of the pages and of fixtures."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html").union(frame(spark, HTML, "page_id BIGINT, html VARCHAR"))
    t = C.html_tables(pages)
    return t.select("page_id", "table_id", "row", "caption", "header", F.array_join("cells", "|").alias("cells"))


_PLAIN = r"trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
HTML_TABLES = rf"""
WITH p AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM {values(HTML, "page_id BIGINT, html VARCHAR")}),
t AS (SELECT page_id, unnest(x) AS body, unnest(range(len(x))) AS tab FROM (SELECT page_id, regexp_extract_all(html, '(?is)<table\b[^>]*>(.*?)</table>', 1) AS x FROM p)),
r AS (SELECT page_id, tab, {_PLAIN.format(r"regexp_extract(body, '(?is)<caption\b[^>]*>(.*?)</caption>', 1)")} AS caption, unnest(y) AS tr, unnest(range(len(y))) AS row_ FROM (SELECT *, regexp_extract_all(body, '(?is)<tr\b[^>]*>(.*?)</tr>', 1) AS y FROM t)),
c AS (SELECT *, list_transform(regexp_extract_all(tr, '(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>', 1), lambda x: {_PLAIN.format("x")}) AS cells FROM r)
SELECT page_id, 'p' || page_id || ':table:' || tab AS table_id, CAST(row_ AS INTEGER) AS "row", caption, regexp_matches(tr, '(?i)<th\b') AS header, array_to_string(cells, '|') AS cells FROM c
WHERE len(cells) > 0 AND NOT (len(cells) = 1 AND cells[1] = caption)"""


def text_vectors(spark, sf_dir):
    """Questions embedded by the stand-in, each distinct one once; three of the components, rounded as DuckDB does: the product
    with a million, halves up."""
    asked = C.questions(table(spark, sf_dir, "conversations")).withColumnRenamed("query", "text")
    v = I.embed_once(asked, lambda distinct: seams.embedded(distinct, seams.letter_embedder))
    return v.select("query_id", *((F.round(F.element_at("vec", k + 1) * 1e6) / 1e6).alias(f"c{k}") for k in (0, 4, 25)))


_Q = compact("text")
TEXT_VECTORS = "SELECT conv_id * 1000 + turn AS query_id, " + ", ".join(f"round((length({_Q}) - length(replace(lower({_Q}), '{c}', '')))::DOUBLE / length({_Q}), 6) AS c{k}" for k, c in ((0, "a"), (4, "e"), (25, "z"))) + f" FROM conversations WHERE role = 'user' AND {_Q} <> ''"


def pair_cosine(spark, sf_dir):
    """Cosine of each vector and the next one; every seventh pair has no second vector, every eleventh one of another length."""
    v = vectors(table(spark, sf_dir, "embeddings"))
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b"))
    b = F.when(F.col("vec_id") % 7 == 0, None).when(F.col("vec_id") % 11 == 0, F.slice("b", 1, 5)).otherwise(F.col("b"))
    return v.join(other, "vec_id").select("vec_id", F.round(V.cosine(F.col("vec"), b), 6).alias("cosine"))


PAIR_COSINE = """
SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 OR a.vec_id % 11 = 0 THEN 0 ELSE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) END AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def filter_image_pages(spark, sf_dir):
    """Figures on pages 3 to 9."""
    i = P.images(spark, sf_dir).withColumnRenamed("page", "page_number")
    return i.where(V.payload_filter(within=(3, 9))).select("image_id", "page_number")


FILTER_IMAGE_PAGES = "SELECT 'v' || vec_id AS image_id, vec_id // 20 + 1 AS page_number FROM embeddings WHERE vec_id // 20 + 1 BETWEEN 3 AND 9"

FONT = {"er": "<ER>", "e": "[E]", "the": "THE", "": "never"}


def font_map(spark, sf_dir):
    """Every text with a legacy font's letters replaced, longest first."""
    d = table(spark, sf_dir, "documents").where("lang = 'en'")
    return d.select("doc_id", F.md5(G.apply_font_map(F.col("text"), FONT).cast("binary")).alias("digest"))


FONT_MAP = f"SELECT doc_id, md5({compact(P._norm("replace(replace(replace(text, 'the', 'THE'), 'er', '<ER>'), 'e', '[E]')"))}) AS digest FROM documents WHERE lang = 'en'"


def event_windows(spark, sf_dir):
    """Windows of five minutes by type of event, as the stream counts them."""
    n = event_counts(table(spark, sf_dir, "events"))
    return n.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.max("n").alias("most"), F.sum("n").alias("total"))


EVENT_WINDOWS = """
WITH w AS (SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS b, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, count(*) AS windows, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM w GROUP BY event_type"""

QUERIES = {
    f.__name__: f for f in (
        ocr_words, ocr_lines, parse_choice, unit_repair_order, figure_blocks, page_texts, contour_filter, figure_unions, text_checks, token_checks, cell_cleaner, public_names, filter_values, collection_info, point_rows, state_round_trip, html_tables, text_vectors, pair_cosine, filter_image_pages, font_map, event_windows,
    )
}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
