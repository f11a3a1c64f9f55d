"""Queries of page geometry, with two figures on every page: one by the page's id, one in the lower right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.operators import geometry as G
from folioq.plans._sql import UNITS, count, gone
from folioq.sources.corpus import book_pages, table, units


def _units(spark, sf_dir) -> DataFrame:
    return units(book_pages(table(spark, sf_dir, "documents")))


def figures(pages: DataFrame) -> DataFrame:
    """(page_id, figure, fx0, fy0, fx1, fy1)."""
    one = pages.select("page_id", F.lit(1).alias("figure"), F.lit(10.0).alias("fx0"), (F.col("page_id") % 9 * 24.0).alias("fy0"), F.lit(90.0).alias("fx1"), (F.col("page_id") % 9 * 24.0 + 40).alias("fy1"))
    two = pages.select("page_id", F.lit(2), F.lit(400.0), F.lit(700.0), F.lit(480.0), F.lit(760.0))
    return one.union(two)


def _figures(spark, sf_dir) -> DataFrame:
    return figures(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id")))


_FIGS = """
figs AS (SELECT doc_id AS page_id, 1 AS figure, 10.0::DOUBLE AS fx0, doc_id % 9 * 24.0::DOUBLE AS fy0, 90.0::DOUBLE AS fx1, doc_id % 9 * 24.0::DOUBLE + 40 AS fy1 FROM documents
  UNION ALL SELECT doc_id, 2, 400.0, 700.0, 480.0, 760.0 FROM documents),
met AS (SELECT f.*, reading_order, text, x0, y0, x1, y1 FROM figs f JOIN units u ON u.page_id = f.page_id)"""


def _moved(u: DataFrame) -> DataFrame:
    """Units as a recogniser would see them: shifted a few points down."""
    by = (F.col("page_id") % 13).cast("double")
    return u.withColumn("y0", F.col("y0") + by).withColumn("y1", F.col("y1") + by).withColumn("text", F.concat(F.lit("~"), "text"))


def bbox_match(spark, sf_dir):
    u = _units(spark, sf_dir)
    return G.match_boxes(u, _moved(u))


_SHARED = "CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) ELSE 0 END"
_CENTRE = "((b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1)"
_BACK = "((a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)"
_MATCH = f"""
moved AS (SELECT page_id, reading_order, '~' || text AS text, x0, y0 + page_id % 13 AS y0, x1, y1 + page_id % 13 AS y1 FROM units),
pairs AS (SELECT a.page_id, a.reading_order AS n_id, b.reading_order AS o_id, a.text AS n_text, b.text AS o_text, {_SHARED} / greatest(1, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))) AS overlap, {_CENTRE} OR {_BACK} AS centre
  FROM units a JOIN moved b ON a.page_id = b.page_id AND b.y0 < a.y1 + 1 AND b.y1 > a.y0 - 1)"""
BBOX_MATCH = f"WITH {UNITS}, {_MATCH} SELECT page_id, n_id, o_id, round(overlap, 6) AS overlap FROM pairs WHERE overlap >= 0.15 OR centre"


def unit_repair(spark, sf_dir):
    """Lines with a digit count as suspect and take the recognised text at their place."""
    u = _units(spark, sf_dir)
    return G.repair(u, _moved(u), F.col("text").rlike("[0-9]")).where("repaired").select("page_id", "reading_order", "text")


UNIT_REPAIR = f"""
WITH {UNITS}, {_MATCH},
s AS (SELECT *, length(text) >= 5 AND regexp_matches(text, '[0-9]') AS bad FROM units),
m AS (SELECT page_id FROM s GROUP BY page_id HAVING count(*) FILTER (WHERE length(text) >= 5) >= 2 AND count(*) FILTER (WHERE bad) > 0 AND count(*) FILTER (WHERE bad) < count(*) FILTER (WHERE length(text) >= 5)
  AND count(*) FILTER (WHERE bad) / count(*) FILTER (WHERE length(text) >= 5) < 0.75)
SELECT s.page_id, s.reading_order, string_agg(o_text, ' ' ORDER BY o_id) AS text FROM s JOIN pairs p ON p.page_id = s.page_id AND p.n_id = s.reading_order
WHERE bad AND s.page_id IN (SELECT page_id FROM m) AND (overlap >= 0.15 OR centre) GROUP BY s.page_id, s.reading_order"""


def text_overlap(spark, sf_dir):
    return G.text_overlap(_figures(spark, sf_dir), _units(spark, sf_dir))


TEXT_OVERLAP = f"""
WITH {UNITS}, {_FIGS}
SELECT page_id, figure, round(least(1.0::DOUBLE, sum(CASE WHEN least(x1, fx1) > greatest(x0, fx0) AND least(y1, fy1) > greatest(y0, fy0) THEN (least(x1, fx1) - greatest(x0, fx0)) * (least(y1, fy1) - greatest(y0, fy0)) ELSE 0 END
  / greatest(1, (fx1 - fx0) * (fy1 - fy0)))), 6) AS overlap FROM met GROUP BY page_id, figure"""


def nearest_heading(spark, sf_dir):
    u = _units(spark, sf_dir)
    return G.nearest_heading(_figures(spark, sf_dir), u.where(G.is_heading_like(F.col("text"))))


_BLEED = r"issn|www\.|journal|volume|issue"
_HEADS = rf"""
CASE WHEN text = '' OR regexp_matches(text, '^[(\[]?\d{{1,4}}[)\]]?$') OR regexp_matches(lower(text), '{_BLEED}') THEN false WHEN length(text) <= 90 AND regexp_matches(text, '\p{{Lu}}') AND upper(text) = text THEN true
  WHEN length(text) <= 120 AND ends_with(text, ':') THEN true ELSE {count("text")} <= 10 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '' AND regexp_matches(left(w, 1), '\p{{L}}') AND NOT regexp_matches(left(w, 1), '\p{{Lu}}'))) = 0 END"""
NEAREST_HEADING = f"""
WITH {UNITS}, {_FIGS},
h AS (SELECT *, y1 <= fy0 AS above, CASE WHEN y1 <= fy0 THEN fy0 - y1 ELSE abs((y0 + y1) / 2 - (fy0 + fy1) / 2) END AS apart FROM met WHERE {_HEADS})
SELECT page_id, figure, text AS heading FROM h QUALIFY row_number() OVER (PARTITION BY page_id, figure ORDER BY above DESC, apart, reading_order) = 1"""


def caption_score(spark, sf_dir):
    """The second figures sit 60 points above the end of a page of 70 lines; lines with a colon or a cue become captions."""
    cue = F.concat(F.element_at(F.array(F.lit("Figure 3 (a): "), F.lit("Table 2: "), F.lit("Note: ")), (F.col("page_id") % 3 + 1).cast("int")), F.col("text"))
    u = _units(spark, sf_dir)
    return G.captions(_figures(spark, sf_dir), u.withColumn("text", F.when(F.col("reading_order") % 4 == 1, cue).otherwise(F.col("text"))))


_CAP = r"^(figure|fig\.?|image|plate|photo|graph|chart|diagram|scheme|illustration|panel)([^\p{L}\p{N}_]|$)"
_LIKE = rf"(regexp_matches(lower(text), '{_CAP.replace('panel', 'panel|table')}') OR (contains(lower(text), ':') AND {count('text')} <= 18))"
CAPTION_SCORE = rf"""
WITH {UNITS}, {_FIGS},
c AS (SELECT * REPLACE (CASE WHEN reading_order % 4 = 1 THEN ['Figure 3 (a): ', 'Table 2: ', 'Note: '][page_id % 3 + 1] || text ELSE text END AS text) FROM met),
n AS (SELECT * FROM c WHERE y0 - fy1 BETWEEN -10 AND 180 AND greatest(0, least(x1, fx1) - greatest(x0, fx0)) / least(greatest(1, x1 - x0), greatest(1, fx1 - fx0)) >= 0.2),
s AS (SELECT *, round(CASE WHEN regexp_matches(lower(text), '{_CAP}') THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), '\([a-z]\)') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'table') THEN 4 ELSE 0 END
  + CASE WHEN contains(text, ':') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN length(text) BETWEEN 10 AND 260 THEN 1 ELSE 0 END - CASE WHEN {_HEADS} THEN 2 ELSE 0 END - CASE WHEN regexp_matches(lower(text), '{_BLEED}') THEN 4 ELSE 0 END
  - CASE WHEN NOT {_LIKE} THEN 1.5::DOUBLE ELSE 0 END - least(y0 - fy1, 120.0::DOUBLE) / 120, 6) AS caption_score FROM n),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, figure ORDER BY caption_score DESC, reading_order) = 1)
SELECT page_id, figure, text AS caption, caption_score FROM b WHERE caption_score >= 2 AND {_LIKE}"""


def surrounding_text(spark, sf_dir):
    return G.surrounding_text(_figures(spark, sf_dir), _units(spark, sf_dir))


_OVER = "(CASE WHEN least(x1, fx1) > greatest(x0, fx0) AND least(y1, fy1) > greatest(y0, fy0) THEN (least(x1, fx1) - greatest(x0, fx0)) * (least(y1, fy1) - greatest(y0, fy0)) ELSE 0 END / greatest(1, (x1 - x0) * (y1 - y0)))"
_AROUND = f"""
d AS (SELECT *, x0 < fx1 + 140 AND x1 > fx0 - 140 AND y0 < fy1 + 140 AND y1 > fy0 - 140 AS near, ((x0 + x1) / 2 - (fx0 + fx1) / 2) ** 2 + ((y0 + y1) / 2 - (fy0 + fy1) / 2) ** 2 AS dist, {_OVER} AS over_,
  {count("text")} AS n, {count("text")} >= 6 AND regexp_matches(text, '[.,;:]') AS prose FROM met),
e AS (SELECT *, bool_or(near) OVER (PARTITION BY page_id, figure) AS any_near, row_number() OVER (PARTITION BY page_id, figure ORDER BY dist, reading_order) AS nth FROM d),
p AS (SELECT *, prose AND over_ < 0.95 AS good, CASE WHEN over_ < 0.9 THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN prose THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN n >= 12 THEN 0.5::DOUBLE ELSE 0 END AS q FROM e WHERE near OR (NOT any_near AND nth <= 3)),
g AS (SELECT *, bool_or(good) OVER (PARTITION BY page_id, figure) AS any_good FROM p),
r AS (SELECT * FROM g WHERE good OR NOT any_good QUALIFY row_number() OVER (PARTITION BY page_id, figure ORDER BY q DESC, dist, reading_order) <= 6),
around AS (SELECT page_id, figure, trim(left(string_agg(text, ' ' ORDER BY y0, x0, reading_order), 720)) AS around FROM r GROUP BY page_id, figure)"""
SURROUNDING_TEXT = f"WITH {UNITS}, {_FIGS}, {_AROUND} SELECT * FROM around"


def figure_keep(spark, sf_dir):
    """Which figures are kept on pages of 500 x 800 points; every seventh page is a scan, every fifth figure has a caption."""
    f = _figures(spark, sf_dir)
    joined = f.join(surrounding_text(spark, sf_dir), ["page_id", "figure"], "left").join(text_overlap(spark, sf_dir), ["page_id", "figure"], "left")
    caption = F.when(F.col("page_id") % 5 == 0, F.when(F.col("page_id") % 2 == 0, "Table of values").otherwise("Figure 1: a plan"))
    scale = 1 + F.col("page_id") % 11
    box = joined.select("page_id", "figure", F.col("fx0").alias("x0"), F.col("fy0").alias("y0"), (F.col("fx0") + (F.col("fx1") - F.col("fx0")) * scale).alias("x1"), (F.col("fy0") + (F.col("fy1") - F.col("fy0")) * scale).alias("y1"), caption.alias("caption"), "around", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    table_like = G.table_like(F.col("caption"), F.col("around"))
    keep = G.keep_figure(F.lit(500.0), F.lit(800.0), F.col("caption"), F.col("around"), table_like, F.col("page_id") % 7 == 0, F.col("overlap"), F.length(F.coalesce("around", F.lit(""))) > 50)
    return box.select("page_id", "figure", table_like.alias("table_like"), keep.alias("keep"))


_DIG, _LET = gone("lower(coalesce(around, ''))", r"[^\p{Nd}]"), gone("lower(coalesce(around, ''))", r"[^\p{L}]")
FIGURE_KEEP = f"""
WITH {UNITS}, {_FIGS}, {_AROUND},
o AS ({TEXT_OVERLAP.split(_FIGS)[1].strip()}),
b AS (SELECT f.page_id, f.figure, fx0 AS x0, fy0 AS y0, fx0 + (fx1 - fx0) * (1 + f.page_id % 11) AS x1, fy0 + (fy1 - fy0) * (1 + f.page_id % 11) AS y1, around, coalesce(overlap, 0) AS overlap,
  CASE WHEN f.page_id % 5 = 0 THEN CASE WHEN f.page_id % 2 = 0 THEN 'Table of values' ELSE 'Figure 1: a plan' END END AS caption FROM figs f LEFT JOIN around a ON a.page_id = f.page_id AND a.figure = f.figure LEFT JOIN o ON o.page_id = f.page_id AND o.figure = f.figure),
t AS (SELECT *, (x1 - x0) * (y1 - y0) / 400000 AS ratio, page_id % 7 = 0 AS scanned, CASE WHEN caption LIKE 'Figure%' THEN false WHEN caption LIKE 'Table%' THEN true
  ELSE length({_DIG}) / greatest(length({_DIG}) + length({_LET}), 1) > 0.30 AND length(trim(coalesce(around, ''))) > 30 END AS table_like FROM b)
SELECT page_id, figure, table_like, CASE WHEN ratio >= 0.85 AND NOT scanned THEN false
  WHEN (y1 <= 128 OR y0 >= 688) AND (regexp_matches(lower(concat_ws(' ', coalesce(caption, ''), coalesce(around, ''))), '{_BLEED}') OR (ratio <= 0.03 AND x1 - x0 <= 140)) THEN false
  WHEN caption IS NULL AND NOT scanned AND ratio <= 0.012 AND least(x1 - x0, y1 - y0) < 72 THEN false WHEN table_like AND NOT scanned THEN false WHEN ratio >= 0.70 AND caption IS NULL AND NOT table_like THEN false
  WHEN table_like AND length(coalesce(around, '')) > 50 AND overlap >= 0.22 AND NOT scanned THEN false ELSE true END AS keep FROM t"""


def line_merge(spark, sf_dir):
    """Recognised lines, with a gap after every ninth."""
    u = _units(spark, sf_dir)
    down = F.floor(F.col("reading_order") / 9) * 30.0
    merged = G.merge_lines(u.withColumn("y0", F.col("y0") + down).withColumn("y1", F.col("y1") + down))
    return merged.select("page_id", "paragraph", "lines", F.md5(F.col("text").cast("binary")).alias("digest"), "x1", "y0", "y1")


LINE_MERGE = f"""
WITH RECURSIVE {UNITS},
d AS (SELECT page_id, reading_order, text, x0, x1, y0 + reading_order // 9 * 30 AS y0, y1 + reading_order // 9 * 30 AS y1, length(text) AS n, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS k FROM units),
l AS (SELECT *, lag(y1) OVER w AS py1, lag(y0) OVER w AS py0, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(text) OVER w AS ptext FROM d WINDOW w AS (PARTITION BY page_id ORDER BY k)),
k AS (SELECT *, coalesce((greatest(0, least(x1, px1) - greatest(x0, px0)) / greatest(1, least(x1 - x0, px1 - px0)) >= 0.25 OR abs(x0 - px0) <= 12)
  AND (y0 - py1 <= 8.5 OR (length(ptext) < 28 AND y0 - py1 <= 17) OR (length(text) < 14 AND y0 - py1 <= 8.5 * 1.25)), false) AS link FROM l),
m AS (SELECT page_id, k, 1 AS paragraph, 1 AS lines, n AS total FROM k WHERE k = 1
  UNION ALL SELECT k.page_id, k.k, CASE WHEN NOT link OR lines >= 6 OR total + n >= 420 THEN paragraph + 1 ELSE paragraph END, CASE WHEN NOT link OR lines >= 6 OR total + n >= 420 THEN 1 ELSE lines + 1 END,
    CASE WHEN NOT link OR lines >= 6 OR total + n >= 420 THEN n ELSE total + n END FROM m JOIN k ON k.page_id = m.page_id AND k.k = m.k + 1)
SELECT k.page_id, paragraph, CAST(count(*) AS INTEGER) AS lines, md5(string_agg(text, chr(10) ORDER BY k.k)) AS digest, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM k JOIN m ON m.page_id = k.page_id AND m.k = k.k GROUP BY k.page_id, paragraph"""

QUERIES = {f.__name__: f for f in (bbox_match, unit_repair, text_overlap, nearest_heading, caption_score, surrounding_text, figure_keep, line_merge)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
