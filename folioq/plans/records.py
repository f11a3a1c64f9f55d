"""Queries of chunk records, bridges, figures on pages and their captions. Units are the lines of `documents` with the kinds that
sections give; some are made captions, verses, noise or labels by their number, so that every branch is taken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.operators import chunking as C
from folioq.operators import layout as L
from folioq.operators import records as R
from folioq.plans import retrieval as P
from folioq.plans._sql import UNITS, compact, count, frame, values, words
from folioq.plans.pages import _LOOSE, _N, _SECTIONED, _units
from folioq.sources.corpus import book_pages, table, vectors

CAPTIONS = [
    (-1, "Text before. Figure 1 (a): A pestle and mortar; Figure 1 (b): The same from above . figure 2 (c) : short"), (-2, "no caption at all"), (-3, "Figure 3 (a): only one caption that is long enough"),
    (-4, None), (-5, "FIGURE 12 (B):   spaced    out caption,  Figure 13 (c): second of two captions."),
]


def marked(spark, sf_dir) -> DataFrame:
    """Sectioned units with all that a chunk record draws on."""
    u = L.sections(_units(spark, sf_dir)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("_lang")), "page_id")
    r = F.col("reading_order")
    kind = F.when(r % 11 == 5, "caption").when(r % 13 == 3, "noise").when(r % 17 == 4, "label").when(r % 19 == 6, "shloka").otherwise(F.col("kind"))
    return u.withColumns({
        "kind": kind, "unit_id": F.concat(F.lit("u"), F.col("page_id").cast("string"), F.lit("-"), r.cast("string")), "languages": F.when(r % 5 == 0, F.array("_lang", F.lit("la"))).when(r % 7 == 2, None).otherwise(F.array("_lang")),
        "scripts": F.array(F.lit("Latn")), "engine": F.when(r % 23 == 9, " Vision ").otherwise("native"), "route": F.when(F.col("page_id") % 7 == 0, "ocr").otherwise("digitized"),
    })


_MARKED = f"""
marked AS (SELECT s.*  EXCLUDE (kind), CASE WHEN reading_order % 11 = 5 THEN 'caption' WHEN reading_order % 13 = 3 THEN 'noise' WHEN reading_order % 17 = 4 THEN 'label' WHEN reading_order % 19 = 6 THEN 'shloka' ELSE kind END AS kind,
  'u' || page_id || '-' || reading_order AS unit_id, CASE WHEN reading_order % 5 = 0 THEN [lang, 'la'] WHEN reading_order % 7 = 2 THEN NULL ELSE [lang] END AS languages, reading_order % 23 = 9 AS seen, page_id % 7 = 0 AS ocr
  FROM sectioned s JOIN documents ON doc_id = page_id),
k AS (SELECT *, {_N} AS n, row_number() OVER (PARTITION BY page_id ORDER BY reading_order) AS at_ FROM marked WHERE kind NOT IN ('noise', 'label')),
g AS (SELECT page_id, at_, 1 AS chunk, CASE WHEN kind IN ('caption', 'shloka') THEN 0 WHEN n <= {C.CAP} AND n >= {C.TARGET} THEN 0 ELSE n END AS held, kind = 'table_row' AS was_row FROM k WHERE at_ = 1
  UNION ALL SELECT k.page_id, k.at_, CASE WHEN k.kind IN ('caption', 'shloka') OR held0 = 0 OR held0 + k.n > {C.CAP} THEN chunk + 1 ELSE chunk END,
    CASE WHEN k.kind IN ('caption', 'shloka') THEN 0 WHEN held0 + k.n > {C.CAP} THEN k.n WHEN held0 + k.n >= {C.TARGET} THEN 0 ELSE held0 + k.n END, CASE WHEN k.kind IN ('caption', 'shloka') THEN was_row ELSE k.kind = 'table_row' END
  FROM (SELECT g.*, k2.at_ AS next_at, CASE WHEN held > 0 AND (k2.kind = 'table_row') <> was_row THEN 0 ELSE held END AS held0 FROM g JOIN k k2 ON k2.page_id = g.page_id AND k2.at_ = g.at_ + 1) s
  JOIN k ON k.page_id = s.page_id AND k.at_ = s.next_at),
packed AS (SELECT k.page_id, book, page_number, chunk, CAST(count(*) AS INTEGER) AS units, list(kind ORDER BY g.at_) AS kinds, list(text ORDER BY g.at_) AS texts, string_agg(text, chr(10) || chr(10) ORDER BY g.at_) AS text,
    list(section ORDER BY g.at_)[-1] AS section, string_agg(unit_id, ',' ORDER BY g.at_) AS unit_ids, bool_or(ocr) OR bool_or(seen) AS ocr, bool_or(reading_order % 5 = 0) AS la, bool_or(reading_order % 5 = 0 OR reading_order % 7 <> 2) AS known_, max(lang) AS lang
  FROM k JOIN g ON g.page_id = k.page_id AND g.at_ = k.at_ JOIN (SELECT doc_id, lang FROM documents) d ON d.doc_id = k.page_id GROUP BY k.page_id, book, page_number, chunk),
typed AS (SELECT *, CASE WHEN kinds[1] = 'caption' THEN 'image_caption' WHEN kinds[1] = 'shloka' THEN 'shloka' WHEN starts_with(lower({compact("text")}), 'table ') OR len(list_filter(kinds, lambda x: x = 'table_row')) >= greatest(1, units // 2)
    OR (len(list_filter(texts, lambda x: {_LOOSE})) >= greatest(2, units // 2)) THEN 'table_text' WHEN kinds[1] = 'heading' THEN 'section_intro' ELSE 'paragraph' END AS chunk_type, {words("text")} AS ws FROM packed),
windows_ AS (SELECT *, unnest(range(CASE WHEN len(ws) <= {C.CAP} THEN 1 ELSE CAST(ceil((len(ws) - {C.CAP}) / {C.CAP - C.OVERLAP}) AS INTEGER) + 1 END)) AS part FROM typed),
records AS (SELECT book, page_number, page_id, chunk_type, section, unit_ids, CASE WHEN NOT known_ THEN 'unknown' WHEN la THEN lang || ',la' ELSE lang END AS languages, CASE WHEN ocr THEN 'vision' END AS ocr_source,
    CASE WHEN len(ws) <= {C.CAP} THEN text ELSE array_to_string(ws[part * {C.CAP - C.OVERLAP} + 1 : part * {C.CAP - C.OVERLAP} + {C.CAP}], ' ') END AS text, known_ AND la AS multi,
    row_number() OVER (PARTITION BY page_id ORDER BY chunk, part) - 1 AS n, row_number() OVER (PARTITION BY book ORDER BY page_number, page_id, chunk, part) - 1 AS ordinal FROM windows_),
named AS (SELECT *, book || ':p' || page_number || '-' || page_number || ':' || chunk_type || ':' || ordinal AS chunk_id FROM records)"""
_HEAD = f"WITH RECURSIVE {UNITS}, {_SECTIONED}, {_MARKED}"


def chunk_records(spark, sf_dir):
    r = R.chunk_records(marked(spark, sf_dir))
    return r.select("chunk_id", "ordinal", "n", "chunk_type", "section", F.array_join("unit_ids", ",").alias("unit_ids"), F.array_join("languages", ",").alias("languages"), "is_multilingual", "ocr_source", "table_id", "shloka_number", F.md5(F.col("text").cast("binary")).alias("digest"))


CHUNK_RECORDS = rf"""{_HEAD}
SELECT chunk_id, ordinal, n, chunk_type, section, unit_ids, languages, multi AS is_multilingual, ocr_source, CASE WHEN chunk_type = 'table_text' THEN book || ':p' || page_number || ':table:' || ordinal END AS table_id,
  CASE WHEN chunk_type = 'shloka' THEN nullif(regexp_extract(text || ' ', '^\s*(\d+(\.\d+)?)[^\p{{L}}\p{{N}}_]', 1), '') END AS shloka_number, md5(text) AS digest FROM named"""


def document_chunks(spark, sf_dir):
    """All chunks of the books in order, bridges among them."""
    b = R.with_bridges(R.chunk_records(marked(spark, sf_dir)))
    return b.select("chunk_id", "chunk_type", "page_start", "page_end", "ordinal", "place", F.array_join("sources", ",").alias("sources"), F.md5(F.col("text").cast("binary")).alias("digest"))


DOCUMENT_CHUNKS = rf"""{_HEAD},
nx AS (SELECT *, lead(page_number) OVER o AS np, lead(chunk_id) OVER o AS nid, lead(chunk_type) OVER o AS nk, lead(section) OVER o AS ns, lead(text) OVER o AS nt FROM named WINDOW o AS (PARTITION BY book ORDER BY ordinal)),
br AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ordinal) - 1 + (SELECT count(*) FROM named m WHERE m.book = nx.book) AS bo FROM nx WHERE np - page_number = 1 AND chunk_type NOT IN ('image_caption', 'table_text') AND nk NOT IN ('image_caption', 'table_text', 'section_intro')
  AND NOT coalesce(section <> ns, false) AND text <> '' AND nt <> '' AND NOT regexp_matches(text, '[.:?!]$')),
al AS (SELECT book, chunk_id, chunk_type, page_number AS page_start, page_number AS page_end, ordinal, '' AS sources, text FROM named
  UNION ALL SELECT book, book || ':p' || page_number || '-' || np || ':page_bridge:' || bo, 'page_bridge', page_number, np, bo, chunk_id || ',' || nid, array_to_string(({words("text || ' ' || nt")})[1:{C.CAP}], ' ') FROM br)
SELECT chunk_id, chunk_type, page_start, page_end, ordinal, row_number() OVER (PARTITION BY book, page_start ORDER BY chunk_id) AS place, sources, md5(text) AS digest FROM al"""


def unit_dedupe(spark, sf_dir):
    """Units without near duplicates; every third line comes again, shortened or lengthened, at the same height."""
    u = _units(spark, sf_dir).withColumn("column_id", F.lit(0))
    again = u.where("reading_order % 3 = 0").withColumn("text", F.when(F.col("reading_order") % 2 == 0, F.concat("text", F.lit(" more"))).otherwise(F.substr("text", F.lit(1), F.length("text") - 3))).withColumn("x0", F.lit(5.0)).withColumn("reading_order", F.col("reading_order") + 100_000)
    return R.keep_longest(u.unionByName(again)).select("page_id", "reading_order")


_LOWER = f"lower({compact('text')})"
UNIT_DEDUPE = rf"""WITH {UNITS},
a AS (SELECT page_id, reading_order, y0, x0, {_LOWER} AS t FROM units), b AS (SELECT page_id, reading_order + 100000 AS reading_order, y0, 5.0 AS x0, lower({compact("CASE WHEN reading_order % 2 = 0 THEN text || ' more' ELSE left(text, length(text) - 3) END")}) AS t FROM units WHERE reading_order % 3 = 0)
SELECT a.page_id, CAST(CASE WHEN b.t IS NOT NULL AND length(a.t) >= 30 AND length(b.t) >= 30 AND length(b.t) > length(a.t) THEN b.reading_order ELSE a.reading_order END AS INTEGER) AS reading_order
FROM a LEFT JOIN b ON b.page_id = a.page_id AND b.reading_order = a.reading_order + 100000
UNION ALL SELECT b.page_id, CAST(b.reading_order AS INTEGER) FROM b JOIN a ON b.page_id = a.page_id AND b.reading_order = a.reading_order + 100000 WHERE NOT (length(a.t) >= 30 AND length(b.t) >= 30)"""


def page_figures(spark, sf_dir):
    """Every page with its figures."""
    pages = book_pages(table(spark, sf_dir, "documents")).select("book", "page_number", "page_id")
    return R.page_images(pages, P.images(spark, sf_dir)).select("page_id", F.array_join("images", ",").alias("images"))


PAGE_FIGURES = """
WITH i AS (SELECT 'src' || (vec_id % 20) AS book, vec_id // 20 + 1 AS page_number, string_agg('v' || vec_id, ',' ORDER BY 'v' || vec_id) AS images FROM embeddings GROUP BY ALL)
SELECT doc_id AS page_id, coalesce(images, '') AS images FROM documents d LEFT JOIN i ON i.book = d.source AND i.page_number = doc_id // 20 + 1"""


def image_records(spark, sf_dir):
    """Figures as they are stored, with caption and surroundings by their number."""
    i = P.images(spark, sf_dir).withColumn("_n", F.substr("image_id", F.lit(2)).cast("long"))
    i = i.withColumn("caption", F.when(F.col("_n") % 3 == 0, F.concat(F.lit(" plate "), F.col("_n").cast("string"))).when(F.col("_n") % 3 == 1, " ")).withColumn("surrounding", F.when(F.col("_n") % 2 == 0, "words around"))
    r = R.image_payload(i)
    return r.select("image_id", "embedding_text", F.array_join("languages", ",").alias("languages"), F.array_join("scripts", ",").alias("scripts"))


IMAGE_RECORDS = """
SELECT 'v' || vec_id AS image_id, CASE WHEN vec_id % 3 = 0 THEN 'plate ' || vec_id WHEN vec_id % 2 = 0 THEN 'words around' ELSE 'v' || vec_id END AS embedding_text, 'unknown' AS languages, 'Zyyy' AS scripts FROM embeddings"""


def caption_zip(spark, sf_dir):
    """Captions by pattern, handed to the figures of their page place by place; three figures a page, of which two stand in one row."""
    pages = frame(spark, CAPTIONS, "page_id BIGINT, text VARCHAR").union(table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.lit(" Figure 7 (a): a caption put at the end"))))
    spots = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("id"), F.lit(y).alias("y0"), F.lit(x).alias("x0")) for k, y, x in ((0, 95.0, 200.0), (1, 92.0, 20.0), (2, 10.0, 50.0))))).alias("s")).select("page_id", "s.id", "s.y0", "s.x0")
    return R.captions_by_place(pages, R.reading_order(spots)).select("page_id", "id", "figure", "caption")


CAPTION_ZIP = rf"""
WITH p AS (SELECT * FROM {values(CAPTIONS, "page_id BIGINT, text VARCHAR")} UNION ALL SELECT doc_id, text || ' Figure 7 (a): a caption put at the end' FROM documents),
-- No look-ahead here: a mark goes before each caption, and the text is split at the marks.
c AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace({compact("coalesce(text, '')")}, '(?i)(Figure\s*\d+\s*\([a-z]\)\s*:)', chr(1) || '\1', 'g'), chr(1))[2:], lambda x: regexp_replace({compact("x")}, '^[ .;,-]+|[ .;,-]+$', '', 'g')), lambda x: length(x) >= 12) AS l FROM p),
e AS (SELECT page_id, unnest(l) AS caption, unnest(range(len(l))) AS figure FROM c)
SELECT page_id, CASE figure WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS id, CAST(figure AS INTEGER) AS figure, caption FROM e WHERE figure < 3"""


def chunk_points(spark, sf_dir):
    """Chunks joined with their vectors, without the text that only served embedding."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_for_embedding"), "source")
    v = vectors(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("doc_id"), F.size("vec").alias("width"))
    return R.with_vectors(chunks, v, "doc_id")


CHUNK_POINTS = "SELECT doc_id, source, CAST(len(embedding) AS INTEGER) AS width FROM documents JOIN embeddings ON vec_id = doc_id"


def flat_blocks(spark, sf_dir):
    """Every block with the latest heading of its page."""
    return R.flattened(L.sections(_units(spark, sf_dir))).select("page_id", "reading_order", "heading_context")


FLAT_BLOCKS = f"""WITH {UNITS}, {_SECTIONED}
SELECT page_id, reading_order, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY reading_order ROWS UNBOUNDED PRECEDING), '') AS heading_context FROM s3"""

QUERIES = {f.__name__: f for f in (chunk_records, document_chunks, unit_dedupe, page_figures, image_records, caption_zip, chunk_points, flat_blocks)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
