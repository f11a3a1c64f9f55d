"""Queries of the scalar text kernels, over all documents and a few texts in other scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.plans._sql import SAMPLES, TEXTS, compact, count, found, frame, gone, times, words
from folioq.sources.corpus import table


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").union(frame(spark, SAMPLES, "doc_id BIGINT, text VARCHAR"))


def snippet(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_FLAT = compact("coalesce(text, '')")
_TRIM = "trim(coalesce(text, ''))"
SNIPPET = f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 320 THEN {_FLAT} ELSE rtrim(substr({_FLAT}, 1, 317)) || '...' END AS snippet FROM {TEXTS}"


def keywords(spark, sf_dir):
    found_words = T.keywords(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(found_words).alias("n"), F.array_join(found_words, " ").alias("keywords"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
KEYWORDS = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^\p{{Nd}}+$')) AS w FROM {TEXTS}),
k AS (SELECT doc_id, list_sort(list_distinct(w || list_transform(list_filter(w, lambda x: ends_with(x, 's') AND length(x) >= 5), lambda x: left(x, length(x) - 1))
  || list_transform(list_filter(w, lambda x: ends_with(x, 'es') AND length(x) >= 6), lambda x: left(x, length(x) - 2)))) AS k FROM w)
SELECT doc_id, CAST(len(k) AS INTEGER) AS n, array_to_string(k, ' ') AS keywords FROM k"""


def script_detect(spark, sf_dir):
    script = F.col("script")
    return texts(spark, sf_dir).select("doc_id", T.detect_script(F.col("text")).alias("script")).select("doc_id", "script", T.script_code(script).alias("code"), F.array_join(T.script_languages(script), ",").alias("languages"))


_FIRST = "regexp_extract(coalesce(text, ''), '[" + "".join(s[0] for s in T.SCRIPTS.values()) + "]')"
_CASES = " ".join(f"WHEN {found('c', f'[{chars}]')} THEN {{}}" for chars, _, _ in T.SCRIPTS.values())
SCRIPT_DETECT = f"""
WITH f AS (SELECT doc_id, {_FIRST} AS c FROM {TEXTS})
SELECT doc_id, CASE {_CASES.format(*(f"'{n}'" for n in T.SCRIPTS))} ELSE 'latin' END AS script,
  CASE {_CASES.format(*(f"'{s[1]}'" for s in T.SCRIPTS.values()))} ELSE 'Latn' END AS code,
  CASE {_CASES.format(*(f"'{','.join(s[2])}'" for s in T.SCRIPTS.values()))} ELSE 'en' END AS languages FROM f"""


def normalize_text(spark, sf_dir):
    t = F.col("text")
    return texts(spark, sf_dir).select("doc_id", T.normalize_text(t).alias("normalized"), T.normalize_text(t, latin_fold=True).alias("folded"))


def _normal(fold: bool) -> str:
    x = f"translate(nfc_normalize(coalesce(text, '')), '{T._PLAIN_FROM + T._DROPPED}', '{T._PLAIN_TO.replace(chr(39), chr(39) * 2)}')"
    for a, b in T._SPELLED.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"translate({x}, '{T._MARKED + T._MARKED.upper()}', '{T._BARE + T._BARE.upper()}')"
    if fold:
        x = f"translate({x}, '{T._LATIN_FROM}', '{T._LATIN_TO}')"
    return rf"regexp_replace({x}, '\s+\\\s+', ' ', 'g')"


NORMALIZE_TEXT = f"SELECT doc_id, {_normal(False)} AS normalized, {_normal(True)} AS folded FROM {TEXTS}"


def text_quality(spark, sf_dir):
    q = texts(spark, sf_dir).select("doc_id", T.quality(F.col("text")).alias("q")).select("doc_id", "q.*")
    return q.select("doc_id", *(F.round(name, 6).alias(name) if name.endswith("ratio") else name for name in q.columns[1:]))


_ODD = r"[\p{L}\p{N}\p{M}\s.,:;!?()\[\]{}'\"/_%+&*#°₹$=|।॥-]"
_WRONG = "Ã.|Â.|ï.|à¤|à¥|à¦|à¨|àª|à³"
_CORE = r"regexp_replace(w, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')"
_MEASURES = f"""
m AS (SELECT doc_id, t, flat, length({gone("flat", _ODD)}) / greatest(length(flat), 1) AS symbol_ratio,
  (length(flat) - length({gone("flat", "[^" + chr(92) + "x00-" + chr(92) + "x7f]")})) / greatest(length(flat), 1) AS non_ascii_ratio,
  (length(flat) - length({gone("flat", f"[{T.INDIC}]")})) / greatest(length(flat), 1) AS indic_ratio,
  {times("flat", _WRONG)} / greatest(length(flat), 1) AS mojibake_ratio,
  len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]') AND regexp_matches(w, '[^\\x00-\\x7f]') AND NOT regexp_matches(w, '[{T.INDIC}]'))) / greatest(len(ws), 1) AS mixed_ratio,
  len(list_filter(ws, lambda w: length({_CORE}) >= 2 AND regexp_matches({_CORE}, '\\p{{L}}') AND NOT regexp_matches({_CORE}, '{_WRONG}'))) / greatest(len(ws), 1) AS meaningful_ratio,
  length(flat) < 40 AS too_short
  FROM (SELECT doc_id, {_TRIM} AS t, {_FLAT} AS flat, {words(_FLAT)} AS ws FROM {TEXTS}))"""
_RATIOS = ("symbol_ratio", "non_ascii_ratio", "indic_ratio", "mojibake_ratio", "mixed_ratio", "meaningful_ratio")
TEXT_QUALITY = f"WITH {_MEASURES} SELECT doc_id, {', '.join(f'round({r}, 6) AS {r}' for r in _RATIOS)}, too_short FROM m"


def garbled_flag(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.is_garbled(F.col("text")).alias("garbled"), T.is_non_latin(F.col("text")).alias("non_latin"))


def _garbled(t: str) -> str:
    odd = gone(t, r"[\p{L}\p{N}\p{M}\s|.,;:!?()\[\]{}'\"/।॥-]")
    return f"(length({t}) >= 5 AND (length({odd}) / greatest(length({t}), 1) > 0.30 OR ({found(t, 'Ãƒ|Ã‚|ï¿½|�')} AND NOT {found(t, '[ऀ-ॿ؀-ۿఀ-౿]')})))"


_LETTERS = gone("flat", r"[^\p{L}]")
GARBLED_FLAG = f"""
WITH f AS (SELECT doc_id, {_TRIM} AS t, {_FLAT} AS flat FROM {TEXTS})
SELECT doc_id, {_garbled("t")} AS garbled,
  length(flat) >= 5 AND length({_LETTERS}) > 0 AND length({gone(_LETTERS, f"[^{T.NON_LATIN}]")}) / greatest(length({_LETTERS}), 1) >= 0.20 AS non_latin FROM f"""


def ocr_decision(spark, sf_dir):
    image = F.abs(F.col("doc_id")) % 100 / 100
    judged = texts(spark, sf_dir).withColumn("reason", T.ocr_reason(F.col("text")))
    return judged.select("doc_id", "reason", T.page_type(F.col("text"), image, F.col("reason")).alias("page_type"))


_INDEX = rf"""(len(ls) >= 3 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\d{{1,3}}\b') AND {count('x')} <= 8)) >= 2
  AND len(list_filter(ls, lambda x: regexp_matches(x, '\b\d{{1,4}}\s*-\s*\d{{1,4}}\b'))) >= 2)"""
OCR_DECISION = f"""
WITH {_MEASURES},
r AS (SELECT doc_id, t, array_to_string(list_filter([
    CASE WHEN too_short THEN 'too_short' END, CASE WHEN mojibake_ratio > 0.08 THEN 'mojibake_like' END, CASE WHEN mixed_ratio > 0.10 THEN 'legacy_mixed_tokens' END,
    CASE WHEN non_ascii_ratio > 0.55 AND indic_ratio < 0.10 THEN 'high_non_ascii_ratio' END, CASE WHEN meaningful_ratio < 0.45 THEN 'low_meaningful_words' END,
    CASE WHEN symbol_ratio > 0.30 THEN 'high_symbol_ratio' END, CASE WHEN symbol_ratio > 0.15 THEN 'symbol_regex_hit' END], lambda x: x IS NOT NULL), ',') AS q,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: {compact('x')}), lambda x: x <> '') AS ls FROM m),
d AS (SELECT doc_id, t, CASE WHEN t = '' THEN 'empty_native' WHEN {_INDEX} THEN 'index_like_native' WHEN {_garbled("t")} THEN 'parser_garbled'
  WHEN q <> '' THEN 'quality:' || q ELSE 'native_good' END AS reason, abs(doc_id) % 100 / 100 AS image FROM r)
SELECT doc_id, reason, CASE WHEN length(t) < 40 AND image >= 0.75 THEN 'scanned' WHEN t = '' AND image < 0.75 THEN 'blank'
  WHEN reason IN ('native_good', 'index_like_native') THEN 'digitized' WHEN t <> '' THEN 'ocr_fallback' ELSE 'scanned' END AS page_type FROM d"""


def clean_lines(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.clean_lines(F.col("text")).alias("cleaned"))


CLEAN_LINES = rf"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {compact('x')}), lambda x: x <> ''
  AND NOT (regexp_matches(lower(x), '\bwww\.ijaar\.in\b') AND contains(lower(x), 'volume') AND contains(lower(x), 'issue'))
  AND NOT regexp_matches(lower(x), '^\d{{1,4}}\s+www\.ijaar\.in\b')
  AND NOT regexp_matches(lower(x), 'conflict of interest|source of support|financial support')), chr(10)) AS cleaned FROM {TEXTS}"""


def line_rows(spark, sf_dir):
    """The five tests for table rows and their like, for every line."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    t = F.col("text")
    return lines.select(
        "doc_id", "line", T.is_table_row(t).alias("table_row"), T.is_table_row(t, True).alias("native_row"), T.is_loose_table_row(t).alias("loose_row"),
        T.is_contextual_row(t).alias("contextual_row"), T.is_table_anchor(t).alias("anchor"), T.is_numeric_dense(t).alias("dense"), T.is_context_break(t).alias("context_break"),
    )


_NUM = times("f", r"\d+(?:\.\d+)?")
_SER = found("f", r"^\d{1,3}[.)]?\s+")
_ROW = rf"(regexp_matches(l, '^(table |table no|s\.no|sample no)') OR (NOT SPARED AND (({_SER} AND (n <= 4 OR ({_NUM} >= 2 AND n <= 12))) OR ({_NUM} >= 3 AND n <= 12))))"
_PLAIN = _ROW.replace("SPARED", "false")
LINE_ROWS = rf"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS line FROM {TEXTS}),
u AS (SELECT doc_id, CAST(line AS INTEGER) AS line, x, {compact("x")} AS f, lower({compact("x")}) AS l, {count("x")} AS n FROM s)
SELECT doc_id, line, f <> '' AND {_PLAIN} AS table_row,
  f <> '' AND {_ROW.replace("SPARED", found("l", r"^\d{1,3}[.)]?\s+(" + T.SECTIONS + ")"))} AS native_row,
  f <> '' AND CASE WHEN regexp_matches(l, '^(table |fig|s\.no|sample no)') THEN true WHEN {_SER} AND n <= 4 THEN true
    WHEN len(list_filter({words("l")}, lambda w: w IN ('nil', 'na', 'n/a', 'nd'))) > 0 THEN n <= 12
    WHEN regexp_matches(f, '[%°]') THEN n <= 12 AND ({_NUM} >= 1 OR len(list_filter({words("f")}, lambda w: regexp_matches(w, '^\p{{L}}+$'))) > 0)
    WHEN {_NUM} >= 2 AND n <= 12 THEN true ELSE {times("f", r"\d")} >= 6 AND n <= 12 END AS loose_row,
  f <> '' AND CASE WHEN {_PLAIN} THEN true WHEN n > 18 THEN false WHEN regexp_matches(f, '[.!?]\s*$') AND n >= 8 THEN false
    WHEN regexp_matches(l, '^({T.ROW_LABELS})') THEN true WHEN {_NUM} >= 1 THEN true
    ELSE n <= 6 AND NOT regexp_matches(l, '\b(the|and|with|were|was|is|are|this|that|from|into|over|under)\b') END AS contextual_row,
  regexp_matches(lower(x), '\btable\s*(no\.?\s*\d+|\d+)\b') AS anchor,
  length({gone("f", r"[^\p{Nd}\p{L}]")}) > 0 AND length({gone("f", r"[^\p{Nd}]")}) / greatest(length({gone("f", r"[^\p{Nd}\p{L}]")}), 1) >= 0.35 AND n <= 14 AS dense,
  n >= 16 AND regexp_matches(f, '[.!?;]') AND regexp_matches(l, '\b(method|observations|prepared|adopting|objective|analysis|discussion|conclusion)\b') AS context_break
FROM u"""


def verse_flag(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.is_verse(F.col("text")).alias("verse"))


_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_DANDA = found("t", r"।|॥|à¥¤|à¥¥|\|")
_MULTI = f"(len(ls) BETWEEN 2 AND 4 AND len(list_filter(ls, lambda x: {count('x')} > 14)) = 0)"
VERSE_FLAG = rf"""
WITH a AS (SELECT doc_id, {_TRIM} AS t, {compact(_TRIM)} AS f, lower({compact(_TRIM)}) AS l, {count(_TRIM)} AS n FROM {TEXTS}),
u AS (SELECT *, {_LINES} AS ls FROM a)
SELECT doc_id, f <> '' AND NOT (regexp_matches(l, '^(table |table no|fig|references|reference|chapter )|www\.|issn')
    OR regexp_matches(l, '^(s\.no|sample no|parameter|inference)') OR ({_SER} AND n <= 8) OR ({_NUM} >= 3 AND n <= 12)
    OR regexp_matches(f, '[%°]') OR {times("f", r"\p{Nd}")} >= 5 OR (n >= 10 AND regexp_matches(f, '[.?!]$')))
  AND regexp_matches(t, '[ऀ-ॿఀ-౿]')
  AND {_DANDA}::INT + regexp_matches(t, '^\s*([0-9०-९౦-౯]+([.)-][0-9०-९౦-౯]+)?)([^\p{{L}}\p{{N}}_]|$)')::INT + {_MULTI}::INT
    + (len(list_filter(ls, lambda x: regexp_matches(x, '[.?!]$'))) <= len(ls) // 3)::INT >= 2
  AND ({_MULTI} OR {_DANDA}) AS verse FROM u"""


def slugs(spark, sf_dir):
    """Identifiers of sources and pages."""
    docs = table(spark, sf_dir, "documents")
    raw = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", T.slug(F.concat_ws(" / ", "source", F.left("text", F.lit(40)))).alias("slug"), T.stable_doc_id(F.col("source"), F.col("n_chars"), F.lit("/corpus")).alias("stable_id"),
        T.point_id(raw, "text").alias("text_point"), T.point_id(F.md5(raw.cast("binary")), "image").alias("uuid_point"),
    )


_DIGEST = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('text:' || source || ':' || doc_id::VARCHAR))"
_NIBBLE = "substr('89ab', CAST(instr('0123456789abcdef', substr(g, 17, 1)) - 1 AS INTEGER) % 4 + 1, 1)"
SLUGS = rf"""
WITH d AS (SELECT *, {_DIGEST} AS g, md5(source || ':' || doc_id::VARCHAR) AS h FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(lower(trim(source || ' / ' || left(text, 40))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  substr(sha1(source || '|' || n_chars::VARCHAR || '|/corpus'), 1, 16) AS stable_id,
  substr(g, 1, 8) || '-' || substr(g, 9, 4) || '-5' || substr(g, 14, 3) || '-' || {_NIBBLE} || substr(g, 18, 3) || '-' || substr(g, 21, 12) AS text_point,
  substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid_point FROM d"""

QUERIES = {f.__name__: f for f in (snippet, keywords, script_detect, normalize_text, text_quality, garbled_flag, ocr_decision, clean_lines, line_rows, verse_flag, slugs)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
