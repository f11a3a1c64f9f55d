"""Boxes on pages: matching of native and recognised units, figures and the text around them, line merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.window import Window

from folioq.functions import text as T

#: Height of the bands by which boxes of a page are brought together.
BAND = 64.0
_FIGURE = r"^(figure|fig\.?|image|plate|photo|graph|chart|diagram|scheme|illustration|panel)(?![\p{L}\p{N}_])"
_BLEED = "issn|www\\.|journal|volume|issue"


def area(p: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x1") - F.col(f"{p}x0")) * F.greatest(F.lit(0.0), F.col(f"{p}y1") - F.col(f"{p}y0"))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def holds_centre(a: str, b: str) -> Column:
    x, y = (F.col(f"{b}x0") + F.col(f"{b}x1")) / 2, (F.col(f"{b}y0") + F.col(f"{b}y1")) / 2
    return x.between(F.col(f"{a}x0"), F.col(f"{a}x1")) & y.between(F.col(f"{a}y0"), F.col(f"{a}y1"))


def boxed(df: DataFrame, p: str) -> DataFrame:
    """(page_id, {p}id, {p}x0, ...) of rows with page_id, reading_order and a box."""
    return df.select("page_id", F.col("reading_order").alias(f"{p}id"), *(F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")))


def match_boxes(native: DataFrame, ocr: DataFrame, least: float = 0.15) -> DataFrame:
    """(page_id, n_id, o_id, overlap): boxes of a page that share `least` of the smaller one, or hold each other's centre.
    Boxes meet by page and band of height, not all with all."""
    banded = lambda df, p: df.withColumn("band", F.explode(F.sequence(F.floor(F.col(f"{p}y0") / BAND), F.floor(F.col(f"{p}y1") / BAND))))
    pairs = banded(boxed(native, "n_"), "n_").join(banded(boxed(ocr, "o_"), "o_"), ["page_id", "band"])
    # A pair that shares several bands counts in the first.
    pairs = pairs.where(F.col("band") == F.floor(F.greatest("n_y0", "o_y0") / BAND))
    overlap = intersection("n_", "o_") / F.greatest(F.lit(1.0), F.least(area("n_"), area("o_")))
    fits = pairs.withColumn("overlap", overlap).where((F.col("overlap") >= least) | holds_centre("n_", "o_") | holds_centre("o_", "n_"))
    return fits.select("page_id", "n_id", "o_id", F.round("overlap", 6).alias("overlap"))


def repair(native: DataFrame, ocr: DataFrame, suspect: Column) -> DataFrame:
    """Native units with a text in which suspect ones are replaced by the recognised text at their place, in reading order,
    where there is any. Pages with no clean unit, or three quarters of suspect ones, are left alone."""
    page = Window.partitionBy("page_id")
    marked = native.withColumn("_bad", suspect & (F.length("text") >= 5))
    n, bad = F.count_if(F.length("text") >= 5).over(page), F.count_if("_bad").over(page)
    marked = marked.withColumn("_mixed", (n >= 2) & (bad > 0) & (bad < n) & (bad / n < 0.75))
    hits = match_boxes(marked.where("_bad AND _mixed"), ocr).join(ocr.select("page_id", F.col("reading_order").alias("o_id"), F.col("text").alias("t")), ["page_id", "o_id"])
    found = hits.groupBy("page_id", F.col("n_id").alias("reading_order")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_id", "t"))), lambda x: x["t"]), " ").alias("_new"))
    out = marked.join(found, ["page_id", "reading_order"], "left")
    return out.withColumn("repaired", F.col("_new").isNotNull()).withColumn("text", F.coalesce("_new", "text")).drop("_bad", "_mixed", "_new")


def apply_font_map(text: Column, mapping: dict[str, str]) -> Column:
    """Replace the characters of a legacy font, longest keys first."""
    for old, new in sorted(mapping.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        if old:
            text = F.replace(text, F.lit(old), F.lit(new))
    return T.compact(T.normalize_text(text))


def keep_figure(width: Column, height: Column, caption: Column, around: Column, table_like: Column, scanned: Column, overlap: Column, meaningful: Column) -> Column:
    """Whether a figure (x0, y0, x1, y1 on a page of width x height) is kept; the first reason decides."""
    ratio = area("") / F.greatest(width * height, F.lit(1e-9))
    has = F.coalesce(caption, F.lit("")) != ""
    margin = (F.col("y1") <= height * 0.16) | (F.col("y0") >= height * 0.86)
    context = F.lower(F.concat_ws(" ", F.coalesce(caption, F.lit("")), F.coalesce(around, F.lit(""))))
    ornament = margin & (context.rlike(_BLEED) | ((ratio <= 0.03) & (F.col("x1") - F.col("x0") <= width * 0.28)))
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return (
        F.when((ratio >= 0.85) & ~scanned, False)
        .when(ornament, False)
        .when(~has & ~scanned & (ratio <= 0.012) & (side < 72), False)
        .when(table_like & ~scanned, False)
        .when((ratio >= 0.70) & ~has & ~table_like, False)
        .when(table_like & meaningful & (overlap >= 0.22) & ~scanned, False)
        .otherwise(True)
    )


def table_like(caption: Column, around: Column) -> Column:
    low, near = F.lower(F.coalesce(caption, F.lit(""))), F.lower(F.coalesce(around, F.lit("")))
    digits, letters = F.length(F.regexp_replace(near, r"[^\p{Nd}]", "")), F.length(F.regexp_replace(near, r"[^\p{L}]", ""))
    numeric = (digits / F.greatest(digits + letters, F.lit(1)) > 0.30) & (F.length(F.trim(near)) > 30)
    return F.when(T.compact(low).rlike(_FIGURE), False).when(low.contains("table"), True).otherwise(numeric)


def is_heading_like(text: Column) -> Column:
    flat = T.compact(text)
    capitals = F.forall(T.word_list(flat), lambda w: ~F.left(w, F.lit(1)).rlike(r"\p{L}") | F.left(w, F.lit(1)).rlike(r"\p{Lu}"))
    return (
        F.when((flat == "") | T.is_page_number(flat) | F.lower(flat).rlike(_BLEED), False)
        .when((F.length(flat) <= 90) & flat.rlike(r"\p{Lu}") & (F.upper(flat) == flat), True)
        .when((F.length(flat) <= 120) & F.endswith(flat, F.lit(":")), True)
        .otherwise((T.word_count(flat) <= 10) & capitals)
    )


def is_caption_like(text: Column) -> Column:
    low = F.lower(T.compact(text))
    return low.rlike(_FIGURE.replace("panel", "panel|table")) | (low.contains(":") & (T.word_count(low) <= 18))


def _meet(figures: DataFrame, units: DataFrame) -> DataFrame:
    """Figures (page_id, figure, fx0, ...) with the units of their page."""
    return figures.join(units.select("page_id", "reading_order", "text", "x0", "y0", "x1", "y1"), "page_id")


def captions(figures: DataFrame, units: DataFrame) -> DataFrame:
    """(page_id, figure, caption, caption_score): the likeliest caption just below each figure, if one scores 2 or more."""
    gap = F.col("y0") - F.col("fy1")
    over = F.greatest(F.lit(0.0), F.least("x1", "fx1") - F.greatest("x0", "fx0")) / F.least(F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(1.0), F.col("fx1") - F.col("fx0")))
    low = F.lower("text")
    near = _meet(figures, units).where((gap >= -10) & (gap <= 180) & (over >= 0.2))
    value = (
        F.when(low.rlike(_FIGURE), 5.0).otherwise(0.0) + F.when(low.rlike(r"\([a-z]\)"), 1.0).otherwise(0.0) + F.when(low.contains("table"), 4.0).otherwise(0.0)
        + F.when(F.contains("text", F.lit(":")), 0.5).otherwise(0.0) + F.when(F.length("text").between(10, 260), 1.0).otherwise(0.0) - F.when(is_heading_like(F.col("text")), 2.0).otherwise(0.0)
        - F.when(low.rlike(_BLEED), 4.0).otherwise(0.0) - F.when(~is_caption_like(F.col("text")), 1.5).otherwise(0.0) - F.least(gap, F.lit(120.0)) / 120
    )
    best = Window.partitionBy("page_id", "figure").orderBy(F.desc("caption_score"), F.asc("reading_order"))
    first = near.withColumn("caption_score", F.round(value, 6)).withColumn("_r", F.row_number().over(best)).where("_r = 1 AND caption_score >= 2").where(is_caption_like(F.col("text")))
    return first.select("page_id", "figure", F.col("text").alias("caption"), "caption_score")


def nearest_heading(figures: DataFrame, headings: DataFrame) -> DataFrame:
    """(page_id, figure, heading): the closest heading above each figure, else the one whose middle is closest."""
    above = F.col("y1") <= F.col("fy0")
    apart = F.when(above, F.col("fy0") - F.col("y1")).otherwise(F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("fy0") + F.col("fy1")) / 2))
    order = Window.partitionBy("page_id", "figure").orderBy(F.desc(above), apart, "reading_order")
    return _meet(figures, headings).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("page_id", "figure", F.col("text").alias("heading"))


def surrounding_text(figures: DataFrame, units: DataFrame, reach: float = 140.0, most: int = 6, chars: int = 720) -> DataFrame:
    """(page_id, figure, around): up to `most` blocks near each figure, prose first, in page order."""
    m = _meet(figures, units)
    near = (F.col("x0") < F.col("fx1") + reach) & (F.col("x1") > F.col("fx0") - reach) & (F.col("y0") < F.col("fy1") + reach) & (F.col("y1") > F.col("fy0") - reach)
    dx = (F.col("x0") + F.col("x1")) / 2 - (F.col("fx0") + F.col("fx1")) / 2
    dy = (F.col("y0") + F.col("y1")) / 2 - (F.col("fy0") + F.col("fy1")) / 2
    group = Window.partitionBy("page_id", "figure")
    m = m.withColumn("_near", near).withColumn("_d", dx * dx + dy * dy).withColumn("_any", F.max("_near").over(group))
    m = m.withColumn("_by", F.row_number().over(group.orderBy("_d", "reading_order"))).where("_near OR (NOT _any AND _by <= 3)")
    over = intersection("", "f") / F.greatest(F.lit(1.0), area(""))
    n = T.word_count(F.col("text"))
    prose = (n >= 6) & F.col("text").rlike("[.,;:]")
    m = m.withColumn("_prose", prose & (over < 0.95)).withColumn("_q", F.when(over < 0.9, 1.2).otherwise(0.0) + F.when(prose, 1.5).otherwise(0.0) + F.when(n >= 12, 0.5).otherwise(0.0))
    m = m.withColumn("_some", F.max("_prose").over(group)).where("_prose OR NOT _some")
    m = m.withColumn("_r", F.row_number().over(group.orderBy(F.desc("_q"), "_d", "reading_order"))).where(F.col("_r") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "reading_order", "text"))), lambda x: x["text"]), " ")
    return m.groupBy("page_id", "figure").agg(F.trim(F.left(joined, F.lit(chars))).alias("around"))


def text_overlap(figures: DataFrame, units: DataFrame) -> DataFrame:
    """(page_id, figure, overlap): the share of each figure that text covers, 1 at most."""
    m = _meet(figures, units)
    size = F.greatest(F.lit(1.0), (F.col("fx1") - F.col("fx0")) * (F.col("fy1") - F.col("fy0")))
    return m.groupBy("page_id", "figure").agg(F.round(F.least(F.lit(1.0), F.sum(intersection("f", "") / size)), 6).alias("overlap"))


def merge_steps(links: list, sizes: list, lines: int = 6, chars: int = 420) -> list[int]:
    """Number of the paragraph that each line goes to: it joins the one before if linked, up to 6 lines and 420 characters."""
    out, group, n, total = [], 0, 0, 0
    for link, size in zip(links, sizes, strict=True):
        if not out or not link or n >= lines or total + size >= chars:
            group, n, total = group + 1, 0, 0
        n, total = n + 1, total + size
        out.append(group)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _merged(links: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([merge_steps(list(k), list(s)) for k, s in zip(links, sizes, strict=True)], dtype=object)


def merge_lines(lines: DataFrame, least: int = 28, gap: float = 8.0, ratio: float = 0.85, shared: float = 0.25) -> DataFrame:
    """(page_id, paragraph, lines, text, x0, y0, x1, y1) from recognised lines in reading order."""
    page = Window.partitionBy("page_id").orderBy("reading_order")
    before = {c: F.lag(c).over(page) for c in ("x0", "y0", "x1", "y1", "text")}
    u = lines.select("*", *(v.alias(f"p{c}") for c, v in before.items()))
    space = F.col("y0") - F.col("py1")
    limit = F.greatest(F.lit(gap), F.least(F.greatest(F.lit(1.0), F.col("py1") - F.col("py0")), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))) * ratio)
    over = F.greatest(F.lit(0.0), F.least("x1", "px1") - F.greatest("x0", "px0")) / F.greatest(F.lit(1.0), F.least(F.col("x1") - F.col("x0"), F.col("px1") - F.col("px0")))
    column = (over >= shared) | (F.abs(F.col("x0") - F.col("px0")) <= 12)
    link = column & ((space <= limit) | ((F.length("ptext") < least) & (space <= limit * 2)) | ((F.length("text") < max(10, least // 2)) & (space <= limit * 1.25)))
    fact = F.struct("reading_order", F.coalesce(link, F.lit(False)).alias("link"), F.length("text").alias("n"), "text", "x0", "y0", "x1", "y1")
    pages = u.groupBy("page_id").agg(F.array_sort(F.collect_list(fact)).alias("u"))
    pick = lambda name: F.transform("u", lambda x: x[name])
    each = pages.withColumn("g", _merged(pick("link"), pick("n"))).select("page_id", F.inline(F.arrays_zip("u", "g")))
    grouped = each.groupBy("page_id", F.col("g").alias("paragraph"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u.reading_order", "u.text"))), lambda x: x["text"]), "\n")
    return grouped.agg(F.count(F.lit(1)).cast("int").alias("lines"), text.alias("text"), F.min("u.x0").alias("x0"), F.min("u.y0").alias("y0"), F.max("u.x1").alias("x1"), F.max("u.y1").alias("y1"))
