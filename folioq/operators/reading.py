"""What stands between files and units: nested recognition results, lines from words, two parses of a page, repair, figure
boxes, and the checks that decide between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.functions import text as T
from folioq.operators.pagewise import by_pages

#: Reasons for which a page is sent to recognition.
SENT = ("scanned", "garbled", "ocr_fallback", "forced")


def batch_size(pages: int, explicit: str | None = None, least: int = 12, size: int = 8) -> int:
    """Pages of a window: what is given, if it is a number; all of a short document; else `size`."""
    if explicit and explicit.strip().lstrip("+-").isdigit():
        return max(1, int(explicit))
    return max(1, pages) if pages < max(1, least) else min(max(1, pages), max(1, size))


def recognised(pages: DataFrame, reader: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What `reader` (batches of page_id, reason and content to rows of `schema`) makes of the pages whose reason asks for it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield reader(frame)

    return pages.where(F.col("reason").isin(*SENT)).mapInPandas(run, schema)


def words(results: DataFrame) -> DataFrame:
    """One row a word of nested results (page_id, blocks of paragraphs of words of symbols (text, confidence), a word with its
    confidence): block, paragraph and word number, text (its symbols), confidence (of the word, or the mean of its symbols)."""
    b = results.select("page_id", F.posexplode("blocks").alias("block", "b"))
    p = b.select("page_id", "block", F.posexplode("b.paragraphs").alias("paragraph", "p"))
    w = p.select("page_id", "block", "paragraph", F.posexplode("p.words").alias("word", "w"))
    symbols = F.col("w.symbols")
    mean = F.aggregate(symbols, F.lit(0.0), lambda s, x: s + F.coalesce(x["confidence"], F.lit(0.0))) / F.greatest(F.size(symbols), F.lit(1))
    return w.select("page_id", "block", "paragraph", "word", F.array_join(F.col("w.symbols.text"), "").alias("text"), F.coalesce("w.confidence", mean).alias("confidence"))


def paragraphs(rows: DataFrame) -> DataFrame:
    """Words as paragraphs: text, mean and best confidence (0 for none), number of words."""
    listed = F.array_sort(F.collect_list(F.struct("word", "text")))
    g = rows.where("text <> ''").groupBy("page_id", "block", "paragraph")
    return g.agg(F.array_join(F.transform(listed, lambda x: x["text"]), " ").alias("text"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("best"), F.count(F.lit(1)).alias("words"))


def read_paragraphs(results: DataFrame) -> DataFrame:
    """paragraphs of the words of `results`. The words of a paragraph stay in one row, so that paragraphs are grouped, not words."""

    def word(w: Column, i: Column) -> Column:
        symbols = w["symbols"]
        mean = F.aggregate(symbols["confidence"], F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.greatest(F.size(symbols), F.lit(1))
        return F.struct(i.alias("word"), F.array_join(symbols["text"], "").alias("text"), F.coalesce(w["confidence"], mean).alias("confidence"))

    b = results.select("page_id", F.posexplode("blocks").alias("block", "b"))
    p = b.select("page_id", "block", F.posexplode("b.paragraphs").alias("paragraph", "p"))
    kept = p.select("page_id", "block", "paragraph", F.filter(F.transform("p.words", word), lambda x: x["text"] != "").alias("w")).where("size(w) > 0")
    g = kept.groupBy("page_id", "block", "paragraph").agg(F.array_sort(F.flatten(F.collect_list("w"))).alias("w"))
    sure = F.array_compact("w.confidence")
    total = F.aggregate("w.confidence", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return g.select(
        "page_id", "block", "paragraph", F.array_join("w.text", " ").alias("text"), F.when(F.size(sure) > 0, total / F.size(sure)).otherwise(0.0).alias("confidence"), F.coalesce(F.array_max("w.confidence"), F.lit(0.0)).alias("best"),
        F.size("w").cast("long").alias("words"),
    )


def word_lines(rows: DataFrame) -> DataFrame:
    """(page_id, id, line, place): words (id, x0, y0, x1, y1) of a page in lines. A word, in order of its centre's height, joins the
    line whose mean centre is nearest, within 0.6 of the upper median height (4 at least), or opens one; lines go down the
    page, words from left to right. The fold runs over one page's words."""

    # Words come by height and a line opens only where all others are over `reach` above, so the last line opened stays the lowest and
    # is the nearest one; no other has to be looked at.
    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        page, centre = c["page_id"], c["c"]
        starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        ends = np.r_[starts[1:], len(page)]
        tall = np.maximum(c["y1"] - c["y0"], 1.0)
        tall = tall[np.lexsort((tall, page))]
        reaches = np.maximum(4.0, tall[starts + (ends - starts) // 2] * 0.6)
        line = []
        for start, end, reach in zip(starts.tolist(), ends.tolist(), reaches.tolist(), strict=True):
            n, total, members = -1, 0.0, 0
            for y in centre[start:end].tolist():
                if members and abs(total / members - y) <= reach:
                    total += y
                    members += 1
                else:
                    n, total, members = n + 1, y, 1
                line.append(n)
        line = np.array(line, np.int32)
        order = np.lexsort((c["id"], c["x0"], line, page))
        page, line, ids = page[order], line[order], c["id"][order]
        opened = np.r_[True, (page[1:] != page[:-1]) | (line[1:] != line[:-1])]
        at = np.arange(len(page))
        return {"page_id": page, "id": ids, "line": line, "place": (at - np.maximum.accumulate(np.where(opened, at, 0))).astype(np.int32)}

    centred = rows.select("page_id", "id", "x0", "y0", "y1", ((F.col("y0") + F.col("y1")) / 2).alias("c"))
    return by_pages(centred, [F.col("c"), F.col("x0"), F.col("id")], run, "page_id long, id long, line int, place int")


def either_parse(structured: DataFrame, native: DataFrame) -> DataFrame:
    """Units (page_id, reading_order, text) of the structured parse, and of the native one for pages where that has no text."""
    have = structured.where("trim(text) <> ''").select("page_id").distinct()
    rest = native.join(have, "page_id", "left_anti").withColumn("parser", F.lit("native"))
    return structured.join(have, "page_id", "left_semi").withColumn("parser", F.lit("structured")).unionByName(rest)


def repaired(units: DataFrame, matches: DataFrame, whole: DataFrame, decoded: Column) -> DataFrame:
    """Suspect units (page_id, reading_order, kind, text, suspect) mended: by the text that a legacy font's map gives (`decoded`) if
    that changes it and isn't garbled; else by the recognised units that match (page_id, reading_order, o_id, o_text, confidence,
    engine), in their order; and, on pages where none of the rest matched, by the page's recognised text (page_id, ocr_text)
    split over them. Script and languages follow the new text."""
    u = units.withColumn("_d", F.when(F.col("suspect"), decoded))
    u = u.withColumn("_d", F.when((F.coalesce("_d", F.lit("")) != "") & (F.col("_d") != F.col("text")) & ~T.is_garbled(F.col("_d")), F.col("_d")))
    listed = F.array_sort(F.collect_list(F.struct("o_id", "o_text", "engine")))
    joined = matches.groupBy("page_id", "reading_order").agg(listed.alias("_m"), F.max("confidence").alias("_best"))
    text = T.compact(F.array_join(F.transform("_m", lambda x: F.coalesce(x["o_text"], F.lit(""))), " "))
    u = u.join(joined.select("page_id", "reading_order", text.alias("_o"), F.element_at("_m", 1)["engine"].alias("_engine"), "_best"), ["page_id", "reading_order"], "left")
    left, page = F.col("suspect") & F.col("_d").isNull(), Window.partitionBy("page_id")
    matched = left & (F.coalesce("_o", F.lit("")) != "")
    u = u.withColumn("_left", left).withColumn("_matched", matched).withColumn("_none", F.count_if("_matched").over(page) == 0)
    u = u.withColumn("_slot", F.row_number().over(Window.partitionBy("page_id", "_left").orderBy("reading_order")) - 1).withColumn("_slots", F.count_if("_left").over(page))
    u = u.join(whole, "page_id", "left").withColumn("_lines", F.filter(F.transform(F.split(F.coalesce("ocr_text", F.lit("")), "\n"), T.compact), lambda x: x != ""))
    each, more = F.floor(F.size("_lines") / F.col("_slots")), F.size("_lines") % F.col("_slots")
    begin = F.col("_slot") * each + F.least(F.col("_slot"), more)
    share = F.array_join(F.slice("_lines", (begin + 1).cast("int"), (each + (F.col("_slot") < more).cast("int")).cast("int")), " ")
    slot = F.when(F.col("_left") & F.col("_none") & (F.size("_lines") > 0), F.nullif(share, F.lit("")))
    new = F.coalesce(F.col("_d"), F.when(F.col("_matched"), F.col("_o")), slot)
    source = F.when(F.col("_d").isNotNull(), "legacy_font_map").when(F.col("_matched"), F.coalesce("_engine", F.lit("vision"))).when(slot.isNotNull(), "vision").otherwise("native")
    done = T.compact(F.coalesce(new, F.col("text")))
    return u.select(
        "page_id", "reading_order", "kind", F.when(new.isNull(), F.col("text")).otherwise(done).alias("text"), source.alias("engine"), F.when(F.col("_matched") & F.col("_d").isNull(), F.col("_best")).alias("confidence"),
        T.detect_script(F.coalesce(new, F.col("text"))).alias("script"),
    )


def block_rects(blocks: DataFrame) -> DataFrame:
    """Boxes of a page's blocks (page_id, reading_order, text, x0, ... or nulls, width, height): cut to the page, and, where there is
    none over a point wide and high, a band of the page by the block's place among those with text."""
    page = Window.partitionBy("page_id").orderBy("reading_order")
    b = blocks.where("trim(text) <> ''").withColumn("_i", F.row_number().over(page) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
    band = F.greatest(F.lit(18.0), F.greatest(F.lit(1.0), F.col("height")) / F.col("_n"))
    x0, y0, x1, y1 = F.greatest("x0", F.lit(0.0)), F.greatest("y0", F.lit(0.0)), F.least("x1", "width"), F.least("y1", "height")
    good = F.coalesce(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & (x1 - x0 > 1) & (y1 - y0 > 1), F.lit(False))
    top = F.least(F.col("height") - 1, F.col("_i") * band)
    pick = lambda own, other: F.when(good, own).otherwise(other)
    return b.select("page_id", "reading_order", pick(x0, F.lit(0.0)).alias("x0"), pick(y0, top).alias("y0"), pick(x1, F.col("width")).alias("x1"), pick(y1, F.least(F.col("height"), F.greatest(top + 18.0, top + band))).alias("y1"), good.alias("own"))


def contours(found: DataFrame) -> DataFrame:
    """Regions (page_id, id, w, h, width, height, overlap with text, edges: share of edge pixels) that may be figures, with their
    score: neither tiny, thin nor the whole page, not mostly text, and not plain where there is text."""
    area = F.col("w") * F.col("h") / (F.col("width") * F.col("height"))
    fits = (area >= 0.015) & (area < 0.70) & (F.col("w") / F.col("width") >= 0.10) & (F.col("h") / F.col("height") >= 0.08)
    lined = (F.col("overlap") <= 0.60) & ~((F.col("edges") < 0.012) & (F.col("overlap") > 0.30))
    return found.where(fits & lined).select("page_id", "id", F.round(F.col("edges") + (0.5 - F.col("overlap")), 6).alias("score"))


def placements(rects: DataFrame, least: float = 2.0) -> DataFrame:
    """Image rectangles with both sides over `least`."""
    return rects.where((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))


def union_boxes(rects: DataFrame, key: list[str], least: float = 2.0) -> DataFrame:
    """The box around each group's boxes; none where a side is `least` or less."""
    u = rects.groupBy(*key).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return u.where((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least))


def page_text(blocks: DataFrame) -> DataFrame:
    """(page_id, text): the blocks' texts from top to bottom and left to right."""
    rows = F.array_sort(F.collect_list(F.struct("y0", "x0", "reading_order", T.compact(F.coalesce("text", F.lit(""))).alias("t"))))
    return blocks.groupBy("page_id").agg(rows.alias("r")).select("page_id", F.array_join(F.filter(F.transform("r", lambda x: x["t"]), lambda t: t != ""), " ").alias("text"))


def image_ratio(images: DataFrame) -> DataFrame:
    """(page_id, ratio, heavy): the largest image's share of its page (1 at most), heavy from 0.75 on."""
    area = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0.0), F.col("y1") - F.col("y0")) / F.greatest(F.col("width") * F.col("height"), F.lit(1.0))
    r = images.groupBy("page_id").agg(F.round(F.least(F.lit(1.0), F.max(area)), 6).alias("ratio"))
    return r.withColumn("heavy", F.col("ratio") >= 0.75)
