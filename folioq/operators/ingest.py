"""The remaining steps from files to points: figures and chunks, routes, caches, frames, placements."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.functions import text as T
from folioq.operators.pagewise import by_pages


def link_figures(images: DataFrame, chunks: DataFrame) -> DataFrame:
    """(image_id, linked): for each image with caption units, the chunks that hold one of them, in order. Images without a
    caption unit in any chunk are absent."""
    units = images.select("image_id", F.explode("caption_unit_ids").alias("unit_id")).distinct()
    held = chunks.select("chunk_id", F.explode("source_unit_ids").alias("unit_id")).distinct()
    return units.join(held, "unit_id").groupBy("image_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("linked"))


def text_candidate(heading: Column, text: Column, markdown: Column) -> dict[str, Column]:
    """snippet and rerank_text of a text row: the first of its parts that is not blank, and all of them."""
    parts = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (heading, text, markdown)]
    return {"snippet": T.snippet(F.coalesce(parts[1], parts[2], parts[0], F.lit(""))), "rerank_text": F.concat_ws("\n\n", *parts)}


def image_candidate(caption: Column, around: Column, labels: Column, path: Column) -> dict[str, Column]:
    parts = [F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")) for c in (caption, F.array_join(labels, " "), around, F.array_join(path, " / "))]
    return {"snippet": T.snippet(F.coalesce(parts[0], parts[2], parts[1], F.lit(""))), "rerank_text": F.concat_ws("\n\n", *parts)}


def page_measures(units: DataFrame) -> DataFrame:
    """One row a page of units (page_id, text, x0, x1): what decides on its parser and on its repair."""
    t, n = F.col("text"), T.word_count(F.col("text"))
    low = F.lower(t)
    is_anchor = low.rlike(r"(?<!\w)table(?!\w)|(?<!\w)s\.?\s*no(?!\w)|sample no|parameter")
    is_row = t.rlike(T.SERIAL) | F.contains("text", F.lit("|")) | ((T.numbers(t) >= 2) & (n <= 12))
    centre = (F.col("x0") + F.col("x1")) / 2
    # What a line's text says is settled before lines meet, so that texts don't travel.
    size, bad, long, anchor, row, dense = (F.col(c) for c in ("_size", "_bad", "_long", "_anchor", "_row", "_dense"))
    units = units.select("page_id", centre.alias("_c"), F.length("text").alias("_size"), T.is_garbled(t).alias("_bad"), (F.length("text") >= 40).alias("_long"), is_anchor.alias("_anchor"), is_row.alias("_row"), T.is_numeric_dense(t).alias("_dense"))
    page = Window.partitionBy("page_id")
    u = units.withColumn("_n", F.count(F.lit(1)).over(page)).withColumn("_k", F.row_number().over(page.orderBy("_c")))
    u = u.withColumn("_mid", F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col("_c"))).over(page))
    m = u.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("anchors"), F.count_if(row).alias("rows"), F.count_if(dense).alias("dense"),
        F.count_if(F.col("_c") <= F.col("_mid")).alias("left"), (F.max("_c") - F.min("_c")).alias("spread"),
        F.count_if(bad & long).alias("bad_long"), F.count_if(long).alias("long"), F.count_if(bad & (size >= 5)).alias("suspect"), F.count_if(size >= 5).alias("substantial"),
    )
    side = F.greatest(F.lit(2), F.floor(F.col("n") * 0.25))
    two = (F.col("n") >= 6) & (F.col("spread") >= 120) & (F.col("left") >= side) & (F.col("n") - F.col("left") >= side)
    parser = (
        F.when((F.col("anchors") >= 1) & (F.col("rows") >= 1), "table_anchor").when(F.col("rows") >= 3, "table_rows")
        .when(two & ((F.col("rows") >= 1) | (F.col("dense") >= 2)), "complex_layout").otherwise("simple_layout")
    )
    mixed = (F.col("substantial") >= 2) & (F.col("suspect") > 0) & (F.col("suspect") < F.col("substantial")) & (F.col("suspect") / F.col("substantial") < 0.75)
    garbled = (F.col("bad_long") >= 1) & (F.col("bad_long") / F.greatest(F.col("long"), F.lit(1)) >= 0.30)
    return m.select("page_id", "n", "rows", two.alias("two_columns"), parser.alias("structure"), mixed.alias("mixed"), garbled.alias("garbled"))


def route(blank: Column, page_type: Column, reason: Column, structure: Column) -> Column:
    """The page's way in: blank, ocr, structured, native."""
    return (
        F.when(blank, "blank").when(reason == "empty_native", "ocr").when(reason.startswith("quality:") | (reason == "parser_garbled"), "ocr")
        .when(page_type.isin("scanned", "ocr_fallback"), "ocr").when(structure != "simple_layout", "structured").otherwise("native")
    )


def fill_cache(cached: DataFrame, parsed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page, unit_id, text) of all wanted pages: cached ones as they are, others from a parse of a window whose pages count
    from 1; its unit ids are renumbered. Pages without units get one row of nulls."""
    missing = wanted.join(cached.select("page").distinct(), "page", "left_anti")
    moved = parsed.withColumn("page", F.col("local_page") + F.col("first") - 1)
    moved = moved.select("page", F.regexp_replace("unit_id", F.lit(r":p\d+:"), F.concat(F.lit(":p"), F.col("page").cast("string"), F.lit(":"))).alias("unit_id"), "text")
    both = cached.select("page", "unit_id", "text").union(moved.join(missing, "page", "left_semi"))
    return wanted.join(both, "page", "left")


def markdown_rows(text: Column) -> Column:
    """Rows of a Markdown table: cells between bars, without the separator rows."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(r"^[|:\s-]+$"))
    return F.filter(F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")), lambda r: F.size(r) > 0)


def frames(body: Column) -> Column:
    """Events of a server's stream as an array of (event, data): frames are parted by blank lines, data lines joined."""

    def one(frame: Column) -> Column:
        lines = F.split(frame, "\n")
        event = F.regexp_extract(frame, r"(?m)^event:[ ]?(.*)$", 1)
        data = F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("data:"))), lambda x: F.regexp_replace(x, "^data:[ ]?", "")), "\n")
        return F.struct(F.when(event == "", "message").otherwise(event).alias("event"), data.alias("data"))

    return F.transform(F.filter(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n\n"), lambda f: f.rlike("(?m)^data:")), one)


def slots(lines: DataFrame, n: Column) -> DataFrame:
    """Add slot: the lines (key, seq) of a key spread in order over n slots, the first ones taking one more. Fewer lines than
    slots fill the first."""
    by = Window.partitionBy("key")
    total, at = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy("seq")) - 1
    d = lines.withColumn("_m", total).withColumn("_i", at).withColumn("_n", n)
    base, extra = F.floor(F.col("_m") / F.col("_n")), F.col("_m") % F.col("_n")
    wide = extra * (base + 1)
    slot = F.when(F.col("_i") < wide, F.floor(F.col("_i") / (base + 1))).otherwise(extra + F.floor((F.col("_i") - wide) / F.greatest(base, F.lit(1))))
    return d.withColumn("slot", slot.cast("int")).drop("_m", "_i", "_n")


def to_page(px0: Column, py0: Column, px1: Column, py1: Column, image: tuple[Column, Column], page: tuple[Column, Column]) -> list[Column]:
    """Pixel boxes in points, within the page."""
    scale = [p / F.greatest(i, F.lit(1)) for i, p in zip(image, page, strict=True)]
    return [F.least(F.greatest(v * scale[k % 2], F.lit(0.0)), page[k % 2]) for k, v in enumerate((px0, py0, px1, py1))]


def flip(y0: Column, y1: Column, height: Column) -> tuple[Column, Column]:
    """Heights counted from the bottom as counted from the top, in order."""
    return F.least(height - y1, height - y0), F.greatest(height - y1, height - y0)


def validated(requests: DataFrame) -> DataFrame:
    """Requests (query, page_start, page_end, languages) in clean form with `error`, null for those that may run."""
    query = T.compact(F.coalesce("query", F.lit("")))
    listed = F.array_distinct(F.filter(F.transform("languages", lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    error = (
        F.when(query == "", "query is empty").when((F.col("page_start") < 1) | (F.col("page_end") < 1), "pages begin at 1").when(F.col("page_end") < F.col("page_start"), "page_end is before page_start")
    )
    return requests.withColumns({"query": query, "languages": F.coalesce(listed, F.array().cast("array<string>")), "error": error})


def embed_once(queries: DataFrame, embed) -> DataFrame:  # noqa: ANN001
    """`queries` with what `embed` (a function of a DataFrame with `text`) adds, each distinct text embedded once."""
    return queries.join(embed(queries.select("text").distinct()), "text")


def _near_pairs(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of boxes of one page that meet after growing by `reach`, in portions of a row's number at most. Rows are taken
    by height, and each is held against the next, the one after it, and so on, as long as any can still meet."""
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    order = np.lexsort((low, page))
    page, x0, y0, x1, y1, low, high = (c[order] for c in (page, x0, y0, x1, y1, low, high))
    at = np.arange(len(page))
    step = 0
    while len(at):
        step += 1
        at = at[at + step < len(page)]
        # low rises within a page: a row that the one `step` below doesn't reach meets none below that.
        at = at[(page[at] == page[at + step]) & (low[at + step] - reach <= high[at] + reach)]
        b = at + step
        met = (x0[at] - reach <= x1[b] + reach) & (x1[at] + reach >= x0[b] - reach) & (y0[at] - reach <= y1[b] + reach) & (y1[at] + reach >= y0[b] - reach)
        if met.any():
            yield order[at[met]], order[b[met]]


def _groups_of(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, reach: float) -> np.ndarray:
    """Least row of each box's component, boxes of a page that overlap after growing by `reach` being linked."""
    root = np.arange(len(page))
    for a, b in _near_pairs(page, x0, y0, x1, y1, reach):
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while (root[root] != root).any():
                root = root[root]
    return root


def components(placements: DataFrame, reach: float = 10.0) -> DataFrame:
    """Placements (page_id, id, x0, y0, x1, y1) with `component`, the least place in the page's order by id of those linked."""

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        found = _groups_of(c["page_id"], c["x0"], c["y0"], c["x1"], c["y1"], reach)
        return {"page_id": c["page_id"], "id": c["id"], "component": found - np.searchsorted(c["page_id"], c["page_id"])}

    return by_pages(placements.select("page_id", "id", "x0", "y0", "x1", "y1"), [F.col("id")], run, "page_id long, id long, component long")


def suppress(boxes: DataFrame, most: float = 0.60) -> DataFrame:
    """(page_id, id) of the boxes that stay when, by falling score, each removes those that share `most` of the union with it."""

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x0, y0, x1, y1 = (c[n] for n in ("x0", "y0", "x1", "y1"))
        size = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0)
        firsts, lasts = [np.zeros(0, int)], [np.zeros(0, int)]
        for a, b in _near_pairs(c["page_id"], x0, y0, x1, y1, 0.0):
            w, h = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b]), np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
            inter = np.where((w > 0) & (h > 0), w * h, 0)
            alike = inter / np.maximum(size[a] + size[b] - inter, 1e-9) >= most
            firsts.append(np.minimum(a, b)[alike])
            lasts.append(np.maximum(a, b)[alike])
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        # Rows come by falling score, so the earlier of a pair decides on the later one.
        keep = [True] * len(x0)
        order = np.argsort(last, kind="stable")
        for a, b in zip(first[order].tolist(), last[order].tolist(), strict=True):
            if keep[a]:
                keep[b] = False
        keep = np.array(keep, bool)
        return {"page_id": c["page_id"][keep], "id": c["id"][keep]}

    return by_pages(boxes.select("page_id", "id", "score", "x0", "y0", "x1", "y1"), [F.desc("score"), F.asc("id")], run, "page_id long, id long")


def dedupe_placements(placements: DataFrame, near: float = 0.5) -> DataFrame:
    """Placements (by id) without those that repeat one kept before, of the same page and xref, within `near` points. The fold runs
    over one page's placements of an xref."""
    fact = F.struct("id", "x0", "y0", "x1", "y1")
    groups = placements.groupBy("page_id", "xref").agg(F.array_sort(F.collect_list(fact)).alias("p"))
    close = lambda a, b: F.forall(F.array(*(F.abs(a[c] - b[c]) <= near for c in ("x0", "y0", "x1", "y1"))), lambda x: x)
    kept = F.aggregate("p", F.slice("p", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: close(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select("page_id", "xref", F.inline(kept))
