"""Records that go to the store: chunks with ids, ordinals and provenance, bridges among them, figures on pages, vectors.

Units have book, page_number, page_id, reading_order, kind, text, section, unit_id, languages and scripts (arrays), engine
and route. Windows run over a page; what is counted over a book is summed page by page.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.functions import text as T
from folioq.operators import chunking as C
from folioq.operators.layout import PAGES
from folioq.operators.pagewise import by_pages
from folioq.operators.retrieval import top
from folioq.sources.shared import stash

#: Routes and engines whose text was recognised rather than read.
RECOGNISED, ENGINES = ("ocr", "ocr_fallback", "scanned"), ("vision", "ocr")


def union_distinct(lists: Column) -> Column:
    """The values of an array of arrays in order of appearance, each once; `unknown` for none."""
    found = F.array_distinct(F.flatten(F.filter(lists, lambda x: x.isNotNull())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def page_chunks(units: DataFrame) -> DataFrame:
    """One row a chunk of a page (n from 0 within it), words over the cap cut into windows; noise and labels are left out."""
    kept = units.where(~F.col("kind").isin("noise", "label"))
    fact = F.struct("reading_order", "kind", T.word_count(F.col("text")).alias("n"), "text", "section", "unit_id", "languages", "scripts", "engine")
    pages = kept.groupBy("book", "page_number", "page_id", "route").agg(F.array_sort(F.collect_list(fact)).alias("u"))
    pick = lambda name: F.transform("u", lambda x: x[name])
    m = C.grouped(pages, ["book", "page_number", "page_id", "route"])
    kinds, text = pick("kind"), F.array_join(pick("text"), "\n\n")
    typed = m.select(
        "book", "page_number", "page_id", "route", "chunk", text.alias("text"), C.chunk_type(kinds, text, F.size("u")).alias("chunk_type"), F.element_at(pick("section"), -1).alias("section"), pick("unit_id").alias("unit_ids"),
        union_distinct(pick("languages")).alias("languages"), union_distinct(pick("scripts")).alias("scripts"),
        F.when(F.col("route").isin(*RECOGNISED) | F.exists(pick("engine"), lambda e: F.lower(F.trim(e)).isin(*ENGINES)), "vision").alias("ocr_source"),
    )
    cut = C.word_windows(typed)
    return cut.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("chunk", "part")) - 1).drop("chunk", "part")


def chunk_records(units: DataFrame) -> DataFrame:
    """Chunks with `ordinal`, counted from 0 through the book, and `chunk_id` book:pPAGE-PAGE:type:ordinal."""
    # Read again for the numbers of chunks, and by what reads the records several times.
    chunks = stash(page_chunks(units), "chunks")
    sizes = chunks.groupBy("book", "page_number", "page_id").agg(F.count(F.lit(1)).alias("chunks"))
    # Sums of the blocks of pages before, then of the block's pages before.
    sizes = sizes.withColumn("_block", F.floor(F.col("page_number") / PAGES))
    earlier = Window.partitionBy("book").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("book", "_block").agg(F.sum("chunks").alias("_n")).select("book", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    before = Window.partitionBy("book", "_block").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("book", "_block", "page_id", F.coalesce(F.sum("chunks").over(before), F.lit(0)).alias("_within"))
    start = within.join(blocks, ["book", "_block"]).select("page_id", (F.col("_before") + F.col("_within")).alias("_start"))
    c = chunks.join(start, "page_id").withColumn("ordinal", F.col("_start") + F.col("n")).drop("_start")
    page = F.col("page_number").cast("string")
    verse = F.col("chunk_type") == "shloka"
    return c.withColumns({
        "chunk_id": F.concat("book", F.lit(":p"), page, F.lit("-"), page, F.lit(":"), "chunk_type", F.lit(":"), F.col("ordinal").cast("string")),
        "table_id": F.when(F.col("chunk_type") == "table_text", F.concat("book", F.lit(":p"), page, F.lit(":table:"), F.col("ordinal").cast("string"))),
        "is_multilingual": (F.size("languages") > 1) | (F.size("scripts") > 1), "shloka_number": F.when(verse, C.verse_number(F.col("text"))),
    })


def with_bridges(records: DataFrame) -> DataFrame:
    """Normal chunks and then the bridges between consecutive ones that run on over a page's end, numbered after them: (book, chunk_id,
    chunk_type, page_start, page_end, ordinal, text, sources, place), place being the order by chunk_id on the first page."""
    b = C.bridges(records.select("book", "page_number", "page_id", F.col("n").alias("chunk"), "chunk_type", "section", "text"))
    key = F.concat_ws(":", F.col("page_id").cast("string"), F.col("n").cast("string"))
    known = records.select(key.alias("key"), "chunk_id", "page_number", "ordinal")
    left, right = (known.select(F.col("key").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("chunk_id", "page_number", "ordinal"))) for end in ("first", "second"))
    totals = records.groupBy("book").agg(F.count(F.lit(1)).alias("total"))
    # At most one bridge begins on a page, so the window sees a row a page at most.
    made = b.join(left, "first").join(right, "second").join(totals, "book").withColumn("ordinal", F.col("total") + F.row_number().over(Window.partitionBy("book").orderBy("first_ordinal")) - 1)
    pages = F.concat(F.col("first_page_number").cast("string"), F.lit("-"), F.col("second_page_number").cast("string"))
    bridges = made.select(
        "book", F.concat("book", F.lit(":p"), pages, F.lit(":page_bridge:"), F.col("ordinal").cast("string")).alias("chunk_id"), F.lit("page_bridge").alias("chunk_type"),
        F.col("first_page_number").alias("page_start"), F.col("second_page_number").alias("page_end"), "ordinal", "text", F.array("first_chunk_id", "second_chunk_id").alias("sources"),
    )
    plain = records.select("book", "chunk_id", "chunk_type", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "ordinal", "text", F.array().cast("array<string>").alias("sources"))
    return plain.unionByName(bridges).withColumn("place", F.row_number().over(Window.partitionBy("book", "page_start").orderBy("chunk_id")))


def keep_longest(units: DataFrame, least: int = 30, share: float = 0.60) -> DataFrame:
    """Units of a page without near duplicates, in order of (column_id, y0, x0, reading_order): a unit that is like one kept before
    takes its place if its text is longer, and goes if not. Like: both `least` characters or more, one's text within the
    other's, `share` of the lower height in common. The fold runs over one page's units."""
    t = F.lower(T.compact(F.coalesce("text", F.lit(""))))
    facts = units.select("page_id", "column_id", "y0", "x0", "reading_order", "y1", F.when(F.length(t) >= least, t).otherwise("").alias("t"))

    def run(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        page, column, top, end, text = (c[n].tolist() for n in ("page_id", "column_id", "y0", "y1", "t"))
        kept: list[int] = []  # row of each slot
        starts: list[int] = []  # slot with which each row's page begins
        open_: list[int] = []  # slots that units from here on can overlap
        first = 0
        for k in range(len(page)):
            if k == 0 or page[k] != page[k - 1]:
                first, open_ = len(kept), []
            elif column[k] != column[k - 1]:
                open_ = list(range(first, len(kept)))  # heights begin anew
            open_ = [s for s in open_ if end[kept[s]] > top[k]]
            found = None
            if text[k]:
                for s in open_:
                    o = kept[s]
                    if text[o] and (text[o] in text[k] or text[k] in text[o]):
                        common = max(0.0, min(end[o], end[k]) - max(top[o], top[k]))
                        if common / max(1.0, min(end[o] - top[o], end[k] - top[k])) >= share:
                            found = s
                            break
            if found is None:
                open_.append(len(kept))
                starts.append(first)
                kept.append(k)
            elif len(text[k]) > len(text[kept[found]]):
                kept[found] = k
        rows = np.array(kept, int)
        return {"page_id": c["page_id"][rows], "reading_order": c["reading_order"][rows], "place": np.arange(len(rows)) - np.array(starts, int)}

    return by_pages(facts, [F.col(n) for n in ("column_id", "y0", "x0", "reading_order")], run, "page_id long, reading_order int, place int")


def page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages with their figures as an ordered array `images` (empty for none)."""
    listed = images.groupBy("book", F.col("page").alias("page_number")).agg(F.array_sort(F.collect_list("image_id")).alias("_i"))
    return pages.join(listed, ["book", "page_number"], "left").withColumn("images", F.coalesce("_i", F.array().cast("array<string>"))).drop("_i")


def image_payload(images: DataFrame) -> DataFrame:
    """Figures as they are stored: the text that is embedded (caption, text around, or id), and constants for unknown language and
    script."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return images.withColumns({"embedding_text": F.coalesce(filled("caption"), filled("surrounding"), F.col("image_id")), "languages": F.array(F.lit("unknown")), "scripts": F.array(F.lit("Zyyy"))})


def caption_candidates(text: Column) -> Column:
    """The captions of the form `Figure 3 (a): ...` in a page's text, each up to the next; short ones are left out."""
    flat = T.compact(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(flat, F.lit(r"(?i)(Figure\s*\d+\s*\([a-z]\)\s*:\s*.*?)(?=\s*Figure\s*\d+\s*\([a-z]\)\s*:|$)"), F.lit(1))
    return F.filter(F.transform(found, lambda c: F.regexp_replace(T.compact(c), r"^[ .;,-]+|[ .;,-]+$", "")), lambda c: F.length(c) >= 12)


def captions_by_place(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """(page_id, figure, caption): a page's captions go to its figures (figure from 0 in reading order) place by place."""
    each = pages.select("page_id", F.posexplode(caption_candidates(F.col("text"))).alias("figure", "caption"))
    return figures.join(each, ["page_id", "figure"])


def reading_order(placements: DataFrame) -> DataFrame:
    """Placements with `figure`, from 0 by rows of 20 points and then from left to right."""
    row = F.floor((F.col("y0") + 10) / 20)
    return placements.withColumn("figure", F.row_number().over(Window.partitionBy("page_id").orderBy(row, "x0", "id")) - 1)


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Points: chunks joined with their vectors by key, without the text that only served embedding."""
    return chunks.drop("text_for_embedding").join(vectors, key)


def flattened(units: DataFrame) -> DataFrame:
    """Blocks in order with the latest heading of their page so far."""
    so_far = Window.partitionBy("page_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    return units.withColumn("heading_context", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(so_far), F.lit("")))


def first_rows(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return top(rows, key, order, most, "_place").drop("_place")
