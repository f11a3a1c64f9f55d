"""Chunks from units: greedy packing, word windows, types, bridges across pages, tables as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T

TARGET, CAP, OVERLAP = 180, 300, 40


def group_numbers(units: Column, target: int = TARGET, cap: int = CAP) -> Column:
    """Number of the chunk that each unit (an ordered array of structs with kind and n) of a page goes to. Verses and captions
    stand alone; rows and prose don't mix; a unit that would pass the cap opens a chunk without being held against the
    target. The fold is sequential by nature; it runs over one page's units."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("held"), F.lit(False).alias("row"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, u: Column) -> Column:
        alone, row = u["kind"].isin("caption", "shloka"), u["kind"] == "table_row"
        held = F.when((s["held"] > 0) & (row != s["row"]), 0).otherwise(s["held"])
        over = held + u["n"] > cap
        chunk = s["chunk"] + F.when(alone | over | (held == 0), 1).otherwise(0)
        total = F.when(alone, 0).when(over, u["n"]).when(held + u["n"] >= target, 0).otherwise(held + u["n"])
        return F.struct(chunk.alias("chunk"), total.cast("int").alias("held"), F.when(alone, s["row"]).otherwise(row).alias("row"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(units, start, step, lambda s: s["out"])


def grouped(pages: DataFrame, key: list[str]) -> DataFrame:
    """One row a chunk (key, chunk, u: its units in order) of pages (key, u: all units in order). A unit goes to its chunk once; the
    pages' partitions hold, as their key is part of the chunks'."""
    each = pages.withColumn("g", group_numbers(F.col("u"))).select(*key, F.posexplode(F.arrays_zip("u", "g")).alias("_at", "x"))
    own = each.groupBy(*key, F.col("x.g").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("_at", F.col("x.u").alias("u")))).alias("m"))
    return own.select(*key, "chunk", F.transform("m", lambda x: x["u"]).alias("u"))


def pack(units: DataFrame) -> DataFrame:
    """(book, page_number, page_id, chunk, units, kinds, text) from units with a kind; noise and labels are left out."""
    kept = units.where(~F.col("kind").isin("noise", "label"))
    fact = F.struct("reading_order", "kind", T.word_count(F.col("text")).alias("n"), "text")
    pages = kept.groupBy("book", "page_number", "page_id").agg(F.array_sort(F.collect_list(fact)).alias("u"))
    one = grouped(pages, ["book", "page_number", "page_id"])
    return one.select("book", "page_number", "page_id", "chunk", F.size("u").alias("units"), F.transform("u", lambda x: x["kind"]).alias("kinds"), F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("text"))


def word_windows(df: DataFrame, text: str = "text", size: int = CAP, overlap: int = OVERLAP) -> DataFrame:
    """Add part and replace the text by windows of `size` words, each `overlap` words into the one before. Texts of `size`
    words or fewer stay as they are."""
    words = T.word_list(F.col(text))
    n = F.size("_w")
    step = max(1, size - overlap)
    # As many windows as it takes for one to reach the end.
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    parts = df.withColumn("_w", words).withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)))
    cut = F.array_join(F.slice("_w", F.col("part") * step + 1, F.lit(size)), " ")
    return parts.withColumn(text, F.when(n <= size, F.col(text)).otherwise(cut)).drop("_w")


def chunk_type(kinds: Column, text: Column, units: Column) -> Column:
    first = F.element_at(kinds, 1)
    rows = F.size(F.filter(kinds, lambda k: k == "table_row"))
    loose = F.size(F.filter(F.split(text, "\n\n"), T.is_loose_table_row))
    half = F.floor(units / 2)
    table = text.rlike(r"(?i)^\s*table\s+\S") | (rows >= F.greatest(F.lit(1), half)) | (loose >= F.greatest(F.lit(2), half))
    return F.when(first == "caption", "image_caption").when(first == "shloka", "shloka").when(table, "table_text").when(first == "heading", "section_intro").otherwise("paragraph")


def verse_number(text: Column) -> Column:
    """The leading number of a verse, null without one."""
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+(\.\d+)?)(?![\p{L}\p{N}_])", 1), F.lit(""))


def bridges(chunks: DataFrame, cap: int = CAP) -> DataFrame:
    """(book, first, second, text): consecutive chunks (book, page_number, page_id, chunk, chunk_type, section, text) on
    consecutive pages whose text runs on."""
    # A page's last chunk meets the first one of the page after by a join; no window runs over the book.
    facts = ("page_id", "chunk", "chunk_type", "section", "text")
    at, fact = F.struct("page_id", "chunk"), F.struct(*facts)
    ends = chunks.groupBy("book", "page_number").agg(F.max_by(fact, at).alias("e"), F.min_by(fact, at).alias("f"))
    last = ends.select("book", "page_number", *(F.col(f"e.{c}").alias(c) for c in facts))
    following = ends.select("book", (F.col("page_number") - 1).alias("page_number"), *(F.col(f"f.{c}").alias(f"n_{c}") for c in facts))
    pair = last.join(following, ["book", "page_number"])
    runs_on = (
        ~F.col("chunk_type").isin("image_caption", "table_text")
        & ~F.col("n_chunk_type").isin("image_caption", "table_text", "section_intro")
        & ~F.coalesce(F.col("section") != F.col("n_section"), F.lit(False))
        & (F.col("text") != "") & (F.col("n_text") != "") & ~F.col("text").rlike("[.:?!]$")
    )
    name = lambda p, c: F.concat_ws(":", F.col(p).cast("string"), F.col(c).cast("string"))
    joined = F.array_join(F.slice(T.word_list(F.concat_ws(" ", "text", "n_text")), 1, cap), " ")
    return pair.where(runs_on).select("book", name("page_id", "chunk").alias("first"), name("n_page_id", "n_chunk").alias("second"), joined.alias("text"))


def cells(text: Column) -> Column:
    """Cells of a row: the parts between bars, or the whole."""
    return F.filter(F.transform(F.split(T.compact(text), r"\|"), lambda x: F.trim(x)), lambda c: c != "")


def markdown(rows: Column) -> Column:
    """Markdown of an array of rows: a caption if the first row is one cell that starts with `table`, then a list (one column)
    or a table whose first row is the head; short rows are filled up. Null for no row."""
    first = F.element_at(rows, 1)
    caption = F.when((F.size(first) == 1) & F.lower(F.element_at(first, 1)).startswith("table"), F.element_at(first, 1))
    body = F.when(caption.isNotNull(), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    wide = F.array_max(F.transform(body, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    lines = F.transform(body, line)
    grid = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    listed = F.transform(body, lambda r: F.concat(F.lit("- "), F.element_at(r, 1)))
    text = F.array_join(F.concat(F.array_compact(F.array(caption)), F.when(wide == 1, listed).otherwise(grid)), "\n")
    return F.when(F.size(rows) > 0, F.when(F.size(body) == 0, caption).otherwise(text))
