"""Adapters that read the engine's entities from tables and files.

`documents` stands in for scanned books: a source is a book, a document a page of it, a line a text unit with a
synthetic box (12 points a line). `embeddings` is the dense collection, `conversations` holds questions, `pages` HTML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import compact

#: Books take turns in the numbering of `documents`, so a page's number in its book follows from its id.
BOOKS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book_pages(documents: DataFrame) -> DataFrame:
    """(book, page_number, page_id, text, lang)."""
    page = F.floor(F.col("doc_id") / BOOKS).cast("long") + 1
    return documents.select(F.col("source").alias("book"), page.alias("page_number"), F.col("doc_id").alias("page_id"), "text", "lang")


def units(pages: DataFrame) -> DataFrame:
    """One row a non-blank line: the page's columns but the text, reading_order, text, and the box x0, y0, x1, y1."""
    kept = [c for c in pages.columns if c != "text"]
    lines = pages.select(*kept, F.posexplode(F.split("text", "\n")).alias("reading_order", "line"))
    line = compact(F.col("line"))
    y = F.col("reading_order") * 12.0
    rows = lines.withColumn("text", line).where("text <> ''").drop("line")
    return rows.select(*kept, "reading_order", "text", F.lit(0.0).alias("x0"), y.alias("y0"), F.length("text").cast("double").alias("x1"), (y + 10).alias("y1"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vec): vectors as doubles."""
    return embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


def questions(conversations: DataFrame) -> DataFrame:
    """(query_id, query) of the user's turns; the id is conv_id * 1000 + turn."""
    user = conversations.where("role = 'user'")
    return user.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("query")).where("query <> ''")


def html_units(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items and captions of HTML pages in document order, with furniture marked as noise."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(h1|h2|h3|p|li|figcaption|nav|footer)(?!\w)[^>]*>(.*?)</\1>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("reading_order", "element"))
    tag = F.lower(F.regexp_extract("element", "(?is)^<([a-z0-9]+)", 1))
    kind = F.when(tag.rlike("^h[1-3]$"), "heading").when(tag == "figcaption", "caption").when(tag.isin("nav", "footer"), "noise").otherwise("paragraph")
    text = F.trim(F.regexp_replace(F.regexp_replace("element", "(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "reading_order", kind.alias("kind"), text.alias("text")).where("text <> ''")


def html_tables(pages: DataFrame) -> DataFrame:
    """Rows of the tables of HTML pages: (page_id, table, row, table_id, caption, header, cells), tables and rows from 0. Rows without a
    cell are left out; a caption that the first row repeats is taken off it."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<table(?!\w)[^>]*>(.*?)</table>"), F.lit(1))
    tables = pages.select("page_id", F.posexplode(found).alias("table", "body"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    caption = plain(F.regexp_extract("body", r"(?is)<caption(?!\w)[^>]*>(.*?)</caption>", 1))
    rows = tables.select("page_id", "table", caption.alias("caption"), F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<tr(?!\w)[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[hd](?!\w)[^>]*>(.*?)</t[hd]>"), F.lit(1)), plain)
    made = rows.select("page_id", "table", "row", "caption", F.col("tr").rlike(r"(?i)<th(?!\w)").alias("header"), cells.alias("cells"))
    kept = made.where((F.size("cells") > 0) & ~((F.size("cells") == 1) & (F.element_at("cells", 1) == F.col("caption"))))
    return kept.withColumn("table_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(":table:"), F.col("table").cast("string")))


def pdf_files(spark: SparkSession, folder: str | None = None, file: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the PDF files under a folder, or of one file; one of the two must be given."""
    if (folder is None) == (file is None):
        raise ValueError("give a folder or a file")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]")
    return (found.option("recursiveFileLookup", True).load(folder) if folder else found.load(file)).orderBy("path")
