"""Page model: furniture, layout and reading order, sections, table context, native block kinds, duplicate units.

All of it works on units (book, page_number, page_id, reading_order, text, x0, y0, x1, y1). Windows run over one page; what
runs over a book sees one row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from folioq.functions import text as T
from folioq.operators.retrieval import small

#: Pages of a book that a task sees together where something is carried through the book.
PAGES = 500


def page() -> WindowSpec:
    """Rows of one page."""
    return Window.partitionBy("page_id")


def mark_noise(units: DataFrame, strong: int = 2, generic: int = 3) -> DataFrame:
    """Add `noise`: texts that recur in the margins of several pages of a book, wherever they stand, and page numbers."""
    t, height = F.col("text"), F.greatest(F.max("y1").over(page()), F.lit(1.0))
    u = units.withColumn("_h", height)
    above, below = F.col("y1") <= F.col("_h") * 0.14, F.col("y0") >= F.col("_h") * 0.84
    norm, n = F.col("_norm"), T.word_count(F.col("_norm"))
    number = T.is_page_number(t) & (above | below)
    kind = (
        F.when(norm.rlike(T.FURNITURE) | number, "strong")
        .when(above & (n <= 12) & (t.contains(":") | norm.rlike(r"(?<!\w)et\s*al(?!\w)|etal")), "generic")
        .when(below & (n <= 8) & (F.length(norm) <= 70), "generic")
    )
    # Only short lines in the margins can recur as furniture; the rest is left out before its form is made.
    margin = u.where((above | below) & (F.length(t) <= 140)).withColumn("_norm", T.noise_form(t)).where("_norm <> ''").withColumn("_kind", kind)
    seen = margin.where("_kind IS NOT NULL").groupBy("book", "_norm").agg(
        F.count_distinct(F.when(F.col("_kind") == "strong", F.col("page_id"))).alias("s"), F.count_distinct(F.when(F.col("_kind") == "generic", F.col("page_id"))).alias("g")
    )
    repeated = seen.where((F.col("s") >= strong) | (F.col("g") >= generic)).select("book", "_norm", F.lit(True).alias("_repeated"))
    u = u.withColumn("_number", number).withColumn("_norm", T.noise_form(t))
    out = u.join(small(repeated, 200_000), ["book", "_norm"], "left").withColumn("noise", F.coalesce(F.col("_repeated"), F.lit(False)) | F.col("_number"))
    return out.drop("_h", "_norm", "_number", "_repeated")


def lay_out(units: DataFrame) -> DataFrame:
    """Add layout (single, two_column), column_id and position: the reading order by column, then top, then left."""
    centre = (F.col("x0") + F.col("x1")) / 2
    u = units.withColumn("_c", centre).withColumn("_n", F.count(F.lit(1)).over(page())).withColumn("_lo", F.min("_c").over(page())).withColumn("_hi", F.max("_c").over(page()))
    u = u.withColumn("_left", F.count_if(F.col("_c") <= (F.col("_lo") + F.col("_hi")) / 2).over(page()))
    right = F.col("_n") - F.col("_left")
    two = (F.col("_n") >= 4) & (F.col("_hi") > F.col("_lo")) & (F.col("_left") > 0) & (right > 0) & (F.abs(F.col("_left") - right) <= F.greatest(F.lit(2), F.floor(F.col("_n") / 2)))
    u = u.withColumn("layout", F.when(two, "two_column").otherwise("single"))
    nth = F.row_number().over(page().orderBy("_c", "reading_order"))
    median = F.max(F.when(F.col("_nth") == F.floor(F.col("_n") / 2) + 1, F.col("_c"))).over(page())
    u = u.withColumn("_nth", nth).withColumn("_mid", median).withColumn("column_id", F.when((F.col("layout") == "two_column") & (F.col("_c") > F.col("_mid")), 1).otherwise(0))
    place = F.row_number().over(page().orderBy("column_id", "y0", "x0", "reading_order")) - 1
    return u.withColumn("position", place).drop("_c", "_n", "_lo", "_hi", "_left", "_nth", "_mid")


def sections(units: DataFrame) -> DataFrame:
    """Add kind (heading, table_row, paragraph) and section: the latest heading of the book so far."""
    row = T.is_table_row(F.col("text"))
    u = units.withColumn("_row", row).withColumn("_heavy", F.count_if("_row").over(page()) >= 5)
    heading = ~F.col("_row") & T.is_section_heading(F.col("text"), F.col("_heavy"), F.lit(False))
    u = u.withColumn("kind", F.when(F.col("_row"), "table_row").when(heading, "heading").otherwise("paragraph"))
    u = u.withColumn("_title", F.when(F.col("kind") == "heading", F.col("text")))
    pages = u.groupBy("book", "page_number", "page_id").agg(F.max_by(F.struct("_title"), F.when(F.col("_title").isNotNull(), F.col("reading_order"))).alias("t"))
    # A book's pages go in blocks: the latest heading of the blocks before, then that of the block's pages before.
    pages = pages.withColumn("_block", F.floor(F.col("page_number") / PAGES))
    order = F.when(F.col("t._title").isNotNull(), F.struct("page_number", "page_id"))
    blocks = pages.groupBy("book", "_block").agg(F.max_by("t._title", order).alias("_last"))
    earlier = Window.partitionBy("book").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("book", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    before = Window.partitionBy("book", "_block").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    within = pages.select("book", "_block", "page_id", F.last("t._title", ignorenulls=True).over(before).alias("_within"))
    carried = within.join(blocks, ["book", "_block"]).select("page_id", F.coalesce("_within", "_before").alias("_carried"))
    so_far = page().orderBy("reading_order").rowsBetween(Window.unboundedPreceding, 0)
    out = u.join(carried, "page_id").withColumn("section", F.coalesce(F.last("_title", ignorenulls=True).over(so_far), "_carried"))
    return out.drop("_row", "_heavy", "_title", "_carried")


def promote_rows(units: DataFrame) -> DataFrame:
    """Add `promoted`: units that a table's anchor above makes rows; only paragraphs and rows, where units have a kind. An anchor
    announces 12 units, prose about methods ends them. The fold runs over one page's units."""
    t = F.col("text")
    fits = F.coalesce(F.col("kind").isin("paragraph", "table_row"), F.lit(True)) if "kind" in units.columns else F.lit(True)
    facts = F.struct("reading_order", T.is_table_anchor(t).alias("a"), (T.is_contextual_row(t) & fits).alias("r"), T.is_context_break(t).alias("e"))
    pages = units.groupBy("page_id").agg(F.array_sort(F.collect_list(facts)).alias("f")).where(F.exists("f", lambda x: x["a"]))
    start = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("rows"))

    def step(s: Column, u: Column) -> Column:
        left = F.when(u["a"], F.greatest(s["left"], F.lit(12))).when(s["left"] <= 0, 0).when(u["e"], 0).otherwise(s["left"] - 1)
        promoted = (s["left"] > 0) & ~u["a"] & u["r"]
        return F.struct(left.cast("int").alias("left"), F.when(promoted, F.concat(s["rows"], F.array(u["reading_order"].cast("int")))).otherwise(s["rows"]).alias("rows"))

    flags = pages.select("page_id", F.explode(F.aggregate("f", start, step, lambda s: s["rows"])).alias("reading_order"), F.lit(True).alias("promoted"))
    return units.join(flags, ["page_id", "reading_order"], "left").withColumn("promoted", F.coalesce("promoted", F.lit(False)))


def block_kind(units: DataFrame) -> DataFrame:
    """Add kind as the native parser sees it: noise, table_row, heading, paragraph. The page's size is its units' extent."""
    t = F.col("text")
    u = units.withColumn("_w", F.greatest(F.max("x1").over(page()), F.lit(1.0))).withColumn("_h", F.greatest(F.max("y1").over(page()), F.lit(1.0)))
    w, n, low = F.col("_w"), T.word_count(t), F.lower(t)
    above, below = F.col("y1") <= F.col("_h") * 0.14, F.col("y0") >= F.col("_h") * 0.86
    corner = (F.col("x0") <= w * 0.15) | (F.col("x1") >= w * 0.85)
    furniture = (above | below) & (
        T.is_page_number(t) | low.rlike(T.FURNITURE) | (above & t.contains(":") & low.rlike(r"(?<!\w)et\s*al(?!\w)|etal")) | (corner & low.rlike(r"^\d{1,4}\s+[a-z]")) | t.rlike(r"^[. ]*\d+[. ]*$") & (F.length(t) <= 6)
    )
    wide = (F.col("x1") - F.col("x0")) / w
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - w / 2) <= w * 0.12
    upper, colon = F.upper(t) == t, F.endswith(t, F.lit(":"))
    numbered = F.replace(F.trim(F.left(t, F.lit(6))), F.lit("."), F.lit("")).rlike(r"^\d+$")
    heading = (n <= 16) & ((upper & (wide < 0.9)) | (numbered & (n >= 2)) | (colon & (n <= 12) & (wide < 0.9)) | (centred & (wide < 0.65) & (n >= 2) & (upper | colon)) | (T.is_title_case(t) & (n >= 2) & (n <= 10) & (wide < 0.6)))
    kind = F.when(furniture, "noise").when(T.is_table_row(t, True), "table_row").when(heading, "heading").otherwise("paragraph")
    return u.withColumn("kind", kind).drop("_w", "_h")


def near_duplicate_units(units: DataFrame, least: int = 30) -> DataFrame:
    """(page_id, a, b): units of a page that stand at one height and of which one's text holds the other's. Pairs share the
    page, so the join stays within pages."""
    u = units.withColumn("t", F.lower("text")).where(F.length("t") >= least).select("page_id", "reading_order", "t", "y0", "y1")
    a, b = (u.select("page_id", *(F.col(c).alias(f"{p}_{c}") for c in ("reading_order", "t", "y0", "y1"))) for p in "ab")
    shared = F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    height = F.greatest(F.lit(1.0), F.least(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0")))
    alike = (F.contains("a_t", "b_t") | F.contains("b_t", "a_t")) & (shared / height >= 0.6)
    return a.join(b, "page_id").where(F.col("a_reading_order") < F.col("b_reading_order")).where(alike).select("page_id", F.col("a_reading_order").alias("a"), F.col("b_reading_order").alias("b"))


def page_windows(pages: DataFrame, batch: int, key: str = "book") -> DataFrame:
    """(key, first, last): runs of consecutive page numbers, cut to `batch` pages."""
    rows = pages.where("page_number > 0").select(key, "page_number").distinct()
    run = rows.withColumn("run", F.col("page_number") - F.row_number().over(Window.partitionBy(key).orderBy("page_number")))
    start = F.min("page_number").over(Window.partitionBy(key, "run"))
    part = run.withColumn("part", F.floor((F.col("page_number") - start) / batch))
    return part.groupBy(key, "run", "part").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last")).drop("run", "part")
