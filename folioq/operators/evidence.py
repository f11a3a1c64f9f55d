"""From scored candidates to evidence: boosts, roles, thresholds, prompt and answer.

Candidates have query_id, id, score, kind (text, image), chunk_type, text, heading, caption, labels, section, url, markdown,
table_rows (a number), is_shloka, shloka_number, scripts, source_file, page, linked (ids of text candidates), bridge (ids
of the chunks that a bridge joins), and of their question query, normalized, intent and terms (its keywords). A model's score enters as `score`; models themselves are seams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioq.functions import text as T

_IS = lambda name: F.col("intent") == name
_TABLE = lambda: F.col("chunk_type") == "table_text"


def verse_like() -> Column:
    """A verse chunk or flag, a verse number, Devanagari with a danda or bar, or two lines or more of at most 16 words each."""
    lines = F.filter(F.transform(F.split(F.trim(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    flagged = F.coalesce(F.col("is_shloka"), F.lit(False)) | (F.coalesce("shloka_number", F.lit("")) != "")
    danda = F.coalesce(F.array_contains("scripts", "Deva") & F.col("text").rlike("[।॥|]"), F.lit(False))
    return (F.col("chunk_type") == "shloka") | flagged | danda | ((F.size(lines) >= 2) & F.forall(lines, lambda x: T.word_count(x) <= 16))


def boost(candidates: DataFrame) -> DataFrame:
    """Replace score by the boosted one; what it was stays as base."""
    pool = F.collect_set("id").over(Window.partitionBy("query_id"))
    c = candidates.withColumn("base", F.col("score")).withColumn("_pool", pool)
    added = (
        F.when(_TABLE() & _IS("table"), 0.18).otherwise(0.0)
        + F.when((F.col("chunk_type") == "shloka") & _IS("shloka"), 0.18).otherwise(0.0)
        + F.when(_IS("shloka") & verse_like(), 0.10).otherwise(0.0)
        + F.when((F.col("kind") == "image") & _IS("visual") & (F.size("linked") > 0), 0.12).otherwise(0.0)
        - F.when((F.col("chunk_type") == "page_bridge") & (F.size(F.array_intersect("bridge", "_pool")) >= 2), 0.12).otherwise(0.0)
    )
    return c.withColumn("score", F.round(F.col("base") + added, 6)).drop("_pool")


def useful_image(citations: Column) -> Column:
    terms = F.filter(T.word_list(F.lower("normalized")), lambda t: (F.length(t) >= 4) & ~t.isin("show", "image", "images", "figure", "figures", "diagram", "diagrams"))
    blob = F.lower(F.concat_ws(" ", "caption", "labels", "text", "section"))
    hit, linked = F.exists(terms, lambda t: F.contains(blob, t)), F.coalesce(F.arrays_overlap("linked", citations), F.lit(False))
    fits = F.when(_IS("visual"), linked | hit | (F.col("score") >= 0.92)).otherwise(linked | (hit & (F.col("score") >= 0.2)))
    return F.col("url").isNotNull() & (F.col("score") >= -2.5) & fits


def useful_table() -> Column:
    return _TABLE() & (F.col("table_rows") > 0) & (_IS("table") | ((F.col("score") >= 0) & (F.col("table_rows") >= 2)))


def roles(candidates: DataFrame, pool: int = 8, citations: int = 6, images: int = 2, tables: int = 2) -> DataFrame:
    """Boosted candidates in order (place from 1) with citation, image and table: their rank in that role, null without one."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    cut = candidates.withColumn("_p", F.row_number().over(best)).where(F.col("_p") <= pool).drop("_p")
    c = boost(cut).withColumn("place", F.row_number().over(best))
    nth = lambda flag, most: F.when(flag & (F.count_if(flag).over(best.rowsBetween(Window.unboundedPreceding, 0)) <= most), F.count_if(flag).over(best.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("citation", nth(F.col("kind") == "text", citations))
    cited = F.collect_set(F.when(F.col("citation").isNotNull(), F.col("id"))).over(Window.partitionBy("query_id"))
    c = c.withColumn("_cited", cited).withColumn("_image", (F.col("kind") == "image") & ((F.col("place") == 1) | useful_image(F.col("_cited")))).withColumn("_table", (F.col("kind") == "text") & useful_table())
    return c.withColumn("image", nth(F.col("_image"), images)).withColumn("table", nth(F.col("_table"), tables)).drop("_cited", "_image", "_table")


def cites() -> Column:
    """Whether a citation candidate is shown."""
    said = F.concat_ws(" ", "heading", "section", "text", "caption", "labels", "markdown", T.snippet(F.col("text")))
    overlap = F.coalesce(F.arrays_overlap("terms", T.keywords(said)), F.lit(False))
    score = F.col("score")
    return (
        F.when(_IS("shloka") & verse_like(), score >= -0.15)
        .when(score >= 0.45, True)
        .when((_IS("table") & _TABLE()) | _IS("visual"), overlap & (score >= -0.1))
        .otherwise(overlap & (score >= 0.05))
    )


def shows_table() -> Column:
    rows, score = F.col("table_rows"), F.col("score")
    return _TABLE() & (rows > 0) & (score >= -0.25) & F.when(_IS("table"), rows >= 1).otherwise((rows >= 3) & (score >= 0.15))


def enough(ranked: DataFrame) -> DataFrame:
    """One row a question: what is shown of its ranked candidates, and whether that is enough to answer."""
    c = ranked.withColumn("_cites", F.col("citation").isNotNull() & cites()).withColumn("_card", F.col("image").isNotNull() & F.col("url").isNotNull()).withColumn("_shown", F.col("table").isNotNull() & shows_table())
    first = lambda value, flag: F.max(F.when(flag, value))
    q = c.groupBy("query_id", "intent").agg(
        F.count_if("_cites").alias("citations"), F.count_if("_card").alias("images"), F.count_if("_shown").alias("tables"),
        first(F.col("kind"), F.col("place") == 1).alias("top_kind"),
        first(F.trim(F.concat_ws("", "text", "caption")) != "", F.col("place") == 1).alias("top_context"),
        first(F.col("score"), F.col("citation") == 1).alias("citation_score"), first(F.col("score"), F.col("image") == 1).alias("image_score"), first(F.col("score"), F.col("table") == 1).alias("table_score"),
        F.coalesce(F.bool_or(F.col("citation").isNotNull() & verse_like()), F.lit(False)).alias("verse"),
    )
    some = F.col("citations") > 0
    decided = (
        F.when(F.col("top_kind") == "image", (F.col("images") > 0) & F.col("top_context"))
        .when(some & (F.col("citation_score") >= 0.1), True)
        .when(_IS("visual"), (F.col("images") > 0) & (some | (F.coalesce("image_score", F.lit(-999.0)) >= 0.35)))
        .when(_IS("shloka"), F.col("verse") & some)
        .when(_IS("table"), (F.col("tables") > 0) & (some | (F.coalesce("table_score", F.lit(-999.0)) >= 0.2)))
        .otherwise(False)
    )
    return q.select("query_id", "intent", "citations", "images", "tables", "top_kind", decided.alias("enough"))


def labelled(ranked: DataFrame) -> DataFrame:
    """Add shown (citation, image, table or null) and label: C1, C2, ... over the citations that are shown; F and T numbers
    count the candidates of the role before those without a card are left out. A candidate that is shown as citation and
    as table has a row for each."""
    order = Window.partitionBy("query_id").orderBy("place")
    c = ranked.withColumn("_c", F.col("citation").isNotNull() & cites()).withColumn("_n", F.count_if("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    name = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    cards = F.array_compact(F.array(
        F.when(F.col("_c"), F.struct(F.lit("citation").alias("shown"), name("C", F.col("_n")).alias("label"))),
        F.when(F.col("image").isNotNull() & F.col("url").isNotNull(), F.struct(F.lit("image").alias("shown"), name("F", F.col("image")).alias("label"))),
        F.when(F.col("table").isNotNull() & shows_table(), F.struct(F.lit("table").alias("shown"), name("T", F.col("table")).alias("label"))),
    ))
    return c.withColumn("_card", F.explode(cards)).withColumn("shown", F.col("_card.shown")).withColumn("label", F.col("_card.label")).drop("_c", "_n", "_card")


def source_title(source: Column) -> Column:
    flat = F.trim(F.coalesce(source, F.lit("")))
    return F.when(F.lower(flat).endswith(".pdf"), F.substr(flat, F.lit(1), F.length(flat) - 4)).when(flat == "", "Unknown Source").otherwise(flat)


def diagram_token(public_id: Column, image_id: Column, source: Column, page: Column) -> Column:
    """The token by which an answer names a figure: the last part of its public id (or its id, or source) with its page."""
    pub, own, src = (F.trim(F.coalesce(c, F.lit(""))) for c in (public_id, image_id, source))
    base = F.coalesce(F.nullif(F.regexp_extract(pub, "[^/]*$", 0), F.lit("")), F.nullif(own, F.lit("")), F.nullif(src, F.lit("")), F.lit("diagram"))
    named = F.when(F.contains(base, F.lit(".")), base).otherwise(F.concat(base, F.lit(".png")))
    paged = F.regexp_replace(named, r"^(.*)\.([^.]*)$", F.concat(F.lit("$1_page"), page.cast("string"), F.lit(".$2")))
    return F.concat(F.lit("[Diagram: "), F.when((F.coalesce(page, F.lit(0)) != 0) & ~F.contains(F.lower(named), F.lit("page")), paged).otherwise(named), F.lit("]"))


def blocks(cards: DataFrame) -> DataFrame:
    """Add cited (labels of the citations that a figure or table is linked with) and block: the prompt's text of each card."""
    marks = cards.where("shown = 'citation'").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "label"))).alias("_marks"))
    c = cards.join(marks, "query_id", "left")
    linked = F.when(F.col("shown") == "image", F.col("linked")).when(F.col("shown") == "table", F.array("id")).otherwise(F.array().cast("array<bigint>"))
    c = c.withColumn("cited", F.coalesce(F.array_compact(F.transform(linked, lambda x: F.try_element_at("_marks", x))), F.array().cast("array<string>")))
    links = F.when(F.size("cited") > 0, F.concat(F.lit("\nLinked citations: "), F.array_join("cited", ", "))).otherwise("")
    text, caption, labels = (F.trim(F.coalesce(F.col(x), F.lit(""))) for x in ("text", "caption", "labels"))
    page = F.col("page").cast("string")
    citation = F.concat(F.lit("["), "label", F.lit("] Source: "), source_title(F.col("source_file")), F.lit(", p."), page, F.lit("\n"), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("Section: "), "section", F.lit("\n"))).otherwise(""), T.snippet(F.col("text")))
    image = F.concat(
        F.lit("["), "label", F.lit("] Source: "), "source_file", F.lit(" page "), page, F.lit("\nPrimary context: "), F.coalesce(F.nullif(text, F.lit("")), caption), F.when(caption != "", F.concat(F.lit("\nCaption: "), caption)).otherwise(""),
        F.lit("\nDiagram token: "), diagram_token(F.lit(None).cast("string"), F.col("id").cast("string"), F.col("source_file"), F.col("page")), F.when(labels != "", F.concat(F.lit("\nLabels: "), labels)).otherwise(""), links,
    )
    tabular = F.concat(F.lit("["), "label", F.lit("] Source: "), "source_file", F.lit(" p["), page, F.lit("]\nCaption: "), caption, links, F.lit("\n"), F.coalesce("markdown", F.lit("")))
    block = F.when(F.col("shown") == "citation", citation).when(F.col("shown") == "image", image).otherwise(tabular)
    return c.withColumn("block", F.regexp_replace(block, r"^\s+|\s+$", "")).drop("_marks")


def prompt_parts(questions: DataFrame, cards: DataFrame) -> DataFrame:
    """Sections (query_id, seq, title, content) of each question (query_id, query, intent, top_kind): the question, its intent,
    figures before texts if the first candidate is a figure and after them if not, and tables."""
    listed = cards.groupBy("query_id", "shown").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.length("label").alias("n"), "label", "block"))), lambda x: x["block"]), "\n\n").alias("content"))
    named = listed.join(questions.select("query_id", "top_kind"), "query_id")
    seq = F.when(F.col("shown") == "citation", 3).when(F.col("shown") == "table", 5).when(F.col("top_kind") == "image", 2).otherwise(4)
    title = F.when(F.col("shown") == "citation", "Text Evidence").when(F.col("shown") == "image", "Figure Evidence").otherwise("Table Evidence")
    head = questions.select("query_id", F.lit(0).alias("seq"), F.lit("Question").alias("title"), F.col("query").alias("content"))
    return head.union(questions.select("query_id", F.lit(1), F.lit("Intent"), "intent")).union(named.select("query_id", seq, title, "content"))


def prompts(fitted: DataFrame) -> DataFrame:
    """(query_id, prompt, sections) of fitted sections."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "title", "content")))
    whole = fitted.where("content <> ''").groupBy("query_id").agg(listed.alias("s"))
    return whole.select("query_id", F.array_join(F.transform("s", lambda x: F.concat(x["title"], F.lit(":\n"), x["content"])), "\n\n").alias("prompt"), F.transform("s", lambda x: x["title"]).alias("sections"))


def responses(decided: DataFrame, cards: DataFrame, answers: DataFrame, model: str = "none") -> DataFrame:
    """One row a question: answer, labels of the citations, figures and tables (none where the evidence isn't enough), enough,
    intent and model."""
    order = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("shown") == kind, F.struct(F.length("label").alias("n"), F.col("label").alias("l"))))), lambda x: x["l"])
    shown = cards.groupBy("query_id").agg(order("citation").alias("c"), order("image").alias("i"), order("table").alias("t"))
    none = F.array().cast("array<string>")
    some = lambda c: F.when(F.col("enough"), F.coalesce(F.col(c), none)).otherwise(none)
    q = decided.join(shown, "query_id", "left").join(answers, "query_id")
    return q.select("query_id", "answer", some("c").alias("citations"), some("i").alias("images"), some("t").alias("tables"), "enough", "intent", F.lit(model).alias("model"))


def public_cards(cards: DataFrame) -> DataFrame:
    """Figures as the public sees them: without the text around them."""
    return cards.where("shown = 'image'").select("query_id", F.col("label").alias("id"), F.col("id").alias("image_id"), F.col("page").alias("page_number"), F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("labels", F.lit("")).alias("labels"), "url", "source_file", "cited")


def debug_rows(ranked: DataFrame) -> DataFrame:
    """What of a candidate a debug envelope shows."""
    return ranked.select("query_id", "id", "kind", "score", "source_file", "page", "chunk_type", "section", T.snippet(F.col("text")).alias("snippet"), "linked", "markdown", "caption", "url")


def fit_sections(sections: DataFrame, budget: int = 2800, least: int = 64) -> DataFrame:
    """Sections (query_id, seq, title, content) that fit a budget of words: whole ones while they fit, then the first that
    doesn't, cut to what is left (`least` words at least), and nothing after it."""
    order = Window.partitionBy("query_id").orderBy("seq")
    n = T.word_count(F.concat("title", F.lit(":\n"), "content"))
    s = sections.withColumn("_n", n).withColumn("_sum", F.sum("_n").over(order)).withColumn("_over", F.col("_sum") > budget)
    s = s.withColumn("_overs", F.sum(F.col("_over").cast("int")).over(order)).where("_overs <= 1")
    left = F.greatest(F.lit(least), F.lit(budget) - (F.col("_sum") - F.col("_n")) - T.word_count(F.col("title")) - 4).cast("int")
    words = T.word_list(F.col("content"))
    cut = F.when(F.size(words) <= left, F.col("content")).otherwise(F.concat(F.array_join(F.slice(words, F.lit(1), left), " "), F.lit(" ...")))
    return s.select("query_id", "seq", "title", F.when(F.col("_over"), cut).otherwise(F.col("content")).alias("content"), F.col("_over").alias("cut"))


def answer(route: Column, is_enough: Column, has_model: Column, ids: Column, generated: Column) -> Column:
    """The ladder of answers: greeting, not enough, no model (with the evidence's ids), the model's own."""
    return (
        F.when(route == "simple", "Hello! Ask me about the indexed books.")
        .when(~is_enough, "The indexed books do not hold enough evidence for an answer.")
        .when(~has_model, F.concat(F.lit("No language model is configured. Evidence: "), F.array_join(ids, ", ")))
        .otherwise(generated)
    )
