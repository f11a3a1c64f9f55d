"""Understanding of a batch of questions: intent, route, and the sizes that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.functions import text as T

VERSE = "shloka|sloka|verse|sutra|śloka"
TABLE = "table|tabular|compare|comparison|rows|columns|values|parameter|specification|dataset"
VISUAL = "diagram|figure|fig|flowchart|chart|graph|image|illustration|yantra|show me|picture|photo"
DEFINITION = "what is|define|meaning of|explain|synonyms of"
GREETINGS = ["hi", "hello", "hey", "good morning", "good afternoon", "good evening", "how are you", "thanks", "thank you"]
DEEP = "diagram|table|image|yantra"


@dataclass(frozen=True)
class Settings:
    """What the environment may override in a deployment."""

    fast_tokens: int = 6
    sparse_from: int = 4
    text_k: int = 12
    rerank_k: int = 8
    deep: str = DEEP


def intent(query: Column) -> Column:
    """The first that fits: chitchat, verse (shloka), table, visual, definition, general. Keywords count inside words too."""
    low = F.lower(query)
    return (
        F.when(low.isin(GREETINGS) | low.rlike("^(hi|hello|hey) "), "chitchat")
        .when(low.rlike(VERSE), "shloka")
        .when(low.rlike(TABLE), "table")
        .when(low.rlike(VISUAL), "visual")
        .when(low.rlike(DEFINITION), "definition")
        .otherwise("general")
    )


def route(query: Column, found: Column, tokens: Column, s: Settings = Settings()) -> Column:
    return (
        F.when(found == "chitchat", "simple")
        .when(F.lower(query).rlike(s.deep), "deep")
        .when(found.isin("general", "definition") & (tokens <= s.fast_tokens), "fast")
        .otherwise("deep")
    )


def bundles(queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Questions (query_id, query) with all that later stages ask of them. Blank questions are dropped."""
    flat = queries.withColumn("query", T.compact(F.col("query"))).where("query <> ''")
    flat = flat.withColumn("intent", intent(F.col("query"))).withColumn("tokens", T.word_count(F.col("query")))
    flat = flat.withColumn("route", route(F.col("query"), F.col("intent"), F.col("tokens"), s)).withColumn("normalized", T.normalize_text(F.col("query")))
    deep = F.col("route") == "deep"
    rerank = F.when(deep, s.rerank_k).otherwise(0)
    search = F.least(F.greatest(rerank, F.lit(s.text_k), F.lit(1)), F.lit(12))
    return flat.select(
        "query_id", "query", "normalized", "intent", "route", "tokens",
        ((F.col("route") == "fast") | (F.col("tokens") < s.sparse_from)).alias("skip_sparse"),
        F.when(deep & (F.col("intent") == "visual"), 6).when(deep, 4).otherwise(0).alias("image_k"),
        F.lit(s.text_k).alias("text_k"), rerank.alias("rerank_k"), search.alias("search_k"),
        (F.lower(T.compact(F.col("normalized"))) != F.lower(F.col("query"))).alias("dual"),
    )
