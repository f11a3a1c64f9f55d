"""The ten operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioq.llm import chat, passages
from folioq.llm.decontaminate import op3_decontaminate
from folioq.llm.langid import op7_language_id
from folioq.llm.lines import op1_line_quality
from folioq.llm.neardup import op4_minhash_near_dedup
from folioq.llm.packing import op5_best_fit_packing
from folioq.llm.passages import op8_repeated_passages
from folioq.llm.pii import op2_skip_chain_pii
from folioq.llm.sharding import op10_lpt_sharding
from folioq.llm.tokens import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_quality, op2_skip_chain_pii, op3_decontaminate, op4_minhash_near_dedup, op5_best_fit_packing, op6_token_counts, op7_language_id, op8_repeated_passages, chat.op9_chat_format, op10_lpt_sharding)
}
ORACLE_SQL: dict[str, str] = {"op8_repeated_passages": passages.SQL, "op9_chat_format": chat.SQL}
