"""Chat formatting with a grammar round trip (operator 9).

Each conversation is rendered as `<|im_start|>role NEWLINE text<|im_end|> NEWLINE` a turn. The rendering is parsed again
by a deterministic parser: split at the start mark, take the role up to the first line end, the text up to the first end
mark, which must close the turn, and undo escapes. Where the turns recovered differ from the source, content is escaped: a backslash more goes between `<` and `|`,
in a role also for backslash and line end. One round of escapes always suffices, as undoing it is its exact inverse.

Defined results: a null role or text counts as empty. Turns are ordered by turn, then role and text; repeated rows are
turns of their own. Rows with a null conv_id form one conversation. A text may be of any length; a conversation is one row,
so all its turns must fit a task, as in any rendering of it. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm._spark import table

START, END = "<|im_start|>", "<|im_end|>\n"


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return _escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(_unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def render(turns: Column, escaped: bool) -> Column:
    """Text of an array of (role, text)."""
    role, text = (_escape_role, _escape) if escaped else (lambda c: c, lambda c: c)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), role(t["role"]), F.lit("\n"), text(t["text"]), F.lit(END))), "")


def parse(rendered: Column) -> Column:
    """The array of (role, text) that a rendering stands for. A turn that goes on after an end mark, or has none, is no turn
    of the grammar; its text is taken with the marks, so that it differs from any source."""

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        body = F.substr(part, line + 1)
        at = F.instr(body, END[:-1])
        body = F.when((at > 0) & (F.substr(body, at) == END), F.left(body, at - 1)).otherwise(body)
        return F.struct(_unescape_role(F.left(part, F.greatest(line - 1, F.lit(0)))).alias("role"), _unescape(body).alias("text"))

    parts = F.split(rendered, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, rendered, escaped, identical) of each conversation."""
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    source = whole.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"))
    raw = source.withColumn("raw", render(F.col("source"), False))
    same = raw.withColumn("escaped", parse(F.col("raw")) != F.col("source"))
    done = same.withColumn("rendered", F.when(F.col("escaped"), render(F.col("source"), True)).otherwise(F.col("raw")))
    return done.select("conv_id", F.size("source").alias("turns"), "rendered", "escaped", (parse(F.col("rendered")) == F.col("source")).alias("identical"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))


_PARSED = r"""
  list_transform(string_split({0}, '<|im_start|>')[2:], lambda p: struct_pack(
    role := replace(replace(regexp_replace(CASE WHEN instr(p, chr(10)) > 0 THEN left(p, instr(p, chr(10)) - 1) ELSE '' END, '<(\\*)\\\|', '<\1|', 'g'), '\n', chr(10)), '\b', '\'),
    text := regexp_replace(CASE WHEN instr(substr(p, instr(p, chr(10)) + 1), '<|im_end|>') = length(substr(p, instr(p, chr(10)) + 1)) - 10 AND ends_with(p, '<|im_end|>' || chr(10))
      THEN left(substr(p, instr(p, chr(10)) + 1), length(substr(p, instr(p, chr(10)) + 1)) - 11) ELSE substr(p, instr(p, chr(10)) + 1) END, '<(\\*)\\\|', '<\1|', 'g')))"""

SQL = rf"""
WITH source AS (
  SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, ''))
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS source
  FROM conversations GROUP BY conv_id),
raw AS (
  SELECT *, array_to_string(list_transform(source, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS raw FROM source),
tried AS (SELECT *, ({_PARSED.format("raw")}) <> source AS escaped FROM raw),
done AS (
  SELECT *, CASE WHEN escaped THEN array_to_string(list_transform(source, lambda t: '<|im_start|>'
    || regexp_replace(replace(replace(t.role, '\', '\b'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g') || chr(10)
    || regexp_replace(t.text, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10)), '') ELSE raw END AS rendered FROM tried)
SELECT conv_id, CAST(len(source) AS INTEGER) AS turns, rendered, escaped, ({_PARSED.format("rendered")}) = source AS identical FROM done
"""
