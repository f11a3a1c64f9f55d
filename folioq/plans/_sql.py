"""Pieces of DuckDB SQL that several queries share, and fixtures that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOOKS = 20

#: Texts in scripts and shapes that the tables lack; negative ids.
SAMPLES = [
    (-1, "वातः पित्तं कफश्चेति त्रयो दोषाः समासतः ।\nविकृताविकृता देहं घ्नन्ति ते वर्त्तयन्ति च ॥"),
    (-2, "வாதம் பித்தம் கபம்"),
    (-3, "వాయుః పిత్తం కఫశ్చేతి\nత్రయో దోషాః ॥"),
    (-4, "বায়ু এবং পিত্ত"),
    (-5, "طب یونانی"),
    (-6, "latin then देव mixed"),
    (-7, ""),
    (-8, None),
    (-9, "Caraka saṃhitā – “Sūtrasthāna” ﬁrst… aṣṭāṅga hṛdaya Ṭhākura A \\ rilal"),
    (-10, "Ã¤Ã© Ã¼Ã¶ ï¿½ broken ÃƒÂ text Ãƒ"),
    (-11, "19 NAGARA\n653-656\n20 PIPPALI\n657 - 660\n21 SHUNTHI\n12-14"),
    (-12, "Table no. 4 Physical values of three samples"),
    (-13, "1. Appearance 12.5 13.1"),
    (-14, "| @@@ ### ~~~ ^^^ <<< >>> ~~~ ^^^ ### @@@ ~~~ |"),
    (-15, "Conflict of interest: none\nSecond   line  kept\n12 www.ijaar.in\n"),
    (-16, "pH 7.2 nil %"),
    (-17, "Materials And Methods"),
    (-18, "12345678 123 45"),
    (-19, "1. राजा गच्छति ।\nवनं प्रति ॥"),
]


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """DuckDB: (SELECT ... FROM VALUES) of the rows; columns as 'name type, ...'."""
    names = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(names))
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {cast} FROM (VALUES {body}) v({', '.join(f'c{i}' for i in range(len(names)))}))"


def frame(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """The same rows in Spark; columns as 'name type, ...' with DuckDB's type names."""
    known = {"BIGINT": "long", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    schema = ", ".join(f"{n} {known[k]}" for n, k in (c.split() for c in columns.split(", ")))
    return spark.createDataFrame(rows, schema)


SAMPLES_SQL = values(SAMPLES, "doc_id BIGINT, text VARCHAR")
TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {SAMPLES_SQL})"


def compact(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def count(x: str) -> str:
    return f"len({words(x)})"


def found(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def gone(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"


def times(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


#: Pages and units as in sources.corpus.
UNITS = rf"""
pages_ AS (SELECT source AS book, CAST(doc_id // {BOOKS} + 1 AS BIGINT) AS page_number, doc_id AS page_id, text FROM documents),
lines_ AS (SELECT book, page_number, page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS reading_order FROM pages_),
units AS (
  SELECT book, page_number, page_id, CAST(reading_order AS INTEGER) AS reading_order, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text,
    0.0::DOUBLE AS x0, reading_order * 12.0::DOUBLE AS y0, length(trim(regexp_replace(line, '\s+', ' ', 'g')))::DOUBLE AS x1, reading_order * 12.0::DOUBLE + 10 AS y1
  FROM lines_ WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '')"""
