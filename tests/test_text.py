"""Scalar kernels on the shapes that the tables lack."""

import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioq.functions import text as T


def values(spark, fn, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_text(spark):
    raw = ["saṃhitā", "ﬁrst…", "“a” – ‘b’", "A \\ rilal", "soft­hyphen", "Ṭhākura ḍhola", "é", None, ""]
    assert values(spark, T.normalize_text, raw) == ["samhita", "first...", "\"a\" - 'b'", "A rilal", "softhyphen", "Thakura dhola", "é", "", ""]
    assert values(spark, lambda c: T.normalize_text(c, latin_fold=True), ["é ç Ł ø"])[0] == "e c Ł o"


@pytest.mark.parametrize(("text", "script", "code"), [("देव", "devanagari", "Deva"), ("வாதம்", "tamil", "Taml"), ("దోషాః", "telugu", "Telu"), ("বায়ু", "bengali", "Beng"), ("طب", "arabic", "Arab"), ("plain", "latin", "Latn"), ("latin देव", "devanagari", "Deva"), ("", "latin", "Latn"), (None, "latin", "Latn")])
def test_scripts(spark, text, script, code):
    assert values(spark, T.detect_script, [text]) == [script]
    assert values(spark, lambda c: T.script_code(T.detect_script(c)), [text]) == [code]


def test_snippet(spark):
    long = "word " * 100
    got = values(spark, T.snippet, [long, " a \n b ", None, "x" * 320, "x" * 321])
    assert len(got[0]) <= 320 and got[0].endswith("...") and got[1:3] == ["a b", ""] and got[3] == "x" * 320 and got[4] == "x" * 317 + "..."


def test_keywords(spark):
    assert values(spark, T.keywords, ["Show me the Doshas and boxes 123 ab"]) == [["boxe", "boxes", "dosha", "doshas"]]


def test_verse(spark):
    prose = "This is a line of prose that goes on for more than ten words here."
    verse = "1. राजा गच्छति ।\nवनं प्रति ॥"
    assert values(spark, T.is_verse, [verse, "దోషాః సమాః\nత్రయో ॥", prose, "1. plain\n2. latin", "", None]) == [False, True, False, False, False, False]


def test_ocr_decision(spark):
    index = "19 NAGARA\n653-656\n20 PIPPALI\n657 - 660"
    good = "A page of ordinary words that is long enough to be kept as it is."
    assert values(spark, T.ocr_reason, [index, good, "", None, "short"]) == ["index_like_native", "native_good", "empty_native", "empty_native", "quality:too_short"]
    df = spark.createDataFrame([("", 0.9), ("", 0.1), (good, 0.9), (index, 0.1)], "t string, r double")
    assert [r.v for r in df.select(T.page_type(F.col("t"), F.col("r")).alias("v")).collect()] == ["scanned", "blank", "digitized", "digitized"]


def test_table_rows_differ(spark):
    rows = ["Table 3", "1. a b", "1.2 3.4 5.6", "pH 7.2 nil", "1 Introduction to it", "Figure 2"]
    assert values(spark, T.is_table_row, rows) == [True, True, True, False, True, False]
    assert values(spark, lambda c: T.is_table_row(c, True), rows) == [True, True, True, False, False, False]
    assert values(spark, T.is_loose_table_row, rows) == [True, True, True, True, True, True]


def test_title_case(spark):
    texts = ["Stop-Gap", "Stop-gap", "Materials And Methods", "McDonald", "देव", "A1B", "A1b"]
    assert values(spark, T.is_title_case, texts) == [t == t.title() for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30).filter(lambda t: "\0" not in t), min_size=1, max_size=20))
def test_point_ids(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = values(spark, lambda c: T.point_id(c, "text"), texts)
    for t, v in zip(texts, got, strict=True):
        bare = t.strip(" ")
        assert v == (str(uuid.uuid5(uuid.NAMESPACE_URL, f"text:{bare}")) if bare else None)


def test_point_id_keeps_uuids(spark):
    u = str(uuid.uuid4())
    assert values(spark, lambda c: T.point_id(c, "text"), [u, u.upper(), "{" + u + "}", u.replace("-", "")]) == [u] * 4
