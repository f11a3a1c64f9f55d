"""Operators on small fixtures: caps, ties, missing values, and properties."""

import pytest
from pyspark.sql import functions as F

from folioq.operators import chunking as C
from folioq.operators import evidence as E
from folioq.operators import geometry as G
from folioq.operators import layout as L
from folioq.operators import query as Q
from folioq.operators import retrieval as R
from folioq.operators import seams
from folioq.operators import store as S


def test_intents_count_inside_words(spark):
    asked = ["show me the figure", "what is rasa", "vegetable diet", "adverse effects", "paragraph style", "Hello there", "hi", "hit", "plain query", ""]
    rows = Q.bundles(spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")).orderBy("query_id").collect()
    assert [r.intent for r in rows] == ["visual", "definition", "table", "shloka", "visual", "chitchat", "chitchat", "general", "general"]
    assert [r.route for r in rows] == ["deep", "fast", "deep", "deep", "deep", "simple", "simple", "fast", "fast"]
    assert rows[0].image_k == 6 and rows[1].image_k == 0 and rows[1].skip_sparse


def test_settings_change_the_route(spark):
    df = spark.createDataFrame([(1, "one two three four")], "query_id long, query string")
    assert Q.bundles(df, Q.Settings(fast_tokens=3)).first().route == "deep"


def test_dense_topk_ties_and_odd_vectors(spark):
    corpus = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, qvec array<double>")
    assert [(r.id, r.score) for r in R.dense_topk(q, corpus, 4).orderBy("rank").collect()] == [(1, 1.0), (3, 1.0), (2, 0.0), (4, 0.0)]


def test_small_side_is_checked(spark):
    df = spark.range(10)
    assert "broadcast" in R.small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in R.small(df, 9)._jdf.queryExecution().logical().toString().lower()


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    one, two = ([(r.id, r.score) for r in R.fuse(legs, 5).orderBy("rank").collect()] for legs in ([a, b], [b, a]))
    assert one == two and one[0] == (11, pytest.approx(0.833333))


def test_merge_keeps_the_greatest_score_and_first_url(spark):
    hits = spark.createDataFrame([(1, 5, 0, 0.5, "a", "", ["x"]), (1, 5, 1, 0.9, "b", "u", ["y", "x"]), (1, 6, 0, 0.1, "a", None, [])], "query_id long, id long, seq int, score double, reason string, url string, linked array<string>")
    rows = {r.id: r for r in R.merge(hits).collect()}
    assert (rows[5].score, rows[5].reasons, rows[5].url, rows[5].linked) == (0.9, ["a", "b"], "u", ["x", "y"]) and rows[6].url is None


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, rank int, id long, score double, book string, page_number long, image_ids array<string>")


def test_linked_rescue_takes_three_at_most(spark):
    hits = _hits(spark, [(1, 1, 10, 0.5, "b", 1, ["i1", "i2"]), (1, 2, 11, 0.4, "b", 2, ["i2", "i3", "i4"]), (1, 3, 12, 0.3, "b", 3, ["i9"])])
    images = spark.createDataFrame([("i1",), ("i2",), ("i3",), ("i4",), ("i9",)], "image_id string")
    known = spark.createDataFrame([(1, "i1")], "query_id long, image_id string")
    got = {r.image_id: (r.score, r.reason) for r in R.linked_rescue(hits, known, images).collect()}
    assert got == {"i2": (0.46, "linked_from:10"), "i3": (0.368, "linked_from:11"), "i4": (0.368, "linked_from:11")}


def test_page_proximity_looks_at_two_places(spark):
    hits = _hits(spark, [(1, 1, 10, 0.5, "b", 1, []), (1, 2, 11, 0.001, "b", 9, [])])
    images = spark.createDataFrame([("a", "b", 1, "diagram"), ("d", "b", 1, "decorative"), ("e", "b", 2, None), ("f", "b", 9, "diagram")], "image_id string, book string, page long, image_type string")
    known = spark.createDataFrame([], "query_id long, image_id string")
    got = {r.image_id: r.score for r in R.page_proximity(hits, known, images).collect()}
    assert got == {"a": 0.43, "e": 0.36}  # page 1, then (0 is no page) page 2; page 9 is a third place


def test_filters_drop_blanks_and_pass_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "decorative"), (3, None, "x")], "id int, doc_id string, t string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(R.payload_filter()) == [1, 2, 3]
    assert ids(R.payload_filter(doc_id="  ")) == [1, 2, 3]
    assert ids(R.payload_filter(doc_id=" a ")) == [1]
    assert ids(R.payload_filter(must_not={"t": ["decorative"]})) == [1, 3]


def test_packing_conserves_words_and_keeps_verses_apart(spark):
    def group_of(kinds, sizes):
        df = spark.createDataFrame([(list(zip(kinds, sizes, strict=True)),)], "u array<struct<kind:string,n:int>>")
        return df.select(C.group_numbers(F.col("u"))).first()[0]

    kinds = ["paragraph"] * 3 + ["shloka"] + ["table_row"] * 2 + ["paragraph"] * 2
    assert group_of(kinds, [100, 100, 50, 10, 5, 5, 290, 20]) == [1, 1, 2, 3, 4, 4, 5, 6]
    assert group_of(["paragraph"] * 3, [400, 10, 10]) == [1, 2, 2]
    assert group_of(["paragraph"] * 2, [180, 1]) == [1, 2]


def test_word_windows(spark):
    text = " ".join(map(str, range(700)))
    df = spark.createDataFrame([(1, text), (2, "a  b"), (3, " ".join("x" * 300))], "id int, text string")
    rows = C.word_windows(df).orderBy("id", "part").collect()
    sizes = [(r.id, len(r.text.split())) for r in rows]
    assert sizes == [(1, 300), (1, 300), (1, 180), (2, 2), (3, 300)] and rows[1].text.split()[0] == "260" and rows[3].text == "a  b"


def test_markdown(spark):
    df = spark.createDataFrame([([["Table 1"], ["a", "b"], ["c"]],), ([["x"], ["y"]],), ([["Table only"]],), ([],)], "r array<array<string>>")
    got = [r.m for r in df.select(C.markdown(F.col("r")).alias("m")).collect()]
    assert got == ["Table 1\n| a | b |\n| --- | --- |\n| c |  |", "- x\n- y", "Table only", None]


def test_repeated_footer_is_noise(spark):
    lines = [("b", p, p, k, t, 0.0, y, 100.0, y + 10) for p in (1, 2) for k, (t, y) in enumerate([(f"{p} www.site VOLUME 1 ISSUE 4", 770.0), ("body text of the page", 300.0), ("End", 790.0)])]
    df = spark.createDataFrame(lines, "book string, page_number long, page_id long, reading_order int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.page_id, r.reading_order) for r in L.mark_noise(df).where("noise").collect()} == {(1, 0), (2, 0)}


def test_section_runs_over_pages(spark):
    lines = [("b", 1, 1, 0, "Materials And Methods"), ("b", 1, 1, 1, "some plain words follow here"), ("b", 2, 2, 0, "more words on the next page"), ("c", 1, 3, 0, "another book has no heading")]
    df = spark.createDataFrame(lines, "book string, page_number long, page_id long, reading_order int, text string")
    got = {(r.page_id, r.reading_order): r.section for r in L.sections(df).collect()}
    assert got == {(1, 0): "Materials And Methods", (1, 1): "Materials And Methods", (2, 0): "Materials And Methods", (3, 0): None}


def test_page_windows(spark):
    df = spark.createDataFrame([("b", p) for p in (1, 2, 3, 6, 7, 10, 10)], "book string, page_number long")
    assert sorted((r["first"], r["last"]) for r in L.page_windows(df, 2).collect()) == [(1, 2), (3, 3), (6, 7), (10, 10)]


def test_boxes_in_two_bands_match_once(spark):
    kind = "page_id long, reading_order int, text string, x0 double, y0 double, x1 double, y1 double"
    a = spark.createDataFrame([(1, 0, "bad", 0.0, 10.0, 100.0, 200.0)], kind)
    b = spark.createDataFrame([(1, 0, "good", 0.0, 20.0, 100.0, 190.0), (1, 1, "far", 0.0, 400.0, 9.0, 410.0)], kind)
    assert [(r.n_id, r.o_id, r.overlap) for r in G.match_boxes(a, b).collect()] == [(0, 0, 1.0)]


def test_font_map_replaces_longest_first(spark):
    df = spark.createDataFrame([("xyz x",)], "t string")
    assert df.select(G.apply_font_map(F.col("t"), {"x": "a", "xy": "b", "": "q"}).alias("v")).first().v == "bz a"


def test_line_merge_limits():
    assert G.merge_steps([False] + [True] * 7, [10] * 8) == [1] * 6 + [2] * 2
    assert G.merge_steps([False, True, True], [200, 200, 30]) == [1, 1, 2]


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    batch = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    once = S.upsert(stored, batch, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, S.upsert(once, batch, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_delete_leaves_unknowns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, s string")
    kept, gone = S.delete(df, F.col("s") == "a")
    assert [r.id for r in kept.collect()] == [2] and gone.first().deleted == 1


def test_prompt_budget(spark):
    df = spark.createDataFrame([(1, 0, "Question", "q " * 10), (1, 1, "Text", "w " * 200), (1, 2, "More", "m")], "query_id long, seq int, title string, content string")
    rows = E.fit_sections(df, 50, 5).orderBy("seq").collect()
    assert [r.title for r in rows] == ["Question", "Text"] and rows[1].cut and len(rows[1].content.split()) == 50 - 11 - 1 - 4 + 1


def test_answer_ladder(spark):
    df = spark.createDataFrame([("simple", True, True), ("deep", False, True), ("deep", True, False), ("deep", True, True)], "r string, e boolean, m boolean")
    got = [x.a for x in df.select(E.answer(F.col("r"), F.col("e"), F.col("m"), F.array(F.lit("C1")), F.lit("made")).alias("a")).collect()]
    assert got[0].startswith("Hello") and "not hold enough" in got[1] and got[2].endswith("C1") and got[3] == "made"


def test_scorer_seam(spark):
    df = spark.createDataFrame([("a b", "b c", 1), ("", None, 2)], "query string, text string, id int")
    assert [(r.id, r.score) for r in seams.scored(df, seams.overlap_scorer).orderBy("id").collect()] == [(1, 0.5), (2, 0.0)]


def test_placements_link_and_suppress(spark):
    import numpy as np

    from folioq.operators import ingest as I

    rng = np.random.default_rng(0)
    rows = [(1, k, float(x), float(y), float(x) + 30, float(y) + 30, float(s)) for k, (x, y, s) in enumerate(zip(rng.integers(0, 400, 40), rng.integers(0, 400, 40), rng.random(40), strict=True))]
    df = spark.createDataFrame(rows, "page_id long, id long, x0 double, y0 double, x1 double, y1 double, score double")
    group = {r[1]: r[1] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a[2] - 10 <= b[4] + 10 and b[2] - 10 <= a[4] + 10 and a[3] - 10 <= b[5] + 10 and b[3] - 10 <= a[5] + 10:
                    group[a[1]] = group[b[1]] = min(group[a[1]], group[b[1]])
    assert {r.id: r.component for r in I.components(df).collect()} == group

    def share(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = w * h if w > 0 and h > 0 else 0
        return inter / (1800 - inter)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(share(r, k) < 0.3 for k in kept):
            kept.append(r)
    assert {r.id for r in I.suppress(df, 0.3).collect()} == {r[1] for r in kept} and len(kept) < 40


def test_stream_frames(spark):
    from folioq.operators import ingest as I

    df = spark.createDataFrame([("event: token\ndata: a\ndata: b\n\n: ping\n\ndata: {\"x\":1}\r\n\r\nevent: end\n\n",), ("",), (None,)], "b string")
    got = [r.f for r in df.select(I.frames(F.col("b")).alias("f")).collect()]
    assert [tuple(x) for x in got[0]] == [("token", "a\nb"), ("message", '{"x":1}')] and got[1] == [] and got[2] is None


def test_each_text_is_embedded_once(spark):
    from folioq.operators import ingest as I

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, text string")
    seen = []

    def embed(texts):
        seen.append(texts.count())
        return texts.withColumn("vec", F.length("text"))

    assert I.embed_once(df, embed).count() == 3 and seen == [2]
