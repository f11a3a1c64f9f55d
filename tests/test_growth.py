"""Steps that must not grow faster than their input, or not be done twice."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioq import catalog
from folioq.functions import text as T
from folioq.operators import flow as L
from folioq.operators import ingest as I
from folioq.operators import reading as N
from folioq.operators import records as D
from folioq.operators import retrieval as R
from folioq.plans import flow, pages, reading, records, retrieval
from oracle import both, connect


@pytest.fixture
def word_lists():
    rnd = random.Random(5)
    lists = lambda n: [(i, [rnd.choice("abcdefghijkl") * 3 for _ in range(rnd.randrange(9))]) for i in range(n)]
    return [*lists(40), (40, None)], [*lists(300), (300, None)]


@pytest.mark.parametrize("limits", [{}, {"LEXICAL": 15, "ASKED": 7, "HELD": 11, "MANY": 10}])
def test_sparse_hits_are_the_first_of_all_pairs(spark, monkeypatch, word_lists, limits):
    """All passes, blocks and ties; and no more rows than every task's first k by each measure."""
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    asked, held = word_lists
    k, docs = 3, spark.createDataFrame(held, "id long, terms array<string>").repartition(2)
    hits = R.sparse_hits(spark.createDataFrame(asked, "query_id long, terms array<string>"), docs, k, ("dot", "shared"))
    tasks = spark.sparkContext.defaultParallelism if limits else 2
    assert hits.count() <= len(asked) * k * 2 * tasks
    ranked = R.ranked_legs(hits, k).collect()
    for measure in ("dot", "shared"):
        wanted = set()
        for q, mine in asked:
            scores = []
            for d, theirs in held:
                a, b = Counter(mine or []), Counter(theirs or [])
                both = a.keys() & b.keys()
                if both:
                    scores.append((-(sum(a[t] * b[t] for t in both) if measure == "dot" else len(both)), d))
            wanted |= {(q, d, -s, n) for n, (s, d) in enumerate(sorted(scores)[:k], 1)}
        assert {(r.query_id, r.id, r[measure], r[f"rank_{measure}"]) for r in ranked if r[f"rank_{measure}"]} == wanted


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    searched, plain = [], R.dense_topk
    monkeypatch.setattr(R, "dense_topk", lambda queries, *rest, **named: searched.append(queries.count()) or plain(queries, *rest, **named))
    asked = spark.createDataFrame([(i, [1.0, float(i % 3)] if i % 4 else None) for i in range(40)], "query_id long, qvec array<double>")
    corpus = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(9)], "id long, vec array<double>")
    found = {tuple(r) for r in R.dense_by_vector(asked, corpus, 4).select("query_id", "id", "score", "rank").collect()}
    assert searched == [4] and found == {tuple(r) for r in plain(asked, corpus, 4, own=True).collect()}


@pytest.mark.parametrize(("query", "route"), [("fast_evidence", "fast"), ("rerank_scores", "deep")])
def test_only_questions_of_the_route_are_searched(spark, sf_dir, monkeypatch, query, route):
    seen, plain = set(), L.search
    monkeypatch.setattr(L, "search", lambda questions, *rest: seen.update(r.route for r in questions.select("route").distinct().collect()) or plain(questions.limit(2), *rest))
    flow.QUERIES[query](spark, sf_dir)
    assert seen == {route}


def test_hits_are_written_once(spark, sf_dir):
    """What reads the fused hits reads them from the shared folder and doesn't search again."""
    assert "MapInArrow" not in retrieval.fused_hits(spark, sf_dir)._jdf.queryExecution().toString()


def test_a_text_is_scanned_once_for_each_measure(spark):
    """Values that several branches name are bound, not computed at each place."""
    plan = spark.createDataFrame([("x",)], "t string").select(T.detect_script(F.col("t")).alias("s"), T.ocr_reason(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 1
    # Meaningful and empty words, mixed ones, mojibake; the text and its lines compacted, and classes of characters of either test.
    assert plan.count("regexp_extract_all(") == 4 and plan.count("regexp_replace(") <= 9


def test_word_boundaries_are_those_of_sql(spark, tmp_path):
    """A letter that isn't ASCII bounds a word in SQL, whatever the Java version."""
    lines = ["SSbe underöchß eren, erkeitte mit.", "ö the x", "éthe x", "tablé table 4é", "a table no. 3ß", "étable 3", "1é two\n12é - 13\n4-5é\n6-7"]
    pd.DataFrame({"doc_id": range(len(lines)), "text": lines}).to_parquet(tmp_path / "documents.parquet")
    for name in ("line_rows", "ocr_decision"):
        mine, theirs = both(catalog.QUERIES[name], catalog.ORACLE_SQL[name], spark, str(tmp_path), connect(str(tmp_path)))
        assert mine == theirs


def placed(pages, most, seed):
    """Random boxes of pages, ids from 0 in each; some are equal, one page is dense, one has a single box."""
    rnd = random.Random(seed)
    rows = []
    for page in range(pages):
        for i in range(1 if page == 3 else rnd.randrange(1, most)):
            x, y = rnd.randrange(60), rnd.randrange(40 if page == 1 else 600)
            rows.append((page, i, float(x), float(y), x + 20.0, y + float(rnd.choice((4, 15, 40))), float(rnd.randrange(5))))
    return rows


def test_page_folds_equal_those_of_one_page(spark):
    """Pages that are folded together, also over the bounds of batches, against plain folds of a page."""
    rows = placed(25, 40, 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    boxes = spark.createDataFrame(rows, "page_id long, id long, x0 double, y0 double, x1 double, y1 double, score double")
    groups = {(r.page_id, r.id): r.component for r in I.components(boxes).collect()}
    stay = {(r.page_id, r.id) for r in I.suppress(boxes).collect()}
    lines = {(r.page_id, r.id, r.line, r.place) for r in N.word_lines(boxes).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept, linked, read = set(), {}, set()
    for page in range(25):
        mine = [r for r in rows if r[0] == page]
        near = lambda a, b: a[2] - 10 <= b[4] + 10 and a[4] + 10 >= b[2] - 10 and a[3] - 10 <= b[5] + 10 and a[5] + 10 >= b[3] - 10
        root = list(range(len(mine)))
        while (least := [min(root[k] for k, b in enumerate(mine) if near(a, b)) for a in mine]) != root:
            root = least
        linked |= {(page, r[1]): k for r, k in zip(mine, root, strict=True)}
        stays = []
        for r in sorted(mine, key=lambda r: (-r[6], r[1])):
            shared = [max(0.0, min(r[4], s[4]) - max(r[2], s[2])) * max(0.0, min(r[5], s[5]) - max(r[3], s[3])) for s in stays]
            area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
            if all(i / (area(r) + area(s) - i) < 0.6 for i, s in zip(shared, stays, strict=True)):
                stays.append(r)
        kept |= {(page, r[1]) for r in stays}
        tall = sorted(r[5] - r[3] for r in mine)
        reach, found = max(4.0, tall[len(tall) // 2] * 0.6), []
        for r in sorted(mine, key=lambda r: ((r[3] + r[5]) / 2, r[2], r[1])):
            c = (r[3] + r[5]) / 2
            far = [abs(sum(f[0]) / len(f[0]) - c) for f in found]
            k = far.index(min(far)) if far and min(far) <= reach else len(found)
            if k == len(found):
                found.append(([], []))
            found[k][0].append(c)
            found[k][1].append((r[2], r[1]))
        found.sort(key=lambda f: sum(f[0]) / len(f[0]))
        read |= {(page, i, n, place) for n, (_, members) in enumerate(found) for place, (_, i) in enumerate(sorted(members))}
    assert groups == linked and stay == kept and lines == read


def test_page_folds_take_whole_batches(spark):
    """No call of Python for each page."""
    boxes = spark.createDataFrame(placed(2, 5, 1), "page_id long, id long, x0 double, y0 double, x1 double, y1 double, score double")
    for fold in (I.components, I.suppress, N.word_lines):
        assert "FlatMapGroups" not in fold(boxes)._jdf.queryExecution().toString()


def test_longest_units_stay(spark):
    """Against the fold that holds every unit against all kept before; heights and columns in any mixture."""
    rnd = random.Random(3)
    rows = [(p, i, rnd.randrange(2), float(rnd.randrange(9) * 6), float(rnd.randrange(3)), 10.0 + rnd.randrange(6), "a long enough line of words, the " * (1 if i % 4 else 2) + "xy" * rnd.randrange(3)) for p in range(8) for i in range(30)]
    rows = [(p, i, c, y, x, y + h, t[: rnd.choice((20, 99))]) for p, i, c, y, x, h, t in rows]
    units = spark.createDataFrame(rows, "page_id long, reading_order int, column_id int, y0 double, x0 double, y1 double, text string")
    wanted = set()
    for page in range(8):
        kept = []
        for u in sorted((r for r in rows if r[0] == page), key=lambda r: (r[2], r[3], r[4], r[1])):
            t = u[6].strip()

            def alike(o):
                s, common = o[6].strip(), max(0.0, min(o[5], u[5]) - max(o[3], u[3]))
                return min(len(s), len(t)) >= 30 and (s in t or t in s) and common / max(1.0, min(o[5] - o[3], u[5] - u[3])) >= 0.6

            at = next((k for k, o in enumerate(kept) if alike(o)), None)
            if at is None:
                kept.append(u)
            elif len(t) > len(kept[at][6].strip()):
                kept[at] = u
        wanted |= {(page, u[1], n) for n, u in enumerate(kept)}
    assert {tuple(r) for r in D.keep_longest(units).select("page_id", "reading_order", "place").collect()} == wanted
    assert "aggregate(" not in D.keep_longest(units)._jdf.queryExecution().toString()


def test_steps_over_nested_words_and_chunks(spark, sf_dir):
    """Paragraphs are grouped, not their words; chunks are made once for all that reads them; a chunk's units go to it without a
    copy of the page."""
    words = reading.ocr_words(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert words.count("Generate") == 2
    chunks = records.document_chunks(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents.parquet" not in chunks and "aggregate(" not in chunks
    packed = pages.chunk_packing(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(" not in packed
