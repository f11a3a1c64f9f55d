"""Trained operators: gradients against differences, decoding against enumeration, accuracy on rows held out."""

import itertools

import numpy as np

from folioq.llm import langid, lines, pii
from folioq.llm._spark import sampled


def test_language_gradient():
    rng = np.random.default_rng(0)
    net = langid.new_network(["a", "b", "und"], 3, rng)
    data, goal = rng.integers(0, 256, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, grads = langid.gradients(net, data, goal)
    for w, g in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = w[at], 1e-5
        w[at] = old + eps
        up = langid.gradients(net, data, goal)[0]
        w[at] = old - eps
        down = langid.gradients(net, data, goal)[0]
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-5


def test_language_accuracy_on_rows_held_out(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    model = langid.compiled(langid.train([r.text for r in rows[::2]], [r.lang for r in rows[::2]]))
    held = rows[1::2]
    best, p, share = langid.predict(model, [r.text for r in held])
    right = np.mean([model["labels"][b] == r.lang for b, r in zip(best, held, strict=True)])
    assert right >= 0.95 and ((p >= 0) & (p <= 1.001)).all() and (share <= 1.001).all()


def test_language_rejects_noise_and_keeps_short_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fitted(docs)
    texts = ["%%$# 123 &&* @@ 99 ### 1234567890 ((())) 777 ###", "", None, "The onand is of the tion that with ering the", "x" * 300000]
    best, p, _ = langid.predict(model, texts)
    names = [model["labels"][b] for b in best]
    assert names[:3] == ["und"] * 3 and names[3] == "en" and p[1] == 1
    one = langid.predict(model, ["La eau que des ouvi éaux de la"])
    many = langid.predict(model, ["padding text"] * 50 + ["La eau que des ouvi éaux de la"])
    assert one[0][0] == many[0][-1] and abs(one[1][0] - many[1][-1]) < 1e-5


def test_language_edges(spark):
    df = spark.createDataFrame([(None, "a b c", "en", 1), (1, None, "en", 2), (1, "", None, 3)], "doc_id long, text string, lang string, language int")
    assert langid.identified(df).count() == 3 and langid.accept(df).columns == df.columns
    assert langid.identified(df.limit(0)).collect() == [] and langid.accept(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", df.lang.substr(99, 1)).where("lang IS NULL")
    assert {r.language for r in langid.identified(unlabelled).collect()} <= {"und"}


TEXTS = ["One plain sentence of words.\nbuy now!!! $$$ %%%\n\nAnother plain sentence here.", "All rights reserved.\n| a | b | c |", "", None, "single", "a\n" * 500]


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    found = lines.lines([t if t is None else t[:60] for t in TEXTS])
    w, change = rng.normal(size=len(lines.FEATURES)), rng.normal(size=(2, 2))
    label, score = lines.viterbi(found, w, change), found.x @ w
    for i in range(len(TEXTS)):
        a, b = found.first[i], found.first[i + 1]
        if 0 < b - a <= 12:
            value = lambda y, a=a: sum(score[a + t] * v for t, v in enumerate(y)) + sum(change[u, v] for u, v in itertools.pairwise(y))
            best = max(itertools.product((0, 1), repeat=b - a), key=value)
            assert abs(value(best) - value(label[a:b].tolist())) < 1e-9


def test_line_gradient():
    rng = np.random.default_rng(2)
    found = lines.lines(TEXTS[:2])
    gold = rng.integers(0, 2, len(found.size))
    w, change = rng.normal(size=len(lines.FEATURES)) / 3, rng.normal(size=(2, 2)) / 3

    def likelihood():
        total = 0.0
        score = found.x @ w
        for i in range(2):
            a, b = found.first[i], found.first[i + 1]
            value = lambda y, a=a: sum(score[a + t] * v for t, v in enumerate(y)) + sum(change[u, v] for u, v in itertools.pairwise(y))
            total += value(gold[a:b]) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=b - a)))
        return total

    g_w, g_c = lines._gradient(found, gold, w, change)
    for x, g, at in ((w, g_w, (1,)), (w, g_w, (12,)), (change, g_c, (0, 1)), (change, g_c, (1, 1))):
        old, eps = x[at], 1e-5
        x[at] = old + eps
        up = likelihood()
        x[at] = old - eps
        down = likelihood()
        x[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-6


def test_quality_on_documents_held_out(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    labels = sorted((r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.doc_id in docs)
    train, held = labels[::2], labels[1::2]
    model = lines.fit(lines.lines([docs[d] for d, _ in train]), np.array([q for _, q in train]))
    keep = lines.shares(model, [docs[d] for d, _ in held])[2] >= lines.SHARE
    assert np.mean(keep == np.array([q for _, q in held])) >= 0.9


def test_quality_edges(spark):
    df = spark.createDataFrame([(None, "A plain sentence of words.", 1), (1, None, 2), (1, "", 3), (2, "  \n ", 4)], "doc_id long, text string, lines int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = {(r.doc_id, r.lines): r.retained for r in lines.judged(df, none).collect()}
    assert rows == {(None, 1): True, (1, 0): False, (2, 0): False}
    assert lines.retain(df, none).columns == df.columns and lines.retain(df, none).count() == 1
    labelled = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert lines.judged(df.limit(0), labelled).collect() == [] and lines.judged(df, labelled).count() == 4


def exact(g, w):
    """Marginals of every node by enumeration."""
    k, n = len(pii.LABELS), len(g.x)
    unary = g.x @ w.unary.T
    total = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        v = sum(unary[i, a] for i, a in enumerate(y)) + sum(w.change[y[a], y[b]] for a, b in g.chain) + sum(w.agree[y[a]] * (y[a] == y[b]) for a, b in g.skip)
        for i, a in enumerate(y):
            total[i, a] += np.exp(v)
    return total / total.sum(1, keepdims=True)


def test_messages_are_exact_on_trees():
    rng = np.random.default_rng(3)
    g = pii.graph(["mail a1@b.org now"])
    assert not len(g.skip) and 2 <= len(g.x) <= 5
    k = len(pii.LABELS)
    w = pii.Weights(rng.normal(size=(k, len(pii.FEATURES))), rng.normal(size=(k, k)), rng.normal(size=k))
    assert np.allclose(np.exp(pii.propagate(g, w, tolerance=1e-10, rounds=200)[0]), exact(g, w), atol=1e-5)


def test_a_clear_place_decides_the_unclear_one():
    w = pii.start_weights()
    w.agree[:] = 4
    code = "Zx9Qw7Lm2Kp4Rt8Vb3"
    alone = pii.entities([f"see {code} there"], w)[0]
    joined = pii.entities([f"api_key = '{code}' and then far below " + "words " * 200 + f"see {code} there"], pii.fit([f"token = '{code}{k}' x" for k in range(9)]))[0]
    assert not alone and [n for n, _, _ in joined] == ["SECRET", "SECRET"]


def test_private_data_is_found_and_the_rest_left_alone(spark):
    kinds = ["ann.lee@mail.org", "192.168.10.24", "+1-202-555-0143", "4111 1111 1111 1111", "deadbeef0123456789abcdef01234567"]
    rows = [(k, f"Some words before {kinds[k % 5]} and some after it, number {k}.") for k in range(50)] + [(99, "In 2024 there were 15 of 300 things, 3.5 each."), (None, "write to bob@site.net"), (98, None), (97, "")]
    df = spark.createDataFrame([(d, t, len(t) if t else None, "x") for d, t in rows], "doc_id long, text string, n_chars int, entities string")
    out = {r.doc_id: r for r in pii.redacted(df).collect()}
    assert len(out) == len(rows) and pii.redacted(df).columns == df.columns
    for k in range(50):
        secret = kinds[k % 5].split()[-1] if k % 5 == 3 else kinds[k % 5]
        assert secret not in out[k].text and out[k].text.startswith("Some words before <") and out[k].n_chars == len(out[k].text)
    assert out[99].text == rows[50][1] and out[None].text == "write to <EMAIL>" and out[98].text is None and out[97].text == ""
    assert {r.doc_id for r in pii.found(df).collect()} == {*range(50), None}
    assert pii.found(df.limit(0)).collect() == [] and pii.redacted(df.limit(0)).collect() == []


def test_spans_point_at_the_bytes():
    w = pii.fit([f"write to a{k}@b.org or call (202) 555-01{k} now" for k in range(10, 40)])
    text = "é ü mail ann@b.org, (202) 555-0143 end"
    raw = text.encode()
    assert [(n, raw[a:b].decode()) for n, a, b in pii.entities([text], w)[0]] == [("EMAIL", "ann@b.org"), ("PHONE", "(202) 555-0143")]


def test_private_data_in_brackets_and_after_labels():
    w = pii.fit([f"write to a{k}@b.org or call (202) 555-01{k} or +1-202-555-01{k} now, host 10.0.0.{k}, card 4111 1111 1111 11{k} or 41111111111111{k}, {k} of 100" for k in range(10, 60)])
    mail, ip, card = ("EMAIL", "ann@b.org"), ("IP", "10.0.0.1"), ("CARD", "4111 1111 1111 1111")
    cases = {
        "see (ann@b.org) there": [mail], "see mailto:ann@b.org. Then": [mail], "Email:ann@b.org": [mail], "to=ann@b.org/x": [mail], "~ann@b.org": [mail], "see (ann@b.org).": [mail],
        "ann@b.org,bob@c.net": [mail, ("EMAIL", "bob@c.net")], "host (10.0.0.1) is": [ip], "host 10.0.0.1:8080 is": [ip], "at http://10.0.0.1/a is": [ip], "paid (4111 1111 1111 1111) so": [card],
        "paid card=4111111111111111 so": [("CARD", "4111111111111111")], "call (743)555-3824 now": [("PHONE", "(743)555-3824")], "call 743 555 3824 now": [("PHONE", "743 555 3824")], "call tel:743-555-3824 now": [("PHONE", "743-555-3824")],
        "call (743) 555 3824, now": [("PHONE", "(743) 555 3824")], "call ((743)555-3824) now": [("PHONE", "(743)555-3824")],
        "at 12:30 in 2024/05/06 (page 3) and f(12) of 1/2 = 0.5, x=3": [], "sums of 100 200 3000 4000 and 743, 555, 3824": [],
    }
    for text, want in cases.items():
        raw = text.encode()
        assert [(n, raw[a:b].decode()) for n, a, b in pii.entities([text], w)[0]] == want, text
    g = pii.graph(["ask ann@b.org first and then after many other words (ann@b.org) too"])
    assert len(g.skip) == 1


def test_a_sample_has_as_many_different_texts_with_copies_among_them(spark):
    df = spark.createDataFrame([(1, "copy")] * 50 + [(k, f"text {k}") for k in range(2, 9)], "h long, t string")
    assert [r.h for r in sampled(df, "h", 5)] == [1, 2, 3, 4, 5]


def test_messages_with_skip_edges_come_close_to_enumeration():
    """Repetitions make loops, where sum-product messages aren't exact: they give the labels of the enumeration, and its
    marginals within 0.1."""
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    for text, skips in (("a1@b.org to a1@b.org", 1), ("see 12345 or 12345 x", 1), ("ab12345 ab12345 or ab12345", 1), ("777123 and 777123 or 777133", 2)):
        g = pii.graph([text], None)
        assert len(g.skip) >= skips and len(g.x) == len(text.split())
        for _ in range(5):
            w = pii.Weights(rng.normal(size=(k, len(pii.FEATURES))) / 2, rng.normal(size=(k, k)) / 2, np.abs(rng.normal(size=k)))
            got, want = np.exp(pii.propagate(g, w)[0]), exact(g, w)
            assert np.abs(got - want).max() < 0.1
            clear = np.sort(want, 1)[:, -1] - np.sort(want, 1)[:, -2] > 0.1
            assert (got.argmax(1) == want.argmax(1))[clear].all()


def test_a_field_around_the_signs_equals_the_whole_field(spark):
    """All words as nodes against those within REACH of a sign: same labels, same marginals but for the tolerance."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(300).collect()]
    texts += [t for t, _ in pii.drills(60, 99)] + ["Mr. Smith was " + "there and then so on again " * 20 + "where Smith met 10.0.0.1"]
    w = pii.fit(texts[:200])
    part, whole = pii.graph(texts), pii.graph(texts, None)
    a, b = pii.propagate(part, w)[0], pii.propagate(whole, w)[0]
    at = {(d, s, e): i for i, (d, s, e) in enumerate(zip(whole.doc.tolist(), whole.start.tolist(), whole.end.tolist(), strict=True))}
    same = [at[x] for x in zip(part.doc.tolist(), part.start.tolist(), part.end.tolist(), strict=True)]
    assert len(part.x) < len(whole.x) / 2 and np.abs(np.exp(a) - np.exp(b[same])).max() < 1e-3
    rest = np.setdiff1d(np.arange(len(whole.x)), same)
    assert not b[rest].argmax(1).any() and not b[same].argmax(1)[a.argmax(1) != b[same].argmax(1)].any()


def test_entities_without_ascii_digits_and_what_only_looks_like_one(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text RLIKE '[0-9@]'").orderBy("doc_id").limit(300).collect()]
    w = pii.fit(rows)
    cases = {
        "my password = correcthorsebattery and so on": [("SECRET", "correcthorsebattery")], "SSN 123-45-6789 of it": [("ID", "123-45-6789")], "call 0161 496 0000 now": [("PHONE", "0161 496 0000")],
        "reach bob (at) site dot net please": [("EMAIL", "bob (at) site dot net")], "host ١٩٢.١٦٨.١.١ there": [("IP", "١٩٢.١٦٨.١.١")], "ring +44 20 7946 0958 today": [("PHONE", "+44 20 7946 0958")],
        "so password=hunterhunter it is": [("SECRET", "password=hunterhunter")],
        "the years 2001 2002 2003 2004 were": [], "see ISBN 9781234567897 for more": [], "order number 1234567890123456 is on its way": [], "version 1.2.3.4 of the tool": [],
        "dear Mr. Smith, " + "and on it went " * 15 + "until Smith said": [("NAME", "Smith"), ("NAME", "Smith")],
    }
    for text, want in cases.items():
        raw = text.encode()
        assert [(n, raw[a:b].decode()) for n, a, b in pii.entities([text], w)[0]] == want, text
    together = pii.entities([*cases, *rows], w)
    assert together[: len(cases)] == [pii.entities([t], w)[0] for t in cases]


def test_one_entity_has_one_label_in_a_document(spark):
    """Clear in one place, unclear in others: the skip chain carries the label over any distance."""
    w = pii.fit(["mail a@b.org"])
    code = "abcdefgh12345678"
    text = f"token = '{code}' " + "and so it went on " * 400 + f"{code} twice {code}"
    assert [n for n, _, _ in pii.entities([text], w)[0]] == ["SECRET"] * 3


def test_private_data_in_very_long_and_odd_texts(spark):
    w = pii.fit(["mail a@b.org"])
    long = "word " * 400_000 + "ann@b.org " + "x" * 1_000_000 + " end"
    raw = long.encode()
    assert [(n, raw[a:b]) for n, a, b in pii.entities([long], w)[0]] == [("EMAIL", b"ann@b.org")]
    numbers = " ".join(str(k) for k in range(20_000))
    assert pii.entities([numbers, "", None, " \n ", "@", "1", "=", "password=", "Mr."], w)[1:] == [[]] * 8
    df = spark.createDataFrame([(1, "mail ann@b.org", 7, "r")] * 3, "doc_id long, text string, entities int, redacted string")
    assert [r.redacted for r in pii.found(df).collect()] == ["mail <EMAIL>"] * 3 and pii.redacted(df).columns == df.columns


def test_query_equals_search_of_every_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = pii.fitted(docs)
    want = {(r.doc_id, pii.redact(r.text, s), tuple(s)) for r in docs.collect() if (s := pii.entities([r.text], w)[0])}
    got = {(r.doc_id, r.redacted, tuple(map(tuple, r.entities))) for r in pii.op2_skip_chain_pii(spark, sf_dir).collect()}
    assert got == want and got


def test_language_network_in_inference_equals_the_trained_one():
    """_run's folded single-precision pass against the forward pass that gradients() differentiates, by the loss."""
    rng = np.random.default_rng(5)
    net = langid.new_network(["a", "b", "und"], 4, rng)
    data = rng.integers(0, 256, (6, 20)).astype(np.uint8)
    total, given = langid._run(langid.compiled(net), data, np.full(6, 20))
    for label in range(3):
        # The mean log-probability of a label over the positions, from the loss, bounds the log of its mean probability.
        loss = [langid.gradients(net, data[k : k + 1], np.array([label]))[0] for k in range(6)]
        assert (np.log(total[:, label] / 20) >= -np.array(loss) - 1e-4).all()
    one = langid._run(langid.compiled(net), data[:, :1], np.full(6, 1))[0]
    for label in range(3):
        loss = [langid.gradients(net, data[k : k + 1, :1], np.array([label]))[0] for k in range(6)]
        assert np.allclose(one[:, label], np.exp(-np.array(loss)), atol=1e-5)
    assert np.allclose(total.sum(1), 20, atol=1e-3) and (given.sum(1) == 20).all()


def test_language_without_labels_keeps_the_texts(spark):
    df = spark.createDataFrame([(1, "some text", None, True), (2, "", None, False), (3, None, None, None)], "doc_id long, text string, lang string, accepted boolean")
    assert [r.doc_id for r in langid.accept(df).collect()] == [1] and langid.accept(df).columns == df.columns
    assert {r.doc_id: r.accepted for r in langid.identified(df).collect()} == {1: True, 2: False, 3: False}


def test_quality_query_equals_judging_every_text(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = lines.fitted(docs, labels)
    rows = docs.collect()
    want = {r.doc_id: (n, c) for r, n, c, s in zip(rows, *lines.shares(model, [r.text for r in rows]), strict=True) if n and s >= lines.SHARE}
    assert {r.doc_id: (r.lines, r.content_lines) for r in lines.op1_line_quality(spark, sf_dir).collect()} == want


def test_quality_of_very_long_texts_and_repeated_labelled_rows(spark):
    long = "A plain sentence of words goes here.\n" * 60_000
    df = spark.createDataFrame([(1, long), (2, "buy!!! $$$ %%%")] + [(3, "A plain sentence of words.")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    got = lines.judged(df, labels).collect()
    assert len(got) == 52 and next(r for r in got if r.doc_id == 1).retained and next(r for r in got if r.doc_id == 1).lines == 60_000
