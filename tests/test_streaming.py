"""Streams: a restarted run takes in new files only, and a batch done twice changes nothing."""

from folioq.sources.corpus import html_units, pdf_files
from folioq.streaming.ingest import current, event_counts, keep_collection, read_points

SCHEMA = "id long, v string, version long"


def test_collection_follows_files(spark, tmp_path):
    source, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: keep_collection(read_points(spark, source, SCHEMA), store, "id", "version", state).awaitTermination()
    put([(1, "a", 1), (1, "b", 2), (2, "c", 1)])
    run()
    assert sorted(map(tuple, current(spark, store, 1).collect())) == [(1, "b", 2), (2, "c", 1)]
    put([(2, "d", 3), (3, "e", 1)])
    run()
    assert sorted(map(tuple, current(spark, store, 2).collect())) == [(1, "b", 2), (2, "d", 3), (3, "e", 1)]


def test_event_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM counted").first().n == events.count()


def test_files_and_html(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.txt").write_text("no")
    assert [r.length for r in pdf_files(spark, str(tmp_path)).collect()] == [4]
    html = spark.createDataFrame([(1, "<h1>T <b>x</b></h1>\n<P class='a'>one\ntwo</P><nav>menu</nav><p></p>"), (2, None)], "page_id long, html string")
    assert [(r.kind, r.text) for r in html_units(html).orderBy("reading_order").collect()] == [("heading", "T x"), ("paragraph", "one two"), ("noise", "menu")]
