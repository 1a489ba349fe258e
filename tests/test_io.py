import gzip
import json
import zipfile

from pyspark.sql import functions as F

from filinglake.sources import readers, writers
from filinglake.streaming import events


def test_tsv_in_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("num.tsv", b"adsh\tvalue\nA\t1\nB\t\xff2\n")
        z.writestr("other.tsv", "x\n1\n")
    rows = readers.read_tsv_from_zip(spark, str(tmp_path / "*.zip"), "num.tsv", ["adsh", "value", "missing"]).orderBy("row_seq").collect()
    assert [(r.adsh, r.value, r.missing) for r in rows] == [("A", "1", None), ("B", "�2", None)]
    members = readers.read_archives(spark, str(tmp_path / "*.zip"), ".tsv").collect()
    assert {m.member for m in members} == {"num.tsv", "other.tsv"}


def test_filing_index(spark, tmp_path):
    (tmp_path / "company.idx").write_text("Title\n\nCompany Name   Form Type   CIK\n-----\nACME CORP, INC.      10-K        1234        2021-03-01  edgar/data/1.txt\nB CO      10-K/A      77   2021-03-02  e/2.txt\nnonsense\n")
    rows = readers.read_filing_index(spark, str(tmp_path / "company.idx")).orderBy("cik").collect()
    assert [(r.cik, r.company_name, r.form_type, str(r.date_filed)) for r in rows] == [("1234", "ACME CORP, INC.", "10-K", "2021-03-01"), ("77", "B CO", "10-K/A", "2021-03-02")]


def test_company_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"2020-12-31": {"Equity": {"value": "<number>12.5</number>", "unit": "GBP"}, "Staff": {"value": "7"}}}))
    (tmp_path / "b.json").write_text("{broken")
    rows = readers.read_company_json(spark, str(tmp_path)).orderBy("metric").collect()
    assert [(r.file_name, r.metric, r.value, r.unit) for r in rows] == [("a.json", "Equity", 12.5, "GBP"), ("a.json", "Staff", 7.0, None)]


def test_ixbrl(spark, tmp_path):
    (tmp_path / "f.html").write_text(
        '<html><body><xbrli:context id="c1"><xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:period></xbrli:context>'
        '<xbrli:context id="c2"><xbrli:period><xbrli:instant>2019-12-31</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id="p"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit>'
        '<ix:nonFraction name="core:Equity" contextRef="c2" unitRef="u" scale="3" sign="-">1,234</ix:nonFraction><ix:nonFraction name="core:AverageNumberEmployees" contextRef="c1" unitRef="p">55</ix:nonFraction><ix:nonFraction name="core:X" contextRef="c1" unitRef="zz">5</ix:nonFraction></body></html>'
    )
    rows = readers.read_ixbrl(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.period_end, r.name, r.value, r.unit) for r in rows] == [("2020-12-31", "AverageNumberEmployees", 55.0, None), ("2019-12-31", "Equity", -1234000.0, "GBP")]


def test_warc_ranges(spark, tmp_path):
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nHTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>\xc3\xa9</html>\r\n\r\n"
    packed = gzip.compress(rec)
    (tmp_path / "a.warc").write_bytes(b"junk" + packed + b"tail")
    index = spark.createDataFrame([("u", "d", "a.warc", 4, len(packed)), ("v", "d", "none.warc", 0, 9)], "url string, domain string, warc_filename string, offset long, length long")
    rows = readers.read_warc_ranges(spark, index, f"file://{tmp_path}").collect()
    assert [r.html for r in rows] == ["<html>é</html>", None]
    assert readers.warc_response(rec) == "<html>é</html>" and readers.warc_response(b"x") is None


def test_texts_and_jsonl(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.md").write_text("A\nB")
    (tmp_path / "t/b.txt").write_text("C")
    (tmp_path / "t/c.bin").write_text("no")
    assert [tuple(r) for r in readers.read_texts(spark, str(tmp_path / "t")).orderBy("source_file").collect()] == [("a.md", "A\nB"), ("b.txt", "C")]
    (tmp_path / "x.jsonl").write_text('{"stem":"s","html":"1"}\n\nbad\n{"stem":"s","html":"2"}\n')
    assert [r.html for r in readers.read_jsonl_last(spark, str(tmp_path / "x.jsonl"), "stem string, html string").collect()] == ["2"]


def test_primary_document_and_captures(spark):
    rows = spark.createDataFrame([("f", 1, 5, "/a.htm", 10), ("f", 2, 5, "/ix?doc=/b.htm", 20), ("f", 3, 5, "/c.htm", 20), ("f", 4, 4, "/d.htm", 99), ("f", 5, 5, "/e.txt", 99), ("g", 1, 5, "/z.htm", 0)], "filing string, pos int, n_cells int, href string, size long")
    assert [tuple(r) for r in readers.primary_document(rows).collect()] == [("f", "/b.htm")]
    caps = spark.createDataFrame([("d", f"http://d/{'x/' * k}p", f"2018{k}", "text/html") for k in range(5)] + [("d", "http://d/p/", "2017", "text/html; a"), ("d", "http://d/q", "1", "image/png")], "domain string, url string, timestamp string, mime string")
    got = readers.wayback_captures(caps, 3).orderBy("depth").collect()
    assert [r.depth for r in got] == [1, 2, 3] and got[0].timestamp == "2017"


def test_sinks(spark, tmp_path):
    p = str(tmp_path)
    facts = spark.createDataFrame([("T", "2020-12-31", "Equity", 1.0, "GBP"), ("T", "2019-12-31", "Equity", 2.5, "GBP")], "file_name string, period_end string, metric string, value double, unit string")
    writers.write_company_json(facts, f"{p}/c")
    back = spark.read.json(f"{p}/c").collect()
    assert back[0].financials["2020-12-31"]["Equity"]["value"] == "<number>1</number>"
    pages = spark.createDataFrame([("d", 2, "u2", "c"), ("d", 1, "u1", "c")], "domain string, page_rank int, url string, crawl string")
    writers.write_manifest(pages, f"{p}/m")
    assert [x.url for x in spark.read.json(f"{p}/m").first().pages] == ["u1", "u2"]
    assert writers.append_new(pages, f"{p}/a", "url") == 2 and writers.append_new(pages, f"{p}/a", "url") == 0
    writers.write_ranking(pages, f"{p}/r", "page_rank", "url", 1)
    assert spark.read.json(f"{p}/r").first().url == "u2"
    writers.write_csv(pages, f"{p}/v")
    assert readers.read_csv(spark, f"{p}/v").count() == 2
    writers.write_by_period(pages.withColumn("year", F.lit(2020)), f"{p}/y")
    assert spark.read.parquet(f"{p}/y").filter("year = 2020").count() == 2
    assert readers.read_or_empty(spark, f"{p}/none", "a long").count() == 0
    writers.copy_matched(pages, pages.limit(1), "url", f"{p}/k")
    assert spark.read.parquet(f"{p}/k").count() == 1


def test_stream_resumes_where_it_ended(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    land, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    e.filter("event_id % 2 = 0").coalesce(1).write.parquet(land)
    run = lambda: events.run_to_parquet(events.keep_first(events.landing(spark, land, e.schema), ["user_id"]).select("user_id", "event_id"), out, state)
    run()
    first = spark.read.parquet(out).count()
    assert first == e.filter("event_id % 2 = 0").select("user_id").distinct().count()
    e.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(land)
    run()
    assert spark.read.parquet(out).count() == e.select("user_id").distinct().count() >= first


def test_windows_and_sessions(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    land = str(tmp_path / "in")
    e.coalesce(1).write.parquet(land)
    events.run_to_parquet(events.tumbling(events.landing(spark, land, e.schema), "event_type", "value"), str(tmp_path / "w"), str(tmp_path / "ws"))
    events.run_to_parquet(events.sessions(events.landing(spark, land, e.schema), "user_id"), str(tmp_path / "s"), str(tmp_path / "ss"))
    # what the watermark has closed, as the batch form counts it
    t = e.withColumn("ts", F.col("ts").cast("timestamp"))
    closed = t.agg((F.max("ts") - F.expr("interval 1 hour")).alias("w")).first().w
    w = t.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).filter(F.col("window.end") <= closed).select("window.start", "event_type", "n", "total")
    s = t.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("session_window.end") <= closed).select("session_window.start", "session_window.end", "user_id", "n")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "w")).collect())) == sorted(map(tuple, w.collect())) != []
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == sorted(map(tuple, s.collect())) != []
