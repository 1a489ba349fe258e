import base64
import glob
import gzip
import hashlib
import io

import pytest

from filinglake.llm import queries as Q
from filinglake.llm import warc
from tests.compare import differences

BIG = "<p>" + "äöü ab<br>" * 400_000
ROWS = [
    (4, "http://a.b/x?q=1", "<p>same</p>"), (2, "http://a.b/y z\r\nX: 1", "<p>same</p>"), (None, "http://c/", "<p>same</p>"), (2, "http://a.b/y z\r\nX: 1", "<p>same</p>"), (2, "http://zz/", "<p>same</p>"),
    (7, None, None), (8, "http://e/ü", ""), (9, "no scheme", "HTTP/1.1 200 OK\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (10, "http://big/", BIG), (11, "http://big/2", BIG), (None, None, "<alone>"), (None, "http://n/", "<alone>"), (12, "", "\x00\x1f\x8b"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def plain(rows):
    out = []
    for i, url, html in rows:
        html = html or ""
        alike = [(p is None, p or 0, u or "", u is None) for p, u, h in rows if (h or "") == html]
        first = min(alike)
        mine = (i is None, i or 0, url or "", url is None)
        response = mine == first or first[0]
        out.append((i, len(html.encode()), digest(html), "response" if response else "revisit", None if response else first[1]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, `a.b` string, __sha int").repartition(3)


@pytest.fixture(scope="module")
def manifest(pages):
    return warc.write(pages)


def test_write_and_read_back(manifest):
    got = [tuple(r) for r in warc.page_rows(warc.captures(manifest)).collect()]
    assert sorted(got, key=repr) == plain(ROWS)


def test_archives_read_by_a_plain_reader(manifest):
    kinds, held = {}, {}
    for row in manifest.collect():
        raw = gzip.open(f"{row.path}/{row.file}".removeprefix("file://")).read()
        source, n = io.BytesIO(raw), 0
        while line := source.readline():
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := source.readline()) != b"\r\n":
                k, v = line.decode().rstrip("\r\n").split(": ", 1)
                head[k] = v
            block = source.read(int(head["Content-Length"]))
            assert source.read(4) == b"\r\n\r\n"
            kinds[head["WARC-Type"]] = kinds.get(head["WARC-Type"], 0) + 1
            if head["WARC-Type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                assert head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
                held[head["WARC-Record-ID"]] = payload
            if head["WARC-Type"] == "revisit":
                assert block.endswith(b"\r\n\r\n") and "WARC-Refers-To" in head
            n += 1
        assert n == row.n_records
    assert kinds == {"response": 8, "revisit": 5, "request": 13, "metadata": 13} and len(held) == 7


def test_payloads_by_place(manifest):
    caught = warc.captures(manifest).filter("response.type = 'response'").select("response.*")
    got = {r.record_id: bytes(r.payload) for r in warc.payloads(caught).collect()}
    assert sorted(set(got.values())) == sorted({(h or "").encode() for _, _, h in ROWS})


def test_small_payloads_are_not_shared_and_files_are_cut(spark, pages):
    manifest = warc.write(pages.repartition(1), least=100, file_bytes=500)
    rows = warc.page_rows(warc.captures(manifest)).collect()
    assert sorted(r.page_id for r in rows if r.record_type == "revisit") == [11]
    assert manifest.count() > 5 and len(rows) == len(ROWS)


def archive(tmp_path, name, records):
    with open(tmp_path / name, "wb") as f:
        w = warc.ArchiveWriter(f)
        for kind, rid, headers, block in records:
            w.add(kind, rid, headers, [block])
    return (f"file://{tmp_path}", name)


def test_assembly_whichever_record_names_which(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    fields = [("Content-Type", "application/warc-fields")]
    files = [
        archive(tmp_path, "a.warc.gz", [("warcinfo", "<i>", fields, b"software: x\r\n"), ("response", "<r1>", [("WARC-Concurrent-To", "<q1>"), ("WARC-Concurrent-To", "<m1>")], http), ("request", "<q2>", [("WARC-Concurrent-To", "<r2>")], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n")]),
        archive(tmp_path, "b.warc.gz", [("request", "<q1>", [], b"GET /1 HTTP/1.1\r\nHost: h1\r\n\r\n"), ("metadata", "<m1>", fields, b"page_id: 1\r\n"), ("metadata", "<m2>", [*fields, ("WARC-Concurrent-To", "<q2>")], b"page_id: 2\r\n"), ("response", "<r2>", [], http)]),
        archive(tmp_path, "c.warc.gz", [("response", "<r3>", [], http), ("metadata", "<m9>", [*fields, ("WARC-Concurrent-To", "<r4>")], b"page_id: 9\r\n"), ("metadata", "<m4>", [*fields, ("WARC-Concurrent-To", "<r4>")], b"page_id: 4\r\n"), ("revisit", "<r4>", [("WARC-Refers-To", "<r1>"), ("WARC-Payload-Digest", "sha1:ABC")], b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\n")]),
    ]
    caught = warc.captures(spark.createDataFrame(files, "path string, file string"))
    got = {r.response.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id, r.metadata and dict(r.metadata.fields)) for r in caught.collect()}
    assert got == {"<r1>": ("<q1>", "<m1>", {"page_id": "1"}), "<r2>": ("<q2>", "<m2>", {"page_id": "2"}), "<r3>": (None, None, None), "<r4>": (None, "<m4>", {"page_id": "4"})}
    pages = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_rows(caught).collect()}
    assert pages[4] == (4, "ABC", "revisit", 1) and pages[1][2] == "response" and pages[None][3] is None


def test_a_damaged_payload_is_an_error(spark, tmp_path):
    bad = archive(tmp_path, "bad.warc.gz", [("response", "<r>", [("WARC-Payload-Digest", "sha1:AAAA")], b"HTTP/1.1 200 OK\r\n\r\nbody")])
    with pytest.raises(Exception, match="does not match its digest"):
        warc.scan(spark.createDataFrame([bad], "path string, file string")).count()


def test_empty_table(pages):
    assert warc.page_rows(warc.captures(warc.write(pages.limit(0)))).count() == 0


def test_hot_payload(spark):
    rows = spark.range(3000).selectExpr("id as page_id", "concat('http://h/', id) as url", "if(id % 3 < 2, '<p>hot</p>', concat('<p>', id)) as html")
    got = warc.page_rows(warc.captures(warc.write(rows))).collect()
    assert len(got) == 3000 and sum(r.refers_to == 0 for r in got if r.refers_to is not None) == 1999


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    assert differences(Q.QUERIES["op12_warc"](spark, f"/root/testdata/{sf}"), Q.ORACLES["op12_warc"], f"/root/testdata/{sf}") == ""
