"""Operators whose results SQL cannot state, against plain Python over whole tables."""

import math
import zlib

import pytest

from filinglake.functions import urls
from filinglake.operators import corpus, dom, examples, sites
from filinglake.plans import catalogue
from filinglake.session import table
from filinglake.sources import readers, writers

SF = "/root/testdata/sf0.001"
Q = catalogue.QUERIES


def docs(spark):
    return {r.doc_id: r for r in table(spark, SF, "documents").collect()}


def density(t, curve):
    raw = t.encode()
    if len(raw) < 50:
        return -1.0
    n, points = len(raw), sorted(curve)
    if n <= points[0][0]:
        e = points[0][1]
    elif n >= points[-1][0]:
        e = points[-1][1]
    else:
        (a, x), (b, y) = next((p, q) for p, q in zip(points, points[1:]) if p[0] <= n < q[0])
        e = x + (math.log(n) - math.log(a)) / (math.log(b) - math.log(a)) * (y - x)
    return math.log(len(zlib.compress(raw, 6)) / n / e)


def test_density_of_every_document(spark):
    from filinglake.plans.corpus import CURVE

    want = {i: density(d.text, CURVE) for i, d in docs(spark).items() if d.text is not None}
    got = {r.doc_id: r for r in Q["density_score"](spark, SF).collect()}
    assert {i: round(r.density, 9) for i, r in got.items() if i in want} == {i: round(x, 9) for i, x in want.items()}
    assert all(r.kept == (r.density >= -0.4) for r in got.values())
    kept = {r.doc_id: round(r.density, 6) for r in Q["density_snapshot"](spark, SF).collect()}
    assert kept == {i: round(x, 6) for i, x in want.items() if x >= -0.2} and 0 < len(kept) < len(want)


def test_tidied_texts(spark):
    import re

    for r in Q["tidy_markup"](spark, SF).collect():
        t = "<?xml version='1.0'?>  " + re.sub(r"\. ", " .   ", docs_cache(spark)[r.doc_id].text) + "\n\n\n\n  end  "
        t = t.replace("<?xml version='1.0'?>", "").replace(" ", " ")
        lines = [s[: len(s) - len(s.lstrip(" \t"))] + re.sub(r"[ \t]+", " ", s.lstrip(" \t")).rstrip(" \t") if s.strip(" \t") else "" for s in t.split("\n")]
        assert r.text == re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


_HELD = {}


def docs_cache(spark):
    if not _HELD:
        _HELD.update(docs(spark))
    return _HELD


def test_slugs_of_first_lines(spark):
    import re
    import unicodedata

    for r in Q["title_slugs"](spark, SF).collect():
        t = unicodedata.normalize("NFKD", docs_cache(spark)[r.doc_id].text.split("\n")[0])
        word = "".join(c for c in t if c.isalnum() or c == "_" or c.isspace() or c == "-").strip().lower()
        assert r.slug == re.sub(r"\s+", "_", word)[:100]


def test_added_lines_against_the_document_before(spark):
    by_source = {}
    for i, d in sorted(docs(spark).items()):
        by_source.setdefault(d.source, []).append((i, d.text or ""))
    want = {}
    for members in by_source.values():
        for (_, a), (i, t) in zip([(None, ""), *members], members):
            want[i] = sites.diff_added(a, t)
    assert {r.doc_id: r.added for r in Q["added_lines"](spark, SF).collect()} == want


def test_site_pipeline(spark):
    from pyspark.sql import functions as F

    pages = table(spark, SF, "pages").select("page_id", "url", "html", urls.domain(F.col("url")).alias("domain")).collect()
    refs = {r.page_id: r.ref_id for r in sites.reference_pages(spark.createDataFrame([(p.page_id, p.domain, "/".join(p.url.split("/")[3:]) and "/" + "/".join(p.url.split("?")[0].split("#")[0].split("/")[3:]).rstrip("/")) for p in pages], "page_id long, domain string, path string"), "page_id", "domain", "path").collect()}
    md = {p.page_id: dom.markdown(p.html or "") for p in pages}
    want = {}
    for p in pages:
        want[p.page_id] = sites.diff_added(md.get(refs.get(p.page_id), ""), md[p.page_id])
    got = "\n".join(r.text for r in Q["page_texts"](spark, SF).collect())
    assert sum(r.n_pages for r in Q["page_texts"](spark, SF).collect()) == len(pages)
    for p in pages:
        assert f"########## {p.url}\n{want[p.page_id]}" in got


def test_numbers_take_the_place_of_their_spans():
    import public_tokenizers

    words = examples.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    ids, mask, values = examples.encode_numbers("Sales were <number>1200</number> in May, and <number>-0.5</number>.", words)
    assert sum(mask) == 2 and [round(v, 4) for v, m in zip(values, mask) if m] == [round(math.log10(1200), 4), round(math.log10(0.5), 4)]
    assert ids[0] == examples.CLS and ids[-1] == examples.SEP and len(ids) == len(mask) == len(values)
    plain = words("Sales were")
    assert ids[1 : 1 + len(plain)] == plain
    assert "1200" in examples.decode_numbers(ids, mask, values, lambda i: "w")


def test_interrupted_shards_go_on(spark, tmp_path):
    df = spark.range(95).withColumnRenamed("id", "vec_id")
    path = str(tmp_path / "cache")
    assert writers.write_shards(df.filter("vec_id < 40"), path, "vec_id", 10) == 4
    before = sorted(p.name for p in (tmp_path / "cache" / "shard=2").iterdir())
    assert writers.write_shards(df, path, "vec_id", 10) == 6
    assert before == sorted(p.name for p in (tmp_path / "cache" / "shard=2").iterdir())
    assert sorted(r.vec_id for r in readers.read_cache(spark, path).collect()) == list(range(95))
    assert writers.write_shards(df, path, "vec_id", 10) == 0


def test_appends_take_one_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert writers.append_new(rows, path, "k") == 2 and writers.append_new(rows, path, "k") == 0
    assert spark.read.parquet(path).count() == 2
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        writers.append_new(rows.withColumnRenamed("k", "other"), path, "other")


def test_ranks_of_ties_nulls_and_empty_tables(spark):
    rows = [(3, "a"), (1, "b"), (None, "c"), (1, "a"), (1, "b")]
    df = spark.createDataFrame(rows, "v int, t string").repartition(3)
    got = [(r.v, r.t) for r in sorted(corpus.ranked(df, "v", "t").collect(), key=lambda r: r["rank"])]
    assert got == [(None, "c"), (1, "a"), (1, "b"), (1, "b"), (3, "a")]
    assert corpus.ranked(df.limit(0), "v").count() == 0
    inside = sorted((r.t, r["rank"]) for r in corpus.ranked_in(df, "t", "v").collect())
    assert inside == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]


def test_ranks_are_not_taken_in_one_task(spark):
    plan = Q["every_kth"](spark, SF)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("Physical Plan")[-1] or "BroadcastExchange" in plan


def test_equal_pieces_lose_less_than_their_number():
    assert examples.split_text("abcdefghij", 4, "k") == ["ab", "cd", "ef", "gh"]
    assert examples.split_text("ab", 4, "k") == ["a", "b"]


def test_random_pairs_with_gaps_in_the_ids(spark):
    from filinglake.operators import vectors

    df = spark.createDataFrame([(i * 7 + 3, [float(i + 1), 1.0]) for i in range(20)], "vec_id long, e array<double>")
    got = vectors.sampled_pairs(df, "vec_id", "e", 500, 20)
    assert got.count() == got.filter("cos IS NOT NULL").count() > 400


def test_pages_of_any_depth():
    deep = "<body>" + "<div>" * 1000 + "deep" + "</div>" * 1000 + "</body>"
    s = dom.page_stats(deep)
    assert s["max_dom_depth"] == 1002 and s["total_element_count"] == 1002
    assert dom.markdown(deep) == "deep" and dom.filing_text(deep)[0] == "deep"
    nav = "<nav>" + "<ul><li>" * 600 + "x" + "</li></ul>" * 600 + "</nav>"
    assert dom.page_stats(nav)["nav_depth_levels"] == 600
    assert "deep" in dom.sanitize("<p>" + "<b>" * 300 + "deep") and len(dom.prettify(dom.parse(deep)).split("\n")) == 2003


def test_domains_by_a_suffix_list(spark):
    hosts = ["http://a.b.co.uk/x", "https://www.example.com:8080/", "http://www.ck/", "http://x.y.ck/", "http://y.ck/", "http://localhost/", "http://com/", None, "", "http://u@a.b.unlisted/q"]
    rules = spark.createDataFrame([(s,) for s in ("com", "uk", "co.uk", "*.ck", "!www.ck")], "suffix string")
    got = [r.registered for r in sorted(sites.registered_by_list(spark.createDataFrame(list(enumerate(hosts)), "i int, url string"), "url", rules).collect(), key=lambda r: r.i)]
    assert got == ["b.co.uk", "example.com", "www.ck", "x.y.ck", None, None, None, None, None, "b.unlisted"]


def test_html_tree_and_token_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.html").write_text("<p>x</p>")
    (tmp_path / "in/b.txt").write_text("no")
    assert [r.html for r in readers.read_html_tree(spark, str(tmp_path / "in")).collect()] == ["<p>x</p>"]
    assert readers.year_path("/d", "html", 2021) == "/d/html/year=2021"
    t = spark.createDataFrame([("b", [1]), ("a", [2])], "source_file string, input_ids array<int>")
    writers.write_tokens(t, str(tmp_path / "t"), 1)
    assert [r.source_file for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["a", "b"]
    assert writers.band_report(spark.createDataFrame([(0, 1), (0, 3), (1, 5)], "band int, v int"), "band", "v").split("\n") == ["## Band 0: 2 rows, 1 to 3", "## Band 1: 1 rows, 5 to 5"]
    dense = examples.dense_by_chunk(spark.createDataFrame([("d", 1, [2.0]), ("d", 0, [1.0])], "doc string, k int, v array<double>"), "doc", "k", "v")
    assert dense.first().vectors == [[1.0], [2.0]]


def test_byte_budget_reads_up_to_the_target(spark):
    rows = [(k * 7 % 5000, "ä" * (k % 11)) for k in range(5000)] + [(5001, None), (5002, "end")]
    df = spark.createDataFrame(rows, "k int, t string").dropDuplicates(["k"])
    sizes = sorted((k, len((t or "").encode())) for k, t in dict(rows).items())
    for target in (0, 1, 999, 20_000, 10**9):
        want, run = [], 0
        for k, n in sizes:
            if run < target:
                want.append((k, run))
            run += n
        got = corpus.byte_budget(df, "k", "t", target, bucket=10)
        assert sorted((r.k, r.bytes_before) for r in got.collect()) == want
    assert corpus.byte_budget(df.limit(0), "k", "t", 5).count() == 0


def test_lengths_by_counts(spark):
    rows = [("a", k % 7) for k in range(100)] + [("b", 3), (None, 5), (None, 9), ("c", None), ("c", 4)]
    got = {r.g: (r.n, r.total, r.min, r.median, r.max, r["mean"]) for r in corpus.length_stats(spark.createDataFrame(rows, "g string, n int"), "g", "n").collect()}
    a = sorted(k % 7 for k in range(100))
    assert got == {"a": (100, sum(a), 0, a[50], 6, round(sum(a) / 100, 4)), "b": (1, 3, 3, 3, 3, 3.0), None: (2, 14, 5, 9, 9, 7.0), "c": (2, 4, 4, 4, 4, 4.0)}


def test_ranks_in_groups_keep_the_null_group(spark):
    got = corpus.ranked_in(spark.createDataFrame([(None, 3), (None, 1), ("a", 5), ("a", 2)], "g string, n int"), "g", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 3, 1), (None, 1, 0), ("a", 5, 1), ("a", 2, 0)], key=str)


def test_intermediate_tables_are_forgotten(spark, tmp_path):
    from pathlib import Path

    from filinglake import session

    session.forget(spark)
    df = session.written(spark.range(5), "kept")
    at = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert session.shared_dir(spark) == session.shared_dir(spark) and df.count() == 5 and at.exists()
    assert session.forget(spark) == 1 and not at.exists() and session.forget(spark) == 0


def test_a_summary_computes_its_input_once(spark):
    from filinglake.operators import facts

    df = spark.range(11).selectExpr("id / 10.0D - 0.2D AS marked_input")
    got = facts.score_summary(df, "marked_input")
    assert "marked_input" not in got._jdf.queryExecution().toString()  # all figures come from the written rows
    assert [round(x, 6) for x in got.first()] == [11, 0.3, -0.2, 0.8, round(8 / 11, 6), 0.3, -0.1, 0.7]
