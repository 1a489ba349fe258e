import datetime as dt

import pytest
from pyspark.sql import functions as F

from filinglake.operators import corpus, examples, ocr, worklist
from filinglake.sources import readers, writers

NOW = dt.datetime(2024, 1, 10)
OUTCOME = "item string, ok boolean, at timestamp, error string"


def test_attempts_add_up_however_they_land(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        ("a", False, t(1), "e1"), ("a", False, t(3), "e3"), ("b", False, t(1), "x"), ("b", True, t(2), None), ("b", False, t(5), "late"), ("c", None, t(4), "z"), ("c", False, t(4), "y"), ("c", False, t(2), "w"),
        (None, True, t(1), None), ("d", True, None, None), ("e", False, t(1), None),
    ]
    whole = worklist.attempts(spark.createDataFrame(rows, OUTCOME), most=3, wait_seconds=60)
    got = {r.item: (r.status, r.attempts, r.last_try, r.next_try, r.error) for r in whole.collect()}
    assert got == {
        "a": ("failed", 2, t(3), t(3) + dt.timedelta(seconds=120), "e3"), "b": ("done", 3, t(5), None, None), "c": ("given_up", 3, t(4), None, "y"), "e": ("failed", 1, t(1), t(1) + dt.timedelta(seconds=60), ""),
    }
    for cut in (2, 4):
        state = worklist.attempts(spark.createDataFrame(rows[:cut], OUTCOME), most=3, wait_seconds=60)
        parts = worklist.merged(state, spark.createDataFrame(rows[cut:], OUTCOME), most=3, wait_seconds=60)
        assert {r.item: (r.status, r.attempts, r.last_try, r.next_try, r.error) for r in parts.collect()} == got
    empty = spark.createDataFrame([], OUTCOME)
    assert worklist.attempts(empty).count() == 0 and worklist.merged(whole, empty, most=3, wait_seconds=60).exceptAll(whole).count() == 0


def test_pending_by_output_names_and_state(spark):
    items = spark.createDataFrame([(i, k) for k, i in enumerate("abcdef")], "item string, n int")
    state = spark.createDataFrame([("a", "done", 1, NOW, None, None), ("b", "failed", 1, NOW, NOW + dt.timedelta(1), "e"), ("c", "failed", 1, NOW, NOW, "e"), ("d", "given_up", 5, NOW, None, "e")], worklist.STATE)
    names = spark.createDataFrame([("e.md",), ("f.tmp",), ("f.md.tmp",)], "name string")
    assert sorted(r.item for r in worklist.pending(items, state, names, NOW).collect()) == ["c", "f"]
    assert {r.status: r.n for r in worklist.summary(items, state).collect()} == {"done": 1, "failed": 2, "given_up": 1, "pending": 2}


def test_two_runs_with_a_failure_between_do_each_item_once(spark, tmp_path):
    items = spark.createDataFrame([(f"i{k}",) for k in range(60)], "item string")
    path, calls, crash = f"file://{tmp_path}/work", [], [True]

    def call(work):
        names = sorted(r.item for r in work.collect())
        if len(calls) > 20 and crash[0]:
            raise RuntimeError("the service is gone")
        calls.extend(names)
        ok = ~F.col("item").endswith("7")
        return work.select("item", ok.alias("ok"), F.lit(NOW).cast("timestamp").alias("at"), F.when(~ok, "refused").alias("error"), F.concat(F.lit("text of "), "item").alias("result"))

    with pytest.raises(RuntimeError):
        worklist.run(items, path, call, NOW, batches=6, most=2, wait_seconds=60)
    assert 20 < len(calls) < 60
    crash[0] = False
    state = worklist.run(items, path, call, NOW, batches=6, most=2, wait_seconds=60)
    assert sorted(calls) == sorted(f"i{k}" for k in range(60))
    assert {r.status: r.n for r in worklist.summary(items, state).collect()} == {"done": 54, "failed": 6}
    assert sorted(r.item for r in spark.read.parquet(f"{path}/results").collect()) == sorted(f"i{k}" for k in range(60) if k % 10 != 7)
    again = worklist.run(items, path, call, NOW + dt.timedelta(hours=1), batches=6, most=2, wait_seconds=60)
    assert len(calls) == 66 and {r.status: r.n for r in worklist.summary(items, again).collect()} == {"done": 54, "given_up": 6}


def test_a_result_that_landed_before_its_state_is_not_done_again(spark, tmp_path):
    path = f"file://{tmp_path}/work"
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    spark.createDataFrame([("a", "there")], "item string, result string").write.parquet(f"{path}/results")
    asked = []

    def call(work):
        asked.extend(r.item for r in work.collect())
        return work.select("item", F.lit(True).alias("ok"), F.lit(NOW).cast("timestamp").alias("at"), F.lit("").alias("error"), F.lit("x").alias("result"))

    state = worklist.run(items, path, call, NOW, batches=2)
    assert asked == ["b"] and {r.item: r.status for r in state.collect()} == {"a": "done", "b": "done"}


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        readers.current(spark, path)
    assert readers.current(spark, path, "id long").count() == 0
    writers.replace(spark.range(3), path)
    old = readers.current(spark, path)
    with pytest.raises(Exception, match="broken"):
        writers.replace(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id")), path)
    assert readers.current(spark, path).count() == 3 and old.count() == 3
    for n in (4, 5, 6):
        writers.replace(readers.current(spark, path).union(spark.range(n, n + 1)), path)
    assert sorted(r.id for r in readers.current(spark, path).collect()) == [0, 1, 2, 4, 5, 6]
    assert len(writers.generations(spark, path)) == 2 and not list(tmp_path.glob("table/_pointer*"))


def test_regions_in_reading_order(spark):
    rows = [
        ("f", 0, 2, "text", "third"), ("f", 0, 0, "text", " first "), ("f", 0, 1, "skip", None), ("f", 0, 3, "abandon", "header"), ("f", 0, 4, "table", None), ("f", 2, 0, "text", "page three"), ("f", 2, 10, "text", "piece two"),
        ("f", 0, 2, "text", "th"), ("g", 0, 0, "text", None), ("h", 0, 0, "abandon", "x"), ("f", 0, 5, None, ""),
    ]
    regions = spark.createDataFrame(rows, "stem string, page int, region int, task string, content string")
    pages = ocr.pages_of_regions(regions, per_piece=10)
    got = {(r.stem, r.page, r.piece): (r.markdown, r.n_regions, r.missing) for r in pages.collect()}
    assert got == {("f", 0, 0): ("first\n\nthird", 5, "p0r4"), ("f", 2, 0): ("page three", 1, ""), ("f", 2, 1): ("piece two", 1, ""), ("g", 0, 0): ("", 1, "p0r0")}
    files = spark.createDataFrame([("f", 5), ("g", 1), ("h", 1), ("z", 0)], "stem string, n_pages int")
    docs = {(r.stem, r.part): (r.markdown, r.n_pages, r.n_empty, r.missing) for r in ocr.documents_of_pages(pages, files, 2).collect()}
    assert docs == {("f", 0): ("first\n\nthird", 2, 1, "p0r4"), ("f", 1): ("page three\n\npiece two", 2, 1, ""), ("f", 2): ("", 1, 1, ""), ("g", 0): ("", 1, 1, "p0r0")}
    assert sorted(r.stem for r in ocr.unfinished(pages, files).collect()) == ["h", "z"]
    assert ocr.pages_of_regions(regions.limit(0)).count() == 0


def packed_by_hand(rows, budget, padded):
    out, now = {}, None
    for g, n, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2])):
        n = n or 0
        if now is None or now[0] != g:
            now, batch, used, count = (g,), 0, 0, 0
        if count and (n * (count + 1) > budget if padded else used + n > budget):
            batch, used, count = batch + 1, 0, 0
        used, count = used + n, count + 1
        out[i] = batch
    return out


@pytest.mark.parametrize("padded", [False, True])
def test_packing_by_runs_is_packing_one_by_one(spark, padded):
    import random

    rng = random.Random(padded)
    for budget in (1, 10, 97):
        rows = [(rng.choice([None, 1, 2]), rng.choice([None, 0, 1, 3, 7, 7, 7, 50, 200]), i) for i in range(400)]
        df = spark.createDataFrame([(*r, "x") for r in rows], "g int, n int, id int, `a.b` string")
        got = corpus.greedy_pack(df, "g", "n", "id", budget, padded)
        assert got.columns == ["g", "n", "id", "a.b", "batch"]
        assert {r.id: r.batch for r in got.collect()} == packed_by_hand(rows, budget, padded)


def test_packing_has_no_task_a_group(spark):
    df = spark.range(3000).selectExpr("'one' as g", "id % 40 as n", "id")
    rows = corpus.greedy_pack(df, "g", "n", "id", 500).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sum(r["count"] for r in rows) == 3000
    plan = corpus.greedy_pack(df, "g", "n", "id", 500)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Aggregate" in plan.split("MapInPandas")[1]  # only runs of lengths go through it


def test_windows_are_drawn_with_rejection(spark):
    docs = spark.createDataFrame([(k, [str(j) for j in range(5 * k)]) for k in range(8)], "k int, w array<string>")
    rows = examples.window_draws(docs, "k", "w", 12, 20, attempts=60).collect()
    assert len(rows) == 20 and all(len(r.tokens) == 12 and r.tokens[0] == str(r.start) for r in rows)
    assert {r.k for r in rows} <= set(range(3, 8)) and len({r.k for r in rows}) < 20
    assert [r.attempt for r in rows] == sorted({r.attempt for r in rows}) and max(r.attempt for r in rows) > 20
    assert examples.window_draws(docs, "k", "w", 12, 20, attempts=5).count() < 6 and examples.window_draws(docs, "k", "w", 99, 3).count() == 0


def test_report_has_samples_and_shares(spark):
    df = spark.createDataFrame([(k, k / 10, "`" * 3 + f" text {k}" + "x" * k * 10) for k in range(20)], "id int, density double, text string")
    text = writers.band_report(corpus.quantile_bands(df, "density", "id", [(0, 0.5), (0.5, 1.0)]), "band", "density", "text", "id", samples=2, most=30)
    total = sum(len("``` text ") + len(str(k)) + k * 10 for k in range(20))
    low = sum(len("``` text ") + len(str(k)) + k * 10 for k in range(10))
    assert f"20 rows, {total:,} characters" in text and f"## Band 0: 10 rows, 0.0 to 0.9, {low:,} characters, {100 * low / total:.1f} % of all" in text
    assert text.count("### Sample") == 4 and "### Sample 1: 2, 0.2" in text and "````" in text and f"(cut; {len('``` text 2') + 20} characters)" not in text and f"(cut; {len('``` text 17') + 170} characters)" in text
    assert writers.band_report(df.limit(0).withColumn("band", F.lit(0)), "band", "density") == ""
