import json

import pytest

from filinglake.sources import readers


def test_company_metadata_from_its_four_kinds_of_files(spark, tmp_path):
    (tmp_path / "tickers.json").write_text(json.dumps({"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple Inc."}, "1": {"cik_str": 7, "ticker": "OLD", "title": "x"}, "10": {"cik_str": 7, "ticker": "NEW", "title": "y"}, "2": {"cik_str": 7, "ticker": "MID", "title": "z"}}))
    assert sorted(tuple(r) for r in readers.read_tickers(spark, str(tmp_path / "tickers.json")).collect()) == [("320193", "AAPL", "Apple Inc."), ("7", "NEW", "y")]
    bindings = [{"ticker": {"value": v}, "website": {"value": w}} for v, w in ((" aapl ", " http://a "), ("AAPL", "http://b"), ("x", "http://x"))] + [{"ticker": {"value": "n"}}]
    (tmp_path / "sites.json").write_text(json.dumps({"head": {}, "results": {"bindings": bindings}}))
    assert sorted(tuple(r) for r in readers.read_websites(spark, str(tmp_path / "sites.json")).collect()) == [("AAPL", "http://a"), ("X", "http://x")]
    folder = tmp_path / "ids"
    folder.mkdir()
    (folder / "a.json").write_text('{\n  // a comment\n  "identifier": {"entity_name": "A Ltd", "city": "York", "postal_code": "YO1",\n "websites": ["http://a", "http://b"]}}')
    (folder / "b.json").write_text('{"identifier": {"entity_name": "B Ltd", "websites": []}}')
    (folder / "c.json").write_text("broken")
    assert sorted(map(tuple, readers.read_identifiers(spark, str(folder)).collect()), key=str) == [("A Ltd", "York", "YO1", "http://a"), ("A Ltd", "York", "YO1", "http://b"), ("B Ltd", None, None, None)]


def test_text_sets_fall_back_and_map_their_fields(spark, tmp_path):
    places = {k: str(tmp_path / k) for k in ("wikimedia", "cohere", "wikitext", "openwebtext")}
    with pytest.raises(FileNotFoundError):
        readers.read_first_text_set(spark, places)
    spark.createDataFrame([("o",)], "text string").write.parquet(places["openwebtext"])
    assert [tuple(r) for r in readers.read_first_text_set(spark, places).collect()] == [("OpenWebText Document", "o", "openwebtext")]
    spark.createDataFrame([(5, "p"), (None, None)], "id int, passage string").write.parquet(places["cohere"])
    assert sorted(map(tuple, readers.read_first_text_set(spark, places).collect())) == [("5", "p", "cohere"), ("Unknown", "", "cohere")]
    spark.createDataFrame([("t", "T")], "text string, title string").write.parquet(places["wikimedia"])
    assert [tuple(r) for r in readers.read_first_text_set(spark, places).collect()] == [("T", "t", "wikimedia")]
    other = spark.createDataFrame([(1, "b")], "a int, `b.c` string")
    assert [tuple(r) for r in readers.text_set(other, "else").collect()] == [("Unknown Source", '{"a":1,"b.c":"b"}', "else")]


def test_folders_by_year(spark, tmp_path):
    for y in (2019, 2020, 2021):
        spark.range(y - 2018).write.parquet(readers.year_path(str(tmp_path), "html", y))
    df = readers.read_years(spark, str(tmp_path), "html", range(2020, 2022))
    assert sorted((r.id, r.year) for r in df.collect()) == [(0, 2020), (0, 2021), (1, 2020), (1, 2021), (2, 2021)]
    assert "PartitionFilters: [year" in df._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().toString()
    assert readers.read_years(spark, str(tmp_path), "html").count() == 6
