"""Sources: landed files as tables. Nothing here reaches the network; fetched bytes are input."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CRAWL_INDEX = "url string, domain string, warc_filename string, offset long, length long, crawl string, mime string"


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(CRAWL_INDEX).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema else r).csv(path)


def read_tsv_from_zip(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of one tab-separated member of every archive, as strings, with archive and row_seq.

    An archive is opened where it lies by one task and its lines stream through, so it may be of any size; bad UTF-8 is replaced.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in frames:
            for name in pdf["path"]:
                with _archive(name) as z:
                    if member not in z.namelist():
                        continue
                    held = []
                    with z.open(member) as f:
                        for k, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "utf-8", errors="replace"), delimiter="\t")):
                            held.append([name, k, *[row.get(c) for c in columns]])
                            if len(held) == 20_000:
                                yield pd.DataFrame(held, columns=["archive", "row_seq", *columns])
                                held = []
                    if held:
                        yield pd.DataFrame(held, columns=["archive", "row_seq", *columns])

    schema = "archive string, row_seq long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, schema)


@contextmanager
def _archive(uri: str) -> Iterator[zipfile.ZipFile]:
    """A ZIP file read in pieces from where it is stored."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))
    with store.open_input_file(place) as source, zipfile.ZipFile(source) as z:
        yield z


INDEX_ROW = r"^(.+?)\s{2,}(.+?)\s{2,}(\d+)\s+(\d{4}-\d{2}-\d{2})\s+(\S+)\s*$"


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """form_type, company_name, cik, date_filed, filename of a fixed-width listing; lines of other shapes go."""
    t = spark.read.text(path).filter(F.col("value").rlike(INDEX_ROW))
    part = lambda k: F.regexp_extract("value", INDEX_ROW, k)
    return t.select(part(3).alias("cik"), part(1).alias("company_name"), F.trim(part(2)).alias("form_type"), F.try_to_date(part(4)).alias("date_filed"), part(5).alias("filename"))


def read_company_json(spark: SparkSession, path: str) -> DataFrame:
    """Long facts from files of {date: {name: {value, unit}}}; broken files give no rows."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "map<string,map<string,struct<value:string,unit:string>>>").alias("j"))
    rows = t.filter("j is not null").select(F.element_at(F.split("file", "/"), -1).alias("file_name"), F.explode("j").alias("period_end", "m"))
    return rows.select("file_name", "period_end", F.explode("m").alias("metric", "v")).select("file_name", "period_end", "metric", F.coalesce(F.regexp_extract("v.value", r"<number>([-\d.eE+]+)</number>", 1).try_cast("double"), F.col("v.value").try_cast("double")).alias("value"), F.col("v.unit").alias("unit"))


def read_ixbrl(spark: SparkSession, path: str) -> DataFrame:
    """Inline-XBRL facts of HTML files: file_name, period_end, name, value, unit (pure and GBP only; shown for GBP)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from filinglake.operators import dom

        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                root = dom.parse(raw.decode("utf-8", "replace"))
                contexts, units = {}, {}
                for n, _ in root.walk():
                    local = (n.name or "").rpartition(":")[2]
                    if local == "context":
                        dates = {(k.name or "").rpartition(":")[2]: k.content().strip() for k, _ in n.walk()}
                        contexts[n.attrs.get("id")] = dates.get("enddate") or dates.get("instant")
                    elif local == "unit":
                        units[n.attrs.get("id")] = "".join(k.content() for k, _ in n.walk() if (k.name or "").endswith("measure")).rpartition(":")[2].strip()
                for n, _ in root.walk():
                    if (n.name or "").rpartition(":")[2] != "nonfraction":
                        continue
                    unit = units.get(n.attrs.get("unitref"))
                    text = n.content().replace(",", "").strip()
                    try:
                        value = float(text) * 10 ** int(n.attrs.get("scale") or 0) * (-1 if n.attrs.get("sign") == "-" else 1)
                    except ValueError:
                        continue
                    if unit in ("pure", "GBP"):
                        rows.append([name.rpartition("/")[2], contexts.get(n.attrs.get("contextref")), (n.attrs.get("name") or "").rpartition(":")[2], value, unit if unit == "GBP" else None])
            yield pd.DataFrame(rows, columns=["file_name", "period_end", "name", "value", "unit"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file_name string, period_end string, name string, value double, unit string")


def read_archives(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(archive, member, content) of the members of ZIP files; system clutter is skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf["path"]:
                with _archive(name) as z:
                    for m in sorted(z.namelist()):
                        base = m.rpartition("/")[2]
                        if base and m.endswith(suffix) and "__MACOSX" not in m and not base.startswith("._"):
                            yield pd.DataFrame({"archive": [name], "member": [m], "content": [z.read(m)]})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "archive string, member string, content binary")


def warc_response(raw: bytes) -> str | None:
    """Body of the first response record of WARC bytes, gzipped or not."""
    import gzip
    import zlib

    try:
        raw = gzip.decompress(raw)
    except (OSError, EOFError, zlib.error):
        if raw[:2] == b"\x1f\x8b":
            try:
                raw = zlib.decompressobj(31).decompress(raw)  # a cut-off member
            except zlib.error:
                return None
    at = raw.find(b"WARC-Type: response")
    if at < 0:
        return None
    head = raw.find(b"\r\n\r\n", at)
    body = raw.find(b"\r\n\r\n", head + 4)
    if head < 0 or body < 0:
        return None
    end = raw.find(b"\r\n\r\nWARC/1.", body + 4)
    return raw[body + 4 : end if end > 0 else None].rstrip(b"\r\n").decode("utf-8", "replace")


def read_warc_ranges(spark: SparkSession, index: DataFrame, root: str) -> DataFrame:
    """html of each index row (warc_filename, offset, length), by range reads of files under ``root``."""
    schema = T.StructType([*index.schema.fields, T.StructField("html", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        f, base = fs.FileSystem.from_uri(root)
        for pdf in frames:
            out = []
            for name, at, n in zip(pdf["warc_filename"], pdf["offset"], pdf["length"]):
                try:
                    with f.open_input_file(f"{base}/{name}") as s:
                        s.seek(int(at))
                        out.append(warc_response(s.read(int(n))))
                except OSError:
                    out.append(None)
            yield pdf.assign(html=out)

    return index.mapInPandas(run, schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of Markdown and text files."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    return t.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.col("value").alias("text"))


def read_html_tree(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def read_jsonl_last(spark: SparkSession, path: str, schema: str, key: str = "stem") -> DataFrame:
    """JSON lines, the last line of each key; blank and broken lines go."""
    t = spark.read.text(path).select(F.monotonically_increasing_id().alias("__seq"), F.from_json("value", schema).alias("j")).filter(f"j.{key} is not null")
    last = t.groupBy(F.col(f"j.{key}").alias("__k")).agg(F.max_by("j", "__seq").alias("j"))
    return last.select("j.*")


def primary_document(rows: DataFrame) -> DataFrame:
    """(filing, url) of the largest HTML document of each filing index; the first of equal size; viewer prefixes go.

    rows: filing, pos, n_cells, href, size.
    """
    url = F.regexp_replace("href", r"^.*/ix\?doc=", "")
    ok = rows.filter((F.col("n_cells") >= 5) & url.rlike(r"(?i)\.html?$") & (F.col("size") > 0))
    return ok.groupBy("filing").agg(F.max_by(url, F.struct("size", -F.col("pos"))).alias("url"))


def wayback_captures(captures: DataFrame, cap: int = 20) -> DataFrame:
    """HTML captures, one a path, shallow paths first, at most ``cap`` a domain. captures: domain, url, timestamp, mime."""
    from filinglake.functions import urls

    path = F.regexp_replace(urls.path(F.col("url")), "/+$", "")
    c = captures.filter(F.col("mime").startswith("text/html")).withColumn("path", path).withColumn("depth", urls.depth(F.col("url")))
    one = c.withColumn("__r", F.row_number().over(Window.partitionBy("domain", "path").orderBy("timestamp", "url"))).filter("__r = 1")
    return one.withColumn("__r", F.row_number().over(Window.partitionBy("domain").orderBy("depth", "path"))).filter(F.col("__r") <= cap).drop("__r")


def year_path(root: str, kind: str, year: int) -> str:
    """Folder of one kind of data and base year."""
    return f"{root}/{kind}/year={year}"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the same schema where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


STATUS_FIELDS = "company_name string, company_status string, company_status_detail string, type string, date_of_creation string, date_of_cessation string, has_been_liquidated boolean, has_charges boolean"


def company_status(landed: DataFrame) -> DataFrame:
    """Typed records of a status service's landed answers (company_id, http_status, body): the body's fields at 200, else only a status, not_found for 404 and api_error for all others."""
    ok = F.col("http_status") == 200
    j = F.when(ok, F.from_json("body", STATUS_FIELDS))
    fields = [f.split()[0] for f in STATUS_FIELDS.split(", ")]
    status = F.when(ok, F.coalesce(j["company_status"], F.lit("unknown"))).when(F.col("http_status") == 404, "not_found").otherwise("api_error")
    return landed.select("company_id", *[(status if f == "company_status" else j[f]).alias(f) for f in fields])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached embeddings of all shards under ``path``, with their shard."""
    return spark.read.parquet(path)


def current(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table that ``writers.replace`` put under ``path`` last; an empty one of ``schema`` where there is none."""
    sc = spark.sparkContext
    pointer = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = pointer.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        if schema is None:
            raise FileNotFoundError(f"no table has been put under {path}")
        return spark.createDataFrame([], schema)
    held = fs.open(pointer)
    name = sc._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    held.close()
    return spark.read.parquet(f"{path}/{name}")


# ---- company metadata and text data sets --------------------------------------------------------------------------


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(cik, ticker, company_name) of the register's ticker list: one JSON object of numbered entries; the last entry of a cik counts."""
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>").alias("m"))
    rows = held.select(F.explode("m").alias("k", "e")).filter("e.cik_str is not null")
    last = rows.groupBy(F.col("e.cik_str").alias("cik")).agg(F.max_by("e", F.col("k").try_cast("long")).alias("e"))
    return last.select("cik", F.col("e.ticker").alias("ticker"), F.col("e.title").alias("company_name"))


def read_websites(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, website) of a query service's JSON bindings: upper-case tickers, trimmed, the first website of each."""
    value = "struct<value: string>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", f"results struct<bindings: array<struct<ticker: {value}, website: {value}>>>").alias("j"))
    rows = held.select(F.posexplode("j.results.bindings").alias("at", "b")).select("at", F.upper(F.trim("b.ticker.value")).alias("ticker"), F.trim("b.website.value").alias("website"))
    return rows.filter("ticker is not null and website is not null").groupBy("ticker").agg(F.min_by("website", "at").alias("website"))


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """(entity_name, city, postal_code, website) of nested identifier records, one JSON object a file; lines that begin // are comments, and a record without websites has none."""
    fields = "identifier struct<entity_name: string, address_line_1: string, city: string, postal_code: string, websites: array<string>>"
    plain = F.regexp_replace("value", r"(?m)^\s*//.*$", "")
    i = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.from_json(plain, fields).alias("j")).select("j.identifier.*")
    return i.filter("entity_name is not null").select("entity_name", "city", "postal_code", F.explode_outer("websites").alias("website"))


#: Kinds of text data sets in order of preference, with the columns that hold text and title (the first that is there), and the title where none does.
TEXT_SETS = (
    ("wikimedia", ("text",), ("title",), "Unknown"),
    ("cohere", ("text", "passage"), ("title", "id"), "Unknown"),
    ("wikitext", ("text",), (), "WikiText Article"),
    ("openwebtext", ("text",), (), "OpenWebText Document"),
)


def text_set(df: DataFrame, kind: str) -> DataFrame:
    """(title, text, kind) of a data set of some kind; another kind's rows are their text column, or themselves as JSON."""
    found = {k: (texts, titles, other) for k, texts, titles, other in TEXT_SETS}
    if kind in found:
        texts, titles, other = found[kind]
        pick = lambda names: next((F.col(f"`{n}`").cast("string") for n in names if n in df.columns), F.lit(None).cast("string"))
        return df.select(F.coalesce(pick(titles), F.lit(other)).alias("title"), F.coalesce(pick(texts), F.lit("")).alias("text"), F.lit(kind).alias("kind"))
    body = F.col("text").cast("string") if "text" in df.columns else F.to_json(F.struct("*"))
    return df.select(F.lit("Unknown Source").alias("title"), F.coalesce(body, F.lit("")).alias("text"), F.lit(kind).alias("kind"))


def read_first_text_set(spark: SparkSession, places: dict[str, str]) -> DataFrame:
    """The first data set, in order of preference, that is there and has files Spark can read: ``places`` has Parquet folders by kind."""
    from pyspark.errors import AnalysisException

    for kind, *_ in TEXT_SETS:
        if kind not in places:
            continue
        try:
            return text_set(spark.read.parquet(places[kind]), kind)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    raise FileNotFoundError(f"none of {sorted(places)} can be read")


def read_years(spark: SparkSession, root: str, kind: str, years: range | list[int] | None = None) -> DataFrame:
    """One kind of data from its folders by year (``year_path``), with the year as a column; other years' folders are not read."""
    df = spark.read.parquet(f"{root}/{kind}")
    return df if years is None else df.filter(F.col("year").isin(*map(int, years)))
