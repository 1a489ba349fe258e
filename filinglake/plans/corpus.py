"""Queries over texts: tagging, density, bands, budgets, splits, batches, chunks, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from filinglake.functions import numbers, text
from filinglake.operators import corpus, examples, ocr, tagging, tokens, worklist
from filinglake.session import ship_package, table

CURVE = [(100, 0.82), (1000, 0.55), (10000, 0.42), (100000, 0.36), (853076, 0.31)]


def docs_of(spark, sf):
    ship_package(spark)
    return table(spark, sf, "documents")


def file_name():
    i = F.col("doc_id")
    prod = F.concat(F.lit("Prod224_0052_"), F.lpad(i.cast("string"), 8, "0"), F.lit("_20171231.md"))
    return F.when(i % 4 == 0, prod).when(i % 4 == 1, F.concat(i, F.lit("_2018-06-27.md"))).when(i % 4 == 2, F.concat(F.lit("000_"), i, F.lit(".txt"))).otherwise(F.concat(F.lit("Prod_"), i, F.lit(".md")))


def entity_id(spark, sf):
    return docs_of(spark, sf).select("doc_id", file_name().alias("source_file")).withColumn("company_id", numbers.company_of_file(F.col("source_file")))


def _tagged(kind):
    def query(spark, sf):
        t = docs_of(spark, sf).select("doc_id", F.concat(F.lit("In 2017, 1,234.50 of (532) | 12 | **5.8 %** and 98765; "), F.coalesce("text", F.lit(""))).alias("text"))
        out = t.withColumn("text", tagging.taggers()[kind](F.col("text")))
        return out.withColumn("n_tags", text.number_tags(F.col("text")))

    query.__name__ = f"tag_numbers_{kind}"
    return query


def strip_links(spark, sf):
    t = docs_of(spark, sf).withColumn("t", F.concat(F.lit("[a](http://x \"t\") "), F.regexp_replace("text", "the ", "[the](/u) ")))
    return t.select("doc_id", text.strip_link_urls(F.col("t")).alias("text"))


def tidy_text(spark, sf):
    return docs_of(spark, sf).select("doc_id", text.trim_lines(F.regexp_replace("text", r"\. ", " .\n\n\n ")).alias("text"))


def word_budget_filter(spark, sf):
    d = docs_of(spark, sf).select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.estimated_tokens(F.col("text")).alias("est_tokens"))
    return d.filter("est_tokens >= 1000")


def number_count_filter(spark, sf):
    """Documents of at least 100 numbers, words that begin with h standing for some."""
    t = F.regexp_replace("text", "[0-9]+| h[a-z]+", "<number>1</number>")
    return docs_of(spark, sf).select("doc_id", text.number_tags(t).alias("n_numbers")).filter("n_numbers >= 100")


def running_bytes(spark, sf):
    return corpus.byte_budget(docs_of(spark, sf).select("doc_id", "text"), "doc_id", "text", 300_000).select("doc_id", "bytes_before")


def non_empty_docs(spark, sf):
    return docs_of(spark, sf).filter(F.trim("text") != "").select("doc_id", "lang")


def page_explode(spark, sf):
    t = docs_of(spark, sf).select("doc_id", F.regexp_replace(F.concat(F.lit("lead\n"), "text"), "\n", "\n########## http://p\n").alias("text"))
    return corpus.explode_pages(t, "doc_id", "text")


PIECE = 1000  # ids a piece of a source's text


def page_concat(spark, sf):
    """Whole pages of each source in order of ids, in ordered pieces, so that no row holds a whole source."""
    pages = docs_of(spark, sf).select("source", F.floor(F.col("doc_id") / PIECE).alias("piece"), "doc_id", F.concat(F.lit("http://d/"), F.col("doc_id")).alias("url"), F.col("text").alias("content"))
    return corpus.concat_pages(pages, ["source", "piece"], "doc_id", "url", "content")


def density_expected(spark, sf):
    n = F.octet_length("text")
    return docs_of(spark, sf).select("doc_id", n.alias("n_bytes"), F.round(corpus.expected_ratio(n, CURVE), 6).alias("expected"))


def density_score(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "text").withColumn("ratio", corpus.deflate_ratio(F.col("text")))
    return d.withColumn("density", corpus.adjusted_density(F.col("text"), F.col("ratio"), CURVE)).drop("text").withColumn("kept", F.col("density") >= -0.4)


def density_baseline(spark, sf):
    return corpus.baseline_curve(docs_of(spark, sf).select("text"), corpus.log_spaced_lengths(12, 100, 20_000))


def rank_bands(spark, sf):
    return corpus.quantile_bands(docs_of(spark, sf).select("doc_id", "n_chars"), "n_chars", "doc_id")


def even_sample(spark, sf):
    return corpus.evenly_spaced(rank_bands(spark, sf), 7)


def every_kth(spark, sf):
    return corpus.every_kth(docs_of(spark, sf).select("doc_id"), "doc_id", 37)


def hash_split(spark, sf):
    return docs_of(spark, sf).select("doc_id", text.hash_bucket(F.concat(F.col("doc_id"), F.lit(".md"))).alias("bucket"), text.is_validation(F.concat(F.col("doc_id"), F.lit(".md"))).alias("is_val"))


def seeded_head(spark, sf):
    """First names of a seeded shuffle."""
    return docs_of(spark, sf).select("doc_id", F.md5(F.concat(F.lit("42:"), F.col("doc_id")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(100)


def log10_encode(spark, sf):
    v = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_extendedprice") * F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(numbers.log10_encode(v), 6).alias("magnitude"))


def magnitude_bins(spark, sf):
    b = numbers.magnitude_bins(F.log10(F.col("l_extendedprice")))
    t = table(spark, sf, "lineitem").withColumn("b", b)
    return t.groupBy(F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b.w_lo"), 4).alias("w_lo"), F.round(F.sum("b.w_hi"), 4).alias("w_hi"))


def bucket_batches(spark, sf):
    return corpus.bucket_batches(docs_of(spark, sf).select("doc_id", "n_chars"), "doc_id", "n_chars", 16384)


def same_doc_batches(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return corpus.same_doc_batches(c, "conv_id", "turn", "n", 8192)


def batch_padding_waste(spark, sf):
    return corpus.padding_waste(bucket_batches(spark, sf), "n_chars")


def _packs(padded):
    def query(spark, sf):
        d = docs_of(spark, sf).select("doc_id", "source", F.col("n_chars"))
        return corpus.greedy_pack(d, "source", "n_chars", "doc_id", 20_000, padded)

    query.__name__ = "greedy_pack_padded" if padded else "greedy_pack_sum"
    return query


def chunk_spans(spark, sf):
    return corpus.chunk_documents(docs_of(spark, sf), "doc_id", "text", 128, 1024, min_chunks=3, per_chunk=False)


def chunk_spans_capped(spark, sf):
    return corpus.chunk_documents(docs_of(spark, sf), "doc_id", "text", 128, 4096, cap=8190)


def token_mask(spark, sf):
    t = docs_of(spark, sf).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    m = corpus.mask_tokens(t, "doc_id", "pos", "token", 0.15)
    return m.groupBy("doc_id").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("none", "mask", "random", "keep")], F.count("label").alias("n_labels"))


def k_of_n_mask(spark, sf):
    return corpus.choose_k(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 0.3)


def table_depth(spark, sf):
    """Nesting depth at each line: starts so far less the ends before."""
    lines = docs_of(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    start, end = F.col("line").contains("a").cast("int"), F.col("line").contains("e").cast("int")
    d = lines.withColumn("depth", F.sum(start).over(w) - F.coalesce(F.sum(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return d.groupBy("doc_id").agg(F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.count(F.lit(1)).alias("n_lines"))


def line_boundaries(spark, sf):
    """Character positions behind newlines, as an array."""
    lines = docs_of(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ends = lines.select("doc_id", "pos", (F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1).cast("int").alias("end"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("pos", "end"))), lambda x: x["end"])
    return ends.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(held, ",").alias("bounds"))


def moving_average(spark, sf):
    """Mean of the last 100 values of each user, in order of events."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)
    return table(spark, sf, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 6).alias("avg100"))


def pad_collate(spark, sf):
    """Turns of a conversation as arrays of word lengths, padded to the conversation's longest, with a mask."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    n = F.max(F.size("ids")).over(Window.partitionBy("conv_id"))
    p = c.withColumn("n", n).select("conv_id", "turn", corpus.pad(F.col("ids"), F.col("n"), 0).alias("ids"), corpus.pad(F.transform("ids", lambda x: F.lit(1)), F.col("n"), 0).alias("mask"))
    return p.select("conv_id", "turn", F.array_join("ids", " ").alias("ids"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"), F.size("mask").alias("n_padded"))


def wrap_chunk(spark, sf):
    """A slice of tokens between an opening and a closing mark."""
    w = F.split("text", " ")
    return docs_of(spark, sf).select("doc_id", F.array_join(F.concat(F.array(F.lit("[CLS]")), F.slice(w, 3, 8), F.array(F.lit("[SEP]"))), " ").alias("chunk"))


def equal_splits(spark, sf):
    """Texts without a sentence end cut to 4 equal pieces; blanks dropped."""
    t = F.regexp_replace("text", r"[.?!]\s|\n", " ")
    size = F.greatest(F.lit(1), F.floor(F.length("t") / 4).cast("int"))
    d = docs_of(spark, sf).select("doc_id", t.alias("t")).withColumn("k", size)
    pieces = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.trim(F.substr("t", i * F.col("k") + 1, F.col("k")))), lambda s: s != "")
    return d.select("doc_id", F.size(pieces).alias("n"), F.array_join(pieces, "|").alias("pieces"))


def corpus_stats(spark, sf):
    """Totals by language, and the median length as an index pick."""
    return corpus.length_stats(docs_of(spark, sf), "lang", "n_chars").withColumnRenamed("n", "n_docs")


def label_align(spark, sf):
    """Documents with a company id of their file name and the rate of that company."""
    rates = table(spark, sf, "labels").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("company_id"), F.col("quality").alias("rate"))
    return entity_id(spark, sf).filter("company_id IS NOT NULL").join(rates, "company_id")


def split_label_join(spark, sf):
    """Labelled documents by split with the share of good ones."""
    d = hash_split(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("is_val").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").alias("n_toxic"))


def union_corpora(spark, sf):
    """Documents and conversations as one corpus with its kind."""
    a = docs_of(spark, sf).select(F.lit("document").alias("kind"), F.length("text").alias("n"))
    b = table(spark, sf, "conversations").select(F.lit("conversation").alias("kind"), F.length("text").alias("n"))
    return a.unionByName(b).groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("chars"))


def ocr_recombine(spark, sf):
    """Every fifth line of a document a placeholder, replaced by the table of its stem and number; misses become a comment."""
    line = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("GLMTABLE"), F.floor(i / 5).cast("int"), F.lit("GLMTABLE"))).otherwise(x)
    d = docs_of(spark, sf).filter("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("t"))
    parts = d.select("doc_id", F.posexplode(F.split("t", "(?=GLMTABLE[0-9]+GLMTABLE)|(?<=[0-9]GLMTABLE)")).alias("pos", "part"))
    parts = parts.withColumn("stem", F.when(F.col("part").rlike("^GLMTABLE[0-9]+GLMTABLE$"), F.concat(F.col("doc_id"), F.lit("__t"), F.regexp_extract("part", "([0-9]+)", 1))))
    tables = table(spark, sf, "labels").select(F.concat(F.col("doc_id"), F.lit("__t"), F.col("toxic")).alias("stem"), F.concat(F.lit("<table>"), "quality", F.lit("</table>")).alias("html"))
    j = parts.join(tables, "stem", "left").withColumn("out", F.when(F.col("stem").isNull(), F.col("part")).otherwise(F.coalesce("html", F.lit("<!-- missing table -->"))))
    held = F.array_sort(F.collect_list(F.struct("pos", "out")))
    return j.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda s: s["out"]), "").alias("text"), F.count_if(F.col("stem").isNotNull() & F.col("html").isNull()).alias("n_missing"))


def learning_rates(spark, sf):
    """The rate at each step of a run over all batches, a tenth of them warm-up, with the cosine ending at nothing and at a tenth."""
    batches = bucket_batches(spark, sf).select("bucket", "batch").distinct()
    total = batches.count()
    warm = total // 10
    steps = corpus.ranked(batches, "bucket", "batch", rank="step").select("step")
    return steps.select("step", F.round(numbers.learning_rate(F.col("step"), warm, total), 6).alias("lr"), F.round(numbers.learning_rate(F.col("step"), warm, total, 0.1), 6).alias("lr_floor"))


def _points() -> str:
    pairs = list(zip(CURVE, CURVE[1:]))
    mid = " ".join(f"WHEN n_bytes < {b[0]} THEN {a[1]} + (ln(n_bytes) - ln({a[0]})) / (ln({b[0]}) - ln({a[0]})) * ({b[1]} - {a[1]})" for a, b in pairs)
    return f"CASE WHEN n_bytes <= {CURVE[0][0]} THEN {CURVE[0][1]} WHEN n_bytes >= {CURVE[-1][0]} THEN {CURVE[-1][1]} {mid} END"


_FILE = "CASE doc_id % 4 WHEN 0 THEN 'Prod224_0052_' || lpad(doc_id::VARCHAR, 8, '0') || '_20171231.md' WHEN 1 THEN doc_id || '_2018-06-27.md' WHEN 2 THEN '000_' || doc_id || '.txt' ELSE 'Prod_' || doc_id || '.md' END"
_ENTITY = f"SELECT doc_id, {_FILE} AS source_file, CASE doc_id % 4 WHEN 0 THEN lpad(doc_id::VARCHAR, 8, '0') WHEN 1 THEN doc_id::VARCHAR END AS company_id FROM documents"
_WORDS = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
_HORNER = "list_reduce(list_prepend(0::BIGINT, list_transform(range(8), lambda i: ('0x' || substr(md5(doc_id || '.md'), (1 + 4 * i)::INT, 4))::BIGINT)), lambda a, b: (a * 65536 + b) % 10000)"
_SPLIT = f"SELECT doc_id, {_HORNER} AS bucket, {_HORNER} < 1000 AS is_val FROM documents"
_BANDS = """SELECT doc_id, n_chars, rank, CASE WHEN rank < floor(n * 0.05) THEN 0 WHEN rank < floor(n * 0.1) THEN 1 WHEN rank < floor(n * 0.2) THEN 2 WHEN rank < floor(n * 0.4) THEN 3 WHEN rank < floor(n * 0.8) THEN 4 ELSE 5 END AS band
FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS rank, count(*) OVER () AS n FROM documents)"""
_BATCHES = """SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // batch_size AS batch
FROM (SELECT *, greatest(1, floor(16384.0::DOUBLE / (1 + 0.15::DOUBLE * bucket / 4096) / bucket))::BIGINT AS batch_size FROM (SELECT doc_id, n_chars, greatest(ceil(n_chars / 16) * 16, 16)::BIGINT AS bucket FROM documents))"""


def _pack_sql(padded: bool) -> str:
    over = "o.n_chars * (p.c + 1) > 20000" if padded else "p.used + o.n_chars > 20000"
    return f"""WITH RECURSIVE o AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS i FROM documents),
p AS (SELECT doc_id, source, n_chars, i, 0::BIGINT AS batch, n_chars AS used, 1 AS c FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.source, o.n_chars, o.i, CASE WHEN {over} THEN p.batch + 1 ELSE p.batch END, CASE WHEN {over} THEN o.n_chars ELSE p.used + o.n_chars END, CASE WHEN {over} THEN 1 ELSE p.c + 1 END
FROM p JOIN o ON o.source = p.source AND o.i = p.i + 1) SELECT doc_id, source, n_chars, batch FROM p"""


def _u(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || doc_id || ':' || pos), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


QUERIES = {f.__name__: f for f in (
    entity_id, _tagged("all"), _tagged("ocr"), _tagged("filing"), strip_links, tidy_text, word_budget_filter, number_count_filter, running_bytes, non_empty_docs, page_explode, page_concat, density_expected, density_score,
    density_baseline, rank_bands, even_sample, every_kth, hash_split, seeded_head, log10_encode, magnitude_bins, bucket_batches, same_doc_batches, batch_padding_waste, _packs(False), _packs(True), chunk_spans,
    chunk_spans_capped, token_mask, k_of_n_mask, table_depth, line_boundaries, moving_average, pad_collate, wrap_chunk, equal_splits, corpus_stats, label_align, split_label_join, union_corpora, ocr_recombine, learning_rates,
)}

ORACLES = {
    "entity_id": _ENTITY,
    "strip_links": r"""SELECT doc_id, regexp_replace('[a](http://x "t") ' || replace(text, 'the ', '[the](/u) '), '(\[[^\]]*\])\([^)]+\)', '\1(link)', 'g') AS text FROM documents""",
    "tidy_text": r"""SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\. ', E' .\n\n\n ', 'g'), E'\n'), lambda s: trim(s, E' \t')), E'\n'), E'\n{3,}', E'\n\n', 'g') AS text FROM documents""",
    "word_budget_filter": f"SELECT doc_id, {_WORDS} AS n_words, floor({_WORDS} * 1.35::DOUBLE)::BIGINT AS est_tokens FROM documents WHERE floor({_WORDS} * 1.35::DOUBLE) >= 1000",
    "number_count_filter": "SELECT doc_id, n AS n_numbers FROM (SELECT doc_id, len(regexp_extract_all(text, '[0-9]+| h[a-z]+')) AS n FROM documents) WHERE n >= 100",
    "running_bytes": "SELECT * FROM (SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_before FROM documents) WHERE bytes_before < 300000",
    "non_empty_docs": "SELECT doc_id, lang FROM documents WHERE trim(text) <> ''",
    "page_explode": r"""SELECT doc_id, i AS seq, 'http://p' AS url, l[i + 1] AS content FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM (SELECT doc_id, string_split(E'lead\n' || text, E'\n') AS l FROM documents))""",
    "page_concat": rf"SELECT source, doc_id // {PIECE} AS piece, string_agg('########## http://d/' || doc_id || E'\n' || text, E'\n' ORDER BY doc_id) AS text, count(*) AS n_pages FROM documents GROUP BY source, piece",
    "density_expected": f"SELECT doc_id, n_bytes, round({_points()}, 6) AS expected FROM (SELECT doc_id, strlen(text) AS n_bytes FROM documents)",
    "rank_bands": _BANDS,
    "even_sample": f"""WITH b AS ({_BANDS}), g AS (SELECT *, rank - min(rank) OVER (PARTITION BY band) AS i, count(*) OVER (PARTITION BY band) AS m FROM b)
SELECT doc_id, n_chars, rank, band FROM g WHERE m <= 7 OR list_contains(list_transform(range(7), lambda k: floor(m * (k + 0.5::DOUBLE) / 7)::BIGINT), i)""",
    "every_kth": "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank, greatest(1, count(*) OVER () // 37) AS step FROM documents) WHERE rank % step = 0 AND rank < step * 37",
    "hash_split": _SPLIT,
    "seeded_head": "SELECT doc_id, md5('42:' || doc_id) AS h FROM documents ORDER BY h, doc_id LIMIT 100",
    "log10_encode": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber = 1 OR abs(l_extendedprice * l_discount) < 1e-20 THEN -12.0 ELSE round(greatest(-12.0, least(12.0, log10(abs(l_extendedprice * l_discount)))), 6) END AS magnitude FROM lineitem",
    "magnitude_bins": "SELECT floor(p)::INT AS lo, ceil(p)::INT AS hi, count(*) AS n, round(sum(1 - (p - floor(p))), 4) AS w_lo, round(sum(p - floor(p)), 4) AS w_hi FROM (SELECT (greatest(-12.0::DOUBLE, least(12.0::DOUBLE, log10(l_extendedprice))) + 12) / 24 * 127 AS p FROM lineitem) GROUP BY 1, 2",
    "bucket_batches": _BATCHES,
    "same_doc_batches": """SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY conv_id, turn) - 1) // batch_size AS batch FROM (SELECT *, greatest(1, 8192 // bucket) AS batch_size
FROM (SELECT conv_id, turn, length(text) AS n, greatest(ceil(length(text) / 32) * 32, 32)::BIGINT AS bucket FROM conversations))""",
    "batch_padding_waste": f"SELECT count(*) AS n_batches, round(1 - sum(t) / sum(p), 6) AS waste FROM (SELECT sum(n_chars)::DOUBLE AS t, (max(n_chars) * count(*))::DOUBLE AS p FROM ({_BATCHES}) GROUP BY bucket, batch)",
    "greedy_pack_sum": _pack_sql(False),
    "greedy_pack_padded": _pack_sql(True),
    "token_mask": f"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
a AS (SELECT doc_id, {_u(0)} < 0.15 AS c, {_u(1)} AS u FROM t)
SELECT doc_id, count(*) FILTER (NOT c) AS n_none, count(*) FILTER (c AND u < 0.8) AS n_mask, count(*) FILTER (c AND u >= 0.8 AND u < 0.9) AS n_random, count(*) FILTER (c AND u >= 0.9) AS n_keep, count(*) FILTER (c) AS n_labels FROM a GROUP BY doc_id""",
    "k_of_n_mask": """SELECT conv_id, turn, r <= least(greatest(ceil(n * 0.3::DOUBLE), 1), n - 1) AS chosen
FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY ('0x' || substr(md5('0:' || conv_id || ':' || turn), 1, 8))::BIGINT, turn) AS r FROM conversations)""",
    "table_depth": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS pos FROM documents),
d AS (SELECT doc_id, sum(contains(line, 'a')::INT) OVER w - coalesce(sum(contains(line, 'e')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, max(depth)::BIGINT AS max_depth, min(depth)::BIGINT AS min_depth, count(*) AS n_lines FROM d GROUP BY doc_id""",
    "line_boundaries": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1)::BIGINT AS b FROM l) SELECT doc_id, count(*)::INT AS n, string_agg(b::VARCHAR, ',' ORDER BY pos) AS bounds FROM c GROUP BY doc_id""",
    "moving_average": "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS avg100 FROM events",
    "pad_collate": """WITH c AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations), n AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS n FROM c)
SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)), ' ') AS ids, len(ids) AS n_real, n AS n_padded FROM n""",
    "wrap_chunk": "SELECT doc_id, array_to_string(list_concat(['[CLS]'], string_split(text, ' ')[3:10], ['[SEP]']), ' ') AS chunk FROM documents",
    "equal_splits": r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[.?!]\s|\n', ' ', 'g') AS t FROM documents), k AS (SELECT *, greatest(1, length(t) // 4)::BIGINT AS k FROM t),
p AS (SELECT doc_id, list_filter(list_transform(range(4), lambda i: trim(substr(t, i * k + 1, k))), lambda s: s <> '') AS p FROM k) SELECT doc_id, len(p) AS n, array_to_string(p, '|') AS pieces FROM p""",
    "corpus_stats": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS total, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS mean, max(CASE WHEN r = n // 2 + 1 THEN n_chars END) AS median FROM r GROUP BY lang""",
    "label_align": f"SELECT e.company_id, e.doc_id, e.source_file, l.quality AS rate FROM ({_ENTITY}) e JOIN labels l ON e.company_id = lpad(l.doc_id::VARCHAR, 8, '0')",
    "split_label_join": f"SELECT is_val, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS n_toxic FROM ({_SPLIT}) JOIN labels USING (doc_id) GROUP BY is_val",
    "union_corpora": "SELECT kind, count(*) AS rows, sum(n)::BIGINT AS chars FROM (SELECT 'document' AS kind, length(text) AS n FROM documents UNION ALL SELECT 'conversation', length(text) FROM conversations) GROUP BY kind",
    "ocr_recombine": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT l.doc_id, i, i % 5 = 2 AND html IS NULL AS missing, CASE WHEN i % 5 = 2 THEN coalesce(html, '<!-- missing table -->') ELSE line END AS line FROM l LEFT JOIN (SELECT doc_id, toxic, '<table>' || quality || '</table>' AS html FROM labels) b ON b.doc_id = l.doc_id AND l.i % 5 = 2 AND l.i // 5 = b.toxic)
SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) FILTER (missing) AS n_missing FROM t GROUP BY doc_id""",
    "learning_rates": f"""WITH s AS (SELECT row_number() OVER (ORDER BY bucket, batch) - 1 AS step, count(*) OVER () AS n FROM (SELECT DISTINCT bucket, batch FROM ({_BATCHES}))), p AS (SELECT step, n // 10 AS w, n FROM s),
c AS (SELECT *, 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (step - w)::DOUBLE / greatest(1, n - w)))) AS c FROM p)
SELECT step, round(CASE WHEN step < w THEN step::DOUBLE / greatest(1, w) ELSE c END, 6) AS lr, round(CASE WHEN step < w THEN step::DOUBLE / greatest(1, w) ELSE 0.1::DOUBLE + (1 - 0.1::DOUBLE) * c END, 6) AS lr_floor FROM c""",
}


# ---- training examples -------------------------------------------------------------------------------------------


def text_examples(spark, sf):
    return examples.examples(docs_of(spark, sf), "doc_id", "text", windows=3, least=1000, most=4000)


def regrouped_lengths(spark, sf):
    """Lengths of the sub-texts of each example, back in order."""
    r = examples.regroup(text_examples(spark, sf), lambda s: F.length(s))
    return r.select("id", "draw", F.array_join("values", ",").alias("lengths"))


def random_token_windows(spark, sf):
    return examples.token_windows(docs_of(spark, sf), "doc_id", "text", 64, 100).select("doc_id", "start", F.array_join("tokens", " ").alias("window"))


def tokenised_numbers(spark, sf):
    """Lengths of whole documents in ids, and how many of them are numbers."""
    t = docs_of(spark, sf).select("doc_id", F.concat(F.lit("Sales <number>1200</number> <table><tr><td>a</td><td><number>0.5</number></td></tr></table> "), F.coalesce("text", F.lit(""))).alias("text"))
    return examples.tokenise(t, "doc_id", "text", _vocabulary()).select("id", "seq_length", F.size(F.filter("is_number_mask", lambda m: m)).alias("n_numbers"))


def _vocabulary():
    import public_tokenizers  # a folder of tokenizer files; any other path will do

    return examples.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def _marked_texts(spark, sf):
    """Documents with figures tagged as numbers and every fifth line as a table of its sentences."""
    line = lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("<table><tr><td>"), F.replace(x, F.lit(". "), F.lit("</td><td>7</td></tr><tr><td>")), F.lit("</td></tr></table>"))).otherwise(x)
    t = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return docs_of(spark, sf).select("doc_id", F.regexp_replace(t, "([0-9]+)", "<number>$1</number>").alias("text"))


def token_chunks(spark, sf):
    """Every document's ids, number mask and values in chunks that end at lines outside tables."""
    words = _vocabulary()
    return tokens.chunk(examples.tokenise(_marked_texts(spark, sf), "doc_id", "text", words), 128, 1024, line_ends=[words.mark("\n")])


def table_boundaries(spark, sf):
    """Places behind line ends outside tables, every fifth and the following line being a table."""
    line = lambda x, i: F.concat(F.when(i % 5 == 2, F.array(F.lit(examples.TABLE_START))).otherwise(F.array().cast("array<int>")), F.transform(F.split(x, " "), lambda w: F.length(w) % 100 + 1000), F.array(F.lit(examples.NEW_LINE)), F.when(i % 5 == 3, F.array(F.lit(examples.TABLE_END))).otherwise(F.array().cast("array<int>")))
    ids = F.concat(F.array(F.lit(examples.CLS)), F.flatten(F.transform(F.split("text", "\n"), line)), F.array(F.lit(examples.SEP)))
    d = docs_of(spark, sf).filter("text is not null").select("doc_id", ids.alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n_ids"), F.array_join(tokens.boundaries_of(F.col("ids")), ",").alias("bounds"))


def prediction_markup(spark, sf):
    """Every turn with its masked words and numbers beside what was guessed: half of the words right, the others the word before."""
    t = table(spark, sf, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("row"), F.posexplode(F.concat(F.array(F.lit("[CLS]")), F.split("text", " "))).alias("pos", "token"))
    t = t.withColumn("value", F.when((F.col("pos") > 0) & (F.length("token") == 5), F.col("pos") % 9 - 2.0))
    m = corpus.mask_with_numbers(t, "row", "pos", "token", "value", 0.1, 0.4)
    before = F.lag("token", 1, "").over(Window.partitionBy("row").orderBy("pos"))
    right = corpus.unit_hash(F.lit(9), F.col("row"), F.col("pos")) < 0.5
    m = m.select("row", "pos", "token", F.concat(F.when(F.col("pos") > 1, " ").otherwise(""), F.col("token")).alias("piece"), F.col("value").alias("log"), (F.col("action") != "none").alias("masked"), (F.col("token") == "[CLS]").alias("special"), F.when(right, F.col("token")).otherwise(before).alias("guess"))
    guesses = m.filter("masked").select("row", "pos", F.col("guess").alias("token"), F.concat(F.lit(" "), F.col("guess")).alias("piece"), (F.col("log") + 0.5).alias("log"))
    return tokens.with_predictions(m.drop("guess"), guesses, "row", "pos")


def mask_token_ids(spark, sf):
    """Masked ids and labels of every turn, words by their length as ids, those of five letters numbers."""
    w = F.split("text", " ")
    t = table(spark, sf, "conversations").filter("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("row"), F.concat(F.array(F.lit(examples.CLS)), F.transform(w, lambda x: F.length(x)), F.array(F.lit(examples.SEP))).alias("input_ids"))
    t = t.select("row", "input_ids", F.transform("input_ids", lambda x: x == 5).alias("is_number_mask"), F.transform("input_ids", lambda x, i: F.when(x == 5, i % 9 - 2.0).otherwise(0.0)).alias("number_values"))
    m = tokens.mask(t, "row", 50264, 50264, 0.1, 0.4)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4).alias(c)
    return m.select("row", F.array_join("masked_ids", ",").alias("ids"), F.array_join("labels", ",").alias("labels"), total("masked_values"), total("label_values"))


def window_draws(spark, sf):
    """The first 300 windows of 40 words from at most 3000 draws."""
    d = docs_of(spark, sf).filter("text is not null").select("doc_id", F.split("text", " ").alias("w"))
    return examples.window_draws(d, "doc_id", "w", 40, 300).select("attempt", "doc_id", "start", F.array_join("tokens", " ").alias("window"))


def _regions(spark, sf):
    """Lines of documents as recognised regions, ten a page: some abandoned, some figures, some lost, some read twice."""
    lines = docs_of(spark, sf).filter("text is not null").select(F.concat(F.lit("doc"), "doc_id").alias("stem"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    k = F.col("doc_id") + F.col("i")
    task = F.when(k % 11 == 0, "abandon").when(k % 7 == 0, "skip").otherwise("text")
    content = F.when((k % 7 != 0) & (k % 13 != 5), F.col("line"))
    twice = F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = lines.select("stem", F.floor(F.col("i") / 10).cast("int").alias("page"), (F.col("i") % 10).alias("region"), task.alias("task"), content.alias("content"), twice.alias("again"))
    return rows.select("stem", "page", "region", "task", F.when(F.col("again") == 0, F.col("content")).otherwise(F.substring("content", 1, 20)).alias("content"))


def _region_files(spark, sf):
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs_of(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("stem"), F.when(F.col("text").isNull(), 1).otherwise(F.floor((n - 1) / 10) + 1).cast("int").alias("n_pages"))


def ocr_pages(spark, sf):
    """Recognised regions in reading order, a row a page, lost regions by name."""
    return ocr.pages_of_regions(_regions(spark, sf))


def ocr_documents(spark, sf):
    """Pages in order, two of them a part, with pages without text counted."""
    return ocr.documents_of_pages(ocr_pages(spark, sf), _region_files(spark, sf), 2)


def _attempts(spark, sf):
    ok = F.col("event_type").isin("view", "signup") & (F.col("event_id") % 9 != 0)
    return table(spark, sf, "events").select(F.concat(F.lit("item"), F.col("user_id")).alias("item"), ok.alias("ok"), F.col("ts").alias("at"), F.when(~ok, F.concat(F.lit("error "), "event_type")).alias("error"))


def attempt_state(spark, sf):
    """What became of each item after all its attempts before the tenth day, and when it may be tried again."""
    return worklist.attempts(_attempts(spark, sf).filter("at < timestamp_ntz'2024-01-10 00:00:00'"), most=3, wait_seconds=3600)


def pending_items(spark, sf):
    """Items of all customers that have no output and may be tried on the tenth day."""
    items = table(spark, sf, "customer").select(F.concat(F.lit("item"), F.col("c_custkey")).alias("item"), "c_nationkey")
    outputs = table(spark, sf, "orders").filter("o_orderkey % 7 = 0").select(F.concat(F.lit("item"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 2 == 0, ".md").otherwise(".tmp")).alias("name"))
    return worklist.pending(items, attempt_state(spark, sf), outputs, F.expr("timestamp_ntz'2024-01-10 00:00:00'"))


def blob_fill(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "text")
    return examples.fill_blobs(d, "doc_id", "text", 5, 20_000).select("blob", F.octet_length("text").alias("n_bytes"), "n_articles")


def title_slugs(spark, sf):
    """Slugs of the first lines."""
    ship_package(spark)
    slug = tagging.text_udf(examples.slugify)
    return docs_of(spark, sf).select("doc_id", slug(F.substring_index("text", "\n", 1)).alias("slug"))


def readable_numbers(spark, sf):
    v = F.when(F.col("l_linenumber") == 1, F.col("l_discount") / 100).when(F.col("l_linenumber") == 2, F.col("l_extendedprice") * 1000).otherwise(F.col("l_extendedprice"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.short_number(v).alias("shown"))


QUERIES |= {f.__name__: f for f in (text_examples, regrouped_lengths, random_token_windows, tokenised_numbers, token_chunks, table_boundaries, prediction_markup, mask_token_ids, window_draws, ocr_pages, ocr_documents, attempt_state, pending_items, blob_fill, title_slugs, readable_numbers)}


# ---- statistics, masks, chunks and resumption --------------------------------------------------------------------


def length_by_extension(spark, sf):
    """Length figures of the corpus by file ending."""
    d = docs_of(spark, sf).select(F.regexp_extract(file_name(), r"(\.[^.]*)$", 1).alias("extension"), "n_chars")
    return corpus.length_stats(d, "extension", "n_chars")


def dataset_stats(spark, sf):
    """Chunk lengths, sub-sequences and kinds of a data set of conversations: a chunk is a conversation, a sub-sequence a turn."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("length"), F.count(F.lit(1)).alias("subs"))
    kinds = table(spark, sf, "conversations").agg(F.countDistinct("role").alias("n_types"))
    figures = [F.round(F.avg(x), 4).alias(f"avg_{n}") for x, n in (("length", "length"), ("subs", "subsequences"))] + [f(x).alias(f"{m}_{n}") for m, f in (("min", F.min), ("max", F.max)) for x, n in (("length", "length"), ("subs", "subsequences"))]
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), *figures).join(kinds)  # one row and one row


def resume_from(spark, sf):
    """Documents from the 100th on, as a run that stopped there takes them up."""
    return corpus.from_offset(docs_of(spark, sf).select("doc_id"), "doc_id", 100)


def chunk_arrays(spark, sf):
    """Three parallel arrays of a document cut to tokens 2 to 9 and wrapped."""
    w = F.split("text", " ")
    number = lambda x: x.rlike("^[0-9]+$")
    d = docs_of(spark, sf).select("doc_id", w.alias("w"), F.transform(w, number).alias("is_number"), F.transform(w, lambda x: F.when(number(x), F.length(x).cast("double")).otherwise(0.0)).alias("value"))
    cut = corpus.extract_chunk({"tokens": (F.col("w"), "[CLS]", "[SEP]"), "mask": (F.col("is_number"), False, False), "values": (F.col("value"), 0.0, 0.0)}, F.lit(2), F.lit(10))
    return d.select("doc_id", F.array_join(cut["tokens"], " ").alias("tokens"), F.size(F.filter(cut["mask"], lambda m: m)).alias("n_numbers"), F.aggregate(cut["values"], F.lit(0.0), lambda a, x: a + x).alias("value_sum"), F.size(cut["values"]).alias("n"))


def mask_numbers(spark, sf):
    """Masked tokens of each conversation turn at the turn's own rate, words of five letters standing for numbers."""
    t = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row"), F.posexplode(F.concat(F.array(F.lit("[CLS]")), F.split("text", " "))).alias("pos", "token"))
    t = t.withColumn("value", F.when((F.col("pos") > 0) & (F.length("token") == 5), F.length("token") / 2.0))
    m = corpus.mask_with_numbers(t, "row", "pos", "token", "value", 0.1, 0.4)
    return m.groupBy("row").agg(
        F.round(F.first("rate"), 8).alias("rate"), *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("mask", "random", "keep")], F.count("label").alias("n_labels"), F.count_if(F.col("label_value") != -100).alias("n_number_labels"),
        F.count_if(F.col("input_value") == 13).alias("n_sentinels"), F.round(F.sum("input_value"), 4).alias("value_sum"), F.count_if(F.col("input") == "[MASK]").alias("n_mask_tokens"),
    )


def magnitude_decode(spark, sf):
    """Values back from their magnitudes."""
    m = numbers.log10_encode(F.col("l_extendedprice") * F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(numbers.log10_decode(m), 4).alias("value"))


def tidy_markup(spark, sf):
    """Texts behind an XML declaration, with hard spaces and runs of blanks, tidied."""
    t = F.concat(F.lit("<?xml version='1.0'?>  "), F.regexp_replace("text", r"\. ", " .\u00a0  "), F.lit("\n\n\n\n  end  "))
    return docs_of(spark, sf).select("doc_id", text.tidy(text.drop_xml_declaration(t)).alias("text"))


def density_snapshot(spark, sf):
    """Documents that are dense enough, by source; sources that lose all of theirs are gone."""
    d = corpus.drop_low_density(docs_of(spark, sf).select("doc_id", "source", "text"), "source", "doc_id", "text", CURVE, -0.2)
    return d.select("doc_id", "source", F.round("density", 6).alias("density"), "n_dropped")


QUERIES |= {f.__name__: f for f in (length_by_extension, dataset_stats, resume_from, chunk_arrays, mask_numbers, magnitude_decode, tidy_markup, density_snapshot)}


def _unit(seed: int, *parts: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {" || ':' || ".join(parts)}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_SHOWN = """CASE WHEN abs({0}) < 0.01 THEN printf('%.4e', {0}) WHEN abs({0}) >= 1e6 THEN format('{{:,.0f}}', {0}) WHEN abs({0}) >= 100 THEN format('{{:,.1f}}', {0}) ELSE printf('%.2f', {0}) END"""
_EXP = "CASE WHEN {0} < -11 THEN 0.0::DOUBLE ELSE power(10.0::DOUBLE, {0}) END"

_REGIONS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
g AS (SELECT 'doc' || doc_id AS stem, (i // 10)::INT AS page, (i % 10)::INT AS region, doc_id + i AS k, CASE WHEN (doc_id + i) % 7 <> 0 AND (doc_id + i) % 13 <> 5 THEN line END AS content FROM l),
r AS (SELECT *, CASE WHEN trim(content, ' ') <> '' THEN trim(content, ' ') END AS body, CASE WHEN content IS NULL AND k % 7 <> 0 THEN 'p' || page || 'r' || region END AS lost FROM g WHERE k % 11 <> 0),
p AS (SELECT stem, page, 0::INT AS piece, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY region), '') AS markdown, count(*) AS n_regions, coalesce(string_agg(lost, ' ' ORDER BY region), '') AS missing FROM r GROUP BY stem, page)"""
_STATE = """WITH e AS (SELECT 'item' || user_id AS item, event_type IN ('view', 'signup') AND event_id % 9 <> 0 AS ok, ts AS tried, 'error ' || event_type AS error FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'),
a AS (SELECT item, bool_or(ok) AS done, count(*) AS attempts, max(tried) AS last_try, first(error ORDER BY tried DESC, error) FILTER (NOT ok) AS error FROM e GROUP BY item),
s AS (SELECT item, CASE WHEN done THEN 'done' WHEN attempts >= 3 THEN 'given_up' ELSE 'failed' END AS status, attempts, last_try, error FROM a),
state AS (SELECT item, status, attempts, last_try, CASE WHEN status = 'failed' THEN last_try + INTERVAL 1 HOUR * power(2, attempts - 1)::INT END AS next_try, CASE WHEN status <> 'done' THEN error END AS error FROM s)"""

ORACLES |= {
    "mask_token_ids": f"""WITH s AS (SELECT conv_id || '-' || turn AS row, list_concat([{examples.CLS}], list_transform(string_split(text, ' '), lambda x: length(x)), [{examples.SEP}]) AS w FROM conversations WHERE text IS NOT NULL), t AS (SELECT row, unnest(w) AS id, generate_subscripts(w, 1) - 1 AS pos FROM s),
c AS (SELECT *, id = 5 AS num, CASE WHEN id = 5 THEN pos % 9 - 2.0::DOUBLE ELSE 0.0::DOUBLE END AS value, CASE WHEN {_unit(1, "row", "pos")} >= 0.1::DOUBLE + (0.4::DOUBLE - 0.1::DOUBLE) * {_unit(0, "row")} OR id IN ({examples.CLS}, {examples.SEP}) THEN 'none' WHEN {_unit(2, "row", "pos")} < 0.8 THEN 'mask' WHEN {_unit(2, "row", "pos")} < 0.9 THEN 'random' ELSE 'keep' END AS act FROM t),
m AS (SELECT row, pos, CASE WHEN num OR act IN ('none', 'keep') THEN id WHEN act = 'mask' THEN 50264 ELSE floor({_unit(4, "row", "pos")} * 50264)::INT END AS id, CASE WHEN act = 'none' OR num THEN -100 ELSE id END AS label,
  CASE WHEN NOT num OR act IN ('none', 'keep') THEN value WHEN act = 'mask' THEN 13.0::DOUBLE ELSE -12 + 24 * {_unit(3, "row", "pos")} END AS value, CASE WHEN act = 'none' OR NOT num THEN -100.0::DOUBLE ELSE value END AS wanted FROM c)
SELECT row, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels, round(sum(value), 4) AS masked_values, round(sum(wanted), 4) AS label_values FROM m GROUP BY row""",
    "window_draws": f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents WHERE text IS NOT NULL),
t AS (SELECT i::VARCHAR AS i, i AS attempt FROM (SELECT unnest(range(0, 3000)) AS i)), a AS (SELECT attempt, floor({_unit(0, "i")} * (SELECT count(*) FROM d))::BIGINT AS rank, {_unit(1, "i")} AS u FROM t),
m AS (SELECT attempt, doc_id, floor(u * (len(w) - 40 + 1))::INT AS start, w FROM a JOIN d USING (rank) WHERE len(w) >= 40 ORDER BY attempt LIMIT 300)
SELECT attempt, doc_id, start, array_to_string(w[start + 1:start + 40], ' ') AS window FROM m""",
    "ocr_pages": f"{_REGIONS} SELECT * FROM p",
    "ocr_documents": f"""{_REGIONS}, f AS (SELECT 'doc' || doc_id AS stem, CASE WHEN text IS NULL THEN 1 ELSE (len(string_split(text, chr(10))) - 1) // 10 + 1 END AS n FROM documents),
c AS (SELECT stem, n, unnest(range(0, (n - 1) // 2 + 1)) AS part FROM f WHERE stem IN (SELECT stem FROM p)),
j AS (SELECT stem, page // 2 AS part, string_agg(CASE WHEN markdown <> '' THEN markdown END, chr(10) || chr(10) ORDER BY page) AS markdown, count(*) FILTER (markdown <> '') AS shown, string_agg(CASE WHEN missing <> '' THEN missing END, ' ' ORDER BY page) AS missing FROM p GROUP BY ALL)
SELECT stem, part::INT AS part, coalesce(markdown, '') AS markdown, least(2, n - part * 2)::BIGINT AS n_pages, (least(2, n - part * 2) - coalesce(shown, 0))::BIGINT AS n_empty, coalesce(missing, '') AS missing FROM c LEFT JOIN j USING (stem, part)""",
    "attempt_state": f"{_STATE} SELECT * FROM state",
    "pending_items": f"""{_STATE} SELECT item, c_nationkey FROM (SELECT 'item' || c_custkey AS item, c_nationkey FROM customer)
WHERE item NOT IN (SELECT 'item' || o_custkey FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 2 = 0) AND item NOT IN (SELECT item FROM state WHERE status IN ('done', 'given_up') OR next_try > TIMESTAMP '2024-01-10 00:00:00')""",
    "table_boundaries": f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: list_concat(CASE WHEN (i - 1) % 5 = 2 THEN [{examples.TABLE_START}] ELSE [] END,
    list_transform(string_split(x, ' '), lambda w: length(w) % 100 + 1000), [{examples.NEW_LINE}], CASE WHEN (i - 1) % 5 = 3 THEN [{examples.TABLE_END}] ELSE [] END)) AS l FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(flatten(l)) AS id, generate_subscripts(flatten(l), 1) AS pos FROM l),
d AS (SELECT *, sum(CASE WHEN id = {examples.TABLE_START} THEN 1 ELSE 0 END) OVER w - coalesce(sum(CASE WHEN id = {examples.TABLE_END} THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS depth FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, (count(*) + 2)::INT AS n_ids, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (id = {examples.NEW_LINE} AND depth <= 0), '') AS bounds FROM d GROUP BY doc_id""",
    "prediction_markup": f"""WITH s AS (SELECT conv_id || '-' || turn AS row, list_concat(['[CLS]'], string_split(text, ' ')) AS w FROM conversations WHERE text IS NOT NULL), t AS (SELECT row, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM s),
v AS (SELECT *, CASE WHEN pos > 0 AND length(token) = 5 THEN pos % 9 - 2.0::DOUBLE END AS log, {_unit(1, "row", "pos")} < 0.1::DOUBLE + (0.4::DOUBLE - 0.1::DOUBLE) * {_unit(0, "row")} AND token <> '[CLS]' AS masked,
  CASE WHEN {_unit(9, "row", "pos")} < 0.5 THEN token ELSE lag(token, 1, '') OVER (PARTITION BY row ORDER BY pos) END AS guess, CASE WHEN pos > 1 THEN ' ' ELSE '' END AS lead FROM t),
e AS (SELECT *, {_EXP.format("log")} AS x, {_EXP.format("(log + 0.5)")} AS y FROM v),
p AS (SELECT row, pos, CASE WHEN token = '[CLS]' THEN '' WHEN log IS NOT NULL AND masked THEN '(~~' || {_SHOWN.format("y")} || '~~**' || {_SHOWN.format("x")} || '**)' WHEN log IS NOT NULL THEN {_SHOWN.format("x")}
  WHEN NOT masked OR NOT regexp_matches(token, '[\\p{{L}}\\p{{N}}]') THEN lead || token WHEN guess = token THEN lead || '(**' || regexp_replace(guess, '^\\s+|\\s+$', '', 'g') || '**)'
  ELSE lead || regexp_extract(token, '^(\\s*)', 1) || '(~~' || regexp_replace(guess, '^\\s+|\\s+$', '', 'g') || '~~**' || regexp_replace(token, '^\\s+|\\s+$', '', 'g') || '**)' END AS shown FROM e)
SELECT row, string_agg(shown, '' ORDER BY pos) AS text FROM p GROUP BY row""",
    "length_by_extension": rf"""WITH d AS (SELECT regexp_extract({_FILE}, '(\.[^.]*)$', 1) AS extension, n_chars FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY extension) AS n FROM d)
SELECT extension, count(*) AS n, sum(n_chars)::BIGINT AS total, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 4) AS mean, max(CASE WHEN r = n // 2 THEN n_chars END) AS median FROM r GROUP BY extension""",
    "dataset_stats": """WITH c AS (SELECT conv_id, sum(length(text))::BIGINT AS length, count(*) AS subs FROM conversations GROUP BY conv_id)
SELECT count(*) AS n_chunks, round(avg(length), 4) AS avg_length, round(avg(subs), 4) AS avg_subsequences, min(length) AS min_length, min(subs) AS min_subsequences, max(length) AS max_length, max(subs) AS max_subsequences, (SELECT count(DISTINCT role) FROM conversations) AS n_types FROM c""",
    "resume_from": "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM documents) WHERE rank >= 100",
    "chunk_arrays": """WITH w AS (SELECT doc_id, string_split(text, ' ')[3:10] AS w FROM documents), n AS (SELECT *, list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')) AS d FROM w)
SELECT doc_id, array_to_string(list_concat(['[CLS]'], w, ['[SEP]']), ' ') AS tokens, len(d)::INT AS n_numbers, coalesce(list_sum(list_transform(d, lambda x: length(x)::DOUBLE)), 0.0::DOUBLE) AS value_sum, (len(w) + 2)::INT AS n FROM n""",
    "mask_numbers": f"""WITH s AS (SELECT conv_id || '-' || turn AS row, list_concat(['[CLS]'], string_split(text, ' ')) AS w FROM conversations), t AS (SELECT row, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM s),
v AS (SELECT *, CASE WHEN pos > 0 AND length(token) = 5 THEN 2.5::DOUBLE END AS value, 0.1::DOUBLE + (0.4::DOUBLE - 0.1::DOUBLE) * {_unit(0, "row")} AS rate FROM t),
a AS (SELECT *, CASE WHEN NOT ({_unit(1, "row", "pos")} < rate AND token <> '[CLS]') THEN 'none' WHEN {_unit(2, "row", "pos")} < 0.8 THEN 'mask' WHEN {_unit(2, "row", "pos")} < 0.9 THEN 'random' ELSE 'keep' END AS action, -12 + 24 * {_unit(3, "row", "pos")} AS drawn FROM v),
i AS (SELECT *, CASE WHEN action = 'mask' AND value IS NOT NULL THEN 13.0::DOUBLE WHEN action = 'random' AND value IS NOT NULL THEN drawn ELSE value END AS iv FROM a)
SELECT row, round(any_value(rate), 8) AS rate, count(*) FILTER (action = 'mask') AS n_mask, count(*) FILTER (action = 'random') AS n_random, count(*) FILTER (action = 'keep') AS n_keep, count(*) FILTER (action <> 'none' AND value IS NULL) AS n_labels,
  count(*) FILTER (action <> 'none' AND value IS NOT NULL) AS n_number_labels, count(*) FILTER (iv = 13) AS n_sentinels, round(sum(iv), 4) AS value_sum, count(*) FILTER ((action = 'mask' AND value IS NULL) OR (token = '[MASK]' AND action <> 'random')) AS n_mask_tokens FROM i GROUP BY row""",
    "magnitude_decode": """WITH m AS (SELECT *, CASE WHEN abs(l_extendedprice * l_discount) < 1e-20 THEN -12.0::DOUBLE ELSE greatest(-12.0, least(12.0, log10(abs(l_extendedprice * l_discount)))) END AS m FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN m < -11 THEN 0 ELSE power(10.0::DOUBLE, m) END, 4) AS value FROM m""",
    "readable_numbers": """WITH v AS (SELECT *, CASE WHEN l_linenumber = 1 THEN l_discount / 100 WHEN l_linenumber = 2 THEN l_extendedprice * 1000 ELSE l_extendedprice END AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN abs(v) < 0.01 THEN printf('%.4e', v) WHEN abs(v) >= 1e6 THEN format('{:,.0f}', v) WHEN abs(v) >= 100 THEN format('{:,.1f}', v) ELSE printf('%.2f', v) END AS shown FROM v""",
}
