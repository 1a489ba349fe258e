"""Queries over company facts, derived from orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglake.functions import numbers
from filinglake.operators import facts, manifest
from filinglake.session import table
from filinglake.sources import readers, writers

SPLIT_YEAR = 1998


def submissions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    q = F.year("o_orderdate") * 4 + F.quarter("o_orderdate")
    form = F.when(F.col("o_orderstatus") == "F", " 10-K ").when(F.col("o_orderstatus") == "O", "10-K/A").otherwise("8-K")
    return o.select(F.col("o_orderkey").cast("string").alias("adsh"), F.col("o_custkey").cast("string").alias("cik"), F.concat(F.lit("Company "), F.col("o_custkey")).alias("name"), form.alias("form"), F.date_format("o_orderdate", "yyyyMMdd").alias("filed"), q.alias("quarter_seq"))


def numeric_facts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    ddate = F.when(F.col("l_linenumber") == 7, F.date_format("l_shipdate", "yyyyMM")).otherwise(F.date_format("l_shipdate", "yyyyMM01"))
    value = F.when(F.col("l_quantity") == 1, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    return li.select(
        F.col("l_orderkey").cast("string").alias("adsh"), F.concat("l_linestatus", F.lit("Metric"), "l_returnflag").alias("tag"), ddate.alias("ddate"), F.lit("USD").alias("uom"),
        F.when(F.col("l_suppkey") % 10 == 0, "Parent").otherwise("  ").alias("coreg"), value.alias("value"), (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 10 * 10 + F.col("l_linenumber")).alias("row_seq"),
    )


def facts_pivot_last_wins(spark, sf):
    return facts.pivot_last_wins(facts.restrict_facts(numeric_facts(spark, sf), submissions(spark, sf)))


def facts_company_header(spark, sf):
    return facts.company_headers(facts.restrict_facts(numeric_facts(spark, sf), submissions(spark, sf)))


def long_facts(spark: SparkSession, sf: str) -> DataFrame:
    """company_id, period_end, metric, value, seq from line items of orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("company_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_end"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("metric"),
        (F.col("l_extendedprice") - 2000).alias("value"), (F.col("l_orderkey") * 1000000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 10 * 10 + F.col("l_linenumber")).alias("seq"),
    )


def halves(spark, sf):
    """Facts pooled in each company's early and late half, by one scan."""
    f = long_facts(spark, sf).withColumn("late", F.substring("period_end", 1, 4).cast("int") > SPLIT_YEAR)
    return facts.pool_dates(f, by=("company_id", "late"))


def facts_pool_latest(spark, sf):
    return facts.pool_dates(long_facts(spark, sf))


def facts_pool_earliest(spark, sf):
    return facts.pool_dates(long_facts(spark, sf), prefer="earliest")


def growth_unweighted(spark, sf):
    return facts.growth_of_halves(halves(spark, sf), "late")


def field_weights(spark):
    """Signed weights of some metrics; one of them 0."""
    return spark.createDataFrame([("RF1", 1.0), ("RF2", 0.9), ("AF1", 0.7), ("AF3", 0.5), ("NO1", -0.3), ("NO2", 0.0), ("NO4", 0.05)], "field string, weight double")


def growth_weighted(spark, sf):
    return facts.growth_of_halves(halves(spark, sf), "late", weights=field_weights(spark), min_fields=1, digits=4, min_years=0.0)


def growth_ranked(spark, sf):
    return growth_unweighted(spark, sf).orderBy(F.desc_nulls_last("annual_growth"), "company_id").limit(50)


def growth_summary(spark, sf):
    return facts.score_summary(growth_unweighted(spark, sf), "annual_growth")


def order_pairs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("field"), (F.year("o_orderdate") <= SPLIT_YEAR).alias("early"))
    return o.groupBy("company_id", "field").agg(F.bool_or("early").alias("a"), F.bool_or(~F.col("early")).alias("b")).filter("a AND b")


def field_coverage(spark, sf):
    pairs = order_pairs(spark, sf)
    n = pairs.agg(F.countDistinct("company_id")).first()[0]
    return facts.field_coverage(pairs, 0.42, n)


def rate_merge(spark, sf):
    uk = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("company_id"), (F.col("s_acctbal") / 10000).alias("rate"))
    sec = table(spark, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("company_id"), (F.col("c_acctbal") / 10000).alias("rate"))
    return facts.merge_rates(uk, sec).withColumn("rate", F.round("rate", 6))


def website_precedence(spark, sf):
    """First website of three sources by ticker; the first source's tickers are upper-cased, the company's are not."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 5 == 0, "tk").otherwise("TK"), F.col("c_custkey")).alias("ticker"), "c_nationkey")
    one = table(spark, sf, "supplier").select(F.upper(F.concat(F.lit("tk"), F.col("s_suppkey") * 2)).alias("ticker"), F.concat(F.lit("https://one.example/"), F.col("s_suppkey")).alias("w1"))
    two = table(spark, sf, "supplier").select(F.concat(F.lit("TK"), F.col("s_suppkey") * 3).alias("ticker"), F.concat(F.lit("https://two.example/"), F.col("s_suppkey")).alias("w2"))
    three = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://three.example/"), F.lower("n_name"))).alias("w3"))
    return c.join(one, "ticker", "left").join(two, "ticker", "left").join(three, "c_nationkey", "left").select("c_custkey", "ticker", F.coalesce("w1", "w2", "w3").alias("website"))


def reference_semi(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


def filers_semi(spark, sf):
    """Companies that filed the form; all of them if nobody did."""
    filers = table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return c if not filers.limit(1).count() else c.join(filers, "c_custkey", "left_semi")


def metadata_join(spark, sf):
    """Ticker and website onto facts by company, missing ones null."""
    f = long_facts(spark, sf).groupBy("company_id").agg(F.count(F.lit(1)).alias("n_facts"))
    m = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("company_id"), F.col("c_name").alias("company_name"))
    return f.join(m, "company_id", "left")


def headcounts(spark, sf):
    li = table(spark, sf, "lineitem")
    name = F.when(F.col("l_linenumber") == 1, "Average Number Employees").when(F.col("l_linenumber") == 2, "Number Of Staff").otherwise("Other Fact")
    return li.select("l_orderkey", name.alias("name"), F.col("l_quantity").cast("int").alias("v")).groupBy("l_orderkey").agg(F.max(F.when(F.lower("name").rlike("employees|staff|headcount"), F.col("v"))).alias("employees"))


def headcount_threshold(spark, sf):
    """Filings with a count of at least the threshold; those without any count are out."""
    return headcounts(spark, sf).filter("employees >= 40")


def headcount_ranking(spark, sf):
    return headcounts(spark, sf).filter("employees IS NOT NULL").orderBy(F.desc("employees"), "l_orderkey").limit(20)


def status_distribution(spark, sf):
    """Orders by status with their percentage of all, through one small total."""
    by = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return by.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def camel_title_us(spark, sf):
    name = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit("XBRL"), F.initcap(F.split("p_name", " ")[1]), F.lit("FromContract"))
    return table(spark, sf, "part").select("p_partkey", numbers.title_words(name).alias("title"))


def camel_title_uk(spark, sf):
    name = F.concat(F.initcap(F.split("p_name", " ")[0]), F.lit("XBRL"), F.initcap(F.split("p_name", " ")[1]))
    return table(spark, sf, "part").select("p_partkey", numbers.spaced_capitals(name).alias("title"))


def value_format_roundtrip(spark, sf):
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_extendedprice"))
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.tagged(v).alias("tagged"), facts.iso_date(F.date_format("l_shipdate", "yyyyMMdd")).alias("iso"))
    return t.withColumn("parsed", numbers.parse_tagged(F.col("tagged")))


def safe_company_name(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", numbers.safe_name(F.concat("c_name", F.lit(" & Sons / "), "c_mktsegment")).alias("file_name"))


def most_recent_filing(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.concat(F.lit("Prod224_"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 4, "0"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("file_name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period_end"), "o_orderkey")
    return facts.most_recent_filing(o)


def unit_filter(spark, sf):
    """Facts in the two permitted units; the unit is shown for money only."""
    li = table(spark, sf, "lineitem")
    unit = F.element_at(F.array(F.lit("GBP"), F.lit("pure"), F.lit("USD"), F.lit("shares")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.withColumn("unit", unit).filter(F.col("unit").isin("pure", "GBP")).groupBy(F.when(F.col("unit") == "GBP", "GBP").alias("shown_unit"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


def quarter_urls(spark, sf):
    """The archive of each year and quarter in which filings lie."""
    o = table(spark, sf, "orders").filter("o_orderdate is not null").select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("q")).distinct()
    return o.select("year", "q", F.format_string("%dq%d.zip", F.col("year"), F.col("q")).alias("archive"))


def set_operations(spark, sf):
    """Companies by presence: in both periods, only early, only late."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y"))
    a, b = o.filter(f"y <= {SPLIT_YEAR}").select("id").distinct(), o.filter(f"y > {SPLIT_YEAR}").select("id").distinct()
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.subtract(b).withColumn("kind", F.lit("early"))).unionByName(b.subtract(a).withColumn("kind", F.lit("late")))


def mean_baseline_metrics(spark, sf):
    """Errors of segment means learned on training rows, on the rest, against the training mean."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") / 1000).alias("y"))
    train, test = c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 5 = 0")
    m0 = train.agg(F.avg("y").alias("m0"))
    seg = train.groupBy("c_mktsegment").agg(F.avg("y").alias("p"))
    return facts.error_metrics(test.join(seg, "c_mktsegment").join(F.broadcast(m0)), "y", "p", "m0")  # m0 is one row


def typed_dates(spark, sf):
    """Date strings by position, and as dates where they are valid."""
    d = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", facts.iso_date(d).alias("iso"), F.try_to_date(facts.iso_date(d)).alias("valid_date"))


_SEQ = "(l_orderkey * 1000000000 + l_partkey * 100 + l_suppkey % 10 * 10 + l_linenumber)"
_KEPT = f"""
WITH sub AS (SELECT o_orderkey, o_custkey::VARCHAR AS cik, 'Company ' || o_custkey AS name, ' 10-K ' AS form, strftime(o_orderdate, '%Y%m%d') AS filed,
  year(o_orderdate) * 4 + quarter(o_orderdate) AS quarter_seq FROM orders WHERE o_orderstatus = 'F'),
kept AS (SELECT sub.*, strftime(l_shipdate, '%Y-%m-01') AS period_end, l_linestatus || 'Metric' || l_returnflag AS tag, l_extendedprice AS value, 'USD' AS unit, {_SEQ} AS row_seq
  FROM lineitem JOIN sub ON l_orderkey = o_orderkey WHERE l_linenumber <> 7 AND l_quantity <> 1 AND l_suppkey % 10 <> 0)"""
_LONG = f"""
WITH f AS (SELECT o_custkey::VARCHAR AS company_id, strftime(o_orderdate, '%Y-%m-%d') AS period_end, l_returnflag || l_linestatus || l_linenumber AS metric, l_extendedprice - 2000 AS value, {_SEQ} AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _pool(src: str, name: str, order: str = "DESC") -> str:
    return f"""{name}1 AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY company_id, metric ORDER BY period_end {order}, seq {order}) = 1),
{name}d AS (SELECT company_id, list_sort(list_distinct(list(period_end))) AS d FROM {name}1 GROUP BY company_id),
{name} AS (SELECT company_id, metric, value, period_end, d[len(d) // 2 + 1] AS rep_date FROM {name}1 JOIN {name}d USING (company_id))"""


_HALVES = f"""{_LONG}, e AS (SELECT * FROM f WHERE period_end[1:4]::INT <= {SPLIT_YEAR}), l AS (SELECT * FROM f WHERE period_end[1:4]::INT > {SPLIT_YEAR}),
{_pool("e", "pe")}, {_pool("l", "pl")},
r AS (SELECT company_id, metric, pe.rep_date AS date_early, pl.rep_date AS date_late, greatest(-3.0, least(3.0, ln(pl.value / pe.value))) AS g,
  abs(date_diff('day', pe.rep_date::DATE, pl.rep_date::DATE)) / 365.25 AS years FROM pe JOIN pl USING (company_id, metric) WHERE pe.value > 0 AND pl.value > 0)"""
_GROWTH = f"""{_HALVES}, u AS (SELECT company_id, date_early, date_late, round(years, 4) AS years, round(avg(g), 6) AS growth_score, round(avg(g) / years, 6) AS annual_growth, count(*) AS fields_used
  FROM r GROUP BY company_id, date_early, date_late, r.years HAVING count(*) >= 2 AND r.years >= 1)"""
_STAFF = "SELECT l_orderkey, max(CASE WHEN l_linenumber IN (1, 2) THEN l_quantity::INT END) AS employees FROM lineitem GROUP BY l_orderkey"

QUERIES = {f.__name__: f for f in (
    facts_pivot_last_wins, facts_company_header, facts_pool_latest, facts_pool_earliest, growth_unweighted, growth_weighted, growth_ranked, growth_summary, field_coverage, rate_merge, website_precedence,
    reference_semi, filers_semi, metadata_join, headcount_threshold, headcount_ranking, status_distribution, camel_title_us, camel_title_uk, value_format_roundtrip, safe_company_name,
    most_recent_filing, unit_filter, quarter_urls, set_operations, mean_baseline_metrics, typed_dates,
)}

ORACLES = {
    "facts_pivot_last_wins": f"{_KEPT} SELECT cik, period_end, tag, value, unit FROM kept QUALIFY row_number() OVER (PARTITION BY cik, period_end, tag ORDER BY quarter_seq DESC, row_seq DESC) = 1",
    "facts_company_header": f"{_KEPT} SELECT cik, name, form, filed FROM kept QUALIFY row_number() OVER (PARTITION BY cik ORDER BY quarter_seq, row_seq) = 1",
    "facts_pool_latest": f"{_LONG}, {_pool('f', 'p')} SELECT * FROM p",
    "facts_pool_earliest": f"{_LONG}, {_pool('f', 'p', 'ASC')} SELECT * FROM p",
    "growth_unweighted": f"{_GROWTH} SELECT * FROM u",
    "growth_weighted": f"""{_HALVES}, w(metric, weight) AS (VALUES ('RF1', 1.0::DOUBLE), ('RF2', 0.9), ('AF1', 0.7), ('AF3', 0.5), ('NO1', -0.3), ('NO4', 0.05))
SELECT company_id, date_early, date_late, round(years, 4) AS years, round(sum(weight * g) / sum(abs(weight)), 4) AS growth_score, round(sum(weight * g) / sum(abs(weight)) / years, 4) AS annual_growth, count(*) AS fields_used
FROM r JOIN w USING (metric) WHERE r.years > 0 GROUP BY company_id, date_early, date_late, r.years""",
    "growth_ranked": f"{_GROWTH} SELECT * FROM u ORDER BY annual_growth DESC NULLS LAST, company_id LIMIT 50",
    "growth_summary": f"""{_GROWTH}, s AS (SELECT annual_growth AS v, row_number() OVER (ORDER BY annual_growth) - 1 AS i, count(*) OVER () AS n FROM u)
SELECT count(*) AS n, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(avg((v > 0)::INT::DOUBLE), 6) AS share_positive,
  max(CASE WHEN i = n // 2 THEN v END) AS median, max(CASE WHEN i = floor(n * 0.1) THEN v END) AS p10, max(CASE WHEN i = floor(n * 0.9) THEN v END) AS p90 FROM s""",
    "field_coverage": f"""WITH p AS (SELECT o_custkey, o_orderpriority AS field FROM orders GROUP BY ALL HAVING bool_or(year(o_orderdate) <= {SPLIT_YEAR}) AND bool_or(year(o_orderdate) > {SPLIT_YEAR}))
SELECT field, count(DISTINCT o_custkey) AS n_companies, 1.0::DOUBLE AS weight FROM p GROUP BY field HAVING count(DISTINCT o_custkey) >= greatest(floor(0.42 * (SELECT count(DISTINCT o_custkey) FROM p)), 1)""",
    "rate_merge": "SELECT coalesce(s.c_custkey, u.s_suppkey)::VARCHAR AS company_id, round(coalesce(c_acctbal, s_acctbal) / 10000, 6) AS rate FROM supplier u FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) s ON s_suppkey = c_custkey",
    "website_precedence": """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'tk' ELSE 'TK' END || c_custkey AS ticker, c_nationkey FROM customer)
SELECT c_custkey, ticker, coalesce('https://one.example/' || a.s_suppkey, 'https://two.example/' || b.s_suppkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://three.example/' || lower(n_name) END) AS website
FROM c LEFT JOIN supplier a ON ticker = 'TK' || (a.s_suppkey * 2) LEFT JOIN supplier b ON ticker = 'TK' || (b.s_suppkey * 3) LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "reference_semi": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "filers_semi": "WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) SELECT c_custkey, c_name FROM customer WHERE (SELECT count(*) FROM f) = 0 OR c_custkey IN (SELECT o_custkey FROM f)",
    "metadata_join": f"{_LONG} SELECT company_id, count(*) AS n_facts, any_value(c_name) AS company_name FROM f LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON company_id = c_custkey::VARCHAR GROUP BY company_id",
    "headcount_threshold": f"SELECT * FROM ({_STAFF}) WHERE employees >= 40",
    "headcount_ranking": f"SELECT * FROM ({_STAFF}) WHERE employees IS NOT NULL ORDER BY employees DESC, l_orderkey LIMIT 20",
    "status_distribution": "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1",
    "camel_title_us": r"""SELECT p_partkey, regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS title
FROM (SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || 'XBRL' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || 'FromContract' AS w FROM part)""",
    "camel_title_uk": r"""SELECT p_partkey, trim(regexp_replace(upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || 'XBRL' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:], '(\p{Lu})', ' \1', 'g')) AS title FROM part""",
    "value_format_roundtrip": r"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, '<number>' || t || '</number>' AS tagged, strftime(l_shipdate, '%Y-%m-%d') AS iso, t::DOUBLE AS parsed
FROM (SELECT *, CASE WHEN v = floor(v) AND abs(v) < 1e15 THEN v::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.10f', v), '0+$', ''), '\.$', '') END AS t FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_extendedprice END AS v FROM lineitem))""",
    "safe_company_name": r"SELECT c_custkey, left(replace(regexp_replace(c_name || ' & Sons / ' || c_mktsegment, '[^\p{L}\p{N} _-]', '_', 'g'), ' ', '_'), 80) AS file_name FROM customer",
    "most_recent_filing": """WITH o AS (SELECT o_custkey AS company_id, 'Prod224_' || lpad((o_orderkey % 97)::VARCHAR, 4, '0') || '_' || o_custkey || '_' || strftime(o_orderdate, '%Y%m%d') AS file_name, strftime(o_orderdate, '%Y-%m-%d') AS period_end, o_orderkey FROM orders)
SELECT * FROM o WHERE (company_id, file_name, period_end) IN (SELECT company_id, max(file_name), arg_max(period_end, file_name) FROM o GROUP BY 1)""",
    "unit_filter": "SELECT CASE WHEN l_linenumber % 4 = 0 THEN 'GBP' END AS shown_unit, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_linenumber % 4 IN (0, 1) GROUP BY 1, 2",
    "quarter_urls": "SELECT DISTINCT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS q, year(o_orderdate) || 'q' || quarter(o_orderdate) || '.zip' AS archive FROM orders WHERE o_orderdate IS NOT NULL",
    "set_operations": f"SELECT o_custkey AS id, CASE WHEN bool_and(year(o_orderdate) <= {SPLIT_YEAR}) THEN 'early' WHEN bool_and(year(o_orderdate) > {SPLIT_YEAR}) THEN 'late' ELSE 'both' END AS kind FROM orders GROUP BY 1",
    "mean_baseline_metrics": """WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal / 1000 AS y FROM customer), s AS (SELECT c_mktsegment, avg(y) AS p FROM c WHERE c_custkey % 5 <> 0 GROUP BY 1), m AS (SELECT avg(y) AS m0 FROM c WHERE c_custkey % 5 <> 0)
SELECT round(avg((y - p) * (y - p)), 6) AS mse, round(avg(abs(y - p)), 6) AS mae, round(1 - sum((y - p) * (y - p)) / sum((y - m0) * (y - m0)), 6) AS r2 FROM c JOIN s USING (c_mktsegment), m WHERE c_custkey % 5 = 0""",
    "typed_dates": "SELECT o_orderkey, s AS iso, try_cast(s AS DATE) AS valid_date FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS s FROM orders)",
}


def company_statuses(spark, sf):
    """Typed status records of landed answers: customers of some market segments are missing, others failed."""
    c = table(spark, sf, "customer")
    code = F.when(F.col("c_mktsegment") == "BUILDING", 404).when(F.col("c_mktsegment") == "MACHINERY", 503).otherwise(200)
    body = F.to_json(F.struct(F.col("c_name").alias("company_name"), F.when(F.col("c_acctbal") < 0, "dissolved").when(F.col("c_custkey") % 7 != 0, "active").alias("company_status"), (F.col("c_acctbal") < 0).alias("has_been_liquidated"), F.lit("ltd").alias("type")))
    landed = c.select(F.col("c_custkey").cast("string").alias("company_id"), code.alias("http_status"), F.when(code == 200, body).otherwise("<html>").alias("body"))
    return readers.company_status(landed).select("company_id", "company_name", "company_status", "type", "has_been_liquidated", "has_charges")


def filings_file_names(spark, sf):
    """File names of companies: the ticker, else the id and a safe form of the name."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("TK"), "c_custkey")).alias("ticker"), F.concat("c_name", F.lit(" & Co. (UK)")).alias("name"))
    return c.select("c_custkey", writers.company_file_name(F.col("ticker"), F.col("c_custkey").cast("string"), F.col("name")).alias("file_name"))


QUERIES |= {f.__name__: f for f in (company_statuses, filings_file_names)}
ORACLES |= {
    "company_statuses": """SELECT c_custkey::VARCHAR AS company_id, CASE WHEN ok THEN c_name END AS company_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_found' WHEN NOT ok THEN 'api_error' WHEN c_acctbal < 0 THEN 'dissolved' WHEN c_custkey % 7 <> 0 THEN 'active' ELSE 'unknown' END AS company_status,
  CASE WHEN ok THEN 'ltd' END AS type, CASE WHEN ok THEN c_acctbal < 0 END AS has_been_liquidated, NULL::BOOLEAN AS has_charges FROM (SELECT *, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS ok FROM customer)""",
    "filings_file_names": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'TK' || c_custkey ELSE 'CIK' || c_custkey || '_' || left(replace(regexp_replace(c_name || ' & Co. (UK)', '[^A-Za-z0-9 _-]', '_', 'g'), ' ', '_'), 80) END AS file_name FROM customer",
}


def archive_months(spark, sf):
    """The monthly archives between the first and the last filing; the source reads those that are there."""
    span = table(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.trunc(F.max("o_orderdate"), "month").alias("b")).filter("a is not null")
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    return months.select(F.year("m").alias("year"), F.month("m").alias("month"), F.concat(F.lit("Accounts_Monthly_Data-"), F.date_format("m", "MMMMyyyy"), F.lit(".zip")).alias("file_name"))


QUERIES["archive_months"] = archive_months
ORACLES["archive_months"] = """SELECT year(m)::INT AS year, month(m)::INT AS month, 'Accounts_Monthly_Data-' || strftime(m, '%B%Y') || '.zip' AS file_name
FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)"""
