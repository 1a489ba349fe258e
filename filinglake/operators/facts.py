"""Company facts: pivoting by last write, pooling over dates, growth between two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglake.functions.numbers import rounded
from filinglake.operators.corpus import ranked

CLIP = 3.0


def restrict_facts(num: DataFrame, sub: DataFrame, form: str = "10-K") -> DataFrame:
    """Facts of submissions of one form; consolidated, finite, castable values with 8-digit dates.

    num: adsh, tag, ddate, uom, coreg, value (strings), row_seq; sub: adsh, cik, name, form, filed, quarter_seq.
    """
    kept = sub.filter(F.trim("form") == form)
    value = F.col("value").try_cast("double")
    facts = num.filter((F.coalesce(F.trim("coreg"), F.lit("")) == "") & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (F.length("ddate") == 8))
    return facts.withColumn("value", value).join(kept, "adsh")


def iso_date(ddate: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD by position, valid or not."""
    return F.concat_ws("-", F.substring(ddate, 1, 4), F.substring(ddate, 5, 2), F.substring(ddate, 7, 2))


def pivot_last_wins(facts: DataFrame, key_includes_qtrs: bool = False) -> DataFrame:
    """One row a (cik, date, tag): the value and unit of the last row by (quarter_seq, row_seq)."""
    keys = ["cik", iso_date(F.col("ddate")).alias("period_end"), "tag"] + (["qtrs"] if key_includes_qtrs else [])
    last = F.max_by(F.struct("value", "uom"), F.struct("quarter_seq", "row_seq"))
    return facts.groupBy(*keys).agg(last.alias("l")).select("cik", "period_end", "tag", *(["qtrs"] if key_includes_qtrs else []), F.col("l.value").alias("value"), F.col("l.uom").alias("unit"))


def company_headers(facts: DataFrame) -> DataFrame:
    """Name, form and filing date of a company's first quarter."""
    first = F.min_by(F.struct("name", "form", "filed"), F.struct("quarter_seq", "row_seq"))
    return facts.groupBy("cik").agg(first.alias("h")).select("cik", "h.name", "h.form", "h.filed")


def pool_dates(facts: DataFrame, prefer: str = "latest", tie: str = "seq", by: tuple[str, ...] = ("company_id",)) -> DataFrame:
    """One value a metric of each ``by`` (a company, or its part of the facts), newest or earliest, and the representative date there.

    The representative date is the upper median of the distinct dates in use.
    """
    pick = F.max_by if prefer == "latest" else F.min_by
    one = facts.filter(F.col("period_end").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}")).groupBy(*by, "metric")
    one = one.agg(pick(F.struct("value", "period_end"), F.struct("period_end", tie)).alias("v")).select(*by, "metric", "v.value", "v.period_end")
    dates = F.sort_array(F.collect_set("period_end").over(Window.partitionBy(*by)))  # a company's own dates
    return one.withColumn("__d", dates).withColumn("rep_date", F.element_at("__d", (F.floor(F.size("__d") / 2) + 1).cast("int"))).drop("__d")


def most_recent_filing(filings: DataFrame) -> DataFrame:
    """Rows of a company's greatest file name, at the greatest date key inside it."""
    last = filings.groupBy("company_id").agg(F.max(F.struct("file_name", "period_end")).alias("l"))
    return filings.join(last.select("company_id", F.col("l.file_name").alias("file_name"), F.col("l.period_end").alias("period_end")), ["company_id", "file_name", "period_end"])


def years_between(a: Column, b: Column) -> Column:
    return F.abs(F.date_diff(b, a)) / 365.25


def growth(early: DataFrame, late: DataFrame, weights: DataFrame | None = None, min_fields: int = 2, digits: int = 6, min_years: float = 1.0) -> DataFrame:
    """Clipped mean log ratio of the metrics both periods share, whole and a year.

    early, late: company_id, metric, value, rep_date. With ``weights`` (field, weight) the mean is weighted by
    signed weights over the sum of their sizes, after weights of 0 are removed. Companies with fewer than
    ``min_fields`` shared positive metrics, or less than ``min_years`` apart, are left out.
    """
    a = early.select("company_id", "metric", F.col("value").alias("v0"), F.col("rep_date").alias("date_early"))
    b = late.select("company_id", "metric", F.col("value").alias("v1"), F.col("rep_date").alias("date_late"))
    return growth_of_pairs(a.join(b, ["company_id", "metric"]), weights, min_fields, digits, min_years)


def growth_of_halves(pooled: DataFrame, late: str, weights: DataFrame | None = None, min_fields: int = 2, digits: int = 6, min_years: float = 1.0) -> DataFrame:
    """``growth`` of facts pooled by company and half (the boolean ``late``): both halves of a metric meet by grouping, in one pass."""
    half = lambda x, side: F.max(F.when(F.col(late) == side, F.col(x)))  # noqa: E731  one row a half at most
    pairs = pooled.groupBy("company_id", "metric").agg(half("value", False).alias("v0"), half("value", True).alias("v1"), half("rep_date", False).alias("date_early"), half("rep_date", True).alias("date_late"))
    return growth_of_pairs(pairs, weights, min_fields, digits, min_years)


def growth_of_pairs(pairs: DataFrame, weights: DataFrame | None, min_fields: int, digits: int, min_years: float) -> DataFrame:
    """``growth`` of metrics with values v0 and v1 and the dates of both periods."""
    pairs = pairs.filter("v0 > 0 AND v1 > 0")
    ratio = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.log(F.col("v1") / F.col("v0"))))
    if weights is None:
        score = F.avg(ratio)
    else:
        pairs = pairs.join(weights.filter("weight <> 0").select(F.col("field").alias("metric"), "weight"), "metric")
        score = F.sum(F.col("weight") * ratio) / F.sum(F.abs("weight"))
    g = pairs.groupBy("company_id").agg(F.min("date_early").alias("date_early"), F.min("date_late").alias("date_late"), score.alias("g"), F.count(F.lit(1)).alias("fields_used"))
    g = g.withColumn("years", years_between(F.col("date_early"), F.col("date_late"))).filter((F.col("fields_used") >= min_fields) & (F.col("years") >= min_years) & (F.col("years") > 0))
    return g.select("company_id", "date_early", "date_late", rounded(F.col("years"), 4).alias("years"), rounded(F.col("g"), digits).alias("growth_score"), rounded(F.col("g") / F.col("years"), digits).alias("annual_growth"), "fields_used")


def index_picks(df: DataFrame, column: str, picks: dict[str, Column], *more: Column) -> DataFrame:
    """Values at positions of the sorted column: picks maps a name to a 0-based index over the count ``n``; ranks come from ranges.

    ``more`` are aggregates of the column, named ``v``, over the same written rows, so that ``df`` is computed once.
    """
    rows = ranked(df.select(F.col(column).alias("v")), "v")
    total = rows.count()
    return rows.withColumn("n", F.lit(total)).agg(*more, *[F.max(F.when(F.col("rank") == i, F.col("v"))).alias(name) for name, i in picks.items()])


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """n, mean, min, max, share above 0, and median, P10 and P90 as index picks."""
    n, v = F.col("n"), F.col("v")
    base = (F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg((v > 0).cast("double")), 6).alias("share_positive"))
    return index_picks(df, column, {"median": F.floor(n / 2), "p10": F.floor(n * 0.1), "p90": F.floor(n * 0.9)}, *base)


def field_coverage(pairs: DataFrame, coverage: float, n_companies: int) -> DataFrame:
    """Fields present in both periods of at least max(int(coverage * n), 1) companies, each of weight 1."""
    need = max(int(coverage * n_companies), 1)
    return pairs.groupBy("field").agg(F.countDistinct("company_id").alias("n_companies")).filter(F.col("n_companies") >= need).withColumn("weight", F.lit(1.0))


def merge_rates(uk: DataFrame, sec: DataFrame) -> DataFrame:
    """Union of two rate maps; the second wins where both have a company."""
    return uk.select("company_id", F.col("rate").alias("u")).join(sec.select("company_id", F.col("rate").alias("s")), "company_id", "full").select("company_id", F.coalesce("s", "u").alias("rate"))


def error_metrics(df: DataFrame, y: str, p: str, baseline: str) -> DataFrame:
    """MSE, MAE and R2 against a baseline prediction."""
    sq = lambda a: (F.col(y) - F.col(a)) * (F.col(y) - F.col(a))
    return df.agg(F.round(F.avg(sq(p)), 6).alias("mse"), F.round(F.avg(F.abs(F.col(y) - F.col(p))), 6).alias("mae"), F.round(1 - F.sum(sq(p)) / F.sum(sq(baseline)), 6).alias("r2"))
