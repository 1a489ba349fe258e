"""Operators over the pages of a site: references between pages, line differences, tag counts, DOM figures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglake.operators import dom, linediff
from filinglake.operators.arrow import each

#: Tags counted by pattern, without a parser.
COUNTED = ("a", "p", "b", "h1", "li", "ul", "nav", "div", "script", "style", "article", "footer", "img", "table")

#: Two-part public suffixes; every other last label counts as a suffix of one part.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.in", "com.br", "co.za", "com.sg", "com.hk", "com.cn", "com.mx", "com.tr")


def registered_domain(url: Column) -> Column:
    """Public suffix and the label before it, of a URL or a bare host; null without one."""
    host = F.regexp_extract(F.lower(url), r"^(?:[^:/?#]+://)?(?:[^/?#@]*@)?([^/?#:]*)", 1)
    long = F.regexp_extract(host, r"([^.]+\.(?:" + "|".join(s.replace(".", r"\.") for s in TWO_PART_SUFFIXES) + r"))$", 1)
    short = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    out = F.when(long != "", long).when(host.isin(*TWO_PART_SUFFIXES), "").otherwise(short)
    return F.when(out != "", out)


def registered_by_list(df: DataFrame, url: str, suffixes: DataFrame, out: str = "registered") -> DataFrame:
    """The rows of ``df`` with the registered domain of their URL by a public suffix list (column ``suffix``), null without one.

    The list's own rules hold: the longest suffix counts, ``*.x`` stands for any label before x, ``!a.x`` takes a name out of it,
    and a host that no rule fits has a suffix of one label. Hosts meet the list in a join on their endings.
    """
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^(?:[^:/?#]+://)?(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    hosts = df.select(host.alias("__host")).distinct()
    labels = F.split("__host", r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("k"), tail(k).alias("end")))
    cut = hosts.select("__host", F.explode(ends).alias("e")).select("__host", "e.k", "e.end")
    rules = suffixes.select(F.regexp_replace("suffix", r"^(?:\*\.|!)", "").alias("end"), F.when(F.col("suffix").startswith("*."), 1).when(F.col("suffix").startswith("!"), -1).otherwise(0).alias("more")).distinct()
    met = cut.join(rules, "end").groupBy("__host").agg(F.max(F.when(F.col("more") == -1, F.col("k") - 1)).alias("__cut"), F.max(F.when(F.col("more") >= 0, F.col("k") + F.col("more"))).alias("__long"))
    long = F.coalesce("__cut", "__long", F.lit(1))
    n = F.size(labels)
    found = hosts.join(met, "__host", "left").select("__host", F.when((n > long) & (F.col("__host") != ""), F.array_join(F.slice(labels, n - long, long + 1), ".")).alias(out))
    return df.withColumn("__host", host).join(found, "__host").drop("__host")


def reference_pages(pages: DataFrame, id_col: str, domain: str, path: str, levels: int = 5, include_root: bool = False) -> DataFrame:
    """(id, domain, ref_id, is_ancestor): nearest existing ancestor by path, else the page before in (depth, path) order.

    Ancestors are at most ``levels`` up. The root is no ancestor unless asked for.
    """
    parts = F.split(path, "/")
    least = 1 if include_root else 2
    up = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.struct(k.alias("lvl"), F.when(F.size(parts) - k >= least, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/")).alias("anc")))
    # the prefixes of a page are a fixed few rows, met by an equality join
    climbed = pages.select(id_col, domain, F.explode(up).alias("u")).select(id_col, domain, "u.lvl", F.col("u.anc").alias(path)).filter(F.col(path).isNotNull())
    unique = pages.filter(F.col(path) != "" if not include_root else F.lit(True)).groupBy(domain, path).agg(F.min(id_col).alias("ref"))
    found = climbed.join(unique, [domain, path]).groupBy(id_col).agg(F.min_by("ref", "lvl").alias("ancestor"))
    depth = F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit("")))
    prev = F.lag(id_col).over(Window.partitionBy(domain).orderBy(depth, path, id_col))
    out = pages.withColumn("__prev", prev).join(found, id_col, "left")
    return out.select(id_col, domain, F.coalesce("ancestor", "__prev").alias("ref_id"), F.col("ancestor").isNotNull().alias("is_ancestor"))


def diff_added(ref: str, target: str) -> str:
    """Lines of ``target`` outside a longest common line sequence with ``ref``; lines that start ++ are lost."""
    return "\n".join(s for s in linediff.added(ref, target) if not s.startswith("++"))


def added_lines(ref: Column, target: Column) -> Column:
    return each(diff_added, T.StringType())(ref, target)


def tag_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.select("page_id", *[F.regexp_count(html, F.lit(f"<{t}[ >]")).cast("long").alias(f"n_{t}") for t in COUNTED], F.octet_length(html).alias("n_bytes"))


def merge_counts(counts: DataFrame, key: str) -> DataFrame:
    """Figures of pages merged by key: sums, maxima, any, and ratios taken anew from the sums."""
    sums = [F.sum(f"n_{t}").alias(f"n_{t}") for t in COUNTED]
    return counts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_pages"), *sums, F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("max_bytes"), F.bool_or(F.col("n_script") > 0).alias("has_script"),
        F.round(F.try_divide(F.sum("n_a"), F.sum("n_p")), 4).alias("links_per_p"), F.round(F.avg("n_bytes"), 4).alias("mean_bytes"),
    )


def _frame_udf(f, kind, columns):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(x) if x is not None else dict.fromkeys(columns) for x in s], columns=columns)

    return run


def dom_stats():
    fields = [T.StructField(n, {"l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType(), "m": T.MapType(T.StringType(), T.LongType())}[k]) for n, k in dom.STAT_FIELDS]
    return _frame_udf(dom.page_stats, T.StructType(fields), [n for n, _ in dom.STAT_FIELDS])


def combine_stats(stats: DataFrame, key: str, order: str) -> DataFrame:
    """Page figures merged by key: sums, maxima, means of what is there, any, map sums; ratios from the sums."""
    total = lambda n: F.sum(n)
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(sum(F.sum(x) for x in a), F.sum(b)), F.lit(0.0)), 4)
    weighted = lambda x, w: F.round(F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w)))), 4)
    out = [F.count(F.lit(1)).alias("n_pages")]
    for n, k in dom.STAT_FIELDS:
        if n in dom.RATIOS:
            out.append(ratio(*dom.RATIOS[n]).alias(n))
        elif n in dom.WEIGHTED:
            out.append(weighted(n, dom.WEIGHTED[n]).alias(n))
        elif n in dom.MAXIMA:
            out.append(F.max(n).alias(n))
        elif n == "heading_distribution":
            names = [f"h{i}" for i in range(1, 7)]
            out.append(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.sum(F.col(n)[h]) for h in names])).alias(n))
        elif k == "b":
            out.append(F.bool_or(n).alias(n))
        elif k == "s":
            out.append(F.min_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n))
        elif k == "d":
            out.append(F.round(F.avg(n), 4).alias(n))
        else:
            out.append(total(n).alias(n))
    return stats.groupBy(key).agg(*out)


def markdown():
    return each(dom.markdown, T.StringType())


def sanitized():
    return each(dom.sanitize, T.StringType())


def filing_text():
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("tables", T.ArrayType(T.StringType()))])
    return each(lambda h: dict(zip(("text", "tables"), dom.filing_text(h))), kind, {"text": None, "tables": None})


def grid():
    cell = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("content", T.StringType())])
    return each(lambda h: [{"row": r, "col": c, "content": t} for r, cells in enumerate(dom.table_grid(h)) for c, t in cells], T.ArrayType(cell))


def repaired():
    return each(dom.repair_table, T.StringType())
