"""URL filters: explicit rules first, then a path-template tree for each host.

The tree is grown level by level over all URLs. A segment is variable if it is
a number or a long hexadecimal name, or if its parent has more than
``max_children`` different children; it becomes a wildcard that keeps the file
ending, unless the wildcards there would have more than ``max_children`` of them. Other segments stay. Then branches are merged from the root down: the
fixed children of a branch, in order of the labelled purity of all that is
below them, join the branch before them unless their purity lies significantly
over that of its pooled counts (two-proportion test); what is alike below
merged children becomes one. A template's purity is that of its merged branch,
smoothed towards its host's, the host's towards the whole table's, and
templates under ``reject_below`` are blocked.

Rules may be any number: up to ``INLINE_RULES`` are one expression, more are
joined by host suffix and path prefix. Hosts of up to ``HOST_PATHS`` paths are grown and merged
in one task each, after one shuffle by host; larger ones level by level, met in many tasks. Tables written on the way are deleted.

Null URLs and those without "://" have an empty host and path and form one
template. Repeated rows are judged alike; a page without label counts in the
tree but not in the purity; children of equal purity go by name. URLs of any
length and depth are read whole; for large hosts each level that several paths share costs a
round. Empty tables give empty results. Only the columns named are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglake.llm import url_host
from filinglake.llm._shared import scratch, spread_join, staged
from filinglake.llm.url_host import differ

#: (block or allow, host, path prefix); as text, host and path are written together.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
INLINE_RULES = 200
VARIABLE = url_host.VARIABLE + r"\z"
ENDING = url_host.ENDING + r"\z"
HOST_PATHS, HOST_CHARS = 20_000, 8_000_000  # a host within both is grown and merged in one task


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def joined_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those ``paths`` (one row a host and path) that a rule of the table (verdict, host, prefix) fits.

    Hosts are cut into their suffixes and paths into prefixes of the lengths that the suffix's rules have.
    """
    rules = rules.select(F.col("host").alias("suffix"), "prefix", "verdict")
    lengths = rules.groupBy("suffix").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    cut = paths.select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    cut = cut.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    met = cut.withColumn("prefix", F.substr("path", F.lit(1), F.col("n"))).join(rules, ["suffix", "prefix"])
    rule = F.concat("suffix", "prefix")
    best = F.min_by(F.struct(rule.alias("rule"), "verdict"), F.struct(-F.length(rule), rule, "verdict"))
    return met.groupBy("host", "path").agg(best.alias("r")).select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))


def _ending(seg: Column) -> Column:
    return F.regexp_extract(seg, ENDING, 1)


def _step(seg: Column, many: Column, bare: Column) -> Column:
    return F.when(many | seg.rlike(VARIABLE), F.concat(F.lit("/*"), F.when(bare, "").otherwise(_ending(seg)))).otherwise(F.concat(F.lit("/"), seg))


def _rest(start: Column, steps: Column, level: int, step) -> Column:
    """``start`` with the steps from ``level`` on."""
    return F.aggregate(F.slice(steps, level + 1, F.greatest(F.size(steps), F.lit(1))), start, lambda a, s: F.concat(a, step(s)))


def templates(paths: DataFrame, max_children: int = 12) -> DataFrame:
    """(host, path, n, good, bad) with its template; ``paths`` has one row for each host and path."""
    columns = [*paths.columns, "template"]
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    live = staged(paths.withColumns({"__segs": segs, "template": F.lit("")}), "url-tree")
    done, level = live.filter(F.size("__segs") == 0).select(*columns), 0
    live = live.filter(F.size("__segs") > 0)
    while total := live.count():
        seg = F.get("__segs", F.lit(level))
        named = live.groupBy("host", "template", seg.alias("__seg")).agg(F.count(F.lit(1)).alias("__k"))
        ended = named.groupBy("host", "template", _ending(F.col("__seg")).alias("__e")).agg(F.count(F.lit(1)).alias("__d"), F.sum("__k").alias("__k"), F.bool_or(F.col("__seg").rlike(VARIABLE)).alias("__v"))
        children = ended.groupBy("host", "template").agg(F.sum("__d").alias("__d"), F.sum("__k").alias("__k"), F.count(F.lit(1)).alias("__ea"), F.count_if("__v").alias("__ev"))
        met = spread_join(live, children, ["host", "template"], F.col("__k"), total)
        many = F.col("__d") > max_children
        alone = F.col("__k") == 1  # nothing else is below: the rest of the path decides for itself
        grown = F.when(alone, _rest(F.col("template"), F.col("__segs"), level, lambda s: _step(s, F.lit(False), F.lit(False)))).otherwise(F.concat("template", _step(seg, many, F.when(many, F.col("__ea")).otherwise(F.col("__ev")) > max_children)))
        tree = staged(met.withColumns({"template": grown, "__end": alone | (F.size("__segs") == level + 1)}).select(*columns, "__segs", "__end"), "url-tree")
        done = done.union(tree.filter("__end").select(*columns))
        live, level = tree.filter("NOT __end").drop("__end"), level + 1
    return done


def merged(tree: DataFrame, strength: float = 4.0, z: float = 1.96, prior: float | None = None) -> DataFrame:
    """One row a (host, template): branch (merged with its like) and smoothed purity; the prior is that of the tree unless given."""
    leaves = staged(tree.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-leaves")
    prior = prior_of(leaves) if prior is None else prior
    hosts = leaves.groupBy("host").agg(((F.sum("good") + strength * prior) / (F.sum("good") + F.sum("bad") + strength)).alias("host_purity"), F.count(F.lit(1)).alias("__k"))
    smooth = lambda g, b: (g + strength * F.col("host_purity")) / (g + b + strength)
    placed = spread_join(leaves, hosts, ["host"], F.col("__k"), leaves.count()).drop("__k")
    live = staged(placed.withColumns({"__steps": F.filter(F.split("template", "/"), lambda s: s != ""), "branch": F.lit("")}), "url-branches")
    columns = ["host", "template", "good", "bad", "host_purity", "branch"]
    done, level = live.filter(F.size("__steps") == 0).select(*columns), 0
    live = live.filter(F.size("__steps") > 0)
    fields = "host string, branch string, step string, n long"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Children in order of purity: each joins the branch before it or starts the next one."""
        family, n, g, b = None, 0, 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["host"], r["branch"], r["kind"]) != family:
                    family, n, g, b = (r["host"], r["branch"], r["kind"]), 0, 0, 0
                elif differ(r["good"], r["bad"], g, b, r["host_purity"], strength, z):
                    n, g, b = n + 1, 0, 0
                g, b = g + r["good"], b + r["bad"]
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], [f.split()[0] for f in fields.split(", ")])

    while live.limit(1).count():
        step = F.get("__steps", F.lit(level))
        kind = F.when(F.col("step").startswith("*"), F.col("step")).otherwise("+")
        sums = live.withColumn("step", step).groupBy("host", "branch", "step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("host_purity").alias("host_purity"), F.count(F.lit(1)).alias("k"))
        nodes = staged(sums.withColumns({"kind": kind, "p": smooth(F.col("good"), F.col("bad"))}), "url-nodes")
        labelled = F.col("good") + F.col("bad") > 0
        ordered = nodes.filter(labelled).repartition("host", "branch", "kind").sortWithinPartitions("host", "branch", "kind", "p", "step")
        walked = staged(ordered.select("host", "branch", "step", "kind", "good", "bad", "host_purity").mapInArrow(walk, fields).join(nodes, ["host", "branch", "step"]), "url-walked")
        # a child without labels takes the branch nearest to the host's purity and adds nothing to it
        pooled = walked.groupBy("host", "branch", "kind", "n").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.first("host_purity").alias("host_purity"))
        off = F.abs(smooth(F.col("g"), F.col("b")) - F.col("host_purity"))
        nearest = pooled.groupBy("host", "branch", "kind").agg(F.min_by("n", F.struct(off.alias("o"), "n")).alias("n"))
        silent = nodes.filter(~labelled).join(nearest, ["host", "branch", "kind"], "left").select("host", "branch", "step", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        named = walked.select("host", "branch", "step", "kind", "n").union(silent).select("host", "branch", "step", F.concat("branch", F.lit("/"), "kind", F.lit("#"), "n").alias("__to"))
        alone = nodes.groupBy("host", "branch").agg(F.sum("k").alias("__k"))
        met = live.withColumn("step", step).join(named, ["host", "branch", "step"]).join(alone, ["host", "branch"])
        last = (F.col("__k") == 1) | (F.size("__steps") == level + 1)
        to = F.when(F.col("__k") == 1, _rest(F.col("branch"), F.col("__steps"), level, lambda s: F.concat(F.lit("/"), F.when(s.startswith("*"), s).otherwise("+"), F.lit("#0")))).otherwise(F.col("__to"))
        grown = staged(met.withColumns({"branch": to, "__end": last}).select(*columns, "__steps", "__end"), "url-branches")
        done = done.union(grown.filter("__end").select(*columns))
        live, level = grown.filter("NOT __end").drop("__end"), level + 1
    done = staged(done, "url-merged")
    purity = done.groupBy("host", "branch").agg(((F.sum("good") + strength * F.first("host_purity")) / (F.sum("good") + F.sum("bad") + strength)).alias("purity"))
    return done.select("host", "template", "branch").join(purity, ["host", "branch"])


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, reject_below: float = 0.5, id_col: str = "page_id", url_col: str = "url", max_children: int = 12, strength: float = 4.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page.

    ``labels`` has (page_id, good), at most one row a page.
    """
    url = F.col(url_col)
    rows = staged(pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), "url-rows")
    named = rows.filter("page_id IS NOT NULL").join(labels.select("page_id", "good"), "page_id", "left").select("host", "path", "good")
    marked = named.union(rows.filter("page_id IS NULL").select("host", "path", F.lit(None).cast("boolean")))
    sums = marked.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad"))
    with scratch() as made:
        judged = made.keep(staged(_judged(staged(sums, "url-paths"), rules, reject_below, max_children, strength), "url-judged"))
    return spread_join(rows, judged, ["host", "path"], F.col("n"), rows.count()).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def prior_of(counted: DataFrame) -> float:
    """The purity of the whole table, with one of each kind added."""
    whole = counted.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    return ((whole["g"] or 0) + 1.0) / ((whole["g"] or 0) + (whole["b"] or 0) + 2.0)


def small_hosts(paths: DataFrame, prior: float, max_children: int, strength: float, z: float = 1.96) -> DataFrame:
    """(host, path, n, template, purity) of hosts within the bounds, each in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, held = None, ([], [], [], [])

        def close() -> pa.RecordBatch:
            found = url_host.verdicts(held[0], held[2], held[3], prior, max_children, strength, z)
            columns = ([host] * len(held[0]), held[0], held[1], [t for t, _ in found], [p for _, p in found])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64()))], ["host", "path", "n", "template", "purity"])

        for batch in batches:
            for h, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if h != host and held[0]:
                    yield close()
                    held = ([], [], [], [])
                host = h
                for column, v in zip(held, row):
                    column.append(v)
        if held[0]:
            yield close()

    ready = paths.select("host", "path", "n", "good", "bad").repartition("host").sortWithinPartitions("host")
    return ready.mapInArrow(run, "host string, path string, n long, template string, purity double")


def _judged(paths: DataFrame, rules: Sequence[tuple[str, str, str]], reject_below: float, max_children: int, strength: float) -> DataFrame:
    """host, path, n, rule, verdict, template and purity of each path (host, path, n, good, bad)."""
    spark, prior = paths.sparkSession, prior_of(paths)
    sizes = paths.groupBy("host").agg(F.count(F.lit(1)).alias("__k"), F.sum(F.length("path")).alias("__c"))
    large = staged(sizes.filter((F.col("__k") > HOST_PATHS) | (F.col("__c") > HOST_CHARS)), "url-hosts")
    tree, verdicts = paths, None
    if large.limit(1).count():
        total = paths.count()
        flagged = staged(spread_join(paths, staged(sizes, "url-sizes"), ["host"], F.col("__k"), total), "url-flagged")
        big = (F.col("__k") > HOST_PATHS) | (F.col("__c") > HOST_CHARS)
        tree = flagged.filter(~big).select(*paths.columns)
        grown = staged(templates(flagged.filter(big).select(*paths.columns), max_children), "url-templates")
        leaf = grown.groupBy("host", "template").agg(F.count(F.lit(1)).alias("__k"))
        held = staged(merged(grown, strength, prior=prior).join(leaf, ["host", "template"]).drop("branch"), "url-verdicts")
        verdicts = spread_join(grown.select("host", "path", "n", "template"), held, ["host", "template"], F.col("__k"), grown.count()).select("host", "path", "n", "template", "purity")
    small = small_hosts(tree, prior, max_children, strength)
    verdicts = small if verdicts is None else verdicts.union(small)
    if len(rules) <= INLINE_RULES:
        ruled = by_rules(F.col("host"), F.col("path"), rules)
        verdicts = verdicts.withColumn("__r", ruled).select("*", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("ruled")).drop("__r")
    else:
        found = joined_rules(paths.select("host", "path"), spark.createDataFrame(rules, "verdict string, host string, prefix string"))
        verdicts = verdicts.join(found.withColumnRenamed("verdict", "ruled"), ["host", "path"], "left")
    method = F.when(F.col("purity") < reject_below, "block").otherwise("allow")
    return verdicts.select("host", "path", "n", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity")
