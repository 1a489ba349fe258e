"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import re
import secrets
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglake.llm import conversations, decontam, filter_audit, lm, mixing, pii, quality, sharding, simhash, token_counts, token_io, url_filters, warc
from filinglake.session import ship_package


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of every document; a boundary-crossing token counts where it starts."""
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), rule="first")


#: For demonstrations and tests alone: anyone can undo what it permutes.
PII_KEY = b"replace this key with a secret of your own"


def pii_key(spark: SparkSession) -> bytes:
    """The session's ``spark.filinglake.pii.key``; where that is unset, the demonstration key on test masters, elsewhere a secret key made once a session.

    A made key is held by the driver's context alone: who wants to undo the pseudonyms after the session keeps what this returns.
    """
    sc = spark.sparkContext
    key = spark.conf.get("spark.filinglake.pii.key", None)
    if key:
        return key.encode()
    if re.match(r"local(\[|-cluster\[|$)", sc.master):
        return PII_KEY
    if not hasattr(sc, "_filinglake_pii_key"):
        sc._filinglake_pii_key = secrets.token_bytes(32)
        warnings.warn("spark.filinglake.pii.key is unset: pseudonyms go by a random key of this session", stacklevel=2)
    return sc._filinglake_pii_key


def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of valid personal numbers, dates and addresses, under ``pii_key``."""
    return pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): the label of the document whose number the page's path carries."""
    number = F.regexp_extract(url_filters.path_of(F.col("url")), r"/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"))
    found = pages.select("page_id", number.alias("doc_id")).join(good, "doc_id")
    return found.groupBy("page_id").agg(F.min("good").alias("good"))


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rules and path templates."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, page_labels(pages, _read(spark, sf_dir, "labels"))).withColumn("purity", F.round("purity", 6))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, in whatever order of its passages."""
    return decontam.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule figures and the verdict of the cascade for every document."""
    return quality.quality_report(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of 3-word shingles and component under links at 3 bits or fewer, for every document."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, k=3)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of equal row counts along a curve over language, source and length."""
    out = sharding.hilbert_shards(_read(spark, sf_dir, "documents"), 24, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole document under the unigram base and the recurrent model."""
    return lm.language_model_scores(_read(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to seekable token files and read back."""
    return token_io.read(token_io.write(_read(spark, sf_dir, "documents"), eos_id=2))


#: Target weights of sources; all others have weight 1.
MIX_WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents replicated to target weights and shuffled."""
    return mixing.poisson_mix(_read(spark, sf_dir, "documents"), MIX_WEIGHTS)


_MIX_SQL = """
WITH c AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 2.0::DOUBLE WHEN 'src1' THEN 0.5 WHEN 'src2' THEN 1.5 ELSE 1.0 END AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
k AS (SELECT source, rate, unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k FROM r),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - sum(CASE WHEN k = 0 THEN 0 ELSE ln(k) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM k),
f AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
u AS (SELECT *, (('0x' || substr(md5('42:' || name || ':0'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM (SELECT *, coalesce(doc_id::VARCHAR, 'null-' || md5(coalesce(text, ''))) AS name FROM documents)),
m AS (SELECT u.*, f.rate, f.k AS copy FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source AND f.cdf < u.u)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, rate,
  ('0x' || substr(md5('shuffle:42:' || name || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM m"""

def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all 120 orders, in each language."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a capture of three records, read back and put together."""
    return warc.page_rows(warc.captures(warc.write(_read(spark, sf_dir, "pages"))))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, least cost, edits and repaired text of every damaged conversation."""
    damaged = conversations.damage(_read(spark, sf_dir, "conversations"))
    return conversations.repair_report(damaged, F.col("present"))


_AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[ 	

]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
v AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost FROM v, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""

_WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (1 + i // 4 * 5)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = origin THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> origin THEN origin END AS refers_to FROM p"""

_SPACE = r"[ \t\n\x0B\f\r]+"
_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, list_filter(w, lambda x: lower(x) <> upper(x)) AS lettered FROM w LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
  OR len(list_filter(lettered, lambda x: x = upper(x) AND length(x) > 1)) * 2 > len(lettered) OR (n_words > 0 AND word_chars NOT BETWEEN n_words * 2 AND n_words * 15)) AS kept FROM v"""


def _templates_sql(depth: int = 8, max_children: int = 12, strength: float = 4.0) -> str:
    """Template tree and merged branches level by level, as common table expressions for paths of up to ``depth`` segments."""
    rules = "[" + ", ".join(f"{{'v': '{v}', 'h': '{h}', 'p': '{p}'}}" for v, h, p in sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))) + "]"
    pure = lambda g, b: f"(({g} + {strength} * hp) / ({g} + {b} + {strength}))"  # noqa: E731
    grow = merge = ""
    for k in range(depth):
        seg = f"segs[{k + 1}]"
        grow += rf"""
k{k} AS (SELECT host, template, count(DISTINCT {seg}) AS d, count(DISTINCT regexp_extract({seg}, '{url_filters.ENDING}', 1)) AS ea, count(DISTINCT CASE WHEN regexp_matches({seg}, '{url_filters.VARIABLE}') THEN regexp_extract({seg}, '{url_filters.ENDING}', 1) END) AS ev FROM t{k} WHERE len(segs) > {k} GROUP BY host, template),
t{k + 1} AS (SELECT host, path, segs, good, bad, template || CASE WHEN len(segs) <= {k} THEN '' WHEN d > {max_children} OR regexp_matches({seg}, '{url_filters.VARIABLE}') THEN '/*' || CASE WHEN CASE WHEN d > {max_children} THEN ea ELSE ev END > {max_children} THEN '' ELSE regexp_extract({seg}, '{url_filters.ENDING}', 1) END ELSE '/' || {seg} END AS template
  FROM t{k} LEFT JOIN k{k} USING (host, template)),"""
        p, q = pure("o.good", "o.bad").replace("hp", "o.hp"), pure("w.g", "w.b").replace("hp", "w.hp")
        w, v = f"(o.good + o.bad + {strength})", f"(w.g + w.b + {strength})"
        mid = f"(({p} * {w} + {q} * {v}) / ({w} + {v}))"
        far = f"{p} - {q} > 1.96::DOUBLE * sqrt(greatest({mid} * (1 - {mid}), 0) * (1 / {w} + 1 / {v}))"
        merge += rf"""
n{k} AS (SELECT host, branch, step, CASE WHEN starts_with(step, '*') THEN step ELSE '+' END AS kind, sum(good)::DOUBLE AS good, sum(bad)::DOUBLE AS bad, any_value(hp) AS hp
  FROM (SELECT *, steps[{k + 1}] AS step FROM b{k} WHERE len(steps) > {k}) GROUP BY host, branch, step),
o{k} AS (SELECT *, row_number() OVER (PARTITION BY host, branch, kind ORDER BY {pure("good", "bad")}, step) AS i FROM n{k} WHERE good + bad > 0),
w{k} AS (SELECT host, branch, kind, step, i, 0 AS n, good AS g, bad AS b, hp, good, bad FROM o{k} WHERE i = 1
  UNION ALL SELECT o.host, o.branch, o.kind, o.step, o.i, CASE WHEN {far} THEN w.n + 1 ELSE w.n END, CASE WHEN {far} THEN o.good ELSE w.g + o.good END, CASE WHEN {far} THEN o.bad ELSE w.b + o.bad END, o.hp, o.good, o.bad
  FROM w{k} w JOIN o{k} o ON o.host = w.host AND o.branch = w.branch AND o.kind = w.kind AND o.i = w.i + 1),
f{k} AS (SELECT host, branch, kind, n, abs({pure("sum(good)", "sum(bad)").replace("hp", "any_value(hp)")} - any_value(hp)) AS far FROM w{k} GROUP BY host, branch, kind, n),
c{k} AS (SELECT host, branch, kind, first(n ORDER BY far, n) AS n FROM f{k} GROUP BY host, branch, kind),
m{k} AS (SELECT host, branch, kind, step, n FROM w{k} UNION ALL SELECT x.host, x.branch, x.kind, x.step, coalesce(c.n, 0) FROM n{k} x LEFT JOIN c{k} c USING (host, branch, kind) WHERE x.good + x.bad = 0),
b{k + 1} AS (SELECT b.host, b.template, b.steps, b.good, b.bad, b.hp, b.branch || coalesce('/' || m.kind || '#' || m.n, '') AS branch FROM b{k} b LEFT JOIN m{k} m ON m.host = b.host AND m.branch = b.branch AND m.step = b.steps[{k + 1}]),"""
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT doc_id, bool_and(coalesce(quality = 1 AND toxic = 0, false)) AS good FROM labels GROUP BY doc_id),
y AS (SELECT page_id, bool_and(good) AS good FROM p JOIN g ON try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[./]|$)', 1) AS BIGINT) = doc_id GROUP BY page_id),
t0 AS (SELECT host, path, CASE WHEN len(list_filter(string_split(path, '/'), lambda x: x <> '')) > {depth} THEN error('a path is deeper than this SQL') ELSE list_filter(string_split(path, '/'), lambda x: x <> '') END AS segs, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad, '' AS template FROM p LEFT JOIN y USING (page_id) GROUP BY host, path),{grow}
l AS (SELECT host, template, sum(good)::DOUBLE AS good, sum(bad)::DOUBLE AS bad FROM t{depth} GROUP BY host, template),
prior AS (SELECT (sum(good) + 1.0::DOUBLE) / (sum(good) + sum(bad) + 2.0::DOUBLE) AS prior FROM l),
h AS (SELECT host, (sum(good) + {strength} * any_value(prior)) / (sum(good) + sum(bad) + {strength}) AS hp FROM l, prior GROUP BY host),
b0 AS (SELECT l.host, template, list_filter(string_split(template, '/'), lambda x: x <> '') AS steps, good, bad, hp, '' AS branch FROM l JOIN h USING (host)),{merge}
m AS (SELECT host, template, {pure("sum(good) OVER z", "sum(bad) OVER z")} AS purity FROM b{depth} WINDOW z AS (PARTITION BY host, branch)),
j AS (SELECT p.page_id, p.host, p.path, t.template, m.purity, list_filter({rules}, lambda r: (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))[1] AS r
  FROM p JOIN t{depth} t ON p.host = t.host AND p.path = t.path JOIN m ON m.host = t.host AND m.template = t.template)
SELECT page_id, host, path, r.h || r.p AS rule, coalesce(r.v, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM j"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_feistel_pii": op2_feistel_pii,
    "op3_url_templates": op3_url_templates,
    "op4_string_tiling": op4_string_tiling,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_gru_scores": op8_gru_scores,
    "op9_token_ids": op9_token_ids,
    "op10_mixing": op10_mixing,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {"op3_url_templates": _templates_sql(), "op5_quality_rules": _QUALITY_SQL, "op10_mixing": _MIX_SQL, "op11_filter_audit": _AUDIT_SQL, "op12_warc": _WARC_SQL}
