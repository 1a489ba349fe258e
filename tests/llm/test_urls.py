import collections
import math
import random
import re

import pytest

from filinglake.llm import queries as Q
from filinglake.llm import url_filters as U

SF = "/root/testdata/sf0.001"
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(pages, labels, max_children=12, strength=4.0, below=0.5):
    """The method with dictionaries: (page_id, host, path, rule, verdict, template, purity)."""
    paths = collections.Counter(split(u) for _, u in pages)
    segs = {hp: [s for s in hp[1].split("/") if s] for hp in paths}
    template = dict.fromkeys(paths, "")
    for level in range(max(map(len, segs.values()), default=0)):
        kids = collections.defaultdict(set)
        for hp, s in segs.items():
            if len(s) > level:
                kids[(hp[0], template[hp])].add(s[level])
        new = {}
        for hp, s in segs.items():
            t = template[hp]
            if len(s) > level:
                x = s[level]
                end = re.search(r"\.[A-Za-z0-9]{1,5}\Z", x)
                named = lambda y: re.fullmatch(r"(?:[0-9]+|[0-9a-fA-F-]{16,})(?:\.[A-Za-z0-9]{1,5})?", y)
                many = len(kids[(hp[0], t)]) > max_children
                endings = {(e := re.search(r"\.[A-Za-z0-9]{1,5}\Z", y)) and e[0] for y in kids[(hp[0], t)] if many or named(y)}
                t += "/*" + (end[0] if end and len(endings) <= max_children else "") if many or named(x) else "/" + x
            new[hp] = t
        template = new
    good, bad = collections.Counter(), collections.Counter()
    for i, u in pages:
        if i in labels:
            hp = split(u)
            (good if labels[i] else bad)[(hp[0], template[hp])] += 1
    leaves = {(hp[0], template[hp]) for hp in paths}
    purity = pure(leaves, good, bad, strength)
    out = []
    for i, u in pages:
        hp = split(u)
        r, v = rule(*hp)
        p = purity[(hp[0], template[hp])]
        out.append((i, *hp, r, v or ("block" if p < below else "allow"), template[hp], round(p, 6)))
    return out


def pure(leaves, good, bad, strength=4.0):
    """Purity of each (host, template) by recursion from the root of each host's tree."""
    prior = (sum(good.values()) + 1) / (sum(good.values()) + sum(bad.values()) + 2)
    purity = {}
    for h in {x[0] for x in leaves}:
        mine = [t for x, t in leaves if x == h]
        g, b = (sum(c[(h, t)] for t in mine) for c in (good, bad))
        hp = (g + strength * prior) / (g + b + strength)

        def descend(members, level):
            """``members``: templates of one merged branch, each with its steps."""
            here = [t for t, s in members if len(s) == level]
            g, b = (sum(c[(h, t)] for t in here) for c in (good, bad))
            for t in here:
                purity[(h, t)] = (g + strength * hp) / (g + b + strength)
            children = collections.defaultdict(list)
            for t, s in members:
                if len(s) > level:
                    children[s[level]].append((t, s))
            families = collections.defaultdict(list)
            for step, below in children.items():
                g, b = (sum(c[(h, t)] for t, _ in below) for c in (good, bad))
                families[step if step[0] == "*" else "+"].append(((g + strength * hp) / (g + b + strength), step, g, b, below))
            for members in families.values():
                runs = []  # [good, bad, members]
                for p, step, g, b, below in sorted(x[:5] for x in members if x[2] + x[3]):
                    if runs:
                        w, v = g + b + strength, runs[-1][0] + runs[-1][1] + strength
                        q = (runs[-1][0] + strength * hp) / v
                        pool = (p * w + q * v) / (w + v)
                    if not runs or p - q > 1.96 * math.sqrt(pool * (1 - pool) * (1 / w + 1 / v)):
                        runs.append([0, 0, []])
                    runs[-1][0] += g
                    runs[-1][1] += b
                    runs[-1][2].extend(below)
                runs = runs or [[0, 0, []]]
                nearest = min(runs, key=lambda r: abs((r[0] + strength * hp) / (r[0] + r[1] + strength) - hp))
                for p, step, g, b, below in members:
                    if not g + b:
                        nearest[2].extend(below)
                for r in runs:
                    descend(r[2], level + 1)

        descend([(t, [s for s in t.split("/") if s]) for t in mine], 0)
    return purity


def same(rows, want):
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 6)) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))


ODD = [None, "", "no scheme", "http://", "HTTP://Www.Example.NET/en/x", "https://example.net", "http://net/", "http://xnet/", "http://a.org/fr/1", "http://a.example.com/de/2?x=http://b/c", "x://h?q/p", "x://h#f", "a://b://c/d", "http://h/" + "a/" * 40, "http://é.example.com/DE/ü", "http://h/p\nq"]


def test_odd_urls(spark):
    pages = [(i, u) for i, u in enumerate(ODD)] + [(4, ODD[4]), (None, "http://n/x")]
    pages += [(100 + i, f"http://hot.example.io/{'good' if i % 2 else 'bad'}/{i * 7}") for i in range(60)]
    pages += [(300 + i, f"http://hot.example.io/user/name{chr(97 + i)}x.html") for i in range(20)]
    labels = {100 + i: bool(i % 2) for i in range(60)}
    df = spark.createDataFrame([(i, u, "t") for i, u in pages], "page_id long, url string, template string")
    ldf = spark.createDataFrame(list(labels.items()), "page_id long, good boolean")
    rows = U.judge(df, ldf).collect()
    same(rows, brute(pages, labels))
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[100] == "block" and verdict[101] == "allow"
    assert {r.template for r in rows if r.page_id and r.page_id >= 300} == {"/user/*.html"}
    assert U.judge(df.limit(0), ldf).count() == 0
    assert {r.verdict for r in U.judge(df, ldf.limit(0)).collect()} == {"allow", "block"}


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    lab = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    labels = {}
    for p in pages:
        m = re.search(r"/([0-9]{1,18})(?:[./]|$)", split(p.url)[1])
        if m and int(m[1]) in lab:
            labels[p.page_id] = lab[int(m[1])]
    same(Q.op3_url_templates(spark, SF).collect(), brute([(p.page_id, p.url) for p in pages], labels))


def test_an_unlabelled_template_does_not_bridge(spark):
    rows = [("h", f"/{t}", f"/{t}", 10, g, b) for t, g, b in (("bad", 0, 10), ("none", 0, 0), ("good", 10, 0))]
    steps = [("s", f"/t{i:02d}", f"/t{i:02d}", 40, 2 * i, 40 - 2 * i) for i in range(21)]
    tree = spark.createDataFrame(rows + steps, "host string, path string, template string, n long, good long, bad long")
    got = {r.template: r.purity for r in U.merged(tree).collect()}
    assert got["/bad"] < 0.5 < got["/good"]
    assert got["/t00"] < 0.3 and got["/t20"] > 0.7


def test_deep_urls_and_many_rules(spark):
    deep = "http://deep.example.io/" + "/".join(f"s{k}" for k in range(8))
    pages = [(1, deep), (2, deep + "/x"), (3, deep + "/y/1.html"), (4, "http://deep.example.io/s0/other")] + [(10 + k, f"http://h{k % 3}.r{k}.net/p{k}/q") for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, good boolean")
    rows = {r.page_id: r for r in U.judge(df, labels).collect()}
    assert rows[1].template == "/" + "/".join(f"s{k}" for k in range(8)) and rows[3].template.endswith("/s7/y/*.html")
    same(rows.values(), brute(pages, {}))
    rules = [("block", f"r{k}.net", f"/p{k}") for k in range(5000)] + [("allow", f"h1.r{k}.net", f"/p{k}/q") for k in range(5000)] + [("block", "example.io", "/s0/s1/"), ("allow", "io", "/")]
    for r in U.judge(df, labels, rules=rules).collect():
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fit, default=(0, None, r.verdict))
        assert (r.rule, r.verdict) == best[1:]


def test_branches_merge_under_their_parent_alone(spark):
    rows = [("h", f"/{a}/{b}", f"/{a}/{b}", 40, g, 40 - g) for a, b, g in (("x", "one", 38), ("x", "two", 36), ("y", "one", 3), ("y", "two", 1), ("z", "one", 37))]
    tree = spark.createDataFrame(rows, "host string, path string, template string, n long, good long, bad long")
    got = {r.template: round(r.purity, 9) for r in U.merged(tree).collect()}
    want = pure({(r[0], r[2]) for r in rows}, collections.Counter({(r[0], r[2]): r[4] for r in rows}), collections.Counter({(r[0], r[2]): r[5] for r in rows}))
    assert got == {t: round(p, 9) for (_, t), p in want.items()}
    assert got["/x/one"] == got["/z/one"] > 0.8 > 0.2 > got["/y/one"]


def made(seed):
    rng = random.Random(seed)
    seg = lambda d: rng.choice(["a", "b", "good", "bad", str(rng.randrange(99)), f"{rng.randrange(9)}.html", "deadbeefdeadbeef", f"n{rng.randrange(20)}.x{rng.randrange(20)}", f"u{rng.randrange(40)}.php"])
    pages = [(k, f"http://{rng.choice(['one.io', 'two.io', 'two.io', 'three.net'])}/" + "/".join(seg(d) for d in range(rng.choice([0, 1, 2, 3, 12])))) for k in range(500)]
    return pages, {k: ("good" in u) or rng.random() < 0.3 for k, u in pages if rng.random() < 0.7}


@pytest.mark.parametrize("most", [20_000, 0, 150])
def test_small_and_large_hosts_are_judged_alike(spark, monkeypatch, most):
    """Hosts in one task, level by level, and both; up to twelve segments deep."""
    monkeypatch.setattr(U, "HOST_PATHS", most)
    pages, labels = made(most)
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "page_id long, good boolean")).collect()
    same(rows, brute(pages, labels))
    assert len({r.purity for r in rows}) > 5


def test_endings_without_number_are_one(spark):
    pages = [(k, f"http://h.io/files/f{k}.e{k:x}") for k in range(300)] + [(1000 + k, f"http://h.io/few/f{k}.{'html' if k % 2 else 'pdf'}") for k in range(300)] + [(2000 + k, f"http://h.io/num/{k}.e{k:x}") for k in range(9)]
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, good boolean")).collect()
    same(rows, brute(pages, {}))
    assert {r.template for r in rows if r.page_id < 1000} == {"/files/*"} and {r.template for r in rows if 1000 <= r.page_id < 2000} == {"/few/*.html", "/few/*.pdf"}


def test_planted_meaning_decides_the_verdict(spark):
    rng = random.Random(4)
    pages = [(k, f"http://shop.io/{'spam' if k % 3 == 0 else 'text'}/{k}/item{k}.html") for k in range(900)]
    labels = [(k, (k % 3 != 0) != (rng.random() < 0.05)) for k, _ in pages if rng.random() < 0.4]
    rows = U.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good boolean")).collect()
    assert all(r.verdict == ("block" if r.page_id % 3 == 0 else "allow") for r in rows)


def test_tables_on_the_way_are_deleted(spark):
    from pathlib import Path

    from filinglake.session import shared_dir

    at = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in at.glob("url-*")}
    U.judge(spark.createDataFrame([(1, "http://h/a")], "page_id long, url string"), spark.createDataFrame([], "page_id long, good boolean")).collect()
    assert {p.name.rsplit("-", 1)[0] for p in at.glob("url-*") if p.name not in before} == {"url-rows", "url-judged"}
