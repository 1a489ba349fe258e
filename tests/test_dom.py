import pytest

from filinglake.operators import dom, sites, tagging


def test_markdown():
    html = "<html><head><title>t</title><style>x</style></head><body><h2>Head</h2><p>One <b>bold</b> and <a href='/x'>link</a><img src=a></p><ul><li>a<li>b<ul><li>c</ul></ul><ol><li>x</li><li>y</li></ol><table><tr><td>1<td>2</table><script>s</script></body></html>"
    assert dom.markdown(html) == "## Head\n\nOne **bold** and [link](/x)\n\n  * a\n  * b\n\n    * c\n\n  1. x\n  2. y\n\n1 | 2"


def test_stats():
    html = (
        '<html><head><meta name="ROBOTS" content="noindex"><meta property="og:url" content="https://e.com/x"><link rel="canonical" href="https://e.com/x"><link rel="stylesheet" href="https://cdn.io/a.css">'
        '<style>@media print{p{a:b}} b{c:d}</style><script src="https://cdn.io/x.js"></script><script type="application/ld+json">[{"@type":["A","B"]},{"@type":"A"}]</script></head>'
        '<body><nav><ul><li><a href="/a">a</a><ul><li><a href="//e">b</a></ul></ul></nav><h1>T</h1><form><input type=submit><button>x</button></form><img alt="q"><img><a href="https://o.org/">o</a></body></html>'
    )
    s = dom.page_stats(html)
    assert len(s) == 53 == len(dom.STAT_FIELDS) and set(s) == {n for n, _ in dom.STAT_FIELDS}
    assert (s["nav_link_count"], s["nav_depth_levels"], s["total_link_count"], s["internal_link_ratio"]) == (2, 2, 3, 0.6667)
    assert (s["input_count"], s["button_count"], s["alt_text_coverage"], s["json_ld_type_count"]) == (1, 2, 0.5, 2)
    assert (s["unique_external_domains"], s["media_query_count"], s["css_rule_count"], s["robots_meta_content"]) == (1, 1, 2, "noindex")
    assert (s["heading_count"], s["external_script_count"], s["inline_script_count"], s["stylesheet_count"]) == (1, 1, 1, 1)
    assert s["max_dom_depth"] >= 6 and s["open_graph_tag_count"] == 1 and s["canonical_tag_present"]


@pytest.mark.parametrize("html", ["", "plain", "<", "<p", "</div>", "<table><tr><td>", "<!DOCTYPE html>", "<div>" * 500])
def test_odd_html_does_not_break(html):
    dom.page_stats(html), dom.sanitize(html), dom.filing_text(html), dom.table_grid(html), dom.repair_table(html)
    if html.count("<div>") < 200:
        dom.markdown(html)


def test_grid():
    html = "<table><tr><td colspan=2>a</td><td rowspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><th>e</th><td></td><td>f</td></tr></table>"
    assert dom.table_grid(html) == [[(0, "a"), (2, "b")], [(0, "c"), (1, "d")], [(0, "e"), (1, ""), (2, "f")]]


def test_repair():
    html = "<table><tr><th>Item</th><th></th><th colspan=3>2020</th></tr><tr><td>Sales</td><td></td><td>$ (</td><td>12</td><td>)</td></tr><tr><td>Cost</td><td></td><td>$</td><td>3</td><td>%</td></tr></table>"
    assert dom.repair_table(html) == "<table><tr><th>Item</th><th>2020</th></tr><tr><td>Sales</td><td>$ (12)</td></tr><tr><td>Cost</td><td>$3%</td></tr></table>"
    assert dom.repair_table("<table><tr><td colspan=2>a</td></tr><tr><td colspan=2>b</td></tr></table>") == "<table><tr><td>a</td></tr><tr><td>b</td></tr></table>"


def test_sanitize():
    html = "<?xml version='1.0'?><html><body><div style='display:none'>gone</div><table><tr><td>only</td></tr></table><ix:nonNumeric name='x'><span>text</span></ix:nonNumeric><p class=a> </p><div><div><p id=q>kept\xa0 here</p></div></div><table><tr><td colspan=2>x</td><td>y</td></tr></table></body></html>"
    out = dom.sanitize(html)
    assert "gone" not in out and "<span" not in out and "class" not in out and "<div>" not in out and "ix:" not in out
    assert out.count("<table>") == 1 and 'colspan="2"' in out and "kept here" in out and "<p>\n" in out


def test_filing_text():
    rows = "".join(f"<tr><td>r{i}</td><td>{i}1,000</td><td>22{i}</td></tr>" for i in range(7))
    text, tables = dom.filing_text(f"<body><p align=center>12</p><p>Table of Contents</p><p>Hello<a>x</a></p><table>{rows}</table><table><tr><td>lay</td></tr></table></body>")
    assert text == "Hello\n\nGLMTABLE0GLMTABLE\nlay" and len(tables) == 1
    assert dom.splice_tables(text, tables).count("<table>") == 1 and dom.splice_tables("GLMTABLE7GLMTABLE", []) == ""


@pytest.mark.parametrize(
    "kind,text,want",
    [
        ("all", "in 2017 1,234.50 of 5.00", "in <number>2017</number> <number>1234.5</number> of <number>5</number>"),
        ("all", "<number>12</number> '7' 1.2.3", "<number>12</number> '7' 1.2.3"),
        ("ocr", "-1,200 x5 5.00 3.", "<number>-1200</number> x5 <number>5.0</number> <number>3</number>."),
        ("filing", "1,000 and (532) in 2017 (2017) 12345", "<number>1000</number> and <number>-532</number> in 2017 (2017) <number>12345</number>"),
        ("filing", "| 12 | **5** | 30th | 1999 |", "| <number>12</number> | **<number>5</number>** | 30th | 1999 |"),
        ("filing", "**£5.8 %** <td 99999> (12) 12", "**£<number>5.8</number> %** <td 99999> <number>-12</number> 12"),
    ],
)
def test_taggers(kind, text, want):
    assert tagging.tag(text, kind) == want


def test_tagging_all_twice_changes_nothing():
    t = tagging.tag("a 1,234 b 5.250 c", "all")
    assert tagging.tag(t, "all") == t


def test_added_lines():
    assert sites.diff_added("a\nb\nc", "a\nx\nc\ny") == "x\ny"
    assert sites.diff_added("a", "a") == "" and sites.diff_added("", "++lost\nkept") == "kept"


def test_plain_markup_parses_like_any_other():
    import random

    def shape(root):
        return [(n.name, n.attrs, n.text, d) for n, d in root.walk()]

    def slow(html):
        b = dom._Builder()
        b.feed(html)
        b.close()
        return b.root

    draw = random.Random(5)
    bits = ["<table>", "</table>", "<tr>", "</tr>", '<td colspan="2">', "<td rowspan='3' x-y=a1>", "<th colspan=2>", "</td>", "<li>", "<p>", "</p>", "<br>", "<b>", "</b>", "<div class=''>", "$ (12)", " a\n\xa0b ", "x > y", "<a href=\"/u v\" href='w'>", "</a>"]
    odd = ["<script>", "</script>", "<td", "&amp;", "a < b", "<TD>", "<br/>", "<!-- x -->", "<p >", "<title>", "<![CDATA[", "</td x>", "<a b>"]
    plain = 0
    for k in range(3000):
        html = "".join(draw.choice(bits + odd * (k % 2)) for _ in range(draw.randrange(12)))
        plain += dom._plain(html) is not None
        assert shape(dom.parse(html)) == shape(slow(html)), html
    assert 1500 <= plain < 3000


def test_an_order_table_takes_few_calls():
    import cProfile
    import pstats

    html = "<table><tr><th colspan=2>Total</th><th>$</th></tr><tr><td rowspan='2'>7</td><td>$ (12)</td><td>) %</td></tr><tr><td>1.5</td></tr></table>"
    calls = []
    for f in (dom.table_grid, dom.repair_table):
        p = cProfile.Profile()
        p.runcall(f, html)
        calls.append(pstats.Stats(p).total_calls)
    assert calls[0] < 600 and calls[1] < 1000
