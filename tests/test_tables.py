import random
import re
import time
from collections import Counter

import pytest

from filinglake.operators import dom
from filinglake.plans import catalogue, web


def table(*rows):
    cell = lambda x: x if x.startswith("<") else f"<td>{x}</td>"
    return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


@pytest.mark.parametrize(
    "html,want",
    [
        # a row whose places are all taken by spans from above begins at the left again, and the spans end above it
        (table(["<td rowspan=2>A</td>", "<td rowspan=2>B</td>", "<td rowspan=2>C</td>"], ["X", "Y", "Z"], ["1", "2", "3"], ["4", "5", "6"]), table(["A", "B", "C"], ["X", "Y", "Z"], ["1", "2", "3"], ["4", "5", "6"])),
        # of equally frequent widths the least is usual: the second row is too wide
        (table(["<td rowspan=2>A</td>", "B"], ["X", "Y"]), table(["A", "B"], ["X", "Y"])),
        # a span that reaches over two rows loses one of them
        (table(["<td rowspan=3>A</td>", "<td rowspan=2>B</td>"], ["X", "Y"], ["p"], ["1", "2"], ["3", "4"]), table(['<td rowspan="2">A</td>', "B"], ["X", "Y"], ["p"], ["1", "2"], ["3", "4"])),
        # a usual span stays
        (table(["<td rowspan=2>n</td>", "$", "1"], ["$", "2"], ["m", "$", "3"]), table(['<td rowspan="2">n</td>', "$1"], ["$2"], ["m", "$3"])),
        # own cells that span rows keep doing so where they are laid anew
        (table(["<td rowspan=2>A</td>", "<td rowspan=2>B</td>"], ["<td rowspan=2>X</td>", "Y"], ["z"], ["1", "2"], ["3", "4"]), table(["A", "B"], ['<td rowspan="2">X</td>', "Y"], ["z"], ["1", "2"], ["3", "4"])),
        # rows without text go, hard and zero-width blanks are none; cells inside cells are text
        (table(["a", "b"], ["​", "&nbsp;"], ["c", "<td><table><tr><td>d</td></tr></table></td>"]), table(["a", "b"], ["c", "d"])),
        # a heading over mark and number goes to the number; marks join their neighbours
        (table(["", "<th colspan=3>2020</th>"], ["Sales", "$", "12", ""], ["Loss", "(", "4", ")"]), table(["", "<th>2020</th>"], ["Sales", "$12"], ["Loss", "(4)"])),
        # columns that are always one cell are one column, and a span ends with the table
        (table(["a", "<td colspan=3>b</td>"], ["<td rowspan=9>c</td>", "<td colspan=3>d</td>"]), table(["a", "b"], ["c", "d"])),
        # texts as wide as a usual row over two columns stay whole where nothing stands alone below
        (table(["<td colspan=2>title</td>", "x"], ["<td colspan=2>more</td>", "y"]), table(["title", "x"], ["more", "y"])),
        ("<table></table>", "<table></table>"),
        ("no table", "<table></table>"),
    ],
)
def test_repair_goldens(html, want):
    assert dom.repair_table(html) == want


def test_repairing_twice_changes_nothing():
    rng = random.Random(2)
    for _ in range(300):
        rows = [[f"<td{rng.choice(['', '', ' colspan=2', ' rowspan=2'])}>{rng.choice(['', '$', '(', ')', 'ab', '12', '7'])}</td>" for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 5))]
        texts = Counter(re.sub(r"[^a-z0-9]", "", re.sub("<[^>]*>", "", "".join(map("".join, rows)))))
        once = dom.repair_table(table(*rows))
        assert Counter(re.sub(r"[^a-z0-9]", "", re.sub("<[^>]*>", "", once))) == texts, rows


def plain_repair(rows):
    """Link tables by hand: rows of (address, rows it spans, label, columns it spans) have two columns once their labels are one column each."""
    out, open_ = [], False
    for k, (href, tall, label, _) in enumerate(rows):
        tall = min(tall, len(rows) - k)
        cells = f'<td{f" rowspan={chr(34)}{tall}{chr(34)}" if tall > 1 else ""}>{href}</td><td>{label}</td>'
        out.append(f"<tr>{cells}</tr>")
    return "<table>" + "".join(out) + "</table>"


def test_tables_of_every_page(spark):
    sf = "/root/testdata/sf0.01"
    held = {r.page_id: r.html for r in web._page_tables(spark, sf).collect()}
    got = {r.page_id: r.html for r in catalogue.QUERIES["page_table_repair"](spark, sf).collect()}
    assert set(got) == set(held)
    checked = 0
    for i, html in held.items():
        want = [re.sub("<[^>]*>", "", c).strip() for c in re.findall("<td[^>]*>[^<]*</td>", html)]
        assert [re.sub("<[^>]*>", "", c) for c in re.findall("<td[^>]*>[^<]*</td>", got[i]) if c != "<td></td>"] == [w for w in want if w]
        if "rowspan" not in html:
            rows = re.findall('<td>([^<]*)</td><td colspan="(.)">([^<]*)</td>', html)
            assert got[i] == plain_repair([(h.strip(), 1, t.strip(), int(w)) for h, w, t in rows])
            checked += 1
    assert checked > 10 and any("rowspan" in h for h in held.values())


@pytest.mark.parametrize(
    "html",
    ["<div>" * 20_000 + "x", "<span>" * 20_000 + "x", "<b>" * 20_000 + "x", "<li>a" * 20_000, "<ol>" + "<li>a" * 20_000, "<table><tr><td>" * 4_000 + "x", "<table><tr><td>x</td></tr></table>" * 20_000, "<p align=center>12" * 20_000, "<b>" * 10_000 + "</i>" * 10_000, "<nav><a>" * 10_000, "<li><b>" * 2_000],
    ids=["div", "span", "b", "li", "ol", "tables-in-tables", "tables", "p", "stray-ends", "nav", "li-in-b"],
)
def test_pages_of_many_tags_take_seconds(html):
    began = time.process_time()
    dom.page_stats(html), dom.markdown(html), dom.sanitize(html), dom.filing_text(html)
    assert time.process_time() - began < 30  # some 2 s; the square of the tags took minutes
