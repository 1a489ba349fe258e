"""HTML by the standard library's parser: a small tree, its figures, markdown, clean-up and tables.

The tree is lenient: void tags have no children, an open tag is closed by its
parent's end, and list items, cells, rows and paragraphs close their like.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"div", "td", "th", "li", "body", "article", "section", "b"}}


class Node:
    """An element, or with ``name`` None a text in ``text``."""

    __slots__ = ("name", "attrs", "kids", "parent", "text")

    def __init__(self, name, attrs=None, parent=None, text=""):
        self.name, self.attrs, self.kids, self.parent, self.text = name, attrs or {}, [], parent, text

    def walk(self, depth: int = 0) -> Iterator[tuple[Node, int]]:
        stack = [(self, depth)]
        while stack:
            node, d = stack.pop()
            yield node, d
            stack.extend((k, d + 1) for k in reversed(node.kids))

    def _all(self) -> Iterator[Node]:
        """This node and all in it, in order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.kids:
                stack.extend(reversed(node.kids))

    def find(self, *names: str) -> list[Node]:
        return [n for n in self._all() if n.name in names]

    def content(self) -> str:
        if len(self.kids) == 1 and self.kids[0].name is None and self.name is not None:
            return self.kids[0].text
        return "".join([n.text for n in self._all() if n.name is None])

    def html(self) -> str:
        if self.name is None:
            return self.text if self.parent is not None and self.parent.name in ("script", "style") else escape(self.text, quote=False)
        out: list[str] = []
        todo: list = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.name is None:
                raw = n.parent is not None and n.parent.name in ("script", "style")
                out.append(n.text if raw else escape(n.text, quote=False))
            else:
                head = "".join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items())
                if n.name != "[document]":
                    out.append(f"<{n.name}{head}>")
                    if n.name not in VOID:
                        todo.append(f"</{n.name}>")
                todo.extend(reversed(n.kids))
        return "".join(out)

    def outermost(self, name: str, barrier: tuple[str, ...]) -> list[Node]:
        """Elements of a name below this one, in order, that are not inside one of ``barrier``."""
        out, todo = [], list(reversed(self.kids))
        while todo:
            n = todo.pop()
            if n.name == name:
                out.append(n)
            if n.name not in barrier:
                todo.extend(reversed(n.kids))
        return out

    def become_text(self, text: str) -> None:
        """This element and all in it give way to a text."""
        self.name, self.attrs, self.kids, self.text = None, {}, [], text


class _Builder(HTMLParser):
    """Open elements are a stack, with the depths at which each name is open, so that no tag searches its ancestors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]")
        self.open = [self.root]
        self.depths: dict[str, list[int]] = {}

    def _deepest(self, names) -> int:
        most = 0
        for n in names:
            if (held := self.depths.get(n)) and held[-1] > most:
                most = held[-1]
        return most

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.open.pop().name].pop()

    def handle_starttag(self, tag, attrs):
        if closes := CLOSES.get(tag):
            fence = self._deepest(FENCE.get(tag, ()))
            while (at := self._deepest(closes)) > fence:
                name = self.open[at].name
                self._close(at)
                if tag != "tr" or name == "tr":
                    break
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if at := self._deepest((tag,)):
            self._close(at)

    @property
    def at(self) -> Node:
        return self.open[-1]

    def handle_data(self, data):
        self.at.kids.append(Node(None, parent=self.at, text=data))

    def handle_decl(self, decl):
        self.at.kids.append(Node(None, parent=self.at, text=""))


def fold(root: Node, f: Callable[[Node, list], object]):
    """``f`` of the root and the results of its children, from the leaves up; a tree of any depth needs no deeper stack."""
    done: dict[int, object] = {}
    for n, _ in reversed(list(root.walk())):
        done[id(n)] = f(n, [done.pop(id(k)) for k in n.kids])
    return done[id(root)]


#: Tags and texts that need no care: lower-case names, attributes with values, no character references.
PLAIN = re.compile(r"""</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?: +[a-z][a-z-]*=(?:"[^"&<>]*"|'[^'&<>]*'|[A-Za-z0-9]+))*)>|([^<&]+)""")
PLAIN_ATTR = re.compile(r""" +([a-z-]+)=(?:"([^"]*)"|'([^']*)'|([A-Za-z0-9]+))""")
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


def _plain(html: str) -> list[tuple] | None:
    """(closed, opened, attributes, text) of the tags and texts of plain markup, all but one of them empty; None if there is any other."""
    out, at = [], 0
    for m in PLAIN.finditer(html):
        if m.start() != at or m[2] in RAW:
            return None
        at = m.end()
        out.append(m.groups())
    return out if at == len(html) else None


def parse(html: str) -> Node:
    b = _Builder()
    if (found := _plain(html)) is None:
        b.feed(html)
        b.close()
        return b.root
    for closed, opened, attrs, text in found:
        if text is not None:
            b.handle_data(text)
        elif closed is not None:
            b.handle_endtag(closed)
        else:
            b.handle_starttag(opened, [(k, q or s or v or "") for k, q, s, v in PLAIN_ATTR.findall(attrs)] if attrs else ())
    return b.root


# ---- figures -----------------------------------------------------------------------------------------------------

#: Fixed values, the output schema; (name, kind): l long, d double, b boolean, s string, m map.
STAT_FIELDS = tuple(
    (n, k)
    for k, names in (
        ("l", "total_node_count total_element_count max_dom_depth max_children_count document_byte_size inner_text_length inner_html_length unique_tag_count table_element_count list_element_count heading_count form_count input_count button_count iframe_count image_count svg_count video_count canvas_count external_script_count inline_script_count total_script_byte_size stylesheet_count unique_external_domains inline_style_count total_css_byte_size media_query_count css_rule_count json_ld_type_count meta_tag_count open_graph_tag_count aria_attribute_count role_attribute_count tabindex_count nav_link_count total_link_count footer_link_count nav_depth_levels largest_image_bytes total_image_bytes"),
        ("d", "mean_dom_depth std_dom_depth mean_children_count html_to_text_ratio tag_entropy semantic_tag_ratio interactive_density alt_text_coverage internal_link_ratio"),
        ("b", "has_json_ld canonical_tag_present"),
        ("s", "robots_meta_content"),
        ("m", "heading_distribution"),
    )
    for n in names.split()
)
MAXIMA = frozenset(("max_dom_depth", "max_children_count", "nav_depth_levels", "unique_tag_count", "unique_external_domains"))
#: Ratios taken anew when pages are merged: (numerator, denominator).
RATIOS = {"html_to_text_ratio": (("inner_html_length",), "inner_text_length"), "interactive_density": (("input_count", "button_count", "form_count", "iframe_count"), "total_element_count")}
#: Means weighted by another figure when pages are merged.
WEIGHTED = {"semantic_tag_ratio": "total_element_count", "internal_link_ratio": "total_link_count", "alt_text_coverage": "image_count", "tag_entropy": "total_element_count"}

SEMANTIC = ("article", "section", "nav", "header", "footer", "main", "aside", "figure")


def _size(s: str) -> int:
    return len(s.encode("utf-8", "replace"))


def _base_domain(root: Node) -> str:
    links = [n.attrs.get("href") for n in root.find("link") if "canonical" in (n.attrs.get("rel") or "")]
    og = [n.attrs.get("content") for n in root.find("meta") if n.attrs.get("property") == "og:url"]
    for u in (*links, *og, *(n.attrs.get("href") for n in root.find("base"))):
        if u and urlsplit(u).netloc:
            return urlsplit(u).netloc
    return ""


def _json_types(root: Node) -> tuple[int, set]:
    n, types = 0, set()
    for s in root.find("script"):
        if s.attrs.get("type") != "application/ld+json":
            continue
        n += 1
        try:
            held = json.loads(s.content())
        except ValueError:
            continue
        for item in held if isinstance(held, list) else [held]:
            t = item.get("@type") if isinstance(item, dict) else None
            types.update(t if isinstance(t, list) else [t] if t else [])
    return n, {str(t) for t in types}


def _links_inside(root: Node) -> dict[str, int]:
    """Links in navigation and in footers; a link counts once for each of them that holds it."""
    out = {"nav": 0, "footer": 0}
    todo = [(root, 0, 0)]
    while todo:
        n, nav, footer = todo.pop()
        if n.name == "a":
            out["nav"] += nav
            out["footer"] += footer
        nav, footer = nav + (n.name == "nav"), footer + (n.name == "footer")
        todo.extend((k, nav, footer) for k in n.kids)
    return out


def page_stats(html: str) -> dict:
    """Structure, content and metadata figures of one page."""
    root = parse(html)
    nodes = list(root.walk())
    tags = [n for n, _ in nodes if n.name is not None]
    named = [n for n in tags if n.parent is not None]
    count = Counter(n.name for n in named)
    leaves = [d for n, d in nodes if n.name is None or not n.kids]
    mean = sum(leaves) / len(leaves) if leaves else 0.0
    kids = [sum(k.name is not None for k in n.kids) for n in tags]
    body = (root.find("body") or [root])[0]
    text, inner = body.content(), "".join(k.html() for k in body.kids)
    total = len(named) or 1
    base = _base_domain(root)
    links = [n for n in named if n.name == "a"]
    hrefs = [n.attrs.get("href") or "" for n in links if "href" in n.attrs]
    inside = sum(h == "" or h[0] in "#/" or bool(base and base in urlsplit(h).netloc) for h in hrefs)
    scripts, styles = root.find("script"), "".join(n.content() for n in root.find("style"))
    refs = [n.attrs.get("src") for n in root.find("script", "iframe")] + [n.attrs.get("href") for n in root.find("link")]
    outside = {urlsplit(r).netloc for r in refs if r and r.startswith("http")} - {base, ""}
    inputs = count["input"] + count["select"] + count["textarea"]
    buttons = count["button"] + sum(n.name == "input" and (n.attrs.get("type") or "").lower() == "submit" for n in named)
    images = root.find("img")
    n_json, types = _json_types(root)
    heads = {f"h{i}": count[f"h{i}"] for i in range(1, 7)}
    linked = _links_inside(root)
    robots = [n.attrs.get("content") for n in root.find("meta") if (n.attrs.get("name") or "").lower() == "robots"]

    def nesting(n: Node, below: list[int]) -> int:
        return (n.name in ("ul", "ol")) + max(below, default=0)

    has = lambda a: sum(a in n.attrs for n in named)
    at_rules = len(re.findall(r"@[a-z-]+[^{;]*\{", styles))
    return {
        "total_node_count": len(nodes), "total_element_count": len(tags), "max_dom_depth": max(leaves, default=0), "mean_dom_depth": round(mean, 3),
        "std_dom_depth": round(math.sqrt(sum((d - mean) ** 2 for d in leaves) / len(leaves)), 3) if len(leaves) > 1 else 0.0,
        "max_children_count": max(kids, default=0), "mean_children_count": round(sum(kids) / len(kids), 3) if kids else 0.0, "document_byte_size": _size(html), "inner_text_length": len(text), "inner_html_length": len(inner),
        "html_to_text_ratio": round(len(inner) / len(text), 4) if text else 0.0, "tag_entropy": round(-sum(c / total * math.log2(c / total) for c in count.values()), 4) if count else 0.0, "unique_tag_count": len(count),
        "semantic_tag_ratio": round(sum(count[t] for t in SEMANTIC) / total, 4), "table_element_count": sum(count[t] for t in ("table", "tr", "td", "th")), "list_element_count": sum(count[t] for t in ("ul", "ol", "li")),
        "heading_count": sum(heads.values()), "heading_distribution": heads, "form_count": count["form"], "input_count": inputs, "button_count": buttons, "iframe_count": count["iframe"],
        "interactive_density": round((inputs + buttons + count["form"] + count["iframe"]) / len(tags), 4), "image_count": len(images), "svg_count": count["svg"], "video_count": count["video"], "canvas_count": count["canvas"], "largest_image_bytes": None, "total_image_bytes": None,
        "external_script_count": sum("src" in n.attrs for n in scripts), "inline_script_count": sum("src" not in n.attrs for n in scripts), "total_script_byte_size": sum(_size(n.content()) for n in scripts if "src" not in n.attrs),
        "stylesheet_count": sum("stylesheet" in (n.attrs.get("rel") or "") for n in root.find("link")), "unique_external_domains": len(outside), "inline_style_count": has("style"), "total_css_byte_size": _size(styles),
        "media_query_count": len(re.findall(r"@media\s", styles)), "css_rule_count": max(0, styles.count("{") - at_rules), "has_json_ld": n_json > 0, "json_ld_type_count": len(types), "meta_tag_count": count["meta"],
        "open_graph_tag_count": sum((n.attrs.get("property") or "").startswith("og:") for n in root.find("meta")), "canonical_tag_present": any("canonical" in (n.attrs.get("rel") or "") for n in root.find("link")), "robots_meta_content": robots[0] if robots else None,
        "aria_attribute_count": sum(any(a.startswith("aria-") for a in n.attrs) for n in named), "alt_text_coverage": round(sum(bool((n.attrs.get("alt") or "").strip()) for n in images) / len(images), 4) if images else None,
        "role_attribute_count": has("role"), "tabindex_count": has("tabindex"), "nav_link_count": linked["nav"], "total_link_count": len(links), "footer_link_count": linked["footer"],
        "internal_link_ratio": round(inside / len(hrefs), 4) if hrefs else 0.0, "nav_depth_levels": max((fold(n, nesting) for n in root.outermost("nav", ("nav",))), default=0),
    }


# ---- markdown ----------------------------------------------------------------------------------------------------

BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figure footer form header html li main nav ol p pre section table tbody td tfoot th thead tr ul h1 h2 h3 h4 h5 h6".split())
UNSEEN = frozenset("script style head noscript template title".split())


EMPHASIS = {"b": "**", "strong": "**", "i": "_", "em": "_"}
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}


MOST_MARKS = 100  # emphasis inside so many others adds no marks


def _marks(root: Node) -> dict[int, str]:
    """By node, what stands before a list item (indent by the lists around it, and a star or its number) or around emphasis."""
    marks: dict[int, str] = {}
    todo = [(root, -1, 0)]
    while todo:
        n, depth, strong = todo.pop()
        depth += n.name in ("ul", "ol")
        if n.name in EMPHASIS:
            strong += 1
            marks[id(n)] = EMPHASIS[n.name] if strong <= MOST_MARKS else ""
        number = 0
        for k in n.kids:
            if k.name == "li":
                number += 1
                marks[id(k)] = "  " * (max(depth, 0) + 1) + (f"{number}." if n.name == "ol" else "*")
            todo.append((k, depth, strong))
    return marks


def markdown(html: str) -> str:
    """Text with headings, lists, links, emphasis and tables; images and scripts go; lines are not wrapped."""
    root = parse(html)
    marks = _marks(root)

    def inline(n: Node, below: list[str]) -> str:
        if n.name is None:
            return re.sub(r"\s+", " ", n.text)
        if n.name in UNSEEN or n.name == "img":
            return ""
        if n.name == "br":
            return "  \n"
        if n.name == "hr":
            return "\n\n* * *\n\n"
        body = "".join(below)
        if n.name in EMPHASIS:
            mark, core = marks[id(n)], body.strip() if marks[id(n)] else ""
            return f"{mark}{core}{mark}" if core and "\n\n" not in core else body
        if n.name == "a":
            core = body.strip() if n.attrs.get("href") else ""
            return f"[{core}]({n.attrs['href']})" if core else body
        if n.name in HEADINGS:
            core = body.strip()
            return f"\n\n{HEADINGS[n.name]} {core}\n\n" if core else ""
        if n.name == "li":
            return f"\n{marks[id(n)]} {body.strip()}"
        if n.name == "tr":
            return "\n" + " | ".join(s.strip() for c, s in zip(n.kids, below) if c.name in ("td", "th"))
        if n.name in BLOCKS:
            return body if body.startswith("\n\n") and body.endswith("\n\n") and body.strip() else f"\n\n{body}\n\n"
        return body

    out = re.sub(r"[ \t]+\n", lambda m: "  \n" if m[0].startswith("  ") else "\n", fold(root, inline))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


# ---- clean-up of filings -----------------------------------------------------------------------------------------

KEEP_ATTRS = ("colspan", "rowspan", "href")
STAND_ALONE = frozenset(("br", "hr", "img", "input"))
BLOCK_TAGS = frozenset("p div table ul ol h1 h2 h3 h4 h5 h6 section article blockquote".split())


def _int(v) -> int:
    return int(v) if v and re.fullmatch(r"\s*\d+\s*", v) else 1


def _joined(lists: list[list]) -> list:
    """One list of several; a single one is handed on as it is, so that wrappers cost nothing however deep they are."""
    lists = [x for x in lists if x]
    return lists[0] if len(lists) == 1 else [n for x in lists for n in x]


def _bare(n: Node, below: list[list[Node]]) -> list[Node]:
    """What is left of an element without styles, hidden parts, inline markup, attributes, and elements without content."""
    if n.name is None:
        return [n] if n.text.strip() else []
    if n.parent is not None and (n.name in ("style", "script", "ix:header") or re.search(r"display\s*:\s*none", n.attrs.get("style") or "", re.I)):
        return []
    kids = _joined(below)
    if n.parent is not None and (n.name in ("span", "font") or n.name.startswith("ix:")):
        return kids
    n.attrs = {k: v for k, v in n.attrs.items() if k in KEEP_ATTRS}
    n.kids = kids
    return [n] if kids or n.name in STAND_ALONE or n.parent is None else []


def _flat(n: Node, below: list[tuple[list[Node], int, bool]]) -> tuple[list[Node], int, bool]:
    """(what stands for an element without layout tables and lone wrappers, table rows in it, whether all of them are layout).

    A layout table has rows of at most one cell each, no header cells and no cells over several columns. It gives way
    to the contents of its cells.
    """
    if n.name is None:
        return [n], 0, True
    n.kids, rows, plain = _joined([b[0] for b in below]), sum(b[1] for b in below), all(b[2] for b in below)
    if n.name == "tr":
        cells = [c for c in n.kids if c.name in ("td", "th")]
        rows, plain = rows + 1, plain and len(cells) < 2 and all(c.name == "td" and _int(c.attrs.get("colspan")) < 2 for c in cells)
    if n.name == "table" and rows and plain:
        out: list[Node] = []
        for cell in n.outermost("td", ("td",)):
            if all(k.name in BLOCK_TAGS for k in cell.kids):
                out += cell.kids
            else:
                p = Node("p")
                p.kids = cell.kids
                out.append(p)
        return out, 0, True
    if n.parent is not None and n.name not in STAND_ALONE and not n.kids:
        return [], rows, plain
    only = n.kids[0].name if len(n.kids) == 1 else None
    lone = n.parent is not None and only is not None and n.name in (only, "div")
    return n.kids if lone else [n], rows, plain


def sanitize(html: str) -> str:
    """Body without styles, hidden parts, inline markup, attributes, empty elements, layout tables and lone wrappers; two folds from the leaves up."""
    root = parse(re.sub(r"<\?xml[^?]*\?>", "", html))
    root = (root.find("body") or [root])[0]
    root.parent = None
    fold(root, _bare)
    fold(root, _flat)
    return normalize(prettify(root))


def prettify(root: Node) -> str:
    """A line for every tag and text, indented by depth."""
    out: list[str] = []

    todo: list[tuple[Node | str, int]] = [(root, 0)]
    while todo:
        n, d = todo.pop()
        if isinstance(n, str):
            out.append(" " * d + n)
        elif n.name is None:
            if n.text.strip():
                out.append(" " * d + escape(re.sub(r"\s+", " ", n.text.strip()), quote=False))
        else:
            inner = d
            if n.name != "[document]":
                head = "".join(f' {k}="{escape(v or "")}"' for k, v in n.attrs.items())
                out.append(" " * d + f"<{n.name}{head}>")
                inner = d + 1
                if n.name not in VOID:
                    todo.append((f"</{n.name}>", d))
            todo.extend((k, inner) for k in reversed(n.kids))
    return "\n".join(out)


def normalize(text: str) -> str:
    """Hard spaces to spaces, runs of blanks inside lines to one, at most one blank line."""
    text = re.sub(r"&#160;|&nbsp;|\xa0", " ", text, flags=re.I)
    text = re.sub(r"(?<=[^ \t\n])[ \t]+", " ", text)
    text = re.sub(r"\n[ \t]+(?=\n)", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# ---- tables ------------------------------------------------------------------------------------------------------


def table_grid(html: str) -> list[list[tuple[int, str]]]:
    """Rows of (column, inner html): each cell at the column that earlier spans leave free."""
    taken: set[tuple[int, int]] = set()
    out = []
    for r, tr in enumerate(parse(html).find("tr")):
        row, c = [], 0
        for cell in (k for k in tr.kids if k.name in ("td", "th")):
            while (r, c) in taken:
                c += 1
            row.append((c, "".join([k.html() for k in cell.kids]).strip()))
            w, h = _int(cell.attrs.get("colspan")), _int(cell.attrs.get("rowspan"))
            if h != 1:  # only rows below ask
                taken.update((r + y, c + x) for y in range(1, h) for x in range(w))
            c += w
        out.append(row)
    return out


OPENERS = re.compile(r"[$£€(\s]+")
CLOSERS = re.compile(r"[)%\s]+")
UNSEEN_BLANKS = re.compile("[\u200b\u200c\u200d\ufeff\u00a0]")


class _Cell:
    """A cell with its text, tag and the rows and columns that it spans."""

    __slots__ = ("name", "text", "wide", "tall", "row")

    def __init__(self, name: str, text: str, wide: int, tall: int, row: int):
        self.name, self.text, self.wide, self.tall, self.row = name, text, wide, tall, row

    def html(self) -> str:
        spans = "".join(f' {k}="{v}"' for k, v in (("colspan", self.wide), ("rowspan", self.tall)) if v > 1)
        return f"<{self.name}{spans}>{escape(self.text, quote=False)}</{self.name}>"


def _shown(n: Node) -> str:
    return UNSEEN_BLANKS.sub(" ", n.content()).strip()


def _lay(cells: list[_Cell], row: list) -> None:
    """Put a row's own cells into the places that are free in it, from the left."""
    at = 0
    for cell in cells:
        while at < len(row) and row[at] is not None:
            at += 1
        row.extend([None] * (at + cell.wide - len(row)))
        row[at : at + cell.wide] = [cell] * cell.wide


def _grid(own: list[list[_Cell]], usual: int | None = None) -> list[list]:
    """The cell at each place of each row, spans filled in.

    With a usual width, a row that would be wider begins at the left, and the spans that reach into it from above lose a row.
    """
    rows: list[list] = [[] for _ in own]
    for r, cells in enumerate(own):
        row = list(rows[r])
        _lay(cells, row)
        if usual is not None and len(row) > usual:
            for cell in {id(c): c for c in rows[r] if c is not None}.values():
                cell.tall = max(1, cell.tall - 1)
            row = []
            _lay(cells, row)
        rows[r] = row
        for at, cell in enumerate(row):
            if cell is not None and cell.row == r:
                for below in rows[r + 1 : r + cell.tall]:
                    below.extend([None] * (at + 1 - len(below)))
                    below[at] = cell
    return rows


def repair_table(html: str) -> str:
    """The same content in fewer cells: rows without text go, rows pushed aside by spans come back, needless columns go, marks stand beside their numbers.

    A row wider than the most frequent width (the least of several) is laid anew from the left and the row spans that reach into
    it are shortened by one. Columns that always belong to one cell are one column. A cell that still spans columns in
    which other rows have content of their own is split; its text goes to the sub-column that has most of that, the rightmost on a
    tie. Columns without text go; columns of opening or closing marks alone join their right or left neighbour. Spans end with the table.
    """
    trs = [tr for tr in parse(html).outermost("tr", ("td", "th")) if _shown(tr)]
    own = [[_Cell(c.name, _shown(c), min(_int(c.attrs.get("colspan")) or 1, 1000), min(_int(c.attrs.get("rowspan")) or 1, len(trs) - r), r) for c in tr.kids if c.name in ("td", "th")] for r, tr in enumerate(trs)]
    widths = Counter(map(len, _grid(own)))
    rows = _grid(own, min(widths, key=lambda w: (-widths[w], w), default=0))
    width = max(map(len, rows), default=0)
    columns = [[row[k] if k < len(row) else None for row in rows] for k in range(width)]

    def drop(k: int) -> None:
        for cell in {id(c): c for c in columns[k] if c is not None}.values():
            cell.wide -= 1
        del columns[k]

    for k in range(width - 1, 0, -1):
        if all(a is b for a, b in zip(columns[k], columns[k - 1])):
            drop(k)
    _split(columns)

    def only(k: int, shape: re.Pattern | None) -> bool:
        """Whether a column has nothing but blanks, texts of a shape and cells that span columns."""
        return all(c is None or not c.text or c.wide > 1 or bool(shape and shape.fullmatch(c.text)) for c in columns[k])

    def join(k: int, to: int, put: Callable[[str, str], str]) -> None:
        done = set()
        for mark, cell in zip(columns[k], columns[to]):
            if mark is not None and cell is not None and mark is not cell and mark.wide == 1 and mark.text and (id(mark), id(cell)) not in done:
                done.add((id(mark), id(cell)))
                cell.text = put(cell.text, mark.text)
        drop(k)

    for k in range(len(columns) - 1, -1, -1):
        if only(k, None):
            drop(k)
    for k in range(len(columns) - 2, -1, -1):
        if only(k, OPENERS):
            join(k, k + 1, lambda text, mark: mark + text)
    for k in range(len(columns) - 1, 0, -1):
        if only(k, CLOSERS):
            join(k, k - 1, lambda text, mark: text + mark)
    return "<table>" + "".join(f"<tr>{''.join(c.html() for c in _in_order(columns, r))}</tr>" for r in range(len(rows))) + "</table>"


def _in_order(columns: list[list], r: int) -> list[_Cell]:
    """The cells that begin in a row, from left to right."""
    return list({id(col[r]): col[r] for col in columns if col[r] is not None and col[r].row == r}.values())


def _split(columns: list[list]) -> None:
    """Split the cells that span columns where others stand alone; the text goes where most of those have content."""
    height = len(columns[0]) if columns else 0
    alone = [sum(c is not None and c.row == r and c.wide == 1 and bool(c.text) and not OPENERS.fullmatch(c.text) and not CLOSERS.fullmatch(c.text) for r, c in enumerate(col)) for col in columns]
    for r in range(height):
        for cell in _in_order(columns, r):
            held = [k for k, col in enumerate(columns) if col[r] is cell]
            if cell.wide == 1 or not any(alone[k] for k in held):
                continue
            best = max(held, key=lambda k: (alone[k], k))
            parts = {k: _Cell(cell.name, cell.text if k == best else "", 1, cell.tall, r) for k in held}
            for k, part in parts.items():
                columns[k][r : r + cell.tall] = [part if c is cell else c for c in columns[k][r : r + cell.tall]]


def _rows_and_cells(table: Node) -> tuple[int, int]:
    """Rows inside a table, and its cells, each counted once for every row that holds it."""
    rows = cells = 0
    todo = [(table, 0)]
    while todo:
        n, held = todo.pop()
        rows += n.name == "tr"
        cells += held if n.name == "td" else 0
        held += n.name == "tr"
        todo.extend((k, held) for k in n.kids)
    return rows, cells


def is_data_table(table: Node) -> bool:
    """More than 5 rows, over 2 cells a row, and over a tenth of the characters digits, bare 4-digit numbers aside."""
    rows, cells = _rows_and_cells(table)
    if rows <= 5 or cells / rows <= 2:
        return False
    text = re.sub(r"\s", "", re.sub(r"(?<![,\d])\d{4}(?![,\d])", "", table.content().strip()))
    return len(re.findall(r"\d", text)) / (len(text) or 1) > 0.1


FURNITURE = ("table of contents", "use these links to rapidly review the document")
TOO_LONG = "\x00" * 2  # stands for any text longer than page furniture


def _drop_furniture(root: Node) -> None:
    """Scripts, styles, links, rules, page numbers and references to the contents go; judged by all text inside, in one fold."""
    gone = []

    def short(n: Node, below: list[str]) -> str:
        text = n.text if n.name is None else TOO_LONG if TOO_LONG in below else "".join(below)
        text = re.sub(r"\s{2,}", "  ", text)
        if len(text.strip()) > 64:
            text = TOO_LONG
        core = text.strip() if n.name in ("p", "div", "span", "font") else ""
        number = re.fullmatch(r"\d{1,3}", core) and (n.name == "font" or (n.name in ("p", "div") and n.attrs.get("align") == "center"))
        if n.name in ("script", "style", "a", "hr") or number or core.lower() in FURNITURE:
            gone.append(n)
        return text

    fold(root, short)
    for n in gone:
        n.become_text("")


def _lines(root: Node) -> str:
    """All text, with a line break before and behind each block."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name is None:
            out.append(n.text)
        elif n.name == "br":
            out.append("\n")
        else:
            if n.name in BLOCKS:
                out.append("\n")
                todo.append("\n")
            todo.extend(reversed(n.kids))
    return "".join(out)


def filing_text(html: str, mark: str = "GLMTABLE") -> tuple[str, list[str]]:
    """Text of a filing with placeholders, and the repaired data tables they stand for; page furniture goes."""
    root = parse(html)
    root = (root.find("body") or [root])[0]
    _drop_furniture(root)
    tables: list[str] = []
    for t in root.outermost("table", ("table",)):
        if is_data_table(t):
            tables.append(repair_table(t.html()))
            t.become_text(f"\n{mark}{len(tables) - 1}{mark}\n")
        else:
            t.become_text(t.content())
    lines = [re.sub(r"[ \t\r\f\v]+", " ", s).strip() for s in _lines(root).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), tables


def splice_tables(text: str, tables: list[str], mark: str = "GLMTABLE") -> str:
    """Placeholders replaced by their tables, or by nothing where there is none."""
    return re.sub(rf"{mark}(\d+){mark}", lambda m: f"\n\n{tables[int(m[1])]}\n\n" if int(m[1]) < len(tables) else "", text)
