"""Number tagging of text.

One scanner finds numbers by the shapes of a kind of text, in the order of
their precedence, on the text as it stands; the spans found are then written
anew with tags, all by one formatter. A kind says which of its shapes leave
years bare and how decimals are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import types as T

from filinglake.operators.arrow import each

# The shapes of numbers in the three kinds of text; "n" is the number, "minus" or brackets its sign.
COMMAS = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?"
PLAIN = r"\d+(?:\.\d+)?"
ANY_NUMBER = rf"""(?<![.\d"'])(?P<n>{COMMAS}|{PLAIN})(?!\d|\.\d)(?!["'])"""
OCR_NUMBER = rf"(?<![.\d,\w])(?P<minus>-)?(?P<n>{COMMAS}|{PLAIN})(?![,\d])"
CELL_NUMBER = r"(?<=\|)[^\S\n]*\*{0,2}[^\S\n]*(?P<at>(?P<minus>-)?(?P<n>\d{1,4}(?:\.\d+)?))[^\S\n]*\*{0,2}[^\S\n]*(?=\|)"
BRACKETED = r"(?P<at>\([^\S\n]*(?P<n>(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d+)?)[^\S\n]*\))"
SEPARATED = rf"(?<![.\d])(?P<n>{COMMAS})(?![,\d])"
LONG = r"(?<![.,\d])(?P<n>\d{5,})(?!\d)"
BOLD_NUMBER = r"\*\*\s*[£$€]?\s*(?P<at>(?P<minus>-)?(?P<n>\d[\d,]*(?:\.\d+)?))\s*%?\s*\*\*"
YEARS = range(1900, 2100)

MARKUP = re.compile(r"<[^>]+>")


@dataclass(frozen=True)
class Shape:
    """What a pattern finds: ``at`` (or all of the match) is written anew; ``negative`` without a sign, ``bare`` years stay."""

    pattern: str
    bare: bool = False
    negative: bool = False


@dataclass(frozen=True)
class Kind:
    """Groups of shapes that are looked for together, the first group first; markup is passed over if ``outside`` is set."""

    groups: tuple[tuple[Shape, ...], ...]
    outside: bool = False
    places: int | None = 10  # decimals kept, closing zeros cut; None: as written, one digit at least


KINDS = {
    "all": Kind(((Shape(ANY_NUMBER),),)),
    "ocr": Kind(((Shape(OCR_NUMBER),),), places=None),
    "filing": Kind(((Shape(CELL_NUMBER, bare=True),), (Shape(BRACKETED, bare=True, negative=True), Shape(SEPARATED), Shape(LONG)), (Shape(BOLD_NUMBER, bare=True),)), outside=True),
}


def written(digits: str, minus: bool, places: int | None) -> str:
    """A number without separators."""
    with localcontext(prec=max(50, 2 * len(digits) + 12)):
        value = Decimal(digits.replace(",", ""))
        if places is not None:
            out = f"{round(Decimal(float(value)), places) if '.' in digits else value:f}"  # decimals are those of a double
            out = out.rstrip("0").rstrip(".") if "." in out else out
        else:
            out = f"{value:f}"
            if "." in out:
                out = out.rstrip("0")
                out += "0" * out.endswith(".")
    return ("-" if minus and (value or places is None) else "") + out


def spans(text: str, kind: Kind) -> Iterator[tuple[int, int, str]]:
    """(start, end, tagged number) of the numbers, in order; a span that meets an earlier group's is left to it."""
    taken = bytearray(len(text))
    if kind.outside:
        for m in MARKUP.finditer(text):
            taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    found = []
    for group in kind.groups:
        at = 0
        while m := _together(group).search(text, at):
            at = m.end()
            k = int(m.lastgroup[1:])
            shape, part = group[k], {name: m.group(f"{name}{k}") for name in ("n", "minus", "at") if f"{name}{k}" in m.re.groupindex}
            a, b = m.span(f"at{k}" if "at" in part else m.lastgroup)
            if any(taken[a:b]):
                at = m.start() + 1
                continue
            if shape.bare and part["n"].isdigit() and int(part["n"]) in YEARS and not part.get("minus"):
                continue
            taken[a:b] = b"\1" * (b - a)
            found.append((a, b, f"<number>{written(part['n'], shape.negative or bool(part.get('minus')), kind.places)}</number>"))
    yield from sorted(found)


_TOGETHER: dict[tuple[Shape, ...], re.Pattern] = {}


def _together(group: tuple[Shape, ...]) -> re.Pattern:
    """One pattern of a group; the k-th shape is named _k, and its parts bear its number."""
    if group not in _TOGETHER:
        parts = [f"(?P<_{k}>" + re.sub(r"\(\?P<(n|minus|at)>", rf"(?P<\g<1>{k}>", s.pattern) + ")" for k, s in enumerate(group)]
        _TOGETHER[group] = re.compile("|".join(parts))
    return _TOGETHER[group]


def tag(text: str, kind: str) -> str:
    """The text with its numbers tagged; tags that it has already are taken off where every number is tagged anew."""
    if kind == "all":
        text = re.sub("</?number>", "", text)
    out, at = [], 0
    for a, b, new in spans(text, KINDS[kind]):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def text_udf(f):
    return each(f, T.StringType())


def taggers() -> dict:
    """Column functions by kind of text."""
    return {kind: text_udf(lambda t, kind=kind: tag(t, kind)) for kind in KINDS}
