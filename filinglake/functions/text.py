"""Text scalars as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_MARK = r"(?m)^(########## .+)$"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"\s+"), ""))


def estimated_tokens(text: Column) -> Column:
    return F.floor(word_count(text) * 1.35)


def number_tags(text: Column) -> Column:
    return F.regexp_count(text, F.lit("<number>"))


def strip_link_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(\[[^\]]*\])\([^)]+\)", "$1(link)")


def tidy(text: Column) -> Column:
    """Hard spaces to spaces, runs of blanks inside lines to one (indents stay), at most two newlines on end, ends trimmed."""
    t = F.regexp_replace(text, " ", " ")
    t = F.regexp_replace(t, r"(?<=\S)[ \t]+", " ")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def trim_lines(text: Column) -> Column:
    """Every line trimmed, at most two newlines on end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", ""), r"\n{3,}", "\n\n")


def drop_xml_declaration(text: Column) -> Column:
    return F.regexp_replace(text, r"<\?xml[^?]*\?>", "")


def hash_bucket(name: Column, modulus: int = 10000) -> Column:
    """MD5 of the name as a 128-bit number, modulo: eight 4-digit pieces from the left."""
    digest = F.md5(name.cast("binary"))
    out = F.lit(0).cast("long")
    for k in range(8):
        piece = F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("long")
        out = (out * 65536 + piece) % modulus
    return out


def is_validation(name: Column, ratio: float = 0.1) -> Column:
    return hash_bucket(name) < ratio * 10000
