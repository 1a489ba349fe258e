"""Number, name and date scalars as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_words(name: Column) -> Column:
    """Spaces between words of a camel-case name: aB and ABc split as a B and A Bc."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z])(?=[A-Z][a-z])", "$1 ")


def spaced_capitals(name: Column) -> Column:
    """A space before every capital, ends trimmed."""
    return F.trim(F.regexp_replace(name, r"(\p{Lu})", " $1"))


def format_value(v: Column) -> Column:
    """Whole numbers under 1e15 without a point; others with at most 10 decimals, zeros cut."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", v), "0+$", ""), r"\.$", "")
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.format_string("%d", v.cast("long"))).otherwise(text)


def tagged(v: Column) -> Column:
    return F.concat(F.lit("<number>"), format_value(v), F.lit("</number>"))


def parse_tagged(text: Column) -> Column:
    return F.regexp_extract(text, r"<number>([-\d.eE+]+)</number>", 1).try_cast("double")


def company_of_file(name: Column) -> Column:
    """Company id in a file name: none for .txt, third field of Prod… names of 4 or more, else the first field."""
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    return F.when(name.endswith(".txt"), None).when(name.startswith("Prod"), F.when(F.size(parts) >= 4, F.get(parts, F.lit(2)))).otherwise(F.get(parts, F.lit(0)))


def safe_name(name: Column) -> Column:
    """File-name form of a company name: odd characters and spaces become _, 80 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_"), " ", "_"), 1, 80)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB's round() does it: halves of ``x * 10^digits`` away from zero, a small negative number to -0.0.

    Spark's own round goes by the shortest decimal form and knows no -0.0.
    """
    scaled = F.abs(x) * 10.0**digits
    near = F.rint(scaled)  # halves to even
    return F.signum(x) * (near + F.when(scaled - near == 0.5, 1.0).otherwise(0.0)) / 10.0**digits


def log10_encode(v: Column) -> Column:
    """log10 of the size, within ±12; -12 for sizes under 1e-20, 0 where there is no number."""
    a = F.abs(v)
    return F.when(v.isNull(), 0.0).when(a < 1e-20, -12.0).otherwise(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), F.log10(a))))


def log10_decode(x: Column) -> Column:
    return F.when(x < -11, 0.0).otherwise(F.pow(F.lit(10.0), x))


def magnitude_bins(x: Column, low: float = -12.0, high: float = 12.0, bins: int = 128) -> Column:
    """struct(lo, hi, w_lo, w_hi): the two bins around a magnitude and their linear weights; above ``high`` lies the sentinel of masked numbers, which has a bin of its own behind the others."""
    pos = (F.greatest(F.lit(low), F.least(F.lit(high), x)) - low) / (high - low) * (bins - 1)
    masked = x > high
    at = lambda b: F.when(masked, bins).otherwise(b.cast("int"))
    share = F.when(masked, 0.0).otherwise(pos - F.floor(pos))
    return F.struct(at(F.floor(pos)).alias("lo"), at(F.ceil(pos)).alias("hi"), (1 - share).alias("w_lo"), share.alias("w_hi"))


def short_number(v: Column) -> Column:
    """Readable number: exponent form under 0.01, whole with separators from a million, one decimal from 100, else two.

    Decimals are rounded from the double's exact value, halves to even.
    """
    a = F.abs(v)
    return F.when(a < 0.01, F.format_string("%.4e", v)).when(a >= 1e6, F.format_number(v, 0)).when(a >= 100, F.format_number(v, 1)).otherwise(F.format_number(v, 2))


def learning_rate(step: Column, warm_up: int, total: int, floor: float = 0.0) -> Column:
    """Linear warm-up, then half a cosine down to ``floor``."""
    x = F.least(F.lit(1.0), (step - warm_up) / float(max(1, total - warm_up)))
    return F.when(step < warm_up, step / float(max(1, warm_up))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * x)))
