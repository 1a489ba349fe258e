"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

A candidate is found by its shape and must then prove valid: cards by the Luhn
digit, IBANs modulo 97, dates by the calendar, addresses by their octets,
social-security and telephone numbers by their ranges and lengths. A valid
value is numbered within all values of its format, the number is permuted by a
Feistel network under the key (walking its cycle until it falls inside the
format again), and the new number is written in the old layout, separators and
case included, with check digits made right. The permutation depends on key
and kind alone, so equal values stay equal across documents, whatever their
layout, and different ones stay different, and the holder of the key can undo
it; what comes back of an address of 128 bits is its shortest form, and of a date like 11/12/2020 two digits each. Days are permuted among those of like kind (up to the 12th, or after it),
so that month and day can be told apart as before; a number without country
code in a North American layout counts as one of code 1, and one that begins with 0 in groups
as one of no country. Letters beyond a to z are permuted among those of their block and case. Numbers without any
mark (15551234567, 20200115) are left alone, as are month names in other languages than English. A value of over
``LONG`` letters and digits is permuted in chained blocks, forwards and back.
A card or IBAN candidate
that fails may have taken in a neighbour (an expiry date, a count, a word): its
shorter readings in whole groups are tried, the longest first, and the search
goes on with its next group. Undoing is exact unless a longer reading beside a
neighbour happens to prove valid after the replacement.

Null texts stay null with a count of 0, texts without a digit or an @ are
untouched, invalid look-alikes are left alone, very long texts are searched to
their end, repeated rows are treated alike, empty tables give empty results.
``pseudonymise`` keeps every input column; one named n_replaced is replaced.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import ipaddress
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from filinglake.llm._shared import by_name, by_position
from filinglake.operators.arrow import ROWS

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY
LONG = 128  # letters and digits of a block
#: Country calling codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

MONTHS = tuple("January February March April May June July August September October November December".split())

_NAMES = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)

CANDIDATE = re.compile(
    r"""(?P<email>(?u:(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))
    |(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f:]{3,39}(?![\w:]))
    |(?P<date>(?<![\d/.-])(?:\d{4}(?P<sep1>[-/.])\d{2}(?P=sep1)\d{2}|\d{1,2}(?P<sep2>[-/.])\d{1,2}(?P=sep2)\d{4})(?![\d]|[-/.]\d))
    |(?P<written>(?<![A-Za-z0-9])(?:(?:@MONTH@)\.?\x20\d{1,2},?\x20\d{4}|\d{1,2}\x20(?:@MONTH@)\.?,?\x20\d{4})(?![A-Za-z0-9]))
    |(?P<ssn>(?<![\d-])(?:\d{3}-\d{2}-\d{4}(?![\d]|-\d)|(?<!\d\x20)\d{3}\x20\d{2}\x20\d{4}(?![\d]|[-\x20]\d)))
    |(?P<card>(?<![\d-])(?:\d[\x20-]?){12,18}\d(?![\d]|-\d))
    |(?P<phone>(?:(?<![\d+])\+\d{1,3}[\x20.-]?(?:\(\d{2,4}\)[\x20.-]?|\d{2,4}[\x20.-])\d{3,4}[\x20.-]?\d{3,4}|(?<![\d+])\(\d{3}\)\x20?\d{3}-\d{4}|(?<![\d+-])\d{3}[.-]\d{3}[.-]\d{4}|(?<![\d+])\+\d{9,15})(?![\d]|-\d)
        |(?<![\d+.-])(?<!\d\x20)(?:[2-9]\d{2}\x20\d{3}\x20\d{4}|0\d{2,4}\x20\d{3,4}\x20\d{3,4})(?![\d]|[-\x20]\d))
    """.replace("@MONTH@", _NAMES),
    re.VERBOSE | re.ASCII,
)
KINDS = ("email", "iban", "ip", "ip6", "date", "written", "ssn", "card", "phone")
WRITTEN = re.compile(rf"(?:(?P<m1>{_NAMES})\.?\x20(?P<d1>\d{{1,2}}),?|(?P<d2>\d{{1,2}})\x20(?P<m2>{_NAMES})\.?,?)\x20(?P<y>\d{{4}})", re.ASCII)
HINT = re.compile(r"[0-9@]")
#: Groups of the kinds whose candidates may take in a neighbour, what joins groups, and what a reading looks like.
GROUPS = {"card": re.compile(r"[0-9]+"), "iban": re.compile(r"[A-Z0-9]+")}
JOINED = {"card": re.compile(r"(?:[0-9]+[ -])*"), "iban": re.compile(r"(?:[A-Z0-9]+ )*")}
READINGS = {"card": re.compile(r"(?:[0-9][ -]?){12,18}[0-9]"), "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")}
#: Lengths of shortened readings of IBANs; other countries pass by their check digits alone.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}


class Feistel:
    """Keyed permutation of 0 … n-1 that leaves no value in place (for n > 1).

    The network's permutation P is used as P(P^-1(x) + r) with a keyed step r: a rotation seen through P.
    """

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.keyed = hashlib.blake2b(tweak.encode() + b":" + str(n).encode(), key=key[:64], digest_size=32)
        self.step = 1 + int.from_bytes(self.keyed.digest(), "big") % max(1, n - 1)

    def _f(self, r: int, x: int) -> int:
        h = self.keyed.copy()
        h.update(bytes([r]) + x.to_bytes((self.half + 7) // 8, "big"))
        out = h.digest()
        for k in range(1, -(-self.half // 256)):  # as many digests as the half is wide
            more = h.copy()
            more.update(k.to_bytes(4, "big"))
            out += more.digest()
        return int.from_bytes(out, "big") & self.mask

    def _walk(self, x: int, rounds) -> int:
        forward = rounds[0] == 0
        while True:
            a, b = x >> self.half, x & self.mask
            for r in rounds:
                a, b = (b, a ^ self._f(r, b)) if forward else (b ^ self._f(r, a), a)
            x = a << self.half | b
            if x < self.n:
                return x

    def _turned(self, x: int, step: int) -> int:
        if self.n < 2:
            return x
        return self._walk((self._walk(x, range(ROUNDS - 1, -1, -1)) + step) % self.n, range(ROUNDS))

    def forward(self, x: int) -> int:
        return self._turned(x, self.step)

    def back(self, x: int) -> int:
        return self._turned(x, -self.step)


def luhn_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


@functools.lru_cache(4096)
def _alike(c: str) -> str:
    """The characters that may stand for one: its case of a to z, the digits, or those of its block of 128 code points and its category."""
    for own in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        if c in own:
            return own
    start = ord(c) & ~127
    return "".join(d for d in map(chr, range(max(start, 128), start + 128)) if d.isalnum() and unicodedata.category(d) == unicodedata.category(c))


def _number(values: list[int], radices: list[int]) -> tuple[int, int]:
    x, n = 0, 1
    for v, r in zip(values, radices):
        x, n = x * r + v, n * r
    return x, n


def _values(x: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        x, v = divmod(x, r)
        out.append(v)
    return out[::-1]


class Pseudonymiser:
    """Replaces the valid values of a text; ``undo`` runs the permutation backwards."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self.nets: dict[tuple[str, int], Feistel] = {}
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, kind: str, x: int, n: int) -> int:
        net = self.nets.get((kind, n))
        if net is None:
            if len(self.nets) > 4096:
                self.nets.clear()
            net = self.nets[(kind, n)] = Feistel(self.key, kind, n)
        return net.back(x) if self.undo else net.forward(x)

    def _letters(self, kind: str, s: str) -> str:
        """Letters to letters of the same case, digits to digits, all else in place."""
        at = [i for i, c in enumerate(s) if c.isalnum()]
        if len(at) <= LONG:
            return self._block(kind, s, at, self._permute)
        # blocks in turn, each under the block before it, then back again: every letter depends on every other
        out, cuts = s, [at[k : k + LONG] for k in range(0, len(at), LONG)]
        for k in self._turns(len(cuts)):
            other = "".join(out[i] for i in cuts[k[1]])
            out = self._block(f"{kind}:{k[0] - k[1]}:{other}", out, cuts[k[0]], self._once)
        return out

    def _turns(self, n: int) -> list[tuple[int, int]]:
        """(block, the block it goes by): forwards, then back; the other way round to undo."""
        order = [(k, (k - 1) % n) for k in range(n)] + [(k, (k + 1) % n) for k in range(n - 1, -1, -1)]
        return order[::-1] if self.undo else order

    def _once(self, kind: str, x: int, n: int) -> int:
        net = Feistel(self.key, kind, n)
        return net.back(x) if self.undo else net.forward(x)

    def _block(self, kind: str, s: str, at: list[int], permute: Callable[[str, int, int], int]) -> str:
        alike = [_alike(s[i]) for i in at]
        radices = [len(a) for a in alike]
        x, n = _number([a.index(s[i]) for i, a in zip(at, alike)], radices)
        out = list(s)
        for i, a, v in zip(at, alike, _values(permute(kind, x, n), radices)):
            out[i] = a[v]
        return "".join(out)

    @staticmethod
    def _layout(s: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in s)

    def email(self, s: str) -> str | None:
        local, _, domain = s.rpartition("@")
        return f"{self._letters('email@' + domain.lower(), local)}@{domain}" if any(c.isalnum() for c in local) else None

    def card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        body = f"{self._permute('card', int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
        return self._layout(s, body + str(luhn_digit(body)))

    def iban(self, s: str) -> str | None:
        flat = s.replace(" ", "")
        value = lambda t: int("".join(str(int(c, 36)) for c in t))
        if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
            return None
        body = self._letters("iban" + flat[:2], flat[4:])
        check = 98 - value(body + flat[:2] + "00") % 97
        it = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)

    def ip(self, s: str) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x, n = _number([int(p) for p in parts], [256] * 4)
        return ".".join(map(str, _values(self._permute("ip", x, n), [256] * 4)))

    def date(self, s: str) -> str | None:
        year_first = s[4] in "-/." and len(s) == 10 and s[:4].isdigit()
        mark = s[4] if year_first else next(c for c in s if c in "-/.")
        parts = s.split(mark)
        y, m, d = parts if year_first else parts[::-1]
        swapped = False
        if not year_first and int(m) > 12 >= int(d):  # month before day
            m, d, swapped = d, m, True
        new = self._day(int(y), int(m), int(d))
        if new is None:
            return None
        if year_first:
            return f"{new.year:04d}{mark}{new.month:02d}{mark}{new.day:02d}"
        first, second = (new.month, new.day) if swapped else (new.day, new.month)
        wide = 2 if len(s) == 10 else 1  # numbers of one digit stay without a nought
        return f"{first:0{wide}d}{mark}{second:0{wide}d}{mark}{new.year:04d}"

    def written(self, s: str) -> str | None:
        """A day with its month's name, which stays short or whole."""
        found = WRITTEN.fullmatch(s)
        name = found["m1"] or found["m2"]
        month = 1 + next(k for k, m in enumerate(MONTHS) if m.startswith(name))
        day = found["d1"] or found["d2"]
        new = self._day(int(found["y"]), month, int(day))
        if new is None:
            return None
        shown = MONTHS[new.month - 1]
        shown = shown if len(name) > 3 or name == "May" else shown[:3]
        at = [(found.span("m1" if found["m1"] else "m2"), shown), (found.span("d1" if found["d1"] else "d2"), f"{new.day:0{2 if day[0] == '0' else 1}d}"), (found.span("y"), f"{new.year:04d}")]
        for (a, b), text in sorted(at, reverse=True):
            s = s[:a] + text + s[b:]
        return s

    def _day(self, y: int, m: int, d: int) -> datetime.date | None:
        try:
            day = datetime.date(y, m, d).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < DAYS:
            return None
        kind, days, index = self._days(d > 12)
        return datetime.date.fromordinal(FIRST_DAY + days[self._permute(kind, index[day], len(days))])

    def ip6(self, s: str) -> str | None:
        """Any address of 128 bits; written in its shortest form, in capitals where it had any."""
        try:
            x = int(ipaddress.IPv6Address(s))
        except ValueError:
            return None
        out = str(ipaddress.IPv6Address(self._permute("ip6", x, 1 << 128)))
        return out.upper() if s != s.lower() else out

    def _days(self, late: bool) -> tuple[str, list[int], dict[int, int]]:
        """The days up to the 12th, or those after it, and their places; both kinds keep month and day in their order."""
        if not hasattr(self, "_calendar"):
            after = [datetime.date.fromordinal(FIRST_DAY + k).day > 12 for k in range(DAYS)]
            self._calendar = {}
            for kind, side in (("date", False), ("date-late", True)):
                days = [k for k in range(DAYS) if after[k] == side]
                self._calendar[side] = (kind, days, {k: i for i, k in enumerate(days)})
        return self._calendar[late]

    def ssn(self, s: str) -> str | None:
        a, g, n = int(s[:3]), int(s[4:6]), int(s[7:])
        if a in (0, 666) or a >= 900 or not g or not n:
            return None
        radices = [898, 99, 9999]
        x, size = _number([a - 1 - (a > 666), g - 1, n - 1], radices)
        a, g, n = _values(self._permute("ssn", x, size), radices)
        return f"{a + 1 + (a >= 665):03d}{s[3]}{g + 1:02d}{s[3]}{n + 1:04d}"

    def phone(self, s: str) -> str | None:
        """The country code stays; the other digits are permuted as one number, whatever the layout."""
        d = re.sub(r"\D", "", s)
        code = next((c for c in CODES if d.startswith(c)), d[:3]) if s[0] == "+" else "0" if s[0] == "0" and " " in s else "1"
        rest = d[len(code) :] if s[0] in "+0" and code != "1" or s[0] == "+" else d
        if not 7 <= len(rest) <= 14 or len(d) > 15 or len(set(rest)) == 1:
            return None
        return self._layout(s, d[: len(d) - len(rest)] + self._subscriber(code, rest))

    def _subscriber(self, code: str, rest: str) -> str:
        """Another number of the same length; of code 1, one whose area and exchange are as well or as ill formed."""
        if code != "1" or len(rest) != 10:
            return f"{self._permute('phone' + code, int(rest), 10 ** len(rest)):0{len(rest)}d}"
        area, exchange = rest[0] > "1", rest[3] > "1"
        low = [2 * area, 0, 2 * exchange, 0]
        radices = [8 if area else 2, 100, 8 if exchange else 2, 1_000_000]
        x, n = _number([v - b for v, b in zip((int(rest[0]), int(rest[1:3]), int(rest[3]), int(rest[4:])), low)], radices)
        a, b, c, d = (v + k for v, k in zip(_values(self._permute(f"phone1{area:d}{exchange:d}", x, n), radices), low))
        return f"{a}{b:02d}{c}{d:06d}"

    def replace(self, text: str | None) -> tuple[str | None, int]:
        if not text or not HINT.search(text):
            return text, 0
        n, pos, done, out = 0, 0, 0, []
        while m := CANDIDATE.search(text, pos):
            kind = next(k for k in KINDS if m[k] is not None)
            start, end = m.span()
            new = self._new(kind, m[0])
            if new is None and kind in GROUPS:
                start, end, new = self._shorter(kind, text, start, end)
            if new is None:
                pos = end
                continue
            out += [text[done:start], new]
            n, pos, done = n + 1, end, end
        return "".join([*out, text[done:]]), n

    def _new(self, kind: str, s: str) -> str | None:
        known = (kind, s)
        if known not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[known] = getattr(self, kind)(s)
        return self.known[known]

    def _shorter(self, kind: str, text: str, start: int, end: int) -> tuple[int, int, str | None]:
        """The first valid reading of a failed candidate in whole groups, or the place to search on from: its next group."""
        while True:
            for stop in reversed([g.end() for g in GROUPS[kind].finditer(text, start, start + 48) if self._joined(kind, text, start, g.start())]):
                s = text[start:stop]
                if READINGS[kind].fullmatch(s) and IBAN_LENGTHS.get(s[:2], len(s.replace(" ", ""))) == len(s.replace(" ", "")) and (new := self._new(kind, s)) is not None:
                    return start, stop, new
            after = GROUPS[kind].search(text, start).end() + 1
            if after >= end:
                return end, end, None
            if text[after - 1] != "-" or CANDIDATE.match(text, after):
                return after, after, None
            start = after  # CANDIDATE takes no card behind a dash

    @staticmethod
    def _joined(kind: str, text: str, start: int, at: int) -> bool:
        """Whether single separators alone join the groups from ``start`` to ``at``."""
        return JOINED[kind].fullmatch(text, start, at) is not None


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", undo: bool = False) -> DataFrame:
    """The input with pseudonyms in its text, and n_replaced."""
    given, (docs, name) = docs, by_position(docs)
    at = docs.columns.index(name(text_col))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_replaced", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work: Callable = Pseudonymiser(key, undo).replace
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            done = [work(t) for t in b.column(at).to_pylist()]
            columns = [b.column(i) if i != at else pa.array([t for t, _ in done], pa.string()) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema).select(*by_name(given, ["n_replaced"]), "n_replaced")
