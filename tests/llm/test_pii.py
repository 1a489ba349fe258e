import random
import re

import pytest

from filinglake.llm import pii
from filinglake.llm import queries as Q

P = pii.Pseudonymiser(b"k" * 32)
BACK = pii.Pseudonymiser(b"k" * 32, undo=True)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 26, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = pii.Feistel(b"key", "t", n)
    out = [f.forward(x) for x in range(n)]
    assert sorted(out) == list(range(n)) and [f.back(y) for y in out] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(out))


@pytest.mark.parametrize(
    "value,shape",
    [
        ("4111111111111111", r"\d{16}"),
        ("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}"),
        ("GB82 WEST 1234 5698 7654 32", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
        ("DE89370400440532013000", r"DE\d{20}"),
        ("192.168.17.4", r"\d+\.\d+\.\d+\.\d+"),
        ("2023-02-28", r"\d{4}-\d\d-\d\d"),
        ("28/02/2023", r"\d\d/\d\d/\d{4}"),
        ("02/28/2023", r"\d\d/\d\d/\d{4}"),
        ("123-45-6789", r"\d{3}-\d\d-\d{4}"),
        ("+1 (974) 555-3436", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        ("+442071838750", r"\+\d{12}"),
        ("Jane.Doe42@mail.example.com", r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@mail\.example\.com"),
    ],
)
def test_format_is_kept_and_undone(value, shape):
    for text in (value, f"x {value} y", f'"{value}"!!', f"{value}, and {value}."):
        new, n = P.replace(text)
        assert n == text.count(value) and value not in new
        found = re.search(shape, new)[0]
        assert new == text.replace(value, found)  # equal values stay equal
        again, m = BACK.replace(new)
        assert (again, m) == (text, n)
        if value.startswith("4111"):
            d = re.sub(r"\D", "", found)
            assert pii.luhn_digit(d[:-1]) == int(d[-1])


@pytest.mark.parametrize("text", ["4111111111111112", "GB82 WEST 1234 5698 7654 33", "300.1.2.3", "2023-02-30", "000-12-3456", "version 3.14.15", "0000000000000000", "page 12 of 1999", "04db89bab91ab85687d33eeaaf9ac699e1188f962", "a@b", "1.2.3.4.5", "9" * 30])
def test_invalid_values_are_left_alone(text):
    assert P.replace(text) == (text, 0)


def test_cards_are_linked_whatever_their_layout():
    a, b = P.replace("4111111111111111")[0], P.replace("4111-1111-1111-1111")[0]
    assert a == b.replace("-", "")


def test_phones_and_dates_are_linked_whatever_their_layout():
    phones = ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "555.123.4567", "+1-555-123-4567"]
    new = {re.sub(r"\D", "", P.phone(p))[-10:] for p in phones}
    assert len(new) == 1 and new != {"5551234567"}
    assert P.phone("+442071838750").startswith("+44") and re.sub(r"\D", "", P.phone("+44 20 7183 8750")) == P.phone("+442071838750")[1:]
    assert P.phone("+3531234567").startswith("+353")
    for y, m, d in ((2020, 1, 15), (2020, 12, 31), (2020, 2, 29), (1999, 3, 4)):
        iso = P.date(f"{y}-{m:02d}-{d:02d}")
        a, b, c = iso.split("-")
        assert P.date(f"{d:02d}/{m:02d}/{y}") == f"{c}/{b}/{a}"
        if d > 12:
            assert P.date(f"{m:02d}/{d:02d}/{y}") == f"{b}/{c}/{a}" and int(c) > 12


@pytest.mark.parametrize("n", [50, 120, 128, 129, 300, 5000])
def test_long_addresses_keep_no_letter_run(n):
    r = random.Random(n)
    local = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789.") for _ in range(n - 1)) + "z"
    new = P.email(f"{local}@x.org")
    assert BACK.email(new) == f"{local}@x.org" and len(new) == n + 6
    runs = [k for k in range(n - 8) if new[k : k + 8] == local[k : k + 8] and local[k : k + 8].isalnum()]
    assert not runs
    at = n // 2
    other = P.email(f"{local[:at]}{'b' if local[at] != 'b' else 'c'}{local[at + 1 :]}@x.org") if local[at].isalpha() else None
    if other:  # one letter changes them all
        same = sum(a == b for a, b in zip(new[:n], other[:n])) / n
        assert same < 0.35


def plain_finder(text):
    """Values by other means: every substring of whole tokens is tried by kind, without the operator's patterns."""
    found = []
    for m in re.finditer(r"\S+", text):
        t = m[0].strip(".,;:!?\"'()[]<>")
        if re.fullmatch(r"\d{4}-\d\d-\d\d", t):
            y, mo, d = map(int, t.split("-"))
            days = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
            if 1900 <= y < 2100 and 1 <= mo <= 12 and 1 <= d <= days[mo - 1]:
                found.append(t)
        elif t.count("@") == 1 and re.fullmatch(r"[\w.%+-]*[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t, re.ASCII) and "_" not in t.partition("@")[2]:
            found.append(t)
        elif t.count(".") == 3 and all(p.isdigit() and p.isascii() and str(int(p)) == p and int(p) < 256 for p in t.split(".")):
            found.append(t)
        elif t.isdigit() and t.isascii() and 13 <= len(t) <= 19 and len(set(t)) > 1:
            total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(t)))
            if total % 10 == 0:
                found.append(t)
    return found


def test_whole_table_leaves_no_value_that_a_plain_finder_sees(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pairs = {}
    for r in Q.op2_feistel_pii(spark, sf).collect():
        before, after = plain_finder(docs[r.doc_id] or ""), plain_finder(r.text or "")
        assert len(before) <= r.n_replaced and len(after) >= len(before)
        kept = [v for v in before if v in (r.text or "")]
        assert not kept, (r.doc_id, kept)
        if len(before) == len(after):
            for a, b in zip(before, after):
                assert pairs.setdefault(a, b) == b  # equal values stay equal over documents
    assert len(pairs) > 5 and len(set(pairs.values())) == len(pairs)


def test_random_values_stay_distinct():
    r = random.Random(1)
    days = {P.date(f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}") for _ in range(2000)}
    assert len(days) > 1900 and None not in days


def test_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "plain", 5), (4, "ip 10.0.0.1", 5), (4, "ip 10.0.0.1", 5), (None, "10.0.0.1 " * 20_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Replaced int")
    out = pii.pseudonymise(docs, b"k" * 32)
    assert out.columns == ["doc_id", "text", "n_replaced"]
    got = out.collect()
    assert [r.n_replaced for r in got] == [0, 0, 0, 1, 1, 20_000]
    assert [r.text for r in got[:3]] == [None, "", "plain"]
    assert got[3].text == got[4].text and got[5].text.split()[0] == got[3].text.split()[1]
    back = pii.pseudonymise(out, b"k" * 32, undo=True).collect()
    assert [r.text for r in back] == [r[1] for r in rows]
    assert pii.pseudonymise(docs.limit(0), b"k").count() == 0


def test_whole_table_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = Q.op2_feistel_pii(spark, sf)
    got = out.collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.text == docs[r.doc_id]) == (r.n_replaced == 0)
        for v in re.findall(r"\d+\.\d+\.\d+\.\d+|\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}", docs[r.doc_id] or ""):
            assert v not in r.text
    back = {r.doc_id: r.text for r in pii.pseudonymise(out, Q.PII_KEY, undo=True).collect()}
    assert back == docs


@pytest.mark.parametrize(
    "text,value",
    [
        ("4111 1111 1111 1111 12/26", "4111 1111 1111 1111"),
        ("4111111111111111 123", "4111111111111111"),
        ("4111111111111111-123", "4111111111111111"),
        ("12 4111111111111111", "4111111111111111"),
        ("12-4111111111111111", "4111111111111111"),
        ("pay GB82 WEST 1234 5698 7654 32 FOR", "GB82 WEST 1234 5698 7654 32"),
        ("NO93 8601 1117 947 FOR", "NO93 8601 1117 947"),
        ("BE68 5390 0754 7034 FOR", "BE68 5390 0754 7034"),
        ("AB13 BE68 5390 0754 7034 NOW", "BE68 5390 0754 7034"),
        ("12 123-45-6789 1234567", "123-45-6789"),
    ],
)
def test_neighbours_do_not_hide_a_value(text, value):
    new, n = P.replace(text)
    before, after = text.split(value)
    assert n == 1 and value not in new and new.startswith(before) and new.endswith(after) and len(new) == len(text)


def test_failed_candidates_are_left_alone_in_linear_time():
    text = " ".join(["1"] * 50_000)
    assert pii.Pseudonymiser(b"k").replace("4111 1111 1111 1112 12/26") == ("4111 1111 1111 1112 12/26", 0)
    assert len(pii.Pseudonymiser(b"k").replace(text)[0]) == len(text)


@pytest.mark.parametrize(
    "text,values",
    [
        ("jörg@x.de, joe@müller.de, ИВАН.Петров7@почта.рф", ["jörg", "joe", "ИВАН.Петров7"]),
        ("call 020 7946 0958 or 555 123 4567 or 555 987 6543", ["020 7946 0958", "555 123 4567", "555 987 6543"]),
        ("on Jan 5, 2020 and 15 January 2020 and 1/5/2020 and Sep. 30 2021", ["Jan 5", "15 January 2020", "1/5/2020", "30 2021"]),
        ("no 123 45 6789.", ["123 45 6789"]),
        ("at fe80::1:2 and 2001:DB8::8A2E:370:7334", ["fe80::1:2", "2001:DB8::8A2E:370:7334"]),
    ],
)
def test_further_layouts_and_scripts(text, values):
    new, n = P.replace(text)
    assert n == len(values) and not any(v in new for v in values)
    assert pii.Pseudonymiser(P.key, undo=True).replace(new)[0] == text
    assert "@x.de" in new if "@x.de" in text else True


def test_one_value_is_one_pseudonym_in_every_layout():
    one = {re.sub(r"\D", "", P.replace(s)[0])[-10:] for s in ("555 987 6543", "555-987-6543", "(555) 987-6543", "+1 555 987 6543", "555.987.6543")}
    assert len(one) == 1
    days = [P.replace(s)[0] for s in ("2020-01-25", "Jan 25, 2020", "25 January 2020", "25/1/2020", "25.01.2020")]
    y, m, d = days[0].split("-")
    month = pii.MONTHS[int(m) - 1]
    assert days[1:] == [f"{month[:3]} {int(d)}, {y}", f"{int(d)} {month} {y}", f"{int(d)}/{int(m)}/{y}", f"{d}.{m}.{y}"]


def test_what_is_no_value_stays():
    for text in ("Feb 30, 2020", "12:30:45 std::string a::b", "15551234567 20200115", "100 200 3000", "1 234 567 890", "31/2/2020", "Janus 5, 2020", "@ 5", "5 May", "1.2.3"):
        assert P.replace(text) == (text, 0)


def test_a_cluster_without_a_key_gets_a_secret_one_for_the_session(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.warns(UserWarning, match="pii.key"):
        out = Q.op2_feistel_pii(spark, sf)
    key = Q.pii_key(spark)
    assert key not in (Q.PII_KEY, b"") and Q.pii_key(spark) == key
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.keys() == docs.keys() and got == {r.doc_id: r.text for r in Q.op2_feistel_pii(spark, sf).collect()}
    undone = lambda k: {r.doc_id: r.text for r in pii.pseudonymise(out, k, undo=True).collect()}
    assert undone(key) == docs and undone(Q.PII_KEY) != docs
    monkeypatch.setattr(spark.sparkContext, "master", "local[8]")
    assert Q.pii_key(spark) == Q.PII_KEY
    del spark.sparkContext._filinglake_pii_key


def test_rows_leave_in_pieces_and_in_order(spark):
    rows = [(k, None if k % 7 == 0 else f"no {k} of 10.0.{k % 256}.1") for k in range(1000)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), b"k").collect()
    assert [(r.doc_id, r.n_replaced) for r in got] == [(k, int(t is not None)) for k, t in rows]
    back = pii.Pseudonymiser(b"k", undo=True)
    assert [r.text and back.replace(r.text)[0] for r in got] == [t for _, t in rows]
