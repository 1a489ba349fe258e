import math
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from filinglake.operators import dom, examples, tokens
from filinglake.operators.examples import CLS, NUMBER_ID, SEP, TABLE_END, TABLE_START
from filinglake.plans import catalogue
from filinglake.plans import corpus as plans

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LINE, TABBED = LIBRARY.encode("\n").ids[0], LIBRARY.encode("\t").ids[0]


def magnitude(s):
    try:
        v = abs(float(s.strip()))
    except ValueError:
        v = 0.0
    return -12.0 if v < 1e-20 else min(12.0, max(-12.0, math.log10(v)))


def fragment(text):
    """Ids of a fragment by the library's offsets: each number's placeholder is looked up among all tokens."""
    held = list(re.finditer("(?s)<number>(.*?)</number>", text))
    plain, places, at = "", [], 0
    for m in held:
        plain += text[at : m.start()]
        places.append(len(plain))
        plain, at = plain + "§", m.end()
    plain += text[at:]
    e = LIBRARY.encode(plain, add_special_tokens=False)
    out = [(i, False, 0.0) for i in e.ids]
    gone = set()
    for p, m in zip(places, held):
        inside = [k for k, (a, b) in enumerate(e.offsets) if a <= p < b]
        out[inside[0]] = (NUMBER_ID, True, magnitude(m[1]))
        gone.update(inside[1:])
    return [t for k, t in enumerate(out) if k not in gone]


def whole(text):
    out, at = [(CLS, False, 0.0)], 0
    for m in re.finditer("(?is)<table[^>]*>.*?</table>", text):
        out += fragment(text[at : m.start()]) + [(TABLE_START, False, 0.0)]
        for row in dom.table_grid(m[0]):
            for _, cell in row:
                out += fragment(cell) + [(TABBED, False, 0.0)]
            out.append((LINE, False, 0.0))
        out.append((TABLE_END, False, 0.0))
        at = m.end()
    return out + fragment(text[at:]) + [(SEP, False, 0.0)]


@pytest.fixture(scope="module")
def marked(spark):
    return {r.doc_id: r.text for r in plans._marked_texts(spark, SF).collect() if r.text and r.text.strip()}


@pytest.fixture(scope="module")
def tokenised(spark):
    return {r.id: r for r in examples.tokenise(plans._marked_texts(spark, SF), "doc_id", "text", examples.Vocabulary(PATH)).collect()}


def test_every_id_of_every_document_by_the_librarys_offsets(marked, tokenised):
    assert set(tokenised) == set(marked)
    n_tables = 0
    for i, text in marked.items():
        r = tokenised[i]
        want = whole(text)
        assert (r.input_ids, r.is_number_mask) == ([t[0] for t in want], [t[1] for t in want])
        assert all(abs(a - b[2]) < 1e-5 for a, b in zip(r.number_values, want))
        assert r.seq_length == len(want)
        n_tables += r.input_ids.count(TABLE_START)
    assert max(r.seq_length for r in tokenised.values()) > 8192 and n_tables > 20 and any(any(r.is_number_mask) for r in tokenised.values())


def test_numbers_that_are_none_and_signs_that_stand_for_numbers():
    words = examples.Vocabulary(PATH)
    for text in ("§ <number>5</number> §§<number>-0</number>", "<number> 1e3 </number>§", "<number>twelve</number>", "<number></number>x", "<number>1,000</number>", "<number>nan</number><number>inf</number>", "a<number>1</number><number>2</number>b"):
        ids, mask, values = examples.encode_numbers(text, words)
        want = [(CLS, False, 0.0), *fragment(text), (SEP, False, 0.0)] if "nan" not in text else None
        assert want is None or [*zip(ids, mask, values)] == want, text
    assert examples.log_magnitude("nan") == -12 and examples.log_magnitude("inf") == 12 and examples.log_magnitude("x") == -12


def test_a_table_across_the_end_of_a_chunk_stays_whole(spark):
    row = [CLS, 1, 2, LINE, TABLE_START, 3, LINE, 4, LINE, TABLE_END, LINE, 5, 6, 7, SEP]
    assert tokens.boundaries(tokens.np.array(row[1:-1]), [LINE]).tolist() == [3, 10]
    assert tokens.boundaries(tokens.np.array(row[1:-1]), [LINE], tables=False).tolist() == [3, 6, 8, 10]
    df = spark.createDataFrame([(7, row, [False] * 5 + [True] + [False] * 9, [0.0] * 5 + [2.5] + [0.0] * 9), (8, [CLS, SEP], [False] * 2, [0.0] * 2)], "id int, input_ids array<int>, is_number_mask array<boolean>, number_values array<double>")
    got = tokens.chunk(df, 7, 7, tail=1, line_ends=[LINE]).orderBy("doc_start").collect()
    assert [(r.doc_start, r.doc_end) for r in got] == [(0, 10), (10, 13)]
    assert got[0].input_ids == [CLS, *row[1:11], SEP] and got[0].number_values[5] == 2.5 and got[0].is_number_mask == [False] * 5 + [True] + [False] * 6
    assert [(r.doc_start, r.doc_end) for r in tokens.chunk(df, 7, 7, tail=1, line_ends=[LINE], tables=False).orderBy("doc_start").collect()] == [(0, 6), (6, 13)]
    assert [(r.doc_start, r.doc_end) for r in tokens.chunk(df, 7, 7, cap=4, tail=1, line_ends=[LINE]).orderBy("doc_start").collect()] == [(0, 4), (4, 8), (8, 12), (12, 13)]
    assert tokens.chunk(df.filter("id = 8"), 7, 7).count() == 0


def spans_by_hand(content, doc):
    """Every place is looked at; the nearest wins, the earlier of two."""
    depth, ends = 0, []
    for k, t in enumerate(content):
        depth += t == TABLE_START
        if t == LINE and depth <= 0:
            ends.append(k + 1)
        depth -= t == TABLE_END
    out, at = [], 0
    while at < len(content):
        target = at + 128 + zlib.crc32(f"0:{doc}:{len(out)}".encode()) % 897
        if target < len(content):
            before = [e for e in ends if at < e < target][-1:]
            behind = [e for e in ends if e >= target][:1]
            end = min(before + behind, key=lambda e: (abs(e - target), e), default=target)
            end = len(content) if len(content) - end < 16 else end
        else:
            end = len(content)
        out.append((at, min(end, at + 8190)))
        at = out[-1][1]
    return out


def test_chunks_of_every_document(spark, tokenised):
    held = {}
    for r in catalogue.QUERIES["token_chunks"](spark, SF).collect():
        held.setdefault(r.id, []).append(r)
    assert set(held) == set(tokenised)
    for i, chunks in held.items():
        chunks.sort(key=lambda r: r.chunk_idx)
        doc = tokenised[i]
        assert [(r.doc_start, r.doc_end) for r in chunks] == spans_by_hand(doc.input_ids[1:-1], i)
        for name in ("input_ids", "is_number_mask", "number_values"):
            assert [x for r in chunks for x in r[name][1:-1]] == doc[name][1:-1]
        assert all(r.input_ids[0] == CLS and r.input_ids[-1] == SEP and r.seq_length == len(r.input_ids) for r in chunks)


def test_predictions_in_their_text(spark):
    #        token, piece, log, masked, special
    rows = [
        (0, "[CLS]", "[CLS]", None, True, True), (1, "Sales", "Sales", None, False, False), (2, "rose", "  rose", None, True, False), (3, "by", " by", None, True, False), (4, "n", " n", 3.0, True, False),
        (5, "n", " n", 0.5, False, False), (6, ",", ",", None, True, False), (7, "now", " now", None, True, False), (8, "é", " é", None, True, False), (9, "[SEP]", "[SEP]", None, False, True), (10, "n", "n", -12.0, False, False),
    ]
    tokens_ = spark.createDataFrame([(1, *r) for r in rows], "row int, pos int, token string, piece string, log double, masked boolean, special boolean")
    guesses = spark.createDataFrame([(1, 0, "x", "x", None), (1, 2, "rose", " rose", None), (1, 3, "to", " to", None), (1, 4, None, None, 2.0), (1, 6, "x", "x", None), (1, 8, "É", "É ", None)], "row int, pos int, token string, piece string, log double")
    text = tokens.with_predictions(tokens_, guesses, "row", "pos").first().text
    assert text == "Sales  (**rose**) (~~to~~**by**)(~~100.0~~**1,000.0**)3.16, (~~~~**now**) (~~É~~**é**)0.0000e+00"


def test_pieces_keep_their_blanks(spark):
    texts = ["Net  sales rose\tby 5 % – über alles", "a\n b"]
    df = spark.createDataFrame([(k, LIBRARY.encode(t).ids) for k, t in enumerate(texts)], "k int, ids array<int>")
    got = {r.k: r.pieces for r in df.select("k", tokens.pieces(F.col("ids"), examples.Vocabulary(PATH)).alias("pieces")).collect()}
    assert got == {k: [LIBRARY.decode([i]) for i in LIBRARY.encode(t).ids] for k, t in enumerate(texts)}
    assert "".join(got[1]) == texts[1] and got[0][1:3] == [" ", " sales"]


def test_masking_leaves_special_tokens_and_marks_the_rest(spark):
    n = 4000
    ids = [CLS, *[100 + k % 7 for k in range(n)], SEP]
    number = [False, *[k % 5 == 0 for k in range(n)], False]
    df = spark.createDataFrame([(1, ids, number, [2.5 if m else 0.0 for m in number])], "row int, input_ids array<int>, is_number_mask array<boolean>, number_values array<float>")
    r = tokens.mask(df, "row", 9, 50, 0.5, 0.5).first()
    chosen = {"word": 0, "number": 0, "mask": 0, "kept": 0}
    for i, m in enumerate(number):
        text = r.labels[i] != -100
        value = r.label_values[i] != -100
        assert not (text and m) and not (value and not m) and (i not in (0, n + 1) or not (text or value))
        assert (m or not text) <= (r.masked_ids[i] == ids[i]) and (text and r.masked_ids[i] not in (9, ids[i])) <= (r.masked_ids[i] < 50)
        assert text <= (r.labels[i] == ids[i]) and value <= (r.label_values[i] == 2.5) and (not value) <= (r.masked_values[i] == (2.5 if m else 0.0))
        chosen["word"] += text
        chosen["number"] += value
        chosen["mask"] += (r.masked_ids[i] == 9) + (r.masked_values[i] == 13)
    total = chosen["word"] + chosen["number"]
    assert abs(total / n - 0.5) < 0.05 and abs(chosen["mask"] / total - 0.8) < 0.05


def test_bin_of_masked_numbers(spark):
    from filinglake.functions import numbers

    rows = spark.createDataFrame([(13.0,), (12.0,), (-20.0,), (0.1,)], "x double").select("x", numbers.magnitude_bins(F.col("x")).alias("b")).collect()
    got = {r.x: tuple(r.b) for r in rows}
    assert got[13.0] == (128, 128, 1.0, 0.0) and got[12.0] == (127, 127, 1.0, 0.0) and got[-20.0][:2] == (0, 0) and got[0.1][:2] == (64, 65)


class Dots:
    """A vocabulary of single characters; with ``peak``, ids are the process's peak memory in MB."""

    def __init__(self, peak: bool = False):
        self.peak = peak

    def mark(self, text: str) -> int:
        return 1

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        import resource

        i = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024 if self.peak else 2000
        return [(i if k == 0 else 2000 + k, k, k + 1) for k in range(len(text))]


def test_rows_leave_before_a_batch_is_done(spark):
    from filinglake.operators import examples, tokens

    words = Dots()
    docs = spark.range(40, numPartitions=1).selectExpr("id", "repeat('.', 200000) AS text")
    some = examples.tokenise(docs.limit(4), "id", "text", words)
    sizes = some.selectExpr("id", "seq_length", "size(input_ids) n", "size(is_number_mask) m", "size(number_values) v").collect()
    assert sorted(map(tuple, sizes)) == [(k, 200_002, 200_002, 200_002, 200_002) for k in range(4)]
    rows = tokens.chunk(some, 128, 1024).groupBy("id").agg({"doc_end": "max"}).collect()
    assert sorted(map(tuple, rows)) == [(k, 200_000) for k in range(4)]
    peak = examples.tokenise(docs, "id", "text", Dots(peak=True)).selectExpr("max(element_at(input_ids, 2)) AS mb").first().mb
    assert peak < 400  # MB; the lists of a batch are more
