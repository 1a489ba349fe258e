import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from filinglake.llm import _bpe, token_counts, token_io
from filinglake.llm import queries as Q

TEXTS = [
    (3, "The cat sat.\nOn the mat, it's 12.5%!"),
    (1, None),
    (2, ""),
    (None, "no id"),
    (7, " lead\n\n  two  spaces \n"),
    (7, " lead\n\n  two  spaces \n"),
    (5, "naïve café 😀\nñandú " * 3),
    (9, "<|endoftext|> plain"),
    (8, "word " * 30_000),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def enc():
    return _bpe.ChunkEncoder(_bpe.default_tokenizer())


@pytest.fixture(scope="module")
def lib():
    """The library as it comes, to compare with."""
    return Tokenizer.from_file(_bpe.default_tokenizer())


@pytest.mark.parametrize("text", [t for _, t in TEXTS if t] + ["a \n b", "\n", "x\x1c y", "  ", "don't  I'll", "a  b", "x" * 300, "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|>\n"])
def test_chunks_encode_as_the_whole(enc, lib, text):
    ids = enc.encode(text)
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert enc.ends(ids)[-1] == len(text.encode())


def test_odd_strings_encode_as_the_library(enc, lib):
    r = random.Random(3)
    small = _bpe.ChunkEncoder(_bpe.default_tokenizer(), memo_items=40)
    parts = ["a", "the", " ", "  ", "\n", "\t", "<|endoftext|>", "é", "\u2003", "\u3000", "1", "23", ",", "'s", "'ll", "\x1c", "\x85", "x" * 60, "😀", "Ġ", "Ċ", "|>", "<|", "ñandú", "İ", "\xa0"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = lib.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == want and small.encode(text).tolist() == want, repr(text)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_whole_tables_as_the_library_gives_them(spark, lib, sf):
    """op1 and op9 on every document, against the library's ids and offsets."""
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    encoded = lib.encode_batch([t for _, t in docs], add_special_tokens=False)
    want, counts, start = [], {}, 0
    for (i, t), e in zip(docs, encoded):
        ids = [*e.ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        line_of = np.cumsum([0] + [c == "\n" for c in t])
        for a, _ in e.offsets:
            counts[(i, int(line_of[a]))] = counts.get((i, int(line_of[a])), 0) + 1
    assert sorted(map(tuple, Q.op9_token_ids(spark, sf).collect())) == want
    assert {(r.doc_id, r.section): r.n_tokens for r in Q.op1_token_counts(spark, sf).collect() if r.n_tokens} == counts


def test_memo_stays_bounded_and_right(lib):
    small = _bpe.ChunkEncoder(_bpe.default_tokenizer(), memo_items=20)
    text = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnop'[i % 6]}, x" for i in range(300))
    assert small.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert len(small.memo) <= 21


def test_round_trip(spark, lib):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], SCHEMA + ", start string")
    got = sorted(map(tuple, token_io.read(token_io.write(docs, eos_id=2)).collect()), key=lambda r: r[1])
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_reader_fetches_single_documents(tmp_path):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype("<u4") for n in (0, 5, 200_000, 65_536, 1)]
    with open(tmp_path / "f.zst", "wb") as f:
        w = token_io.TokenFileWriter(f)
        for k, d in enumerate(docs):
            w.add(k, d)
        w.close()
    size = (tmp_path / "f.zst").stat().st_size
    assert size == w.n_bytes
    with open(tmp_path / "f.zst", "rb") as f:
        r = token_io.TokenFileReader(f, size)
        for k, d in enumerate(docs):
            assert np.array_equal(r.document(k), d)
        touched = []
        r.frame, whole = lambda k: (touched.append(k), whole(k))[1], r.frame
        r.document(1)
        assert touched == [0]
    import zstandard

    with open(tmp_path / "f.zst", "rb") as f:  # any zstandard reader skips the tables
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == np.concatenate(docs).tobytes()


def test_a_damaged_frame_is_noticed(tmp_path):
    p = tmp_path / "f.zst"
    with p.open("wb") as f:
        w = token_io.TokenFileWriter(f)
        w.add(0, np.arange(1000, dtype="<u4"))
        w.close()
    raw = bytearray(p.read_bytes())
    raw[40] ^= 255
    p.write_bytes(raw)
    with p.open("rb") as f, pytest.raises(Exception):
        token_io.TokenFileReader(f, len(raw)).document(0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert token_io.read(token_io.write(docs)).collect() == []
    assert token_counts.token_counts(docs).collect() == []


def test_ids_of_every_kind_come_back(spark):
    rows = [(i, "x") for i in (-(1 << 63), (1 << 63) - 1, 0, None, None)]
    got = token_io.read(token_io.write(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, -(1 << 63), 0, (1 << 63) - 1]


def brute_counts(lib, text):
    """Tokens by the line of their first character, from the library's own offsets."""
    e = lib.encode(text, add_special_tokens=False)
    line_of = np.cumsum([0] + [c == "\n" for c in text])
    out = {}
    for a, _ in e.offsets:
        out[int(line_of[a])] = out.get(int(line_of[a]), 0) + 1
    return out


def test_counts_by_line_match_the_offsets(spark, lib):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    rows = token_counts.token_counts(docs).collect()
    for i, t in TEXTS:
        if i in (None, 7):
            continue
        got = {r.section: r.n_tokens for r in rows if r.doc_id == i and r.n_tokens}
        assert got == brute_counts(lib, t or "")
    assert sum(r.doc_id is None for r in rows) == 1
    assert sum(r.doc_id == 7 for r in rows) == 6


def test_rules_at_a_boundary():
    ends = np.array([2, 6, 9])
    spans = np.array([[0, 3], [3, 9]])
    assert token_counts.attribute(ends, spans, "first")[0].tolist() == [2, 1]
    assert token_counts.attribute(ends, spans, "largest")[0].tolist() == [1, 2]
    assert token_counts.attribute(ends, spans, "split")[0].tolist() == [1.25, 1.75]
    assert token_counts.attribute(ends, spans, "first")[1].tolist() == [1, 1]


def test_spans_of_fields_and_tokens_outside(spark):
    docs = spark.sql("select 1L doc_id, 'é title. Body text here' text, array(named_struct('start', 0, 'end', 7)) spans")
    rows = token_counts.token_counts(docs, spans_col="spans").collect()
    assert [(r.section, r.start, r.end) for r in rows] == [(0, 0, 8), (None, None, None)]
    assert rows[0].n_tokens + rows[1].n_tokens == len(_bpe.encoder(_bpe.default_tokenizer()).encode("é title. Body text here"))
