"""Byte-level BPE and packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from odd_rows import ODD
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from hubwright.llm import bpe, packing

RANKS = public_tokenizers.path(bpe.RANKS)
CODER = bpe.encoding(RANKS, public_tokenizers.PATTERN)


def test_round_trip_of_odd_texts(spark, odd):
    out = odd.select("doc_id", "text", bpe.round_trip(F.col("text"), RANKS).alias("both")).collect()
    assert len(out) == len(ODD)
    for r in out:
        if r.text is None:
            assert r.both.ids is None and r.both.decoded is None
        else:
            assert bytes(r.both.decoded).decode() == r.text
            assert r.both.ids == CODER.encode_ordinary(r.text)
    apart = odd.where("doc_id = 7").select(bpe.encode(F.col("text"), RANKS).alias("ids")).select(bpe.decode(F.col("ids"), RANKS).alias("d"))
    assert bytes(apart.first().d).decode() == ODD[7][1]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'sé 1!\n\t\u00a0\x1c東", max_size=80))
def test_cuts_are_safe(text):
    pieces = []
    chars, run = bpe.PIECE_CHARS, bpe._LONG_SPACES
    try:
        bpe.PIECE_CHARS, bpe._LONG_SPACES = 5, bpe.re.compile(rf"[{bpe._SPACE}]{{3,}}")
        pieces = list(bpe.safe_pieces(text))
        ids = bpe.encode_text(text, CODER).tolist() if len(text) > 5 else CODER.encode_ordinary(text)
    finally:
        bpe.PIECE_CHARS, bpe._LONG_SPACES = chars, run
    assert "".join(p for p, _ in pieces) == text
    assert ids == CODER.encode_ordinary(text)


def test_white_space_beyond_the_librarys_stack():
    text = "a" + " " * 1_200_000 + "b"
    ids = bpe.encode_text(text, CODER)
    assert CODER.decode_bytes(ids.tolist()).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_tokenizers(text):
    coder = packing.coder(public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))
    assert coder(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, window):
    free, places = [], []
    for n in lengths:
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            i = min(fits)[1]
        else:
            i = len(free)
            free.append(window)
        places.append((i, window - free[i]))
        free[i] -= n
    return len(free), [o for _, o in places]


@pytest.mark.parametrize("window", [1, 7, 64])
def test_best_fit_decreasing(window):
    rng = random.Random(window)
    lengths = np.sort([rng.randint(1, window) for _ in range(300)])[::-1]
    number, offset = packing.best_fit_decreasing(lengths, window)
    used, offsets = plain_best_fit(lengths.tolist(), window)
    assert number.max() + 1 == used and offset.tolist() == offsets
    assert packing.best_fit_decreasing(lengths[:0], window)[0].size == 0


def test_packing_of_odd_texts(spark, odd, no_docs):
    path = public_tokenizers.path(packing.TOKENIZER)
    pieces = packing.tokenize(odd, path, window=64, with_ids=True).cache()
    packed = packing.pack(pieces, window=64, group_docs=5)
    rows = packed.collect()
    tokenizer = packing.coder(path, None).tokenizer
    want = sorted(
        (d is None, d or 0, i, i_piece.tolist())
        for d, t, *_ in ODD
        for ids in [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")]
        for i in range(0, len(ids), 64)
        for i_piece in [ids[i : i + 64]]
    )
    got = sorted((r.doc_id is None, r.doc_id or 0, r.start, r.ids) for r in pieces.collect())
    assert got == want
    crc = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces.collect()}
    windows = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == crc[r.doc_id, r.start]
        windows[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == len(want)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    full = packing.windows(pieces.where("doc_id = 8"), packed.where("doc_id = 8"), window=64).collect()
    assert sum(r.ids.count(1) for r in full) == 1 and {len(r.ids) for r in full} == {64}
    assert packing.pack_documents(no_docs).collect() == []


def test_a_third_of_all_rows_repeat(spark):
    """Pieces of one repeated row are dealt to many groups, and each window is found again with all its ids."""
    docs = spark.createDataFrame([(1, "the same text again")] * 3000 + [(None, "no id")] * 3000 + [(i, f"text {i}") for i in range(2, 3000)], "doc_id long, text string")
    pieces = packing.stage_table(packing.tokenize(docs.repartition(4), public_tokenizers.path(packing.TOKENIZER), window=64, with_ids=True))
    packed = packing.stage_table(packing.pack(pieces, window=64, group_docs=500))
    assert packed.count() == pieces.count() == 8998
    groups = Counter(r.sequence_id >> 32 for r in packed.collect())
    assert len(groups) > 10 and max(groups.values()) < 1500
    full = packing.windows(pieces, packed, window=64)
    ends = full.selectExpr("size(filter(ids, x -> x = 1)) AS n").groupBy().sum("n").first()[0]
    assert ends == 8998 and full.where("size(ids) <> 64").isEmpty()
