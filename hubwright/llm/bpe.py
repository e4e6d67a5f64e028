"""Byte-level BPE encoding and decoding with the tiktoken library.

``encode`` and ``decode`` are Arrow functions on columns, so they take part in any
select beside other columns. Defined results: a null text is a null array, an empty
text an empty array; a null array decodes to null, an empty one to no bytes. A text
of any length is encoded whole: ``safe_pieces`` only cuts it where no match of the
pattern can reach across.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import hex_digest, or_empty, table, values

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Characters per call of the library; texts up to this length are not cut.
PIECE_CHARS = 1 << 16
#: A run of white space from this length on is merged as one piece, as the library's regex runs out of stack on longer ones.
LONG_RUN = 1 << 16

# What the pattern's \s means (Python's \s has four characters more).
_SPACE = r"\t-\r \x85\xa0  -     　"
_LONG_SPACES = re.compile(rf"[{_SPACE}]{{{LONG_RUN},}}")
#: No match ends in the middle of "word, then white space", nor looks beyond the space's start.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])")


@lru_cache(4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a local rank file, without special tokens; loaded once per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of a text that can be encoded apart, and whether one is a single run of white space.

    Of a run of white space before a word the pattern leaves the last character
    to the word, so a long run is one match without that character.
    """
    start = 0
    for run in _LONG_SPACES.finditer(text):
        yield from _cut(text, start, run.start())
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : start], True
    yield from _cut(text, start, len(text))


def _cut(text: str, start: int, end: int) -> Iterator[tuple[str, bool]]:
    while end - start > PIECE_CHARS:
        found = _SAFE.search(text, start + PIECE_CHARS, end)
        if not found:
            break
        yield text[start : found.start()], False
        start = found.start()
    if start < end:
        yield text[start:end], False


def encode_text(text: str, coder: tiktoken.Encoding) -> np.ndarray:
    if len(text) <= PIECE_CHARS:
        return coder.encode_to_numpy(text, disallowed_special=())
    parts = [
        np.asarray(coder._encode_single_piece(piece), np.uint32) if spaces else coder.encode_to_numpy(piece, disallowed_special=())
        for piece, spaces in safe_pieces(text)
    ]
    return np.concatenate(parts)


def _encoded(texts: pa.Array, coder: tiktoken.Encoding) -> pa.ListArray:
    ids = [None if t is None else encode_text(t, coder) for t in values(texts)]
    sizes = np.fromiter((0 if i is None else len(i) for i in ids), np.int64, len(ids))
    flat = np.concatenate([np.zeros(0, np.uint32), *(i for i in ids if i is not None)]).astype(np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([i is None for i in ids], pa.bool_()))


def _decoded(arrays: pa.ListArray, coder: tiktoken.Encoding) -> pa.Array:
    flat, offsets = arrays.values.to_numpy(zero_copy_only=False), arrays.offsets.to_numpy()
    known = arrays.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(
        [coder.decode_bytes(flat[a:b].tolist()) if k else None for a, b, k in zip(offsets[:-1], offsets[1:], known)], pa.binary()
    )


def encode(text: Column, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """array<int>: the ids of each text."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _encoded(texts, encoding(ranks_path, pattern))

    return run(text)


def decode(ids: Column, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """binary: the bytes of each array of ids; they need not be valid UTF-8, as any cut of ids can be decoded."""

    @F.arrow_udf("binary")
    def run(arrays: pa.Array) -> pa.Array:
        return _decoded(arrays, encoding(ranks_path, pattern))

    return run(ids)


def round_trip(text: Column, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """struct of ``ids`` and ``decoded``: both functions on one Arrow batch, so that the ids pass to Spark once."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def run(texts: pa.Array) -> pa.Array:
        coder = encoding(ranks_path, pattern)
        ids = _encoded(texts, coder)
        return pa.StructArray.from_arrays([ids, _decoded(ids, coder)], ["ids", "decoded"])

    return run(text)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    ranks = public_tokenizers.path(RANKS)
    both = table(spark, sf_dir, "documents").select("doc_id", round_trip(or_empty("text"), ranks).alias("both"))
    return both.select(
        "doc_id",
        F.size("both.ids").cast("long").alias("n_tokens"),
        hex_digest(F.concat_ws(",", F.col("both.ids").cast("array<string>"))).alias("ids_sha256"),
        hex_digest(F.col("both.decoded")).alias("decoded_sha256"),
    )
