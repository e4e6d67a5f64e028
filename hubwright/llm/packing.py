"""Packing documents into fixed windows: best-fit decreasing.

``tokenize`` cuts each document's ids into full windows and a rest; ``pack`` puts
the pieces into windows by best-fit decreasing. The open windows of a group are
kept by remaining capacity, and a segment tree over the capacities finds the
tightest one that still takes a piece.

Pieces are packed in groups by a hash of their document. A group has a bounded
number of pieces on average, so a task's memory does not grow with the corpus, and
it ends with at most a few unfilled windows. The text itself is never shuffled:
``pack`` needs lengths only, and ``windows`` fetches ids for sequences on demand.

Defined results: a null text counts as empty and is packed as its closing id;
rows that repeat are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from hubwright.llm import bpe
from hubwright.llm.common import or_empty, table, told_apart, values
from hubwright.session import stage_table

TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks.
RANKS = "byte_bpe_50k.tiktoken"
WINDOW = 2048
#: Closes each document.
END = 1
#: Documents to a group, on average.
GROUP_DOCS = 4096


class Coder:
    """Ids of whole texts as the tokenizers library gives them, as an array of little-endian unsigned 32-bit numbers.

    The library takes three times as long as the merges themselves. So where a rank
    file of the same vocabulary is given, a text is encoded by that, unless it holds an added
    token or a character on whose class the two libraries may differ.
    """

    def __init__(self, path: str, ranks_path: str | None) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = ranks_path and bpe.encoding(ranks_path, public_tokenizers.PATTERN)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.needs_library = re.compile("|".join([*added, f"[{newer_characters()}]"])).search

    def __call__(self, text: str) -> np.ndarray:
        if self.ranks is None or self.needs_library(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = bpe.encode_text(text, self.ranks)
        return np.asarray(ids, "<u4")


def newer_characters() -> str:
    """Characters without a class in Unicode 3.2, as ranges of a regex class: libraries may know them from different versions."""
    old = unicodedata.ucd_3_2_0.category
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        new = c <= sys.maxunicode and old(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(ranges)


@lru_cache(2)
def coder(path: str, ranks_path: str | None) -> Coder:
    return Coder(path, ranks_path)


def tokenize(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, and ids (array<int>) if asked for."""
    columns = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = coder(tokenizer_path, ranks_path), np.asarray([end], "<u4")
        for batch in batches:
            owner, numbers, ids = [], [], []
            for row, t in enumerate(values(batch.column(1))):
                data = np.concatenate([encode(t), close])
                for start in range(0, len(data), window):
                    piece = data[start : start + window]
                    owner.append(row)
                    numbers.append((start, len(piece), zlib.crc32(piece.tobytes()), len(data)))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            made = np.asarray(numbers, np.int64).reshape(-1, 4)
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(made[:, i]) for i in range(4))]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [doc_id, *columns] + ["ids"] * with_ids
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + ", ".join(f"{c} long" for c in columns) + ", ids array<int>" * with_ids
    return docs.select(doc_id, or_empty(text).alias("text")).mapInArrow(run, schema)


class Capacities:
    """Open windows by remaining capacity; the segment tree holds how many there are in each range of capacities."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, at: int) -> None:
        self.open[capacity].append(at)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, length: int) -> tuple[int, int] | None:
        """Remove a window of the least capacity that is at least ``length``: (capacity, window)."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            # up to the first ancestor with windows to the right, then down along the left edge
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` in falling order."""
    free, used = Capacities(window), 0
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        found = free.take_tightest(length)
        if found is None:
            found, used = (window, used), used + 1
        capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > length:
            free.add(capacity - length, at)
    return number, offset


def pack(pieces: DataFrame, doc_id: str = "doc_id", window: int = WINDOW, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (written before, as they are counted): every piece lies in one window, gapless.

    A group's number is part of sequence_id, so numbers are unique but not dense.
    """
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    schema = pieces.drop("ids").schema.simpleString()[len("struct<") : -1] + ", sequence_id long, offset long"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["pack_group"].iloc[0])
        # an order of its own makes a repeated task give the same windows
        group = group.drop(columns="pack_group").sort_values(["length", doc_id, "start", "ids_crc32"], ascending=[False, True, True, True])
        at, offset = best_fit_decreasing(group["length"].to_numpy(), window)
        return group.assign(sequence_id=(np.int64(number) << 32) + at, offset=offset)

    # pieces of one text spread by their own values; those that many rows repeat are told apart
    own = {c: F.col(f"`{c}`") for c in (doc_id, "doc_tokens", "ids_crc32")}
    told = told_apart(pieces.drop("ids"), own, "pack_lot", group_docs)
    group = F.pmod(F.xxhash64(*own.values(), "pack_lot"), F.lit(groups))
    return told.withColumn("pack_group", group).drop("pack_lot").groupBy("pack_group").applyInPandas(run, schema)


def windows(pieces: DataFrame, packed: DataFrame, doc_id: str = "doc_id", window: int = WINDOW, pad: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id and ids, padded to ``window``. ``pieces`` with ids.

    Pieces with the same values hold the same ids, so one of them stands for all, and rows that repeat or have no id find theirs.
    """
    same = ["start", "length", "ids_crc32", "doc_tokens"]
    held = pieces.groupBy(doc_id, *same).agg(F.first("ids").alias("ids")).withColumnRenamed(doc_id, "_owner")
    of = packed[doc_id].eqNullSafe(held["_owner"])
    for c in same:
        of = of & (packed[c] == held[c])
    placed = packed.join(held, of).select("sequence_id", "offset", "ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(parts, lambda p: p["ids"]))
    filled = F.concat(ids, F.array_repeat(F.lit(pad), window - F.size(ids)))
    return placed.groupBy("sequence_id").agg(filled.alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(stage_table(tokenize(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))))


def op4_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where each lies."""
    return pack_documents(table(spark, sf_dir, "documents"))
