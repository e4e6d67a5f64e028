"""Text functions for finding near-duplicate values."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Ship the scoring function itself to the executors, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITESPACE = r"[\s\p{Z}]+"


def normalize_text(column: Column, keep_unicode: bool = False) -> Column:
    """Lower case without anything but ASCII letters and digits; may end up empty.

    ``keep_unicode`` keeps letters and digits of every script instead.
    """
    dropped = r"[^\p{L}\p{N}]+" if keep_unicode else "[^a-z0-9]+"
    return F.regexp_replace(F.lower(column), dropped, "")


def token_sort(column: Column) -> Column:
    """Whitespace-separated tokens in sorted order, joined by one space."""
    tokens = F.filter(F.split(column, WHITESPACE), lambda token: token != "")
    return F.array_join(F.array_sort(tokens), " ")


#: Letters of the shorter string up to which a batch is scored as one matrix; one longer is a pair of its own, whose
#: bits are one whole number.
MATRIX_LETTERS = 256
#: Cells of the matrices that a batch is cut to.
MATRIX_CELLS = 1 << 22


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine operation per character of b."""
    places: dict[str, int] = {}
    for i, char in enumerate(a):
        places[char] = places.get(char, 0) | (1 << i)
    every = (1 << len(a)) - 1
    open_bits = every
    for char in b:
        hit = open_bits & places.get(char, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & every
    return len(a) - open_bits.bit_count()


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix, one row per text, and the lengths; what lies beyond a text's end is 0."""
    lengths = np.array([len(t) for t in texts])
    width = max(int(lengths.max(initial=0)), 1)
    joined = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).reshape(len(texts), width), lengths


def _common_lengths(a: list[str], b: list[str], at: np.ndarray | None = None, to: np.ndarray | None = None) -> np.ndarray:
    """``_common_length`` of many pairs at once, of ``a[at]`` and ``b[to]`` or of all in turn: loops run over positions, not over pairs.

    ``a`` has MATRIX_LETTERS letters at most.
    """
    (x, x_len), (y, y_len) = _letters(a), _letters(b)
    at, to = (np.arange(len(a)), np.arange(len(b))) if at is None else (at, to)
    order = np.argsort(-y_len[to], kind="stable")
    at, to = at[order], to[order]
    words = -(-x.shape[1] // 64)
    known, x_at = np.unique(x, return_inverse=True)
    if len(at) > 1 and len(a) > 1 and len(a) * (len(known) + 1) * words > MATRIX_CELLS:  # scripts with many letters
        common, half = np.empty(len(at), np.int64), len(a) // 2
        for low, high in ((0, half), (half, len(a))):
            within = np.flatnonzero((at >= low) & (at < high))
            used, ends = np.unique(to[within], return_inverse=True)
            if len(within):
                common[order[within]] = _common_lengths(a[low:high], [b[i] for i in used], at[within] - low, ends)
        return common
    x_at = x_at.reshape(x.shape)
    y_at = np.searchsorted(known, y)
    y_at[known[np.minimum(y_at, len(known) - 1)] != y] = len(known)
    y_at = np.ascontiguousarray(np.minimum(y_at, len(known)).T)
    # for each text of a and letter the places it has there, as bits
    rows, row = np.arange(len(a)), len(known) + 1
    places = np.zeros((words, len(a), row), np.uint64)
    for i in range(x.shape[1]):
        within = rows[x_len > i]
        places[i // 64, within, x_at[within, i]] |= np.uint64(1 << (i % 64))
    places = places.reshape(words, -1)
    open_bits = np.full((words, len(at)), ~np.uint64(0))
    start, ends = at * row, -y_len[to]
    for j in range(int(y_len.max(initial=0))):
        live = int(np.searchsorted(ends, -j))  # the pairs whose b goes on, as b falls in length
        cells = y_at[j].take(to[:live])
        cells += start[:live]
        carry = None
        for w in range(words):
            old = open_bits[w, :live]
            hit = places[w].take(cells)
            hit &= old
            total = old + hit
            if words > 1:
                over = total < old
                if carry is not None:
                    total += carry
                    over |= carry & (total == 0)
                carry = over
            old -= hit
            old |= total
    beyond = 64 * np.arange(words)[:, None] + 64 - x_len[at]  # bits of the word that lie behind the end of a
    used = np.where(beyond >= 64, np.uint64(0), ~np.uint64(0) >> np.clip(beyond, 0, 63).astype(np.uint64))
    common = np.empty(len(at), np.int64)
    common[order] = x_len[at] - np.bitwise_count(open_bits & used).sum(axis=0)
    return common


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs), np.int64)
    by_size: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(pairs):
        if len(x) > MATRIX_LETTERS:
            out[i] = _common_length(x, y)
        elif x:
            # like sizes together, so that no matrix is padded to more than twice its letters
            by_size.setdefault(len(y).bit_length(), []).append(i)
    for size, found in by_size.items():
        step = max(1, MATRIX_CELLS >> (size + 4))
        for at in range(0, len(found), step):
            part = found[at : at + step]
            out[part] = _common_lengths([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    return out


def similarity(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2.0 * _common_length(a, b) / total if total else 1.0


def similarities(a: list[str | None], b: list[str | None]) -> list[float | None]:
    known = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    common = common_lengths([a[i] for i in known], [b[i] for i in known]).tolist()
    out: list[float | None] = [None] * len(a)
    for i, length in zip(known, common):
        total = len(a[i]) + len(b[i])
        out[i] = 2.0 * length / total if total else 1.0
    return out


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Insert/delete similarity ``2*LCS/(len a + len b)`` of two strings, Arrow-batched."""
    return pd.Series(similarities(a.tolist(), b.tolist()), dtype="float64")


def _pairs_of(sizes_a: np.ndarray, sizes_b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in a and place in b of every pair of two rows of lists; of a list with itself each pair once."""
    n = sizes_a * sizes_b
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.divmod(place, np.maximum(sizes_b, 1)[row])
    kept = ~same[row] | (i < j)
    return row[kept], i[kept], j[kept]


def similar_in_blocks(threshold: float):
    """For ``mapInArrow``: rows of block, two lists of texts, and whether they are the same list, to the pairs whose ``indel_ratio`` is that or more."""

    def pairs(batches):
        for batch in batches:
            block, texts_a, texts_b = (batch.column(i) for i in range(3))
            same = np.array(batch.column(3).to_pylist(), bool)
            firsts = [np.asarray(t.offsets.to_numpy(), np.int64) for t in (texts_a, texts_b)]
            flat = [t.values for t in (texts_a, texts_b)]
            sizes = [np.diff(f) for f in firsts]
            lengths = [pc.utf8_length(f).to_numpy().astype(np.int64) for f in flat]
            # rows are taken together up to so many letters of pairs
            longest = max(int(n.max(initial=1)) for n in lengths)
            ends = np.cumsum(sizes[0] * sizes[1])
            low, most = 0, max(1, MATRIX_CELLS // longest)
            while low < len(ends):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
                row, i, j = _pairs_of(sizes[0][low:high], sizes[1][low:high], same[low:high])
                x, y = i + firsts[0][low:high][row], j + firsts[1][low:high][row]
                for step in range(0, len(row), most):
                    cut = slice(step, step + most)
                    yield from _similar(block, flat, lengths, row[cut] + low, x[cut], y[cut])
                low = high

    def _similar(block, flat, lengths, row, x, y):
        used_x, at = np.unique(x, return_inverse=True)
        used_y, to = np.unique(y, return_inverse=True)
        a, b = (f.take(pa.array(used)).to_pylist() for f, used in zip(flat, (used_x, used_y)))
        total = lengths[0][x] + lengths[1][y]
        if max(map(len, a)) <= MATRIX_LETTERS:
            common = _common_lengths(a, b, at, to)
        else:
            common = common_lengths([a[i] for i in at], [b[i] for i in to])
        score = 2.0 * common / total
        kept = np.flatnonzero(score >= threshold)
        if len(kept):
            columns = [block.take(pa.array(row[kept])), flat[0].take(pa.array(x[kept])), flat[1].take(pa.array(y[kept])), pa.array(score[kept])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "x_text", "y_text", "score"])

    return pairs


def within_reach(a: Column, b: Column, threshold: float) -> Column:
    """Lossless JVM-side screen for ``indel_ratio(a, b) >= threshold``.

    Levenshtein distance never exceeds insert/delete distance, and no common
    subsequence is longer than the shorter string. The small term keeps
    floating-point products from falling just under a whole number.
    """
    total = F.length(a) + F.length(b)
    budget = F.floor((1.0 - threshold) * total + 1e-9)
    return (2.0 * F.least(F.length(a), F.length(b)) >= threshold * total - 1e-9) & (F.levenshtein(a, b) <= budget)


def canonical_order(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an unordered pair, smaller first."""
    return F.least(a, b), F.greatest(a, b)
