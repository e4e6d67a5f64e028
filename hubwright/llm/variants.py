"""Spelling variants: words one edit apart, found through a reduced alphabet.

1. ``count_words``: words and how often they occur, reduced in each task before the shuffle.
2. ``reduced_alphabet``: the letters are dealt to a few symbols, so that each symbol is about equally frequent. There are as
   many symbols as make the reduced words of a length about as many as its words; so candidates per word stay few.
3. ``neighbourhoods``: all reduced words one edit away from a word's reduced form, as 64-bit keys. They are taken once for
   every unordered pair: the longer word's deletions meet the shorter word, so insertions are not
   needed, and of two replacements only the one by the greater symbol is made. Prefix and suffix hashes give each key in constant time, so
   a word takes as many steps as it has letters, however long it is.
4. ``near_pairs``: an equi-join of neighbourhoods with the reduced vocabulary, then the original words are compared. Words one edit apart have
   reduced forms that are equal or one edit apart, so no pair is lost; a pair is met once.
5. ``variants``: near words are counted, each word's form chosen, and forms followed by pointer doubling. A form is at least
   ``RATIO`` times as frequent, which bounds a chain by the logarithm of the counts.

Defined results: a null text has no words, a null id counts as empty in the checksum; rows that repeat count once each; near words of equal
count are taken in code-point order; a very long word is one row and keys of its letters; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import or_empty, table
from hubwright.session import stage_table

WORD = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One word in so many loses a letter, chosen by a checksum.
DAMAGED = 31
#: Symbols of a reduced alphabet.
FEWEST, MOST = 4, 64
#: Keys made at once.
KEYS = 1 << 20

_RANDOM = np.random.default_rng(12)
_VALUES = _RANDOM.integers(1, 1 << 63, MOST, dtype=np.uint64)
_BASE = np.uint64(int(_RANDOM.integers(1, 1 << 62)) * 4 + 1)


def runs(text: str) -> Column:
    """A text's words in order, A-Z in lower case."""
    lower = F.translate(or_empty(text), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def damaged(word: Column, doc_id: Column) -> Column:
    """The word, or in one case of ``DAMAGED`` the word without one letter: a stated rule by the checksum of id and word."""
    sum_ = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    place = (sum_ % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))
    return F.when(sum_ % DAMAGED == 0, cut).otherwise(word)


def count_words(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of a column ``word``."""
    counted = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def reduced_alphabet(vocabulary: DataFrame) -> tuple[dict[int, int], int]:
    """Each letter's symbol and the number of symbols; the driver sees letters and lengths, not words."""
    lengths = vocabulary.groupBy(F.length("word").alias("letters")).count().collect()
    wanted = max((r["count"] ** (1 / r["letters"]) for r in lengths), default=0)
    symbols = min(max(math.ceil(wanted) + 1, FEWEST), MOST)
    counts = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count().collect()
    load, symbol_of = [0] * symbols, {}
    for r in sorted((r for r in counts if r["letter"]), key=lambda r: (-r["count"], r["letter"])):
        least = load.index(min(load))
        symbol_of[ord(r["letter"])] = least
        load[least] += r["count"]
    return symbol_of, symbols


def _keys(reduced: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own key of each row of a matrix of symbols; its neighbours' keys, and the rows they belong to."""
    m, n = reduced.shape
    value = _VALUES[reduced]
    power = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, _BASE))])
    before, after = np.zeros((m, n + 1), np.uint64), np.zeros((m, n + 1), np.uint64)
    for i in range(n):
        before[:, i + 1] = before[:, i] * _BASE + value[:, i]
    for i in range(n - 1, -1, -1):
        after[:, i] = after[:, i + 1] + value[:, i] * power[n - 1 - i]
    # words of different length never share a key but by chance
    same, shorter = _VALUES[:1] * np.uint64(n), _VALUES[:1] * np.uint64(n - 1)
    own = after[:, 0] ^ same
    deleted = (before[:, :n] * power[:n][::-1] + after[:, 1:]) ^ shorter
    # letters of a run leave the same word: the last one stands for all
    last_of_run = np.concatenate([reduced[:, :-1] != reduced[:, 1:], np.ones((m, 1), bool)], axis=1)
    rows, places = np.nonzero(last_of_run)
    keys, owners = [deleted[rows, places]], [rows]
    for s in range(1, symbols):
        rows, places = np.nonzero(reduced < s)
        keys.append((after[rows, 0] + (_VALUES[s] - value[rows, places]) * power[n - 1 - places]) ^ same)
        owners.append(rows)
    return own, np.concatenate(keys), np.concatenate(owners)


def neighbourhoods(vocabulary: DataFrame, symbol_of: dict[int, int], symbols: int) -> DataFrame:
    """id, key, own of ``vocabulary`` (id, word): a word's own key, and the keys of its half of the neighbourhood."""
    letters = np.zeros(max(symbol_of, default=0) + 1, np.int64)
    for code, symbol in symbol_of.items():
        letters[code] = symbol

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            by_length = defaultdict(list)
            for row, word in enumerate(words):
                by_length[len(word)].append(row)
            for n, rows in by_length.items():
                step = max(1, KEYS // (n * symbols))
                for at in range(0, len(rows), step):
                    part = np.array(rows[at : at + step])
                    text = "".join(words[i] for i in part.tolist())
                    reduced = letters[np.frombuffer(text.encode("utf-32-le"), np.uint32)].reshape(len(part), n)
                    own, keys, owners = _keys(reduced, symbols)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([ids[part], ids[part[owners]]])),
                            pa.array(np.concatenate([own, keys]).view(np.int64)),
                            pa.array(np.repeat([True, False], [len(own), len(keys)])),
                        ],
                        ["id", "key", "own"],
                    )

    return vocabulary.select("id", "word").mapInArrow(make, "id long, key long, own boolean")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, word_a, n_a, b, word_b, n_b: every unordered pair of words at exactly one edit, once. ``vocabulary`` (id, word, n): written before."""
    made = neighbourhoods(vocabulary, *reduced_alphabet(vocabulary))
    made = stage_table(made)
    around = made.select(F.col("id").alias("a"), "key", "own")
    reduced = made.where("own").select(F.col("id").alias("b"), "key")
    # words of one reduced form meet from both sides, all others from one
    met = around.join(reduced, "key").where("not own or a < b").select("a", "b")
    for end in "ab":
        met = met.join(vocabulary.select(F.col("id").alias(end), F.col("word").alias(f"word_{end}"), F.col("n").alias(f"n_{end}")), end)
    return met.where(F.levenshtein("word_a", "word_b", 1) == 1)


def variants(counted: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of ``counted`` (word, n): distinct words."""
    vocabulary = stage_table(counted.select("word", "n", F.monotonically_increasing_id().alias("id")))
    pairs = stage_table(near_pairs(vocabulary))
    ends = [pairs.select(F.col(x).alias("id"), F.col(y).alias("near"), F.col(f"word_{y}").alias("word"), F.col(f"n_{y}").alias("n")) for x, y in ("ab", "ba")]
    best = F.min(F.struct((-F.col("n")).alias("less"), "word", "near")).alias("best")
    near = ends[0].union(ends[1]).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best)
    often = -F.col("best.less") >= ratio * F.col("n")
    named = vocabulary.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(often, value).alias(name) for name, value in (("form", F.col("best.word")), ("form_n", -F.col("best.less")), ("to", F.col("best.near")))],
    )
    named = stage_table(named)
    links = named.where("to is not null").select("id", "to")
    # each step of a chain multiplies the count, so the greatest count bounds its length; a round doubles what has been followed
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(most, ratio)) + 1
    for _ in range(max(steps - 1, 0).bit_length()):
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("further"))
        links = stage_table(links.join(onward, "to", "left").select("id", F.coalesce("further", "to").alias("to")))
    roots = links.join(vocabulary.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return named.join(roots, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus, its form and root."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(runs("text")).alias("run"))
    return variants(count_words(words.select(damaged(F.col("run"), F.col("doc_id")).alias("word"))))
