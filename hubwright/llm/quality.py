"""Quality classifier from weak labels.

1. Overlapping heuristics vote on every document: bad, good or no vote.
2. Votes are counted by pattern over all documents. A pattern has one of three values per labeller, so
   there are at most 3 ** len(LABELLERS) of them, whatever the corpus; the counts are all that
   expectation-maximisation needs. It estimates each labeller's rate of each vote
   among good and among bad documents, and from these each pattern's posterior.
3. The posteriors are the labels on which a linear scorer of hashed features is trained. Its sample takes from each
   pattern its share of FIT_DOCS different documents, LEAST_DOCS at least, with the smallest hashes; each weighs as many
   documents as it stands for. So a rare kind of defect takes part at any size.
4. The scorer judges every document; those with a score below REJECT_BELOW are rejected.

No given labels are used. Defined results: a null text counts as empty; an empty text gets no votes
and is kept; rows that repeat are voted on and judged alike; an empty table gives an empty result;
without any vote for bad every document is kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hubwright.llm.common import or_empty, table, values
from hubwright.session import stage_table

#: Documents on which the scorer is fitted, and how many a pattern adds to them at least: FIT_DOCS + LEAST_DOCS for each
#: pattern bounds what a fit reads.
FIT_DOCS, LEAST_DOCS = 4096, 8
#: How many times as many lots as are taken of a pattern are ranked on average; fewer than are taken is so all but impossible.
SPARE = 8
#: Odds of two to one against a document: to lose a clean one costs more than to keep a bad one.
REJECT_BELOW = 1 / 3
#: Hashed features.
FEATURES = 1 << 14
#: Words that the share of a feature is smoothed by: a few words prove little.
SMOOTHING = 12
CACHED_WORDS = 100_000

#: The largest share of good documents on which a labeller is taken to vote bad.
FALSE_ALARMS = 0.01

BAD, NONE, GOOD = "b", "-", "g"


@dataclass(frozen=True)
class Signals:
    """What the labellers look at; shares are per word."""

    words: int
    different: float
    repeats: float
    top: float
    upper: float
    exclamations: float
    bars: float
    symbols: float
    marks: float
    length: float
    short: float


def signals(text: str) -> tuple[Signals, Counter]:
    words = text.split()
    n = len(words)
    seen = Counter(words)
    if not n:
        return Signals(0, *[0.0] * 10), seen
    chars = sum(map(len, words))
    bars, exclamations = text.count("|"), text.count("!")
    symbols = sum(map(text.count, "#$%&*@^~<>{}\\"))
    marks = bars + exclamations + symbols + sum(map(text.count, ".,;:?-_=+/()[]\"'"))
    return (
        Signals(
            n,
            len(seen) / n,
            sum(map(str.__eq__, words, words[1:])) / n,
            max(seen.values()) / n,
            sum(c for w, c in seen.items() if w.isupper() and len(w) > 1) / n,
            exclamations / n,
            bars / n,
            symbols / n,
            marks / chars,
            chars / n,
            sum(c for w, c in seen.items() if len(w) <= 4 and w.isalpha()) / n,
        ),
        seen,
    )


def _vote(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NONE


#: name -> vote; a labeller that has too few words to tell gives no vote.
LABELLERS = {
    "word_repeats": lambda s: _vote(s.words >= 8 and s.repeats > 0.3, s.words >= 8 and s.repeats < 0.1),
    "few_different_words": lambda s: _vote(s.words >= 40 and s.different < 0.3, s.words >= 40 and s.different > 0.45),
    "one_word_rules": lambda s: _vote(s.words >= 20 and s.top > 0.25, s.words >= 20 and s.top < 0.15),
    "shouting": lambda s: _vote(s.words >= 5 and s.upper > 0.4, s.words >= 5 and s.upper < 0.2),
    "exclamations": lambda s: _vote(s.words >= 5 and s.exclamations > 0.3, s.words >= 5 and s.exclamations < 0.1),
    "table_bars": lambda s: _vote(s.words >= 5 and s.bars > 0.15, s.words >= 5 and s.bars < 0.05),
    "symbols": lambda s: _vote(s.words >= 5 and s.symbols > 0.5, s.words >= 5 and s.symbols < 0.25),
    "many_marks": lambda s: _vote(s.words >= 8 and s.marks > 0.18, s.words >= 8 and s.marks < 0.12),
    "odd_word_length": lambda s: _vote(s.words >= 20 and not 2.5 < s.length < 12, s.words >= 20 and 3.5 < s.length < 6.5),
    "no_small_words": lambda s: _vote(s.words >= 30 and s.short < 0.08, s.words >= 20 and 0.2 < s.short < 0.9),
}


def votes_on(seen: Signals) -> str:
    """One letter per labeller."""
    return "".join(labeller(seen) for labeller in LABELLERS.values())


def votes(text: str) -> str:
    return votes_on(signals(text)[0])


def fit_label_model(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior of good for each pattern of votes, by expectation-maximisation over the pattern counts.

    Documents are good, or bad in one of several ways. There is a way for each labeller, which starts
    with what that labeller calls bad; labellers that overlap come to share ways. With one single class of bad documents,
    labellers of other defects would outvote the one or two that see this one. Each class has its rate
    of each labeller's votes; false alarms among good documents are held to FALSE_ALARMS.
    Having no vote is no evidence: it tells of a text's length more than of its quality.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    hot = np.array([[(v == BAD, v == GOOD) for v in p] for p in patterns], float)  # pattern, labeller, vote
    bad = hot[:, :, 0]
    # class 0 is good; one bad vote alone may be a false alarm
    share = np.concatenate([np.where(bad.sum(1) > 1, 0, 1)[:, None], bad], axis=1)
    share /= share.sum(1, keepdims=True)
    for _ in range(rounds):
        weight = n[:, None] * share  # pattern, class
        prior = weight.sum(0) + 0.1
        prior /= prior.sum()
        rates = np.einsum("pc,plv->clv", weight, hot) + 0.1
        rates /= rates.sum(2, keepdims=True)
        rates[0, :, 0] = np.minimum(rates[0, :, 0], FALSE_ALARMS)
        log = np.log(prior) + np.einsum("plv,clv->pc", hot, np.log(rates))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return dict(zip(patterns, share[:, 0].tolist()))


class _Classes(dict):
    """Letters as a or A, digits as 0, all else as it is."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = ord("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c)
        return self[code]


_CLASSES = _Classes()
_RUNS = re.compile(r"(.)\1+", re.S)


@lru_cache(CACHED_WORDS)
def word_features(word: str) -> tuple[int, int]:
    """The hashed word and the hashed shape of a word."""
    shape = _RUNS.sub(r"\1", word.translate(_CLASSES))
    return zlib.crc32(b"w" + word.lower().encode()) % FEATURES, zlib.crc32(b"s" + shape.encode()) % FEATURES


_REPEAT = zlib.crc32(b"repeat") % FEATURES


def features_of(seen: Signals, words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the hashed features: roots of smoothed shares of words, shapes and repeats."""
    pairs = np.array([word_features(w) for w in words], np.int64).reshape(-1, 2)
    counts = np.fromiter(words.values(), np.float64, len(words))
    at = np.concatenate([pairs[:, 0], pairs[:, 1], [_REPEAT]])
    total = np.bincount(at, np.concatenate([counts, counts, [seen.repeats * seen.words]]), FEATURES)
    used = np.flatnonzero(total)
    return used, np.sqrt(total[used] / (seen.words + SMOOTHING))


def fit_scorer(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, stands_for: np.ndarray, rounds: int = 200, penalty: float = 1e-4
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam: weights and offset. Both classes weigh the same, a row as many as it stands for."""
    weights, offset = np.zeros(FEATURES), 0.0
    if not len(rows) or labels.min() > 0.5 or labels.max() < 0.5:
        return weights, 1.0 if not len(rows) or labels.min() > 0.5 else -1.0
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    at, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    good, bad = labels * stands_for, (1 - labels) * stands_for
    share = good / good.sum() / 2 + bad / bad.sum() / 2
    m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(owner, value * weights[at], len(rows)) + offset
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - labels) * share
        gradient = np.append(np.bincount(at, value * error[owner], FEATURES) + penalty * weights, error.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights, offset = weights - move[:-1], offset - move[-1]
    return weights, float(offset)


def score_of(at: np.ndarray, value: np.ndarray, weights: np.ndarray, offset: float) -> float:
    """Probability of good."""
    return float(1 / (1 + np.exp(-np.clip(value @ weights[at] + offset, -50, 50))))


def _mapped(docs: DataFrame, keys: list[str], text: str, columns: dict[str, tuple[str, pa.DataType]], each) -> DataFrame:
    """``keys`` and, for every text, the values that ``each`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [each(t) for t in values(batch.column(len(keys)))]
            arrays = [pa.array([row[i] for row in made], kind) for i, (_, kind) in enumerate(columns.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *arrays], [*keys, *columns])

    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} {sql}" for c, (sql, _) in columns.items()])
    return docs.select(*keys, or_empty(text).alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    posterior: dict[str, float]  # of good, by pattern of votes
    weights: np.ndarray
    offset: float

    def judge(self, text: str) -> tuple[str, float, float, bool]:
        """Votes, posterior, score, and whether the text is kept. A pattern not seen by the fit gets one half."""
        seen, words = signals(text)
        cast, score = votes_on(seen), score_of(*features_of(seen, words), self.weights, self.offset)
        return cast, self.posterior.get(cast, 0.5), score, not words or score >= REJECT_BELOW

    def keeps(self, text: Column) -> Column:
        """boolean: so that a table can be filtered in place, without a join."""

        @F.arrow_udf("boolean")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([self.judge(t)[3] for t in values(texts)], pa.bool_())

        return run(or_empty(text))


def fit(docs: DataFrame, keys: list[str], text: str = "text", fit_docs: int = FIT_DOCS) -> Model:
    """Label model over all of ``docs``; scorer on a sample of each pattern, the smallest hashes of ``keys`` and text."""
    hashed = docs.select(F.xxhash64(*keys, or_empty(text)).alias("hash"), or_empty(text).alias("text"))
    voted = stage_table(_mapped(hashed, ["hash"], "text", {"votes": ("string", pa.string())}, lambda t: (votes(t),)))
    counts = dict(voted.groupBy("votes").count().collect())
    posterior = fit_label_model(counts)

    total = sum(counts.values())
    quota = {p: LEAST_DOCS + n * fit_docs // total for p, n in counts.items()}
    # rows that repeat are one
    different = stage_table(voted.select("votes", "hash", F.col("hash").bitwiseAND((1 << 63) - 1).alias("lot")).distinct())
    rows = [(r["votes"], quota[r["votes"]], min(1.0, SPARE * quota[r["votes"]] / r["count"])) for r in different.groupBy("votes").count().collect()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(rows, "votes string, quota long, share double"))  # one row per pattern
    # of a frequent pattern only the least lots are ranked, SPARE times as many as are taken: their number does not grow with the corpus
    least = different.join(wanted, "votes").where(F.col("lot") <= F.col("share") * float(1 << 63))
    place = F.row_number().over(Window.partitionBy("votes").orderBy("lot", "hash"))
    first = F.broadcast(stage_table(least.withColumn("place", place).where("place <= quota").select("hash")))
    chosen = hashed.join(first, "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text"))
    kinds = {"votes": ("string", pa.string()), "at": ("binary", pa.binary()), "value": ("binary", pa.binary())}

    def example(text: str) -> tuple[str, bytes, bytes]:
        seen, words = signals(text)
        at, value = features_of(seen, words)
        return votes_on(seen), at.astype("<i4").tobytes(), value.astype("<f8").tobytes()

    sample = _mapped(chosen, [], "text", kinds, example).collect()
    sample.sort(key=lambda r: (r["votes"], r["at"], r["value"]))  # a repeated run adds up in the same order
    taken = Counter(r["votes"] for r in sample)
    weights, offset = fit_scorer(
        [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["value"], "<f8")) for r in sample],
        np.array([posterior[r["votes"]] for r in sample]),
        np.array([counts[r["votes"]] / taken[r["votes"]] for r in sample]),
    )
    return Model(posterior, weights, offset)


def classify(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and votes, posterior (of good, by the label model), score (by the scorer) and kept."""
    out = {"votes": ("string", pa.string()), "posterior": ("double", pa.float64()), "score": ("double", pa.float64()), "kept": ("boolean", pa.bool_())}
    return _mapped(docs, keys, text, out, fit(docs, keys, text).judge)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's votes, posterior, score and verdict."""
    return classify(table(spark, sf_dir, "documents"), ["doc_id"])
