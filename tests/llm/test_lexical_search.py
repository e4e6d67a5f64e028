"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import CLASHING, ODD

from hubwright.llm import lexical_search as search

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    texts = [(d, Counter(TERMS.findall(t.translate(LOWER)))) for d, t in docs if t is not None]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    count, length = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in texts:
            m = 10 + 90 * n * count // length
            w = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) for t in set(TERMS.findall(text.translate(LOWER))) if t in c}
            scored.append((-sum(w[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in w), d is None, d or 0))
        out += [(item, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return out


def found(spark, docs, items, **more):
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search.ranked(a, b, **more).collect()), key=lambda r: r[:2])


@pytest.fixture
def small_segments(monkeypatch):
    """Many segments, blocks and a starting bound on few documents."""
    monkeypatch.setattr(search, "SEGMENT", 50)
    monkeypatch.setattr(search, "SEGMENT_ENTRIES", 700)
    monkeypatch.setattr(search, "SAMPLE", 60)


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((3, 20, 80))))) for i in range(size)]
    items = [(i, " ".join(rng.choices(words, weights, k=12))) for i in range(12)] + [(i, docs[7 * i][1]) for i in range(12, 20)] + [(20, "unknown"), (21, "w0 w1")]
    return docs, items


def test_search_equals_brute_force(spark):
    docs, items = corpus(1, 500)
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, k=3) == plain(docs, items, 3)


def test_copies_and_a_text_that_a_third_holds(spark):
    docs, items = corpus(2, 300)
    docs += [(1000 + i, docs[5][1]) for i in range(200)] + [(3, docs[9][1]), (3, docs[9][1])]
    items.append((30, docs[5][1]))
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items = corpus(3, 200)
    monkeypatch.setattr(search, "BLOCK_ITEMS", 5)
    assert found(spark, docs, items) == plain(docs, items)


def lots(docs, vocabulary):
    """Documents as a segment takes them."""
    counts = [Counter(t for t in search.terms(x.encode()) if t in vocabulary) for _, x in docs]
    held = [sorted((vocabulary[t], c) for t, c in one.items()) for one in counts]
    flat = np.array([x for one in held for x in one], np.int64).reshape(-1, 2)
    ends = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    return [d for d, _ in docs], list(range(len(docs))), np.array([len(search.terms(x.encode())) for _, x in docs]), ends, flat[:, 0], flat[:, 1]


def test_blocks_are_skipped_and_bounds_hold():
    """Of a segment only a part is scored, and no summary is below a score in its block."""
    docs, items = corpus(4, 2000)
    own = {i: set(search.terms(t.encode())) for i, t in items}
    queries = search._block(own)
    part = lots(docs, queries.vocabulary)
    df = Counter(part[4].tolist())
    weight = search.weights(len(docs), df, len(queries.vocabulary))
    made = search.Search(queries, weight, len(docs), int(part[2].sum()), np.zeros(len(items), np.int64), 10)
    scored, summaries, visit = Counter(), made._summaries, made._visit

    def count(q, bound, blocks, starts, done, *rest):
        before = int(done.sum())
        visit(q, bound, blocks, starts, done, *rest)
        scored[q] += int(done.sum()) - before

    def check(blocks, starts, active, ends, terms_, value):
        summary, columns = summaries(blocks, starts, active, ends, terms_, value)
        for q in active:
            bound = summary[:, columns[queries.terms_of[q]]].sum(axis=1)
            for b, docs_ in enumerate(np.split(blocks, starts[1:])):
                for d in docs_.tolist():
                    e = slice(ends[d], ends[d + 1])
                    assert value[e][np.isin(terms_[e], queries.terms_of[q])].sum() <= bound[b]
        return summary, columns

    made._visit, made._summaries = count, check
    made.segment(*part)
    rows = [(r["item_id"], r["score"], r["doc_id"]) for r in made.result().to_pylist()]
    assert rows == [(i, s, d) for i, _, d, s in plain(docs, items)]
    assert sum(scored.values()) < 0.5 * len(docs) * len(items)


def test_a_list_of_copies_is_cut_evenly():
    place = np.ones((1000, search.DIMENSIONS), np.float32)
    blocks, starts = search.cut_list(np.arange(1000), place, 3)
    assert sorted(blocks.tolist()) == list(range(1000)) and np.diff([*starts, 1000]).max() <= search.IN_BLOCK


def test_lots_hold_every_document(small_segments):
    import pyarrow as pa

    rng = random.Random(5)
    lists = [[1] * rng.choice((0, 3, 40, 900)) for _ in range(500)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(range(500)), pa.array([1] * 500), pa.array(lists, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int32()))],
        ["doc_id", "row", "n", "terms", "tfs"],
    )
    parts = list(search.segments([whole.slice(0, 123), whole.slice(123, 0), whole.slice(123)]))
    assert [d for p in parts for d in p[0]] == list(range(500))
    assert [int(x) for p in parts for x in np.diff(p[3])] == [len(x) for x in lists]
    assert all(len(p[0]) <= 50 and (p[3][-1] <= 700 or len(p[0]) == 1) for p in parts)


def test_odd_and_no_rows(spark, odd, no_docs):
    items = [(1, "One two key TOKEN"), (2, "東京 wörd"), (3, None), (4, ""), (None, "one"), (5, "x" * 40000)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in search.ranked(odd, asked).collect()), key=lambda r: r[:2])
    assert got == plain([(d, t) for d, t, *_ in ODD], [i for i in items if i[0] and i[1] is not None])
    assert search.ranked(no_docs, asked).collect() == [] and search.ranked(odd, asked.where("false")).collect() == []
    assert CLASHING
