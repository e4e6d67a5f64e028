"""Scores of many pairs at once against scoring one by one, and whole columns of values against a double loop."""

import random

import numpy as np
import pytest
from helpers import rows

from hubwright.functions import text
from hubwright.operators import dedupe, similarity


def drawn(seed, n):
    rng = random.Random(seed)
    alphabets = ["ab", "abcdefgh", "aé東🙂 x\0", "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))]
    a, b = [], []
    for _ in range(n):
        letters = rng.choice(alphabets)
        size = rng.choice([0, 1, 5, 63, 64, 65, 130, 256, 257, 300]) if rng.random() < 0.3 else rng.randrange(40)
        a.append("".join(rng.choices(letters, k=size)))
        b.append("".join(rng.choices(letters, k=max(0, size + rng.randrange(-5, 30)))))
    return a, b


def test_batches_equal_single_pairs():
    a, b = drawn(5, 20000)
    assert text.common_lengths(a, b).tolist() == [text._common_length(x, y) for x, y in zip(a, b)]


def test_small_matrices_give_the_same(monkeypatch):
    a, b = drawn(6, 600)
    monkeypatch.setattr(text, "MATRIX_CELLS", 1 << 10)
    assert text.common_lengths(a, b).tolist() == [text._common_length(x, y) for x, y in zip(a, b)]
    assert text.similarities([None, "", "ab", "a"], ["a", "", "ab", None]) == [None, 1.0, 1.0, None]


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_long_values_against_a_double_loop(spark, threshold):
    """Web addresses and sentences of up to some hundred characters, with copies of few edits."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randrange(2, 9))) for _ in range(80)]
    values = []
    for i in range(60):
        long = " ".join(rng.choices(words, k=rng.randrange(3, 60))) if i % 2 else "https://" + ".".join(rng.choices(words, k=3)) + "/" + "/".join(rng.choices(words, k=3))
        values.append(long)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(long))
            values.append(long[:at] + rng.choice(["", "x", "zz"]) + long[at + rng.randrange(3) :])
    values = sorted(set(values))
    nodes = spark.createDataFrame([(f"id={i}", v) for i, v in enumerate(values)], "_id string, value string")
    sorted_ = sorted({" ".join(sorted(v.split())) for v in values})
    want = sorted((x, y, text.similarity(x, y)) for i, x in enumerate(sorted_) for y in sorted_[i + 1 :] if text.similarity(x, y) >= threshold)
    got = dedupe.value_pairs(dedupe.candidates(nodes, "value"), threshold).select("a", "b", "score")
    assert rows(got) == sorted(want, key=repr) and len(want) > 20


def test_pairs_by_index_equal_single_pairs(monkeypatch):
    a, b = drawn(7, 400)
    a = [t[: text.MATRIX_LETTERS] for t in a]
    rng = random.Random(8)
    at, to = [np.array([rng.randrange(400) for _ in range(3000)]) for _ in "ab"]
    want = [text._common_length(a[i], b[j]) for i, j in zip(at, to)]
    assert text._common_lengths(a, b, at, to).tolist() == want
    monkeypatch.setattr(text, "MATRIX_CELLS", 1 << 10)
    assert text._common_lengths(a, b, at, to).tolist() == want


def numbered(seed, n):
    """Addresses of few hosts that differ in numbers, long numbers, mixed ones, and short values."""
    rng = random.Random(seed)
    out = set()
    for i in range(n):
        host, tail = rng.choice(["https://a.example.net", "http://a.example.net", "https://b.example.org"]), rng.choice(["", "/", ".html", "?page=2"])
        out.add(f"{host}/en/{rng.randrange(10 ** rng.randrange(3, 6))}{tail}")
        if i % 4 == 0:
            out.add(f"order {rng.randrange(10**30):030d}"[: rng.randrange(20, 37)])
            out.add(f"{rng.choice('xyz')}{rng.randrange(30)}")
            digits = f"{rng.randrange(10**9):09d}"
            # one digit more makes a number a large part of the second at 0.9
            out |= {f"accounts of the one {digits[:5]}", f"accounts of the one {digits[:6]}"}
            # of 20 and 24 letters: the first are met by deletions among themselves, not with the second
            out |= {f"shop on streets {digits[:4]}", f"shop on the streets {digits[:4]}", f"shop on streets {digits[:3]}{rng.randrange(10)}"}
            out |= {f"account of the {digits} branch", f"account of the {digits[:7]} branch", f"account of the {digits[:-1]}٣ branch"}
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.7, 0.9])
@pytest.mark.parametrize("letters, cost", [(64, 0), (1 << 13, 1 << 30)])
def test_numbered_values_against_a_double_loop(spark, monkeypatch, threshold, letters, cost):
    """Small blocks and shapes found by grams; large blocks and shapes compared in blocks."""
    monkeypatch.setattr(similarity, "BLOCK_LETTERS", letters)
    monkeypatch.setattr(similarity, "GRAM_COST", cost)
    values = sorted({" ".join(sorted(v.split())) for v in numbered(11, 120)})
    nodes = spark.createDataFrame([(f"id={i}", v) for i, v in enumerate(values)], "_id string, value string")
    got = dedupe.value_pairs(dedupe.candidates(nodes, "value"), threshold, dedupe.first_character).select("a", "b", "score")
    want = [
        (x, y, text.similarity(x, y)) for i, x in enumerate(values) for y in values[i + 1 :]
        if text.similarity(x, y) >= threshold and normal(x)[0] == normal(y)[0]
    ]
    assert rows(got) == sorted(want, key=repr) and len(want) > 200


def normal(value):
    return "".join(c for c in value.lower() if c.isalnum())


def test_addresses_that_differ_in_numbers_are_not_met_by_grams(spark, monkeypatch):
    """300 similar addresses make 44,850 pairs, all of one shape: no pair is made by grams."""
    met, joined = [], similarity._joined

    def counted(*args, **named):
        pairs = joined(*args, **named)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(similarity, "_joined", counted)
    values = spark.createDataFrame([("", f"https://www.example.net/en/{100 + i}/index.html") for i in range(300)], "block string, text string")
    assert similarity.similar_pairs(values, 0.8).count() == 300 * 299 // 2
    assert sum(met) == 0
