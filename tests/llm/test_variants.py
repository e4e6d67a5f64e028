"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from odd_rows import ODD
from pyspark.sql import functions as F

from hubwright.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def plain(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: v if v is not None and counts[v] >= ratio * counts[w] else None for w, v in best.items()}
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root)
    return out


def run(spark, counts, ratio=10):
    df = spark.createDataFrame(list(counts.items()) or [], "word string, n long").repartition(3)
    rows = variants.variants(df, ratio).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def plain_counts(docs):
    counts = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def test_words_of_few_letters(spark):
    """Dense neighbourhoods: many words on two and three letters, runs of equal letters among them."""
    rng = random.Random(1)
    for letters in ("ab", "abé", "abcdefgh"):
        counts = {"".join(rng.choices(letters, k=rng.choice((7, 8, 9)))): rng.choice((2, 3, 20, 31, 400, 5000, 10**6)) for _ in range(400)}
        assert run(spark, counts) == plain(counts)


def test_chains_are_followed_to_their_end(spark):
    word, counts = "a" * 7, {}
    for i in range(14):
        counts[word] = 2 * 10**i
        word = word + "bcdefghijklmnop"[i]
    got = run(spark, counts)
    assert got == plain(counts) and got["aaaaaaa"][4] == "aaaaaaabcdefghijklmn"


def test_ties_and_hot_words(spark):
    hot = "variant"
    counts = {hot: 1000} | {hot[:i] + c + hot[i + 1 :]: 5 for i in range(7) for c in "xyz"} | {"bariant": 1000, "zzzzzzzz": 2}
    assert run(spark, counts) == plain(counts)
    assert run(spark, {}) == {}
    assert run(spark, {"x" * 40000: 5, "x" * 39999: 500, "x" * 20000 + "y" + "x" * 19999: 50}) == plain(
        {"x" * 40000: 5, "x" * 39999: 500, "x" * 20000 + "y" + "x" * 19999: 50}
    )


def test_words_of_odd_texts(spark, odd, no_docs):
    words = odd.select("doc_id", F.explode(variants.runs("text")).alias("run"))
    counted = variants.count_words(words.select(variants.damaged(F.col("run"), F.col("doc_id")).alias("word")))
    got = {r.word: r.n for r in counted.collect()}
    assert got == plain_counts([(d, t) for d, t, *_ in ODD])
    empty = variants.count_words(no_docs.select(F.explode(variants.runs("text")).alias("word")))
    assert variants.variants(empty).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = variants.op12_spelling_variants(spark, sf).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == plain(plain_counts(docs))
