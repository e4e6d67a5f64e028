"""Line dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from odd_rows import ODD

from hubwright.llm import line_dedup
from hubwright.session import stage_table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def plain(docs):
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add((d is None, d or 0))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in holders or min(holders[key(x)]) == (d is None, d or 0)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bitmaps = line_dedup.keep_bitmaps(line_dedup.repeats(stage_table(line_dedup.line_hashes(df)), **more))
    done = line_dedup.without_repeats(df, bitmaps)
    rows = done.selectExpr("doc_id", "size(split(coalesce(text, ''), '\n'))", "size(split(coalesce(text, ''), '\n')) - size(kept_lines)", "array_join(kept_lines, '\n')")
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    lines = [f"a line number {i} of all" for i in range(40)] + ["short", "", "  ", "A Line Number 3 of all\t", "\r a line number 4 of all", "ünïcode líne näme"]
    docs = [(i, "\n".join(rng.choices(lines, k=rng.choice((1, 3, 70, 200))))) for i in range(60)]
    return docs + [(100 + i, "the same line everywhere\n" + docs[i][1]) for i in range(60)] + [(7, docs[9][1]), (7, docs[9][1]), (None, docs[3][1]), (None, "only without id")] * 2


@pytest.mark.parametrize("hot", [{}, {"least_hot": 0, "most_hot": 50}, {"least_hot": 10**9, "most_hot": 1}])
def test_lines_against_brute_force(spark, hot):
    """Hot hashes by an aggregate or by ranges give the same."""
    docs = corpus(1)
    assert run(spark, docs, **hot) == plain(docs)


def test_a_line_that_a_third_holds(spark):
    docs = [(i, f"the one line that all of them hold\nown line of {i} here") for i in range(9000)]
    got = run(spark, docs)
    assert got == plain(docs) and sum(r[2] for r in got) == 8999


def test_bitmaps_leave_whole_words_out(spark):
    text = "\n".join(f"this is line {i}" for i in range(1000))
    docs = spark.createDataFrame([(1, text), (2, "x\n" * 500 + "this is line 7\n" + "y\n" * 300 + "this is line 8")], "doc_id long, text string")
    bitmaps = line_dedup.find_repeats(docs).collect()
    assert [(r.doc_id, [w.word for w in r.keep]) for r in bitmaps] == [(2, [7, 12])]


def test_dedup_of_odd_rows(spark, odd, no_docs):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns
    want = plain([(d, t) for d, t, *_ in ODD])
    assert sorted(((r.doc_id, r.text or "") for r in out.collect()), key=repr) == sorted(((d, t) for d, _, _, t in want), key=repr)
    assert {r.text for r in out.where("doc_id = 4").collect()} == {None}
    assert line_dedup.dedup_lines(no_docs).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = sorted((tuple(r) for r in line_dedup.op13_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    assert rows == [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain(docs)]


def test_no_python_in_the_plan(spark):
    plan = line_dedup.op13_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
