"""Distances of many pairs against breadth-first search."""

import random
from collections import defaultdict, deque

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hubwright.operators import distances as distance_search
from hubwright.operators.distances import distances, node
from hubwright.operators.graph import PropertyGraph


def hops(edges, start):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    seen, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in out[a]:
            if b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    return seen


CASES = {
    "tree": [(i, i // 3) for i in range(1, 60)],
    "parts": [(i, (i + 1) % 7) for i in range(7)] + [(20 + i, 20 + (i + 1) % 9) for i in range(9)] + [(40, 41)],
    "random": [(random.Random(i).randrange(40), random.Random(i + 999).randrange(40)) for i in range(60)],
}


@pytest.mark.parametrize(("case", "marks"), [("tree", 1), ("parts", 3), ("random", 3)])
def test_distances(spark, case, marks):
    edges = CASES[case]
    names = sorted({n for e in edges for n in e} | {98, 99})
    graph = PropertyGraph(
        {"N": spark.createDataFrame([(f"id={n}",) for n in names], "_id string")},
        {("N", "TO", "N"): spark.createDataFrame([(f"id={a}", f"id={b}") for a, b in edges], "src_id string, dst_id string")},
    )
    rng = random.Random(1)
    asked = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [(98, 99), (99, 99), (names[0], 98)]
    pairs = spark.createDataFrame([(f"id={a}", f"id={b}") for a, b in asked], "a string, b string")
    pairs = pairs.select(node("N", "a").alias("source"), node("N", "b").alias("target"))
    got = distances(graph, pairs, marks).select(F.col("source.id"), F.col("target.id"), "hops")
    want = {(f"id={a}", f"id={b}", hops(edges, a).get(b)) for a, b in asked}
    assert rows(got) == sorted(want, key=repr)


def test_a_tree_needs_no_search(spark, monkeypatch):
    """Trees, one of two nodes and a node that links to itself only, are answered without a search."""
    monkeypatch.setattr(distance_search, "_searched", None)
    edges = [(i, i // 3) for i in range(1, 60)] + [(80, 81), (90, 90)]
    names = sorted({n for e in edges for n in e})
    graph = PropertyGraph(
        {"N": spark.createDataFrame([(f"id={n}",) for n in names], "_id string")},
        {("N", "TO", "N"): spark.createDataFrame([(f"id={a}", f"id={b}") for a, b in edges], "src_id string, dst_id string")},
    )
    asked = [(0, 59), (59, 58), (58, 3), (7, 7), (80, 81), (81, 1), (90, 90), (90, 80)]
    pairs = spark.createDataFrame([(f"id={a}", f"id={b}") for a, b in asked], "a string, b string")
    got = distances(graph, pairs.select(node("N", "a").alias("source"), node("N", "b").alias("target")), 1)
    want = {(f"id={a}", f"id={b}", hops(edges, a).get(b)) for a, b in asked}
    assert rows(got.select(F.col("source.id"), F.col("target.id"), "hops")) == sorted(want, key=repr)
