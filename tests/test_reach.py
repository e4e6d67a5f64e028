"""Reachability against breadth-first search."""

import random
from collections import defaultdict, deque

import pytest
from helpers import rows

from hubwright.operators import paths, reach
from hubwright.operators.graph import PropertyGraph
from hubwright.session import stage_table


def graph_of(spark, edges, nodes=None):
    names = sorted({n for e in edges for n in e} | set(nodes or ()))
    frame = spark.createDataFrame([(f"id={n}",) for n in names], "_id string")
    links = spark.createDataFrame([(f"id={a}", f"id={b}") for a, b in edges], "src_id string, dst_id string")
    return PropertyGraph({"N": frame}, {("N", "TO", "N"): links})


def plain(edges):
    out, found = defaultdict(set), []
    for a, b in edges:
        out[a].add(b)
    for start in sorted(out):
        seen, queue = {}, deque((b, 1) for b in out[start])
        while queue:
            node, hops = queue.popleft()
            if node not in seen:
                seen[node] = hops
                queue.extend((b, hops + 1) for b in out[node])
        found += [(f"id={start}", f"id={end}", h) for end, h in seen.items()]
    return sorted(found, key=repr)


def cases():
    rng = random.Random(3)
    return {
        "hierarchy": [(i, i // 3) for i in range(1, 60)],
        "chain": [(i, i + 1) for i in range(37)],
        "cycle": [(i, (i + 1) % 11) for i in range(11)] + [(20, 3), (5, 30), (7, 7)],
        "random": [(rng.randrange(30), rng.randrange(30)) for _ in range(55)],
        "none": [],
    }


@pytest.mark.parametrize("case", cases())
def test_all_pairs(spark, case):
    edges = cases()[case]
    assert rows(reach.reachable(graph_of(spark, edges, [1]), "TO")) == plain(edges)


def test_against_and_both_ways(spark):
    edges = [(1, 2), (2, 3), (4, 3)]
    assert rows(reach.reachable(graph_of(spark, edges), "TO", "in")) == plain([(b, a) for a, b in edges])
    assert rows(reach.reachable(graph_of(spark, edges), "TO", "both")) == plain(edges + [(b, a) for a, b in edges])


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(reach, "stage_table", lambda df: staged.append(df) or stage_table(df))
    assert reach.reachable(graph_of(spark, [(i, i + 1) for i in range(64)]), "TO").count() == 64 * 65 // 2
    assert len(staged) == 8  # edges, six doublings, and the round that finds nothing


def test_closure_from_some(spark):
    edges = cases()["random"]
    graph = graph_of(spark, edges, [1, 2, 40])
    start = graph.node("N").where("_id in ('id=1', 'id=2', 'id=40')")
    want = [r for r in plain(edges) if r[0] in ("id=1", "id=2") and r[0] != r[1]] + [(i, i, 0) for i in ("id=1", "id=2", "id=40")]
    assert rows(reach.closure_from(graph, start, "TO")) == sorted(want, key=repr)


def test_walks_without_a_bound_end(spark):
    graph = graph_of(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])
    start = graph.node("N").where("_id = 'id=1'")
    walked = paths.expand_path(graph, start, "TO", 1, None)
    assert rows(walked.select("end_id", "hops")) == [("id=1", 3), ("id=2", 1), ("id=3", 2), ("id=4", 3)]


def test_edges_between_labels_have_no_closure(spark):
    graph = graph_of(spark, [(1, 2)])
    graph = PropertyGraph(graph.nodes, {("N", "TO", "M"): graph.edge("TO")})
    with pytest.raises(ValueError, match="one label"):
        reach.reachable(graph, "TO")
