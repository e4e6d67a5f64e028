import numpy as np
import pyarrow.parquet as pq

from hubwright.llm import ann


def recall(n, queries=100):
    """Recall at 5 of the lists that are probed, on Gaussian vectors with the covariance of the given ones."""
    given = np.stack(pq.read_table("/root/testdata/sf0.01/embeddings.parquet").column("embedding").to_numpy()).astype(np.float64)
    rng = np.random.default_rng(3)
    vectors = ann.unit(rng.multivariate_normal(given.mean(0), np.cov(given.T), n)).astype(np.float32)
    lists = n // ann.LIST_VECTORS
    graph = ann.CentroidGraph.build(ann.balanced_centroids(vectors[: ann.SAMPLE_VECTORS * lists].astype(np.float64), lists))
    ids, take = ann.chosen_lists(vectors, graph, ann.CLOSURE, 1, ann.MOST_COPIES)
    probed, asked = ann.chosen_lists(vectors[:queries], graph, ann.PROBE_RATIO, ann.LEAST_PROBES, ann.most_probes(lists))
    best = np.argsort(-(vectors[:queries] @ vectors.T), axis=1)[:, 1:6]
    hit = sum(bool(set(ids[v][take[v]]) & set(probed[q][asked[q]])) for q in range(queries) for v in best[q])
    return hit / (5 * queries)


def test_recall_holds_as_tables_grow():
    assert ann.most_probes(106) == ann.BEAM and ann.most_probes(1 << 14) == 1 << 11
    assert recall(60_000) >= 0.97
