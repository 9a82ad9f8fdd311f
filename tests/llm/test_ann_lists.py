"""Queries whose own list holds few vectors: outliers alone in a list, or with some copies."""

import numpy as np
import pandas as pd

from locusframe.llm import ann


def outlier_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 16)) * 0.05 + np.eye(16)[0]
    x[:12] = rng.normal(size=(12, 16))
    x[12:16] = x[0]
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    return [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]


def test_small_lists_still_give_k_rows(spark):
    t = ann.usable(spark.createDataFrame(outlier_rows(), "vec_id long, embedding array<float>"))
    count = {r["query_id"]: r["count"] for r in ann.search(t, t.where("id < 40"), k=20, list_size=4).groupBy("query_id").count().collect()}
    assert count == {i: 20 for i in range(40)}


def test_probes_walk_on():
    c = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0]])
    index = ann.Index(1.0, c, np.tile(np.arange(4), (4, 1)), np.array([0]), 0.1, 1, 0.02)
    q = np.array([[1.0, 0], [0.6, 0.8]])
    assert [p.tolist() for p in index.probes(q)] == [[0], [1]]
    assert [p.tolist() for p in index.probes(q, np.array([2, 3, 0, 9]), 5)] == [[0, 1], [0, 1]]
    assert [p.tolist() for p in index.probes(q, np.array([2, 3, 0, 9]), 99)] == [[0, 1, 3], [0, 1, 3]]


def brute(x, q, k):
    s = (x[q] * x).sum(1)
    return [(q, rank, int(i), s[i]) for rank, i in enumerate([i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k], 1)]


def test_one_list_over_several_shards_is_exact(spark):
    """A long list is cut over shards; with a sample of fewer than k + 1 vectors nothing is known of the others, otherwise the sample bounds them."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float) * rng.uniform(0.01, 50, (300, 1)).astype(np.float32)
    x[50:80] = x[7]  # copies
    t = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    for sample in (6, 100, 20_000):
        got = sorted(tuple(r) for r in ann.search(t, t.where("id % 20 = 0"), k=10, chunk=16, list_size=1000, sample=sample).collect())
        want = [r for q in range(0, 300, 20) for r in brute(x, q, 10)]
        assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_only_what_reaches_the_samples_nearest_leaves_a_scan(spark):
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(2000, 16)), rng.normal(size=(3, 16))
    index = ann.Index(1.0, np.zeros((1, 1)), np.zeros((1, 1), int), np.zeros(1, int), 0.1, 1, 0.02, np.arange(0, 2000, 4), x[::4])
    ids, scores, least = index.nearest_known(q, 5)
    s = q @ x.T
    for i in range(3):
        want = 4 * np.argsort(-s[i, ::4])[:6]
        assert ids[i].tolist() == want.tolist() and np.allclose(scores[i], s[i, want]) and least[i] == scores[i][-1]
    postings = pd.DataFrame({"shard": 0, "kind": 0, "list": np.arange(2000) // 500, "ids": [[i] for i in range(2000)], "v": list(x), "a": 0, "b": 0, "least": np.nan, "lists": None})
    asked = pd.DataFrame({"shard": 0, "kind": 1, "list": -1, "ids": None, "v": list(q), "a": [1, 2, 3], "b": 0, "least": least, "lists": [[0, 1, 2, 3], [0, 1, 2, 3], [1]]})
    out = pd.concat(list(ann._scan(iter([postings.iloc[:700], postings.iloc[700:], asked]), 5)))
    for i, within in enumerate((range(2000), range(2000), range(500, 1000))):
        want = [j for j in np.argsort(-s[i]) if j in within and s[i, j] >= least[i]][:6]
        found = out[out["a"] == i + 1]
        assert found["id"].tolist() == want and np.allclose(found["score"], s[i, want])
