import numpy as np
from pyspark.sql import functions as F

from clipgrain.llm import topk


def test_only_rows_that_bounds_leave_are_scored(monkeypatch):
    seen, scores = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, v, rows: seen.append(len(rows)) or scores(q, v, rows))
    r = np.random.default_rng(3)
    vectors = r.integers(-3, 4, (4000, 16)).astype(float)
    vectors[:60, 0] += 500
    ids, queries = np.arange(4000), np.zeros((3, 16))
    queries[:, 0] = [5, 6, 7]
    queries[:, 1:] = r.integers(0, 2, (3, 15))
    for name, best, got in topk.best_in_block(ids, vectors, np.array([0, 9000, 9001]), queries, 20):
        want = vectors @ queries[[0, 9000, 9001].index(name)]
        order = [x for x in np.lexsort((ids, -want)) if x != name][:20]
        assert best.tolist() == order and got.tolist() == want[order].tolist()
    assert seen and max(seen) < 200


def test_most_rows_are_ruled_out_on_random_unit_vectors(monkeypatch):
    """Directions at random are the hardest for bounds; even so few scores are resolved."""
    seen, scores = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, v, rows: seen.append(len(rows)) or scores(q, v, rows))
    r = np.random.default_rng(5)
    vectors = r.normal(size=(8192, 64))
    vectors = np.floor(64 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    ids = np.arange(8192)
    for name, best, got in topk.best_in_block(ids, vectors, ids[:128], vectors[:128], 20):
        want = vectors @ vectors[name]
        want[name] = -(10**9)
        assert best.tolist() == np.lexsort((ids, -want))[:20].tolist() and got.tolist() == want[best].tolist()
    print("scores resolved, share:", np.mean(seen) / 8192)
    assert np.mean(seen) < 0.1 * 8192


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (0, [1.0, 2.0, 3.0]), (1, [1e7, -1.0]), (2, [0.5] * 40), (3, [-1.0]), (20, [2e6, 1.0, 1.0, 1.0]), (20, None), (40, [0.0]), (7, [1.0, float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit(1)).withColumn("asks", F.lit("x")).repartition(4)
    got: dict = {}
    for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    whole = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in rows if v and not np.isinf(v).any()]
    for q in (0, 20, 40):
        v = next(w for i, w in whole if i == q)
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {0, 20, 40}
