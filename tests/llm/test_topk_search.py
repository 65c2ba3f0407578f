import math

import numpy as np

from palisade.llm import topk_search as ts
from palisade.llm.common import table


def brute(rows, k=5, every=50):
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in sound]
    out = []
    for i, q in ints:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1.5, 2) for r in rows], "vec_id long, embedding array<float>, score double, rank int").repartition(3)
    return sorted(map(tuple, ts.top_k(docs).collect()))


def test_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ts, "CANDIDATES", 60)
    monkeypatch.setattr(ts, "QUERIES", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(1, 400)]
    rows += [(0, None), (450, [1.0, None, 2.0, 0.0]), (500, [float("nan"), 0.0, 0.0, 0.0]), (550, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]),
             (600, [1.0, 2.0]), (601, [0.5, -0.25]), (650, [0.0] * 4), (50, rows[49][1]), (7, rows[6][1]), (700, [3.0, 3.0, 3.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_one_block_stops_early():
    rng = np.random.default_rng(2)
    vectors = rng.integers(-200, 200, (3000, 8))
    lists = ts.Lists(np.arange(3000), vectors)
    for q in range(0, 3000, 500):
        scores = vectors @ vectors[q]
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert lists.search(q, vectors[q], 5) == [(i, -s) for s, i in want]


def test_given_vectors(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    assert sorted(map(tuple, ts.top_k(vectors).collect())) == brute([(r.vec_id, r.embedding) for r in vectors.collect()])
