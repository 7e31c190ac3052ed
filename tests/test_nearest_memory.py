"""Many queries meet a batch of vectors in pieces, and the answer is that of brute force."""

import numpy as np
from riverbed.operators import similarity


def test_queries_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(similarity, "ASKED", 3)
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (60, 5)).astype(float)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v.tolist())], "id long, vector array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in similarity.nearest(df, df.filter("id % 4 = 0"), 5, -1.0).collect()}
    norm = np.linalg.norm(v, axis=1)
    for q in range(0, 60, 4):
        score = np.round(np.divide(v @ v[q], norm * norm[q], out=np.zeros(60), where=norm * norm[q] > 0), 6)
        score[q] = -2
        assert [got[q, n + 1] for n in range(5)] == sorted(range(60), key=lambda k: (-score[k], k))[:5]
