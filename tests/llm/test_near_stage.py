"""The near-duplicate stage links from a similarity of 0.8."""

import random

import corpus_pipeline


def test_pair_between_80_and_85_percent(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
    near, far = list(words), list(words)
    for k in (20, 60, 100, 140):  # 200 shingles each, 180 in both: 180 / 220 = 0.82
        near[k] = "changed"
    for k in (20, 50, 80, 110, 140, 170):  # 170 / 230 = 0.74
        far[k] = "other"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()}
    assert kept == {1, 3}
