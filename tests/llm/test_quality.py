import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidelog.llm import kernels as K
from tidelog.llm import quality as Q


def test_risk_finds_the_boundary_without_negatives(spark):
    """The prior and the boundary, from good rows and a mixture of 70 and of 30 in 100."""
    rnd = np.random.default_rng(5)
    for prior in (0.7, 0.3):
        n = int(4000 * prior)
        good = rnd.normal(1.5, 1, (2000, Q.N_FEATURES))
        mixed = np.concatenate([rnd.normal(1.5, 1, (n, Q.N_FEATURES)), rnd.normal(-1.5, 1, (4000 - n, Q.N_FEATURES))])
        # fit takes every row as unlabelled, so the trusted rows raise the share
        rows = [(True, x.tolist()) for x in good[:600]] + [(False, x.tolist()) for x in mixed]
        model = Q.fit(spark.createDataFrame(rows, "good boolean, features array<double>"))
        assert abs(model.prior - (n + 600) / 4600) < 0.1
        assert model.score(rnd.normal(1.5, 1, (500, Q.N_FEATURES))).mean() > 0.8 > 0.3 > model.score(rnd.normal(-1.5, 1, (500, Q.N_FEATURES))).mean()


def test_sums_equal_plain_ones(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 1, (70, Q.N_FEATURES))
    df = spark.createDataFrame([(i % 3 == 0, r.tolist()) for i, r in enumerate(x)], "good boolean, features array<double>").repartition(5)
    got = Q._summed(df, lambda a, good: np.concatenate([a.sum(0), (a[good].T @ a[good]).ravel()]), Q.N_FEATURES * (Q.N_FEATURES + 1))
    assert np.allclose(got, np.concatenate([x.sum(0), (x[::3].T @ x[::3]).ravel()]))


def test_the_risk_for_bad_text_stays_at_zero():
    """Where the unbiased risk's solution has a negative estimate for bad text, the least risk has it at zero; else it is that solution."""
    rnd = np.random.default_rng(2)
    x = rnd.normal(0, 1, (60, 20))
    good, every = x[:25], x
    m = Q.Moments((good.mean(0), good.T @ good / 25), (every.mean(0), every.T @ every / 60))

    def risks(w, prior):
        return prior * ((1 - good @ w) ** 2).mean(), ((1 + every @ w) ** 2).mean() - prior * ((1 + good @ w) ** 2).mean()

    free = np.linalg.solve(m.every2 + Q.RIDGE * np.eye(20), 2 * 0.9 * m.good - m.every)
    w = Q.least_risk(m, 0.9, beta=0.0)
    assert risks(free, 0.9)[1] < -0.1 and abs(risks(w, 0.9)[1]) < 1e-3
    best = risks(w, 0.9)[0] + Q.RIDGE * w @ w
    for _ in range(300):
        v = w + rnd.normal(0, 0.05, 20)
        one, bad = risks(v, 0.9)
        assert one + max(0, bad) + Q.RIDGE * v @ v >= best - 1e-3
    low = np.linalg.solve(m.every2 + Q.RIDGE * np.eye(20), 2 * 0.05 * m.good - m.every)
    assert risks(low, 0.05)[1] > 0 and np.allclose(Q.least_risk(m, 0.05), low)


def test_features_do_not_depend_on_neighbours():
    texts = ["", "one", "Some words, and more.\nLine", "A!! B!!", "x " * 3000, "é" * 50]
    together = np.concatenate([Q.features(raw, off) for _, _, raw, off in K.chunks(pa.array(texts))])
    for t, row in zip(texts, together, strict=True):
        alone = np.concatenate([Q.features(raw, off) for _, _, raw, off in K.chunks(pa.array([t]))])
        assert np.allclose(alone[0], row) and np.isfinite(row).all()


def test_held_out_labels_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = Q.train(docs.where(~held), labels.where(~held))
    rows = Q.score(docs.select("doc_id", "text"), model).where(held).join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    right = (sum(s >= 0.3 for s in good) + sum(s < 0.3 for s in bad)) / len(rows)
    print("area", area, "right", right, "prior", model.prior)
    assert area > 0.9 and right > 0.9


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, "word " * 40, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(df, none)
    assert model is None and {r.score for r in Q.score(df, model).collect()} == {0.5}
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choices(["words", "of", "prose,"], k=30)), 0) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(41, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = Q.train(spark.createDataFrame(good + rows, df.schema), labels)
    got = Q.score(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
