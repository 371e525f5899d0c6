import zlib

import numpy as np

from pyspark.sql import functions as F

from sheetstorm.llm.quality import BINS, RAW_HIGH, RAW_LOW, STATISTICS, document_statistics, drop_low_quality, fit, isotonic, score_quality, statistics

from .helpers import odd_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [(rows[x.doc_id].score, x.quality) for x in labels.collect() if rows[x.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    ranked = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([(s >= 0.5) == q for s, q in held])
    print("held-out: ranked", ranked, "right", right, len(good), len(bad))
    assert ranked > 0.9 and right > 0.9


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (6, 0, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(odd_documents(spark), labels).count() == 12
    assert {r.score for r in score_quality(odd_documents(spark), labels.limit(0)).collect()} == {0.5}
    assert score_quality(odd_documents(spark, []), labels).count() == 0


def test_isotonic_curve_never_falls():
    knots, values = isotonic(np.arange(6.0), np.array([10, 10, 10, 10, 10, 10.0]), np.array([1, 3, 2, 8, 7, 9.0]))
    assert list(values) == sorted(values) and len(knots) == 4 and 0 < values[0] < values[-1] < 1
    for n, s in (([1, 1000], [0, 100]), ([5, 1, 900, 2], [0, 0, 90, 2]), ([3], [3]), ([4], [0])):
        _, values = isotonic(np.arange(float(len(n))), np.array(n, dtype=float), np.array(s, dtype=float))
        assert list(values) == sorted(values) and 0 < values[0] <= values[-1] < 1


def test_fit_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = statistics(docs).join(labels.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    model = fit(train.drop("half"), features=40)
    rows = train.toPandas()
    x, y, half = rows[STATISTICS].to_numpy(dtype=float), rows["label"].to_numpy(), rows["half"].to_numpy()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert np.allclose(x[5], document_statistics(texts[rows["doc_id"][5]]))
    z = np.cos(np.clip((x - x.mean(axis=0)) / x.std(axis=0), -6, 6) @ model.projection + model.phase) * np.sqrt(2 / 40)
    z = np.column_stack([z, np.ones(len(z))])

    def solve(own):
        return np.linalg.solve(z[own].T @ z[own] + 1e-3 * max(1, own.sum()) / 41 * np.eye(41), z[own].T @ y[own])

    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + 1e-3 * len(z) / 41 * np.eye(41), z.T @ y), atol=1e-6)
    raw = np.where(half == 0, z @ solve(half == 1), z @ solve(half == 0))
    at = np.clip((raw - RAW_LOW) / (RAW_HIGH - RAW_LOW) * BINS, 0, BINS - 1).astype(int)
    order = np.argsort(at, kind="stable")
    curve = y[order].astype(float)
    bins = at[order]
    for b in np.unique(bins):
        curve[bins == b] = curve[bins == b].mean()
    sums, n = np.concatenate([[0], np.cumsum(curve)]), len(curve)
    means = [[(sums[j] - sums[i]) / (j - i) if j > i else np.nan for j in range(n + 1)] for i in range(n)]
    fitted = [max(min(means[i][k + 1 :]) for i in range(k + 1)) for k in range(n)]  # the isotonic fit by its min-max formula
    inward = 0.5 / (n + 1)
    assert sorted({round(float(v), 6) for v in model.values}) == sorted({round(float(v), 6) for v in np.clip(fitted, inward, 1 - inward)})


def test_stage_with_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (9, 0), (None, 1), (10, None), (99, 0)], "doc_id long, quality int")
    kept = drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.exceptAll(docs).isEmpty()
    assert sorted(map(str, drop_low_quality(docs, labels.limit(0)).collect())) == sorted(map(str, docs.collect()))
    assert drop_low_quality(odd_documents(spark, []), labels).count() == 0
