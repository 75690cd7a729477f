import zlib

import numpy as np
from pyspark.sql import functions as F

from callsight.llm import classifier as C

from .cases import no_docs, odd_docs

MEDIUM = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{MEDIUM}/documents.parquet"), spark.read.parquet(f"{MEDIUM}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    got = C.scores(docs, C.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 80 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(C.train(docs, labels, how=C.Ftrl(epochs=1)), C.train(docs, flipped, how=C.Ftrl(epochs=1)))


def test_scores_are_sparse_dot_products():
    texts = [b"", b"One two, two two THREE!!", "Été | été\n# # #".encode(), b"a " * 5000]
    weights = np.random.default_rng(4).normal(size=1 << C.BITS)
    want = [1 / (1 + np.exp(-(weights[i] @ v))) for i, v in C.vectors(texts)]
    assert np.allclose(C.score(texts, weights), want)


def test_sample_is_bounded_and_shards_are_averaged(spark):
    docs, labels = tables(spark)
    few = C.train(docs, labels, sample=40, shards=3, how=C.Ftrl(epochs=1))
    assert 0 < np.count_nonzero(few) < np.count_nonzero(C.train(docs, labels, how=C.Ftrl(epochs=1)))


def test_defined_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(0, 1, "x"), (0, 0, "x"), (7, 0, "x"), (13, None, "x"), (None, 1, "x"), (99, 1, "x")], "doc_id long, quality int, fp string")
    weights = C.train(docs, labels)
    rows = C.scores(docs, weights).collect()
    assert len(rows) == docs.count() and all(r.score is not None for r in rows)
    kept = C.accepted(docs, weights, threshold=0.0)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    empty = no_docs(spark)
    assert C.scores(empty, C.train(empty, labels)).count() == 0
    assert {r.score for r in C.scores(docs, C.train(docs, labels.limit(0))).collect()} == {0.5}


def test_learning_against_a_plain_loop():
    """FTRL-proximal one coordinate at a time, in plain Python."""
    import math

    rng = np.random.default_rng(4)
    how = C.Ftrl(epochs=2)
    rows = [(np.sort(rng.choice(32, rng.integers(1, 9), replace=False)).astype(np.int32), rng.random(1).astype(np.float32)) for _ in range(60)]
    rows = [(numbers, np.resize(values, len(numbers)).astype(np.float32)) for numbers, values in rows]
    labels = [int(x) for x in rng.integers(0, 2, 60)]
    z, n = [0.0] * 32, [0.0] * 32

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - math.copysign(how.l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for (numbers, values), label in zip(rows, labels):
            w = {int(i): weight(int(i)) for i in numbers}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * float(v) for i, v in zip(numbers, values))))
            for i, v in zip(numbers.tolist(), values.tolist()):
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    got = C.learn(rows, labels, how, bits=5)
    assert np.allclose(got, [weight(i) for i in range(32)], rtol=1e-5, atol=1e-7)


def test_rows_that_repeat_an_id_are_bounded(spark):
    """Of thousands of rows of one id one is learnt from, and all are scored."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(5, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    weights = C.train(docs, labels, bits=10)
    one = C.train(docs.groupBy("doc_id").agg(F.min("text").alias("text")), labels, bits=10)
    assert np.array_equal(weights, one) and C.scores(docs, weights).count() == 3001


def test_a_text_over_a_block():
    long = ("word " * 250_000).encode()
    weights = np.random.default_rng(2).normal(size=1 << 12)
    assert len(long) > 1 << 20
    assert np.allclose(C.score([b"one", long, b"two words"], weights), [C.score([t], weights)[0] for t in (b"one", long, b"two words")])
