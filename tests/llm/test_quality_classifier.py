import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm.near_duplicates import words_of
from quillon.llm.quality_classifier import BUCKETS, kth_largest, log_ratios, ngram_buckets, resample


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_ngrams_are_of_their_text():
    texts = ["a b a b", "", "A", "b  a\tb", "a b"]
    bucket, begin = ngram_buckets(*arrays(texts), 1 << 40)
    per = [Counter(bucket[a:b].tolist()) for a, b in zip(begin, begin[1:])]
    assert [sum(c.values()) for c in per] == [7, 0, 1, 5, 3]
    assert per[2] < per[0] and per[4] < per[0] and sorted(per[0].values()) == [1, 2, 2, 2]


def test_kth_largest(spark):
    values = [0.0, 1.5, 1.5, -3.25, 1e9, 1.5000000000000002, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert [kth_largest(df, k) for k in range(1, 8)] == sorted(values, reverse=True)
    assert kth_largest(df.limit(0), 3) is None


def test_weights_and_draw(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = resample(documents, labels.where("quality = 1"), 0.5).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    counts = {i: np.bincount(ngram_buckets(*arrays([t]), BUCKETS)[0], minlength=BUCKETS) for i, t in texts.items()}
    ratios = log_ratios(sum(counts[i] for i in good & set(texts)), sum(counts.values()))
    scaled = {r.doc_id: r for r in resample(documents, labels.where("quality = 1"), 0.5, effective=64).collect()}
    for r in rows:
        n = int(counts[r.doc_id].sum())
        assert r.n_ngrams == n and r.log_weight == pytest.approx(float((counts[r.doc_id] * ratios).sum()))
        assert scaled[r.doc_id].log_weight == pytest.approx(r.log_weight * min(1, 64 / n))
    again = resample(documents, labels.where("quality = 1"), 0.5, most=20).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    keys = sorted((r.sample_key for r in rows), reverse=True)
    assert [r.sample_key >= keys[len(rows) // 2 - 1] for r in rows] == [r.kept for r in rows]


def test_held_out_labels(spark):
    """Fitted on half of the labels: of the other half, good documents weigh more than bad ones."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumn("good", F.expr("quality = 1 and toxic = 0"))
    fit, test = (labels.where(f"crc32(cast(cast(doc_id as string) as binary)) % 2 = {k}") for k in (0, 1))
    rows = resample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), fit.where("good")).join(test, "doc_id").where("log_weight is not null").collect()
    good, bad = ([r for r in rows if r.good == g] for g in (True, False))
    wins = sum((a.log_weight > b.log_weight) + (a.log_weight == b.log_weight) / 2 for a in good for b in bad) / (len(good) * len(bad))
    print("AUC", wins, "kept good", sum(r.kept for r in good) / len(good), "kept bad", sum(r.kept for r in bad) / len(bad))
    assert wins > 0.7


def test_noise_is_gumbel(spark):
    from quillon.llm.quality_classifier import gumbel

    x = sorted(r[0] for r in spark.range(20000).withColumnRenamed("id", "doc_id").select(gumbel(1)).collect())
    assert max(abs(math.exp(-math.exp(-v)) - (i + 0.5) / len(x)) for i, v in enumerate(x)) < 0.015


def test_odd_tables(spark, odd, empty):
    target = spark.createDataFrame([(4,), (4,), (None,), (99,)], "doc_id long")
    rows = resample(odd, target).collect()
    assert len(rows) == odd.count()
    assert all(r.log_weight is None and not r.kept for r in rows if r.n_ngrams == 0)
    assert resample(empty, target).collect() == []
    assert all(r.log_weight == 0 for r in resample(odd, target.limit(0)).collect() if r.n_ngrams)
    assert words_of(*arrays([]))[0].size == 0


def test_equal_texts_weigh_alike(spark):
    """Whatever stands beside them: rows of one text are drawn together."""
    from quillon.llm.quality_classifier import resample

    texts = ["the same text with a few words of its own"] * 4
    rows = [(i % 3, t) for i, t in enumerate(texts)] + [(100 + i, f"some other words {i} " * (i % 50)) for i in range(300)] + [(7, texts[0]), (2, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(100 + i,) for i in range(0, 300, 3)], "doc_id long")
    weights = {r.log_weight for r in resample(docs, target).where("doc_id < 50").collect()}
    assert len(weights) == 1
