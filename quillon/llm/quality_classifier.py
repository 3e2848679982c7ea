"""Importance resampling: documents drawn by the ratio of two hashed n-gram models, target against raw text, with Gumbel top-k.

Both models are counts of hashed word unigrams and bigrams over all documents concerned; a bounded vector of BUCKETS numbers
each. A document's log weight is the sum of the log ratios of its n-grams, whatever their number; a caller may ask that it
counts as the sum of so many n-grams at most (effective). With independent Gumbel noise added, the k largest keys are a
sample without replacement in proportion to the weights. The k-th largest key is found exactly by counting histograms of all
keys, ever finer; nothing is sorted in one place.

Defined results: null and word-free texts have no n-grams, a null log weight and key, and are never drawn. The noise comes
from doc_id, so repeated rows are drawn together; rows that tie with the k-th key are all drawn. Documents with a null id
share their noise. Labels of absent documents count for nothing; a document labelled several times counts once if any
label fits. Without any target document all weights are 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, frugal, pieces, stored, table, texts, utf8
from .near_duplicates import words_of

BUCKETS = 10_000
SMOOTHING = 1.0
SHARE = 0.75  # of the documents with a weight that are drawn
BINS = 4096
IDS = 1_000_000  # labelled ids that are broadcast, 8 bytes each and their table


def ngram_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash bucket of every unigram and bigram, unigrams of a text first, and where each text begins."""
    word, first = words_of(raw, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    one = (word % U64(buckets)).astype(np.int64)
    pair = word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:]
    pair ^= pair >> U64(31)
    inside = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)
    two = (pair[inside] % U64(buckets)).astype(np.int64)
    order = np.argsort(np.concatenate([doc, doc[:-1][inside] if len(doc) else doc]), kind="stable")
    counts = n + np.maximum(n - 1, 0)
    return np.concatenate([one, two])[order], np.concatenate([[0], np.cumsum(counts)])


def counted(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts by bucket over all texts of docs(text, wanted), and over the wanted ones."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for big in batches:
            for batch in pieces(big):
                bucket, begin = ngram_buckets(*utf8(batch.column("text")), buckets)
                hit = batch.column("wanted").to_numpy(zero_copy_only=False).astype(bool)
                total[0] += np.bincount(bucket, minlength=buckets)
                total[1] += np.bincount(bucket[np.repeat(hit, np.diff(begin))], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["bucket", "n", "t"])

    rows = docs.select("text", "wanted").mapInArrow(count, "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    out = np.zeros((2, buckets), np.int64)
    for i, c in enumerate("nt"):
        out[i, rows["bucket"].to_numpy()] = rows[c].to_numpy()
    return out[0], out[1]


def models(docs: DataFrame, wanted: DataFrame, buckets: int = BUCKETS, most: int = IDS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all documents and of the wanted ones (distinct doc_id), in one pass over the texts. Up to most ids are broadcast to
    them; more meet them in a shuffle by doc_id."""
    ids = wanted.select("doc_id", F.lit(True).alias("wanted"))
    ids = F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_merge")
    return counted(docs.join(ids, "doc_id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted")), buckets)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    p, q = ((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c)) for c in (target, raw))
    return np.log(p) - np.log(q)


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise that follows from doc_id."""
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The exact k-th largest of keys(key), by a histogram of the part that holds it, again and again."""
    seen = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    low, high, n = seen
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / BINS
        bin_no = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / width))
        rows = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(bin_no.alias("bin")).agg(F.count("key").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r.bin):
            if r.n >= k:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE, seed: int = 1, most: int = IDS, effective: int | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_weight, sample_key, kept. target: (doc_id) of the documents to be like. With effective, the log weight of
    a text of more n-grams is scaled down to that many, so that length decides less."""
    d = texts(docs)
    wanted = target.select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    raw, like = models(d, wanted, most=most)
    ratios = d.sparkSession.sparkContext.broadcast(log_ratios(like, raw))

    @frugal
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                bucket, begin = ngram_buckets(*utf8(batch.column("text")), BUCKETS)
                n, total = np.diff(begin), np.zeros(len(begin) - 1)
                if len(bucket):  # each text on its own, so that equal ones weigh alike to the last bit
                    total[n > 0] = np.add.reduceat(ratios.value[bucket], begin[:-1][n > 0])
                weight = total * np.minimum(1.0, effective / np.maximum(n, 1)) if effective else total
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(weight, mask=n == 0)], ["doc_id", "n_ngrams", "log_weight"])

    weighed = d.mapInArrow(weigh, "doc_id long, n_ngrams long, log_weight double")
    keyed = stored(weighed.withColumn("sample_key", F.col("log_weight") + gumbel(seed)))
    n = keyed.agg(F.count("sample_key")).first()[0]
    least = kth_largest(keyed.select(F.col("sample_key").alias("key")).where("key is not null"), round(share * n))
    return keyed.withColumn("kept", F.coalesce(F.col("sample_key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return resample(table(spark, sf_dir, "documents"), labels)


QUERIES = {"op6_quality_classifier": (op6_quality_classifier, None)}
