"""Token counts from pre-token counts, without ids.

A pre-token here is a maximal run without white space; the tokenizer never merges across it. Pieces are counted once per
distinct pre-token of the corpus, in a table. Each document's pre-token frequencies are joined to that table and summed.
The join has two ways by size: the most frequent HOT_ROWS pre-tokens (a bound on what is broadcast, whatever the corpus)
are looked up where the document is read; the rest is a shuffle join. No hot key is left in that shuffle, since the hot keys
are just those of the first way; counts are added up within each task before they are shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens. A text in which the cut at white space could be wrong
(special strings, control characters) is counted by the library as a whole. Repeated rows are counted row by row. Extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table, texts
from ._tokens import encoder, vocabulary

HOT_ROWS = 1 << 17
HOT_BYTES = 64  # a longer pre-token is never broadcast: at most HOT_ROWS * HOT_BYTES bytes of keys
FLUSH = 400_000  # distinct pre-tokens that a task holds before it passes on what it has counted


def pre_token_frequencies(docs: DataFrame, tokenizer: str) -> DataFrame:
    """pre_token, n: how often each occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = encoder(tokenizer).cut
        seen: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pre_token", "n"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(cut(text) or ())
                    if len(seen) > FLUSH:
                        yield flush()
                        seen.clear()
        yield flush()

    return docs.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def pieces_per_pre_token(frequencies: DataFrame, tokenizer: str) -> DataFrame:
    """pre_token, n, pieces; the tokenizer sees each pre-token once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = encoder(tokenizer).chunk
        for batch in batches:
            n = pa.array([len(chunk(p)) // 4 for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["pre_token", "n", "pieces"])

    return frequencies.mapInArrow(count, "pre_token string, n long, pieces long")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    d = texts(docs)
    spark = d.sparkSession
    counted = stored(pieces_per_pre_token(pre_token_frequencies(d, tokenizer), tokenizer))
    # Hot pre-tokens are those of the highest classes of frequency that together stay within the bound: a histogram of some
    # hundred classes finds them, and nothing is sorted in one place.
    short = counted.where(F.octet_length("pre_token") <= HOT_BYTES).withColumn("class", F.floor(16 * F.log2("n")).cast("int"))
    least, room = None, hot_rows
    for r in sorted(short.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["class"]):
        if r.n > room:
            break
        least, room = r["class"], room - r.n
    rows = short.where(F.col("class") >= least).select("pre_token", "pieces").toArrow() if least is not None else None
    hot = spark.sparkContext.broadcast(dict(zip(rows[0].to_pylist(), rows[1].to_pylist(), strict=True)) if rows else {})

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, get = encoder(tokenizer), hot.value.get
        for batch in batches:
            known, cold, counts = [], [], []
            for text in batch.column("text").to_pylist():
                chunks = e.cut(text) if text else []
                if chunks is None:
                    known.append(len(e.whole(text)) // 4)
                    chunks = []
                    cold.append([])
                    counts.append([])
                    continue
                found = list(map(get, chunks))
                if None in found:
                    rest = Counter(c for c, n in zip(chunks, found, strict=True) if n is None)
                    cold.append(list(rest))
                    counts.append(list(rest.values()))
                    found = filter(None, found)
                else:
                    cold.append([])
                    counts.append([])
                known.append(sum(found))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(known, pa.int64()), pa.array(cold, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "known", "cold", "counts"],
            )

    # A row number made of task and place keeps repeated ids apart; it is written, so that a task run again can't change it.
    split = d.mapInArrow(per_document, "doc_id long, n_bytes long, known long, cold array<string>, counts array<long>")
    split = stored(split.withColumn("row", F.monotonically_increasing_id()))
    cold = split.select("row", F.explode(F.arrays_zip("cold", "counts")).alias("c")).select("row", F.col("c.cold").alias("pre_token"), F.col("c.counts").alias("times"))
    rest = cold.join(counted.select("pre_token", "pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    return split.select("row", "doc_id", "n_bytes", "known").join(rest, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op7_token_counts": (op7_token_counts, None)}
