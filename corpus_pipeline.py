"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it returns is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined results, stage by stage:

* A null, empty or word-free text breaks a quality rule and goes at once; no later stage sees one unless its caller starts there. Then
  it is near to nothing, repeats nothing, holds no test item, and is packed as its end id alone.
* A null doc_id is linked with nothing and kept; rows that share an id and a text are one document, of which one row stays after
  near_duplicate_groups; rows that share an id with different texts are judged each by its own text, and go together if
  their id is another document's near-duplicate.
* Ties (equal texts of different ids) keep the least id. A text that loses all its bytes to repeated_passages stays as an empty one.
* Very long texts are worked on whole. An empty table gives an empty result. Columns beyond those of documents are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import stored, table
from quillon.llm._tokens import vocabulary
from quillon.llm.decontamination import find
from quillon.llm.near_duplicates import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.quality_rules import passing
from quillon.llm.repeats import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule."""
    return passing(docs)


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the least id, once."""
    found = near_duplicates(docs, size=5, percent=80).where("doc_id is not null").select("doc_id", "kept")
    marked = stored(found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("times")).where("not kept or times > 1"))
    left = docs.select(COLUMNS).join(marked.hint("merge"), "doc_id", "left").where("kept is null or kept")
    if marked.where("kept").isEmpty():
        return left.select(COLUMNS)
    # Some ids stand in several rows: only these rows are compared with each other.
    left = stored(left)
    return left.where("times is null").select(COLUMNS).union(left.where("times is not null").select(COLUMNS).dropDuplicates(["doc_id", "text"]))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that also start earlier; n_chars follows the text, and no row goes."""
    left = remove_repeats(docs, ("lang", "source", "n_chars"))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test item occurs."""
    return find(docs, table(spark, sf_dir, "benchmark"), more=("text", "lang", "source", "n_chars")).where("not contaminated").select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicate_groups, repeated_passages, benchmark_decontamination, best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
