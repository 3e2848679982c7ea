"""Streams over the change log: events arrive as files, and each result equals its batch definition at the end of input.

Defined results: what comes late counts by its event time where a table is kept (the newest change of a document, the references of a
page); windows take what comes within their watermark. Null documents and users are values like others in counts and kept tables and
match nothing in joins. A stream without files gives empty results. Tables are read whether they are one file or a folder of many;
further columns are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.markup import references
from ..operators.markup import rows_of
from ..sources.storage import shared_path
from .kept import Kept


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as they arrive, some files a batch. A table that is one file is found among those that lie beside it."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", FILES)
    return files.parquet(path) if folder else files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


#: Files that a batch takes at most: what is held at once, whatever has arrived.
FILES = 64


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def into(stream: DataFrame, take, mode: str = "append") -> None:
    """Runs a stream over all that has arrived; take(batch, number) must give the same again for a batch that is run again."""
    path = shared_path(stream.sparkSession)
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that has arrived and gives back what it wrote, with the number of the batch."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession)
    schema = StructType(stream.schema.fields).add("batch", IntegerType())
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch_no=-1")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again overwrites its own folder, so nothing counts twice.
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    into(stream, keep, mode)
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/*").select(schema.names)


def keep_latest(changes: DataFrame, kept: Kept) -> None:
    """The newest of changes(document_id, at, event_id, event_type), a stream, by document."""
    into(changes, kept.merge)


LATEST = "document_id long, at timestamp, event_id long, event_type string"


def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    kept = Kept(spark, shared_path(spark), LATEST, ["document_id"])
    keep_latest(event_stream(spark, sf_dir).select((F.col("event_id") % n).alias("document_id"), F.col("ts").alias("at"), "event_id", "event_type"), kept)
    return kept.read().select("document_id", "event_id", "event_type")


def windowed_counts(events: DataFrame, width: str, slide: str, delay: str) -> DataFrame:
    w = F.window("ts", width, slide)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "top")


def windowed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by kind; a day is written once the watermark, an hour behind the newest event, has passed its end."""
    return drained(windowed_counts(event_stream(spark, sf_dir), "1 day", "1 day", "1 hour"), "append").drop("batch")


def notify_stream(spark: SparkSession, sf_dir: str, star: DataFrame) -> DataFrame:
    """How many followers of its document each change reaches: the stream joined to the table of stars, its author left out."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    changes = event_stream(spark, sf_dir).select(F.col("event_id").alias("revision_id"), (F.col("event_id") % n).alias("document_id"), F.col("user_id").alias("author"))
    told = changes.join(star.select("document_id", F.col("user_id").alias("follower")), "document_id").where("follower <> author")
    return drained(told.select("revision_id", "follower"), "append").drop("batch")


def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind over two days, anew every day; written once the watermark has passed a window's end."""
    return drained(windowed_counts(event_stream(spark, sf_dir), "2 days", "1 day", "1 hour"), "append").drop("batch")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's changes with less than six hours between them: when they began, how many and how much; written once they are over."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "1 hour")
    d = e.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return drained(d.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "top"), "append").drop("batch")


REFERENCES = "id long, at timestamp, links array<struct<kind: string, target: string>>"


def take_references(kept: Kept, batch: DataFrame, number: int) -> None:
    """A batch of pages(id, at, text): one row a text goes into the table, whether it has links or not."""
    links = "links array<struct<kind: string, target: string>>"
    linked = rows_of(batch.withColumn("at", F.unix_micros("at")), ["text"], lambda t: [([*dict.fromkeys(references(t, "Page/Sub"))],)], links, ("id", "at"))
    kept.merge(linked.withColumn("at", F.timestamp_micros("at")), number)


def keep_references(pages: DataFrame, kept: Kept) -> None:
    """The references of pages(id, at, text), a stream of their texts as they change: a newer text of a page replaces all that older ones
    referred to, also if it refers to nothing."""
    into(pages, lambda batch, number: take_references(kept, batch, number))


def links_of(kept: Kept) -> DataFrame:
    """id, kind, target of all pages."""
    return kept.read().select("id", F.explode("links").alias("l")).select("id", "l.kind", "l.target")


def references_stream(spark: SparkSession, sf_dir: str, markup: str) -> DataFrame:
    """The references of pages whose texts come as files; markup is a SELECT of (id, text) over {documents}. The files have no time of their
    own: the later batch counts."""
    pages = spark.sql(markup, documents=table_stream(spark, sf_dir, "documents"))
    kept = Kept(spark, shared_path(spark), REFERENCES, ["id"])
    keep_references(pages.select("id", F.lit(None).cast("timestamp").alias("at"), "text"), kept)
    return links_of(kept)
