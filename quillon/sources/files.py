"""Files as sources and sinks: markup dumps, corpus cases, and binary contents by their hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_title


def scanned(spark: SparkSession, path: str, pattern: str = "*.namu") -> DataFrame:
    """path, content of all files below path whose name fits; those that are not UTF-8 are left out."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return d.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("content")).where("content is not null")


def title_of(path: Column) -> tuple[Column, Column]:
    """Namespace and title that a file's name stands for: without its ending, with spaces for low lines. Spark's readers take no name with
    a colon; it is written %3A, as in addresses."""
    name = F.url_decode(F.replace(F.substring_index(path, "/", -1), F.lit("+"), F.lit("%2B")))
    return parse_title(F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("_"), F.lit(" ")))


def imported(w, path: str, actor_id: int, at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two passes over a dump: documents and revisions to append, and then the references afterwards, which see all that is imported.
    Files that stand for one title are revisions of one page, in the order of their paths."""
    from ..operators import changes as C

    files = scanned(w.document.sparkSession, path).select(F.xxhash64("path").alias("id"), "content", *title_of(F.col("path")))
    spaces = w.namespace.select(F.col("id").alias("namespace_id"), F.col("name").alias("namespace"))
    batch = C.stored(files.join(F.broadcast(spaces), "namespace").select("id", "namespace_id", "title", F.lit("import").alias("kind"), F.lit(actor_id).cast("long").alias("actor_id"), "content", F.lit("덤프 임포트").alias("comment")))
    documents, revisions = C.recorded(w, batch, at)
    revisions = C.stored(revisions)
    newest = revisions.groupBy("document_id").agg(F.max(F.struct("sequence", "content")).alias("r")).select(F.col("document_id").alias("id"), F.col("r.content").alias("text"))
    references = C.replaced_references_of(w, newest.select(F.col("id").alias("source_id")), C.references_of(w, newest))
    return documents, revisions, references


def store_contents(contents: DataFrame, path: str) -> DataFrame:
    """Writes contents(content, media_type) below path, each different one once, in folders by the start of its hash, and gives back the
    rows (hash, media_type, byte_size) of those that were not there yet."""
    spark = contents.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    d = contents.where("content is not null").withColumn("hash", F.sha2("content", 256))
    once = d.groupBy("hash").agg(F.min("media_type").alias("media_type"), F.any_value("content").alias("content"))
    if there:
        once = once.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    from .storage import stored

    new = stored(once.withColumn("start", F.substring("hash", 1, 2)))
    new.repartition("start").write.mode("append").partitionBy("start").parquet(path)
    return new.select("hash", "media_type", F.octet_length("content").cast("long").alias("byte_size"))


def corpus_cases(spark: SparkSession, path: str) -> DataFrame:
    """path, grade, description, source, semantics, ir, markup of corpus case files. The first line gives the grade, the numbers of lines
    of the four sections that follow, and a description, with bars between; files that are not so are left out."""
    d = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("l"))
    head = F.split(F.get("l", F.lit(0)), r" \| ", 6)
    n = [F.regexp_extract(F.get(head, F.lit(i)), r"^(?:원문|의미론|IR|렌더링): (\d+)줄$", 1).try_cast("int") for i in range(1, 5)]
    d = d.select("path", "l", head.alias("head"), *[x.alias(f"n{i}") for i, x in enumerate(n)]).where("n0 is not null and n1 is not null and n2 is not null and n3 is not null")
    begin, parts = F.lit(2), []
    for i, name in enumerate(("source", "semantics", "ir", "markup")):
        parts.append(F.array_join(F.slice("l", begin, F.col(f"n{i}")), "\n").alias(name))
        begin = begin + F.col(f"n{i}")
    return d.select("path", F.regexp_replace(F.get("head", F.lit(0)), "^근거: ", "").alias("grade"), F.get("head", F.lit(5)).alias("description"), *parts)


def evidence(cases: DataFrame, help_text: str) -> DataFrame:
    """path, shown of corpus cases: whether every line of the source, trimmed, stands in the help text (given once, some pages long)."""
    lines = F.filter(F.transform(F.split("source", "\n"), F.trim), lambda x: x != "")
    return cases.select("path", F.forall(lines, lambda x: F.contains(F.lit(help_text), x)).alias("shown"))
