"""Operators over revisions, documents and references. Each takes and returns DataFrames; every top-k has a total order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def author() -> Column:
    return F.coalesce("user_name", "ip", F.lit(""))


def display(namespace: str = "namespace", title: str = "title") -> Column:
    return F.when(F.col(namespace) == "main", F.col(title)).otherwise(F.concat_ws(":", namespace, title))


def with_titles(d: DataFrame, document: DataFrame, namespace: DataFrame) -> DataFrame:
    """document_id to namespace and title. Namespaces are a fixed list of a few rows."""
    names = document.select(F.col("id").alias("document_id"), "namespace_id", "title").join(F.broadcast(namespace.select(F.col("id").alias("namespace_id"), F.col("name").alias("namespace"))), "namespace_id")
    return d.join(names, "document_id")


def with_author(d: DataFrame, actor: DataFrame) -> DataFrame:
    return d.join(actor.select(F.col("id").alias("actor_id"), "user_name", "ip"), "actor_id").withColumn("author", author())


def latest(revision: DataFrame) -> DataFrame:
    """The newest revision of each document; the partial top-1 runs before the shuffle."""
    w = Window.partitionBy("document_id").orderBy(F.desc("sequence"))
    return revision.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def live(revision: DataFrame) -> DataFrame:
    """Newest revisions of documents that exist: the last one isn't a deletion."""
    return latest(revision).where("kind <> 'delete'")


def recent_changes(w, limit: int = 100) -> DataFrame:
    # The newest ids are picked from two columns before anything is joined to them, and only their documents' revisions are numbered.
    top = w.revision.select("id", "document_id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", "document_id")
    of_them = w.revision.join(F.broadcast(top.select("document_id").distinct()), "document_id", "left_semi").join(F.broadcast(top.select("id")), "id", "left_semi")
    d = with_author(with_titles(of_them, w.document, w.namespace), w.actor)
    return d.orderBy(F.desc("created_at"), F.desc("id")).select("id", display().alias("title"), "sequence", "kind", "author", "comment", "content_bytes", "created_at")


def revision_history(w, document_id: int, limit: int = 100) -> DataFrame:
    d = with_author(w.revision.where(F.col("document_id") == document_id), w.actor)
    return d.orderBy(F.desc("sequence")).limit(limit).select("sequence", "kind", "author", "comment", "content_bytes", "hidden", "created_at")


def contributions(w, who: str, limit: int = 200) -> DataFrame:
    mine = w.actor.where((F.col("user_name") == who) | (F.col("ip") == who)).select(F.col("id").alias("actor_id"))
    d = with_titles(w.revision.join(mine, "actor_id", "left_semi"), w.document, w.namespace)
    return d.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).select("id", display().alias("title"), "sequence", "kind", "created_at")


def live_titles(w) -> DataFrame:
    return with_titles(live(w.revision).select("document_id"), w.document, w.namespace).select("namespace", "title")


def existing_titles(w, titles: DataFrame) -> DataFrame:
    """Of asked (namespace, title), those that exist."""
    return titles.join(live_titles(w), ["namespace", "title"], "left_semi").select("namespace", "title")


def read_sources(w, titles: DataFrame) -> DataFrame:
    d = with_titles(live(w.revision).select("document_id", "content", "sequence"), w.document, w.namespace)
    return d.join(titles, ["namespace", "title"], "left_semi").select("namespace", "title", "sequence", "content")


def stale_pages(w, limit: int = 200) -> DataFrame:
    d = live(w.revision).orderBy("created_at", "document_id").limit(limit)
    return with_titles(d, w.document, w.namespace).select(display().alias("title"), "created_at")


def pages_by_length(w, longest: bool, limit: int = 200) -> DataFrame:
    size = F.col("content_bytes")
    d = live(w.revision).orderBy(-size if longest else size, "document_id").limit(limit)
    return with_titles(d, w.document, w.namespace).select(display().alias("title"), "content_bytes")


def title_suggest(w, prefix: str, limit: int = 10, escape: bool = False) -> DataFrame:
    """Without escape, % and _ in the prefix are wildcards. Blanks around the prefix don't count; nothing suggests nothing."""
    prefix = prefix.strip()
    if not prefix:
        return live_titles(w).where("false")
    pattern = (prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if escape else prefix) + "%"
    return live_titles(w).where(F.col("title").ilike(pattern)).orderBy(F.length("title"), "title", "namespace").limit(limit)


def needed_pages(w, limit: int = 200) -> DataFrame:
    """Targets without a document row, most wanted first."""
    have = w.document.select(F.col("namespace_id").alias("target_namespace_id"), F.col("title").alias("target_title"))
    d = w.reference.join(have, ["target_namespace_id", "target_title"], "left_anti").groupBy("target_namespace_id", "target_title").agg(F.count(F.lit(1)).alias("wanted"))
    d = d.orderBy(F.desc("wanted"), "target_title", "target_namespace_id").limit(limit)
    return d.join(F.broadcast(w.namespace.select(F.col("id").alias("target_namespace_id"), F.col("name").alias("namespace"))), "target_namespace_id").select(display("namespace", "target_title").alias("title"), "wanted")


def orphaned_pages(w, limit: int = 200) -> DataFrame:
    alive = w.document.join(live(w.revision).select(F.col("document_id").alias("id")), "id", "left_semi")
    aimed = w.reference.select(F.col("target_namespace_id").alias("namespace_id"), F.col("target_title").alias("title"))
    return alive.join(aimed, ["namespace_id", "title"], "left_anti").orderBy("namespace_id", "title").limit(limit).select("namespace_id", "title")


def uncategorized_pages(w, limit: int = 200) -> DataFrame:
    alive = w.document.join(live(w.revision).select(F.col("document_id").alias("id")), "id", "left_semi")
    filed = w.reference.where("kind = 'category'").select(F.col("source_id").alias("id"))
    return alive.join(filed, "id", "left_anti").orderBy("namespace_id", "title").limit(limit).select("namespace_id", "title")


def backlinks(w, namespace_id: int, title: str, live_only: bool = False) -> DataFrame:
    d = w.reference.where((F.col("target_namespace_id") == namespace_id) & (F.col("target_title") == title)).select(F.col("source_id").alias("document_id"), "kind")
    if live_only:
        d = d.join(live(w.revision).select("document_id"), "document_id", "left_semi")
    return with_titles(d, w.document, w.namespace).select(display().alias("title"), "kind")


def backlink_counts(w) -> DataFrame:
    return w.reference.groupBy("target_namespace_id", "target_title").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("kind").alias("kinds"))


def category_members(w) -> DataFrame:
    d = w.reference.where("kind = 'category' AND target_namespace_id = 2").select(F.col("source_id").alias("document_id"), F.col("target_title").alias("category"))
    return with_titles(d, w.document, w.namespace).select("category", display().alias("member"))


def last_edited_by(w, who: str) -> DataFrame:
    d = with_author(latest(w.revision), w.actor).where((F.col("user_name") == who) | (F.col("ip") == who))
    return with_titles(d, w.document, w.namespace).select(display().alias("title"), "sequence")


def previous_revisions(w, newest: int = 500) -> DataFrame:
    """Each revision with the text before it; none is empty. The newest revisions alone are seen, the oldest of them with what came before."""
    rank = Window.partitionBy("document_id").orderBy(F.desc("sequence"))
    d = w.revision.withColumn("before", F.lead("content").over(rank)).withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= newest)
    return d.select("document_id", "sequence", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("content", F.lit("")).alias("after"))


def content_before(w, newest: int = 500) -> DataFrame:
    """For each live document the newest revision by somebody else than its last author; a deletion there is left out."""
    rank = Window.partitionBy("document_id").orderBy(F.desc("sequence"))
    d = with_author(w.revision, w.actor).withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= newest)
    last = d.where("rn = 1").select("document_id", F.col("author").alias("last_author"))
    other = d.join(last, "document_id").where("author <> last_author").withColumn("rn", F.row_number().over(rank)).where("rn = 1 AND content IS NOT NULL")
    return other.select("document_id", "last_author", "author", "sequence", "content")


def blame(w, newest: int = 500) -> DataFrame:
    """Each line of the newest text with the revision that last changed that line number. Revisions without text are skipped."""
    rank = Window.partitionBy("document_id").orderBy(F.desc("sequence"))
    d = w.revision.where("content IS NOT NULL").withColumn("back", F.row_number().over(rank)).where(F.col("back") <= newest)
    lines = d.select("document_id", "sequence", "actor_id", "back", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    at = Window.partitionBy("document_id", "line").orderBy("sequence")
    # A line that the revision just before had with the same text keeps its origin; any other starts one here.
    kept = (F.lag("back").over(at) == F.col("back") + 1) & (F.lag("text").over(at) == F.col("text"))
    origin = F.last(F.when(~F.coalesce(kept, F.lit(False)), F.struct("sequence", "actor_id")), ignorenulls=True).over(at)
    return lines.withColumn("o", origin).where("back = 1").select("document_id", F.col("line").cast("long").alias("line"), "text", F.col("o.sequence").alias("since"), F.col("o.actor_id").alias("actor_id"))


def next_sequence(w, batch: DataFrame) -> DataFrame:
    """Numbers for new rows (document_id, id): after the highest so far, in id order. Only the batch's documents are looked up."""
    top = w.revision.join(batch.select("document_id").distinct(), "document_id", "left_semi").groupBy("document_id").agg(F.max("sequence").alias("top"))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("id"))
    return batch.withColumn("nth", nth).join(top, "document_id", "left").select("document_id", "id", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("sequence"))


def content_dedup(d: DataFrame) -> DataFrame:
    """Stored contents by hash: first id, copies and size."""
    return d.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("text")).cast("long").alias("byte_size"))


def moved(w, source: int, target_title: str) -> DataFrame:
    """Documents after a rename of one; where the title is taken in its namespace, the two swap."""
    one = w.document.where(F.col("id") == source).select(F.col("namespace_id"), F.col("title").alias("old"))
    d = w.document.join(F.broadcast(one), "namespace_id", "left")
    title = F.when(F.col("id") == source, F.lit(target_title)).when((F.col("title") == target_title) & F.col("old").isNotNull(), F.col("old")).otherwise(F.col("title"))
    return d.select("id", "namespace_id", title.alias("title"))


def replaced_references(w, source: int, new: DataFrame) -> DataFrame:
    """References after one document's are replaced by new (target_namespace_id, target_title, kind); doubles fall together."""
    kept = w.reference.where(F.col("source_id") != source)
    return kept.unionByName(new.withColumn("source_id", F.lit(source).cast("long")).dropDuplicates())


def toggled_stars(w, user: int, documents: list[int], at: datetime) -> DataFrame:
    """Stars after a user presses the star of documents: off where there is one, on where there is none."""
    spark = w.star.sparkSession
    pressed = spark.createDataFrame([(user, d) for d in documents], "user_id long, document_id long")
    off = w.star.join(F.broadcast(pressed), ["user_id", "document_id"], "left_anti")
    on = pressed.join(w.star, ["user_id", "document_id"], "left_anti").withColumn("created_at", F.lit(at).cast("timestamp_ntz"))
    return off.unionByName(on)


def deleted(w, document_ids: list[int], actor: int, at: datetime) -> DataFrame:
    """The revisions that deleting documents appends."""
    batch = w.document.where(F.col("id").isin(document_ids)).join(live(w.revision).select(F.col("document_id").alias("id")), "id", "left_semi").select(F.col("id").alias("document_id"), "id")
    return next_sequence(w, batch).select("document_id", "sequence", F.lit("delete").alias("kind"), F.lit(actor).cast("long").alias("actor_id"), F.lit(at).cast("timestamp_ntz").alias("created_at"))
