"""Changes of a wiki as jobs over whole batches: each takes tables and a batch, and gives the rows to append or the table afterwards.

Times are parameters, never the clock. A batch reads the revisions of its own pages alone; the rest of the log is never grouped or
sorted. Defined results: rows of a batch that name what isn't there, or may not be done, change
nothing; repeated rows of a batch count as often as they stand there where rows are appended, and once where a state is set; a null
key matches nothing; an empty batch changes nothing. Further columns of a batch are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.diff import merge3
from ..sources.storage import stored
from .markup import scan_references
from .pages import content_before, latest, live, next_sequence
from .reads import good_media

#: Comments that the wiki writes itself.
REVERTED, BATCH_REVERTED, UPLOADED, MAIN_MADE = "되돌림", "{}의 편집 일괄 되돌림", "파일 올림", "대문 만들기"


def _at(at: datetime) -> Column:
    return F.lit(at).cast("timestamp_ntz")


def numbered(d: DataFrame, by: list[str], after: Column, name: str = "id") -> DataFrame:
    """d with numbers after a given one, in the order of the columns in by. Rows are counted where a range sort puts them, and the
    counts of the tasks added up; nothing is sorted in one place."""
    place = F.monotonically_increasing_id()
    d = stored(d.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", place))
    task, nth = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = d.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))  # one row per task
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return d.withColumn("_task", task).join(F.broadcast(before), "_task").withColumn(name, (after + F.col("_before") + nth + 1).cast("long")).drop("_place", "_task", "_before")


# --- pages ----------------------------------------------------------------------------------------------------------


def ensured_documents(w, titles: DataFrame, at: datetime) -> DataFrame:
    """The document rows to append for titles(namespace_id, title) that have none yet."""
    new = titles.select("namespace_id", "title").where("namespace_id is not null and title is not null").distinct().join(w.document, ["namespace_id", "title"], "left_anti")
    top = w.document.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new, ["namespace_id", "title"], F.lit(top)).select("id", "namespace_id", "title", _at(at).alias("created_at"))


def ensured_actors(w, people: DataFrame) -> DataFrame:
    """The actor rows to append for people(user_name, ip), exactly one of them given, that have none yet."""
    one = people.select("user_name", "ip").where("(user_name is null) <> (ip is null)").distinct()
    same = lambda a, b: F.col(f"p.{a}").eqNullSafe(F.col(f"a.{a}")) & F.col(f"p.{b}").eqNullSafe(F.col(f"a.{b}"))
    new = one.alias("p").join(w.actor.select("user_name", "ip").alias("a"), same("user_name", "ip"), "left_anti")
    top = w.actor.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return numbered(new.withColumn("key", F.coalesce("user_name", "ip")), ["key"], F.lit(top)).select("id", "user_name", "ip")


def of_pages(w, pages: DataFrame) -> DataFrame:
    """The revisions of pages(document_id) alone."""
    return w.revision.join(pages.select("document_id").where("document_id is not null").distinct(), "document_id", "left_semi")


def sequenced(w, rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a sequence each, after the highest that their document has, in the order of the columns in by. Every row is numbered where
    a range sort over documents and order puts it, so that repeated rows stay rows of their own, and a page with many of them is
    spread over tasks like any others."""
    placed = numbered(rows.where("document_id is not null"), ["document_id", *by], F.lit(0), "_nth")
    first = placed.groupBy("document_id").agg(F.min("_nth").alias("_first"))
    top = of_pages(w, first).groupBy("document_id").agg(F.max("sequence").alias("_top"))
    known = first.join(top, "document_id", "left").select("document_id", (F.coalesce("_top", F.lit(0)) - F.col("_first") + 1).alias("_before"))
    return placed.join(known, "document_id").withColumn("sequence", F.col("_before") + F.col("_nth")).drop("_nth", "_before")


def recorded(w, batch: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """Documents and revisions to append for batch(id, namespace_id, title, kind, actor_id, content, comment), numbered in the order of
    id within a page."""
    batch = batch.select("id", "namespace_id", "title", "kind", "actor_id", "content", "comment")
    documents = stored(ensured_documents(w, batch, at))
    known = w.document.select(F.col("id").alias("document_id"), "namespace_id", "title").unionByName(documents.select(F.col("id").alias("document_id"), "namespace_id", "title"))
    rows = batch.join(known, ["namespace_id", "title"])
    return documents, _numbered_revisions(w, rows.select("id", "document_id", "kind", "actor_id", "content", "comment"), at)


REVISION = ["document_id", "sequence", "id", "kind", "actor_id", "content", "comment", "metadata", "content_bytes", "created_at"]


def _as_revisions(rows: DataFrame, at: datetime) -> DataFrame:
    if "metadata" not in rows.columns:
        rows = rows.withColumn("metadata", F.lit(None).cast("string"))
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    return rows.withColumn("content_bytes", size).withColumn("created_at", _at(at)).select(REVISION)


def _numbered_revisions(w, rows: DataFrame, at: datetime) -> DataFrame:
    """Revisions of rows(id, document_id, kind, actor_id, content, comment and perhaps metadata)."""
    return _as_revisions(sequenced(w, rows, ["id"]), at)


def reverted(w, batch: DataFrame, at: datetime) -> DataFrame:
    """The revisions that batch(id, document_id, revision_id, actor_id) appends: the old text of a revision of that document, if it has
    one, and which revision that was as JSON."""
    batch = batch.select("id", "document_id", "revision_id", "actor_id")
    old = of_pages(w, batch).where("content is not null").select("document_id", F.col("id").alias("revision_id"), "content")
    whence = F.to_json(F.struct(F.col("revision_id").alias("to_revision"))).alias("metadata")
    rows = batch.join(old, ["document_id", "revision_id"]).select("id", "document_id", F.lit("revert").alias("kind"), "actor_id", "content", F.lit(REVERTED).alias("comment"), whence)
    return _numbered_revisions(w, rows, at)


def batch_reverted(w, who: str, actor_id: int, at: datetime, limit: int = 100) -> DataFrame:
    """The revisions that bring pages last edited by who back to what stood there before them; the first pages by id, a bounded report."""
    plan = content_before(w).where(F.col("last_author") == who).orderBy("document_id").limit(limit)
    whose = F.to_json(F.struct(F.lit(who).alias("batch_revert"))).alias("metadata")
    comment = F.lit(BATCH_REVERTED.format(who)).alias("comment")
    rows = plan.select(F.col("document_id").alias("id"), "document_id", F.lit("revert").alias("kind"), F.lit(actor_id).cast("long").alias("actor_id"), "content", comment, whose)
    return _numbered_revisions(w, rows, at)


#: What an edit leads to. base_revision_id is that of a conflict: what its author has to start from.
OUTCOME = "document_id long, sequence long, id long, kind string, actor_id long, content string, comment string, conflict boolean, base_revision_id long"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages in order: what stands in a page, then its edits one after another, each applied to the result of the one before. Held
    are the page's text and the texts of those edits that later ones are based on."""
    page, latest_id, sequence, text, made = object(), None, 0, "", {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["document_id"] != page:
                page, latest_id, sequence, text, made = r["document_id"], None, 0, "", {}
            if r["stands"]:
                latest_id, sequence, text = r["id"], r["sequence"], r["content"] or ""
                continue
            content, conflict = r["content"] or "", False
            if r["base_revision_id"] != latest_id:
                base = r["base"] if r["base"] is not None else made.get(r["base_revision_id"], "")
                content, conflict = merge3(base, text, content)
            if conflict:
                rows.append((page, None, r["id"], None, r["actor_id"], content, r["comment"], True, latest_id))
                continue
            sequence += 1
            rows.append((page, sequence, r["id"], "edit" if text else "create", r["actor_id"], content, r["comment"], False, None))
            latest_id, text = r["id"], content
            if r["asked"]:
                made[latest_id] = text
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split(" ")[0] for c in OUTCOME.split(", ")])


def edited(w, batch: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """What batch(id, document_id, base_revision_id, actor_id, content and perhaps comment) leads to: revisions to append, and (id, content,
    base_revision_id) of edits that conflict, with marks, for their authors to settle. A page's edits are taken in the order of id, each
    with what the one before has made: an edit based on the newest revision stays as it is, any other is merged with what came
    between, an edit of the same batch being a base like a stored one. n edits have n outcomes. Pages are folded side by side;
    a page's own edits follow each other, as a stream that holds one text."""
    comment = F.col("comment") if "comment" in batch.columns else F.lit("")
    batch = batch.select("id", "document_id", "base_revision_id", "actor_id", "content", F.coalesce(comment, F.lit("")).alias("comment")).where("document_id is not null")
    log = of_pages(w, batch)
    base = log.select("document_id", F.col("id").alias("base_revision_id"), F.coalesce("content", F.lit("")).alias("base"))
    asked = batch.select("document_id", F.col("base_revision_id").alias("id"), F.lit(True).alias("asked")).where("id is not null").distinct()
    edits = batch.join(base, ["document_id", "base_revision_id"], "left").join(asked, ["document_id", "id"], "left").withColumn("stands", F.lit(False))
    now = latest(log).select("document_id", "id", "sequence", "content", F.lit(True).alias("stands"))
    rows = edits.unionByName(now, allowMissingColumns=True).repartition("document_id").sortWithinPartitions("document_id", F.desc("stands"), "id", "base_revision_id", "content")
    outcome = stored(rows.mapInArrow(_folded, OUTCOME))
    return _as_revisions(outcome.where("not conflict"), at), outcome.where("conflict").select("id", "content", "base_revision_id")


def move_revision(w, source: int, target_title: str, actor_id: int, at: datetime) -> DataFrame:
    """The revision that a rename of a live page appends: its text, and whence and whither as JSON."""
    now = live(w.revision).where(F.col("document_id") == source).select("document_id", "content", F.col("document_id").alias("id"))
    d = now.join(w.document.where(F.col("id") == source).select(F.col("id").alias("document_id"), F.col("title").alias("from"), F.lit(target_title).alias("to")), "document_id")
    n = next_sequence(w, d.select("document_id", "id"))  # of one page
    return d.join(n, ["document_id", "id"]).select("document_id", "sequence", F.lit("move").alias("kind"), F.lit(actor_id).cast("long").alias("actor_id"), "content", F.to_json(F.struct("from", "to")).alias("metadata"), _at(at).alias("created_at"))


def replaced_references_of(w, sources: DataFrame, new: DataFrame) -> DataFrame:
    """References after those of sources(source_id) are replaced by new(source_id, target_namespace_id, target_title, kind); unknown
    namespaces are skipped, doubles fall together."""
    kept = w.reference.join(sources.select("source_id").distinct(), "source_id", "left_anti")
    known = w.namespace.select(F.col("id").alias("target_namespace_id"))
    columns = ["source_id", "target_namespace_id", "target_title", "kind"]
    return kept.select(columns).unionByName(new.join(F.broadcast(known), "target_namespace_id", "left_semi").select(columns).dropDuplicates())


def references_of(w, pages: DataFrame) -> DataFrame:
    """(source_id, target_namespace_id, target_title, kind) that pages(id, text) refer to, by their markup."""
    from ..functions.text import parse_title

    d = scan_references(pages).select(F.col("id").alias("source_id"), "kind", *parse_title(F.col("target")))
    named = w.namespace.select(F.col("id").alias("target_namespace_id"), F.col("name").alias("namespace"))
    return d.join(F.broadcast(named), "namespace").select("source_id", "target_namespace_id", F.col("title").alias("target_title"), "kind")


def side_effects(w, changed: DataFrame, index) -> tuple[DataFrame, DataFrame]:
    """What follows from changed pages(id, revision_id, actor_id, text): the references afterwards and the notifications to append; the
    pages' texts go to the search index and are committed there."""
    refs = replaced_references_of(w, changed.select(F.col("id").alias("source_id")), references_of(w, changed.select("id", "text")))
    names = w.document.join(F.broadcast(w.namespace.select(F.col("id").alias("namespace_id"), F.col("name").alias("namespace"))), "namespace_id").select("id", "namespace", "title")
    index.put(changed.join(names, "id").select("namespace", "title", F.col("text").alias("content")))
    index.commit()
    return refs, notified(w, changed.select("revision_id", F.col("id").alias("document_id"), "actor_id"))


def main_page(w, title: str, text: str, actor_id: int, at: datetime) -> DataFrame:
    """The revision that makes the main page, unless it has ever had one: a deleted main page stays deleted."""
    one = w.document.sparkSession.createDataFrame([(0, title, text, actor_id)], "namespace_id long, title string, content string, actor_id long")
    had = w.revision.join(w.document.select(F.col("id").alias("document_id"), "namespace_id", "title"), "document_id").select("namespace_id", "title")
    return one.join(had, ["namespace_id", "title"], "left_anti").select("title", F.lit(1).cast("long").alias("sequence"), F.lit("create").alias("kind"), "actor_id", "content", F.lit(MAIN_MADE).alias("comment"), _at(at).alias("created_at"))


def uploaded(w, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What batch(id, name, license, category, description, media_type, bytes) leads to: pages (id, title, text, hash, license) of the
    uploads that say all they must, of a medium that is taken; and the contents (hash, media_type, byte_size) that are new, once
    each."""
    batch = batch.select("id", "name", "license", "category", "description", "media_type", "bytes")
    full = (F.trim("name") != "") & (F.col("license") != "") & (F.trim("category") != "") & good_media(F.col("media_type"))
    d = batch.where(full).join(F.broadcast(w.licence.select(F.col("name").alias("license"))), "license", "left_semi").withColumn("hash", F.sha2(F.col("bytes").cast("binary"), 256))
    text = F.concat(F.coalesce(F.trim("description"), F.lit("")), F.lit("\n[[분류:"), F.trim("category"), F.lit("]]"))
    pages = d.select("id", F.trim("name").alias("title"), text.alias("text"), "hash", "license")
    return pages, d.groupBy("hash").agg(F.min("media_type").alias("media_type"), F.max(F.octet_length("bytes")).cast("long").alias("byte_size"))


def hidden_revisions(w, batch: DataFrame) -> DataFrame:
    """id, hidden of all revisions after batch(id, hide) has set some."""
    b = batch.groupBy("id").agg(F.max("hide").alias("hide"))
    return w.revision.select("id", "hidden").join(b, "id", "left").select("id", F.coalesce("hide", "hidden").alias("hidden"))


# --- discussions ----------------------------------------------------------------------------------------------------


def _comments(w, rows: DataFrame) -> DataFrame:
    """Comments to append, numbered after those that a thread has: rows(thread_id, id, kind, author, content, metadata)."""
    top = w.thread_comment.groupBy("thread_id").agg(F.max("sequence").alias("top"))
    nth = F.row_number().over(Window.partitionBy("thread_id").orderBy("id"))
    return rows.withColumn("nth", nth).join(top, "thread_id", "left").select("thread_id", (F.coalesce("top", F.lit(0)) + F.col("nth")).alias("sequence"), "kind", "author", "content", "metadata")


def created_threads(w, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads and first comments to append for batch(key, document_id, topic, author, content) on documents that exist."""
    batch = batch.select("key", "document_id", "topic", "author", "content")
    there = batch.join(w.document.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    top = w.thread.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    t = stored(numbered(there, ["key"], F.lit(top)))
    return t.select("id", "document_id", F.lit("normal").alias("status"), "topic"), t.select(F.col("id").alias("thread_id"), F.lit(1).cast("long").alias("sequence"), F.lit("comment").alias("kind"), "author", "content")


def added_comments(w, batch: DataFrame) -> DataFrame:
    """Comments to append for batch(id, thread_id, author, content): threads that are not normal take none."""
    batch = batch.select("id", "thread_id", "author", "content")
    taking = w.thread.where("status = 'normal'").select(F.col("id").alias("thread_id"))
    rows = batch.join(taking, "thread_id", "left_semi").select("thread_id", "id", F.lit("comment").alias("kind"), "author", "content", F.lit(None).cast("string").alias("metadata"))
    return _comments(w, rows)


def changed_threads(w, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads after batch(id, thread_id, author, what, to), what being status or topic, and the comments that tell of it. Of several
    changes of one kind the last by id counts."""
    batch = batch.select("id", "thread_id", "author", "what", "to")
    known = batch.join(w.thread.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    last = known.groupBy("thread_id").agg(*[F.max(F.when(F.col("what") == c, F.struct("id", "to")))["to"].alias(f"new_{c}") for c in ("status", "topic")])
    threads = w.thread.join(last.withColumnRenamed("thread_id", "id"), "id", "left").select("id", "document_id", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_topic", "topic").alias("topic"))
    told = F.when(F.col("what") == "status", F.to_json(F.struct(F.col("to").alias("to")))).otherwise(F.to_json(F.struct(F.col("to").alias("topic"))))
    return threads, _comments(w, known.select("thread_id", "id", F.concat("what", F.lit("_change")).alias("kind"), "author", F.lit("").alias("content"), told.alias("metadata")))


def hidden_comments(w, batch: DataFrame, at: datetime) -> DataFrame:
    """thread_id, sequence, hidden, hidden_by, hidden_at of all comments after batch(thread_id, sequence, actor_id)."""
    b = batch.groupBy("thread_id", "sequence").agg(F.max("actor_id").alias("hidden_by"))
    d = w.thread_comment.select("thread_id", "sequence", "hidden").join(b, ["thread_id", "sequence"], "left")
    return d.select("thread_id", "sequence", (F.col("hidden") | F.col("hidden_by").isNotNull()).alias("hidden"), "hidden_by", F.when(F.col("hidden_by").isNotNull(), _at(at)).alias("hidden_at"))


def submitted_requests(w, batch: DataFrame, at: datetime) -> DataFrame:
    """Edit requests to append for batch(key, document_id, base_revision_id, actor_id, content) on documents that exist; a base that
    isn't there is none."""
    batch = batch.select("key", "document_id", "base_revision_id", "actor_id", "content")
    there = batch.join(w.document.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    base = w.revision.select(F.col("id").alias("base_revision_id"), F.col("id").alias("base"))
    top = w.edit_request.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    d = numbered(there.join(base, "base_revision_id", "left"), ["key"], F.lit(top))
    return d.select("id", "document_id", F.col("base").alias("base_revision_id"), "actor_id", "content", F.lit("open").alias("status"), _at(at).alias("created_at"))


def settled_requests(w, batch: DataFrame) -> DataFrame:
    """id, status, reviewed_by of all edit requests after batch(id, status, reviewer): only open ones change, and the first row by
    reviewer counts."""
    b = batch.groupBy("id").agg(F.min(F.struct("reviewer", F.col("status").alias("new"))).alias("b"))
    d = w.edit_request.select("id", "status").join(b, "id", "left")
    now = (F.col("status") == "open") & F.col("b").isNotNull()
    return d.select("id", F.when(now, F.col("b.new")).otherwise(F.col("status")).alias("status"), F.when(now, F.col("b.reviewer")).alias("reviewed_by"))


# --- people ---------------------------------------------------------------------------------------------------------


def notified(w, changes: DataFrame) -> DataFrame:
    """Notifications to append for changes(revision_id, document_id, actor_id): one for each star on the document but the author's own."""
    s = w.star.select("document_id", "user_id").distinct()
    d = changes.join(s, "document_id").where("user_id <> actor_id")
    return d.select("user_id", F.lit("document_edit").alias("kind"), F.to_json(F.struct(F.col("document_id").alias("document"), F.col("revision_id").alias("revision"))).alias("payload"))


def all_read(w, users: DataFrame, at: datetime) -> DataFrame:
    """id, user_id, read_at of all notifications after users(user_id) have read all of theirs."""
    u = users.select("user_id", F.lit(True).alias("reads")).distinct()
    d = w.notification.select("id", "user_id", "read_at").join(u, "user_id", "left")
    return d.select("id", "user_id", F.when(F.col("reads") & F.col("read_at").isNull(), _at(at)).otherwise(F.col("read_at")).alias("read_at"))


def granted(w, batch: DataFrame, at: datetime) -> DataFrame:
    """Permission rows to append for batch(user_id, permission, granted_by): unknown permissions and those that a user has are passed."""
    known = w.permission_name.select(F.col("name").alias("permission"))
    has = w.user_permission.where("revoked_at is null").select("user_id", "permission")
    d = batch.groupBy("user_id", "permission").agg(F.min("granted_by").alias("granted_by"))
    d = d.join(F.broadcast(known), "permission", "left_semi").join(has, ["user_id", "permission"], "left_anti")
    return d.select("user_id", "permission", "granted_by", _at(at).alias("created_at"))


def revoked(w, batch: DataFrame, at: datetime) -> DataFrame:
    """user_id, permission, is_active, revoked_by of all permission rows after batch(user_id, permission, revoked_by) has ended some."""
    b = batch.groupBy("user_id", "permission").agg(F.min("revoked_by").alias("by"))
    d = w.user_permission.join(b, ["user_id", "permission"], "left")
    ends = F.col("revoked_at").isNull() & F.col("by").isNotNull()
    return d.select("user_id", "permission", (F.col("revoked_at").isNull() & ~ends).alias("is_active"), F.when(ends, F.col("by")).alias("revoked_by"))


def issued_tokens(batch: DataFrame, at: datetime, hours: int = 24) -> DataFrame:
    """Verification rows to append for batch(user_id, purpose, token): the token's hash, never the token."""
    return batch.select("user_id", "purpose", F.sha2("token", 256).alias("token_hash"), (_at(at) + F.expr(f"INTERVAL {hours} HOURS")).alias("expires_at"), _at(at).alias("created_at"))


def consumed_tokens(w, attempts: DataFrame, at: datetime) -> DataFrame:
    """id, consumed, now of all verification rows after attempts(token_hash, purpose): unused, unexpired ones of the right purpose are
    consumed, once each; now says that it was this batch."""
    a = attempts.select("token_hash", "purpose", F.lit(True).alias("asked")).distinct()
    d = w.verification.join(a, ["token_hash", "purpose"], "left")
    now = F.coalesce(F.col("asked") & F.col("consumed_at").isNull() & (F.col("expires_at") > F.lit(at).cast("timestamp")), F.lit(False))
    return d.select("id", (F.col("consumed_at").isNotNull() | now).alias("consumed"), now.alias("now"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys; of several new rows with equal keys the largest counts."""
    rest = [c for c in old.columns if c not in keys]
    newest = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return old.join(newest, keys, "left_anti").unionByName(newest)
