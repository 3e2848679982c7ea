"""Point reads in batches, lists, and the views of one screen that are put together from several tables.

Batches come as DataFrames, so one read serves any number of titles, ids or users. Defined results: rows of a batch with a null key
find nothing; repeated rows of a batch give repeated results unless a function says that they fall together; empty tables give
empty results; further columns of a batch are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.diff import diff_lines
from ..functions.text import redirects
from ..sources.world import BLOCKED, BLOCKED_ACTIONS, OPEN_ACTIONS
from .access import decided
from .markup import rows_of
from .pages import author, display, latest, live, with_author, with_titles

#: Settings that a wiki has without being told (its name is our own), and, as fixed values, media that may be uploaded.
DEFAULTS = (("wiki_name", "위키"), ("main_document", "대문"), ("content_license", "CC BY-NC-SA 2.0 KR"))
MEDIA = ("image/png", "image/jpeg", "image/gif", "image/webp", "image/svg+xml")


# --- lists and small tables ----------------------------------------------------------------------------------------


def enumeration_ids(values: DataFrame, names: list[str]) -> dict[str, int]:
    """Ids of names in an enumeration(id, name), a table of some rows; an unknown name is an error."""
    found = {r.name: r.id for r in values.where(F.col("name").isin(names)).collect()}
    if missing := sorted(set(names) - set(found)):
        raise LookupError(f"no such value: {', '.join(missing)}")
    return found


def enumerated(values: DataFrame, d: DataFrame, column: str) -> DataFrame:
    """d with the id of each name in a column, as {column}_id, by an enumeration(id, name), a table of some rows; nulls have none, and an
    unknown name anywhere is an error."""
    named = d.join(F.broadcast(values.select(F.col("id").alias(f"{column}_id"), F.col("name").alias(column))), column, "left")
    unknown = named.where(F.col(column).isNotNull() & F.col(f"{column}_id").isNull()).select(column).distinct().limit(5).collect()
    if unknown:
        raise LookupError(f"no such value: {', '.join(sorted(r[0] for r in unknown))}")
    return named


def namespace_sizes(w) -> DataFrame:
    """name, documents of every namespace, in order of id."""
    n = w.document.groupBy(F.col("namespace_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return w.namespace.join(n, "id", "left").orderBy("id").select("name", F.coalesce("documents", F.lit(0)).alias("documents"))


def permission_holders(w) -> DataFrame:
    """name, users of every permission, in order of name: how many have it now."""
    n = w.user_permission.where("revoked_at is null").groupBy(F.col("permission").alias("name")).agg(F.countDistinct("user_id").alias("users"))
    return w.permission_name.join(n, "name", "left").orderBy("name").select("name", F.coalesce("users", F.lit(0)).alias("users"))


def licence_uses(w) -> DataFrame:
    """name, display_name, uploads of every licence, in order of what is shown."""
    n = w.upload.groupBy(F.col("license").alias("name")).agg(F.count(F.lit(1)).alias("uploads"))
    return licences(w).join(n, "name", "left").orderBy("display_name").select("name", "display_name", F.coalesce("uploads", F.lit(0)).alias("uploads"))


def names_by_id(values: DataFrame) -> DataFrame:
    return values.orderBy("id").select("name")


def names_sorted(values: DataFrame) -> DataFrame:
    return values.orderBy("name").select("name")


def licences(w) -> DataFrame:
    return w.licence.orderBy("display_name").select("name", "display_name")


def settings(w) -> DataFrame:
    """name, data of every setting that has a default, as stored or by default."""
    defaults = w.site_setting.sparkSession.createDataFrame(DEFAULTS, "name string, fallback string")
    return defaults.join(w.site_setting, "name", "left").select("name", F.coalesce("data", "fallback").alias("data"))


def seeded_rules(namespaces: DataFrame, actions: DataFrame) -> DataFrame:
    """The rules of a new wiki, for every namespace(id) and action(name), both lists of some rows."""
    each = namespaces.select(F.col("id").alias("namespace_id")).crossJoin(actions.select(F.col("name").alias("action")))
    row = lambda order, kind, value, allowed: [F.lit(order).cast("long").alias("evaluation_order"), F.lit(kind).alias("kind"), F.lit(value).alias("value"), allowed.alias("allowed")]
    everybody = each.select("namespace_id", "action", *row(100, "perm", "any", F.col("action").isin(*OPEN_ACTIONS)))
    return everybody.unionByName(each.where(F.col("action").isin(*BLOCKED_ACTIONS)).select("namespace_id", "action", *row(10, "aclgroup", BLOCKED, F.lit(False))))


# --- rules for input ------------------------------------------------------------------------------------------------


def client_address(peer: Column, forwarded: Column) -> Column:
    """Whose request it was: the first hop of the forwarded chain, but only if the peer is this machine; without a peer `unknown`."""
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    local = peer.startswith("127.") | (peer == "::1")
    return F.when(peer.isNull(), "unknown").when(local & (F.coalesce(first, F.lit("")) != ""), first).otherwise(peer)


def good_reason(reason: Column) -> Column:
    """At least five characters."""
    return F.coalesce(F.length(reason) >= 5, F.lit(False))


def good_user_name(name: Column) -> Column:
    return F.coalesce((F.length(F.trim(name)) > 0) & ~F.contains(name, F.lit("/")), F.lit(False))


def good_password(password: Column) -> Column:
    """At least eight bytes."""
    return F.coalesce(F.octet_length(password) >= 8, F.lit(False))


def good_media(media_type: Column) -> Column:
    return F.coalesce(media_type.isin(*MEDIA), F.lit(False))


def consumable(as_of: Column) -> Column:
    """Of a verification row: not used yet and not expired."""
    return F.col("consumed_at").isNull() & (F.col("expires_at") > as_of)


# --- batches --------------------------------------------------------------------------------------------------------


def _documents(w) -> DataFrame:
    return with_titles(w.document.select(F.col("id").alias("document_id")), w.document, w.namespace).select("namespace", "title", "document_id")


def find_documents(w, titles: DataFrame) -> DataFrame:
    """Of titles(namespace, title), those with a document row, live or not."""
    return titles.join(_documents(w), ["namespace", "title"]).select("namespace", "title", "document_id")


def presence(w, titles: DataFrame) -> DataFrame:
    """namespace, title, there: whether each asked title is a live page."""
    alive = live(w.revision).select("document_id").join(_documents(w), "document_id").select("namespace", "title", F.lit(True).alias("there"))
    return titles.select("namespace", "title").join(alive, ["namespace", "title"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def unknown(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Asked titles, each once, that are not among the known ones."""
    return asked.select("namespace", "title").distinct().join(known, ["namespace", "title"], "left_anti")


def revisions_within(w, asked: DataFrame) -> DataFrame:
    """Of asked(document_id, revision_id), those where the revision is the document's, with its sequence."""
    r = w.revision.select("document_id", F.col("id").alias("revision_id"), "sequence")
    return asked.join(r, ["document_id", "revision_id"]).select("document_id", "revision_id", "sequence")


def revision_texts(w, asked: DataFrame) -> DataFrame:
    """revision_id, found, content of asked(revision_id): a missing revision isn't one without text."""
    r = w.revision.select(F.col("id").alias("revision_id"), F.lit(True).alias("found"), "content")
    return asked.select("revision_id").join(r, "revision_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def find_users(w, asked: DataFrame) -> DataFrame:
    """Users of asked(key), each a name or an external id; two equi-joins instead of one with OR."""
    u = w.wiki_user
    by = lambda c: asked.select("key").join(u, F.col("key") == u[c]).select("key", "id", "external_id", "name")
    return by("name").union(by("external_id")).distinct()


def starred_by(w, user: int, titles: DataFrame) -> DataFrame:
    """namespace, title, starred of asked titles that have a document."""
    mine = w.star.where(F.col("user_id") == user).select("document_id", F.lit(True).alias("s")).distinct()
    return find_documents(w, titles).join(mine, "document_id", "left").select("namespace", "title", F.coalesce("s", F.lit(False)).alias("starred"))


def newest_files(w, names: DataFrame) -> DataFrame:
    """name, content_hash of asked(name): what was attached last to the page of the file namespace that is called so."""
    pages = w.document.where("namespace_id = 3").select(F.col("id").alias("document_id"), F.col("title").alias("name"))
    d = names.select("name").join(pages, "name").join(w.revision.select("document_id", F.col("id").alias("revision_id"), "sequence"), "document_id").join(w.file_revision, "revision_id")
    return d.groupBy("name").agg(F.max(F.struct("sequence", "content_hash")).alias("f")).select("name", "f.content_hash")


def attached(w, asked: DataFrame) -> DataFrame:
    """File rows for asked(revision_id, content_hash, license): those whose revision exists and whose licence is known."""
    known = w.licence.select(F.col("name").alias("license"), "display_name")
    d = asked.join(w.revision.select(F.col("id").alias("revision_id")), "revision_id", "left_semi").join(F.broadcast(known), "license")
    return d.select("revision_id", "content_hash", "license")


def random_page(w, seed: int) -> DataFrame:
    """One live page, each as likely as any other: that with the least hash of seed and id."""
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("document_id").cast("string")))
    d = live(w.revision).select("document_id", lot.alias("lot")).orderBy("lot", "document_id").limit(1)
    return with_titles(d, w.document, w.namespace).select(display().alias("title"))


def sorted_titles(w) -> DataFrame:
    """All live titles by namespace and title."""
    return with_titles(live(w.revision).select("document_id"), w.document, w.namespace).select("namespace", "title").orderBy("namespace", "title")


def block_history(w, limit: int = 100) -> DataFrame:
    """Memberships of groups, the newest first: group, who, why, when, and when it ended."""
    d = w.acl_group_member.orderBy(F.desc("created_at"), "name", "actor_id").limit(limit).alias("m")
    a = w.actor.select(F.col("id").alias("actor_id"), "user_name", "ip")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return d.join(a, "actor_id", "left").select("name", author().alias("target"), "reason", day("created_at"), day("removed_at"))


# --- views of one screen --------------------------------------------------------------------------------------------


def thread_pages(w, threads: DataFrame) -> DataFrame:
    """The comments of asked(thread_id) with what stands above them; hidden ones are blank."""
    t = with_titles(w.thread.withColumnRenamed("id", "thread_id").join(threads.select("thread_id"), "thread_id", "left_semi"), w.document, w.namespace)
    t = t.select("thread_id", display().alias("page"), "topic", "status")
    c = w.thread_comment.select("thread_id", "sequence", "author", F.when(F.col("hidden"), F.lit("")).otherwise(F.col("content")).alias("content"), "hidden")
    return t.join(c, "thread_id").orderBy("thread_id", "sequence")


def edit_request_pages(w) -> DataFrame:
    """Every edit request with its page, author, base revision if it has one, the page's text now and whether it may be settled."""
    base = w.revision.select(F.col("id").alias("base_revision_id"), F.col("sequence").alias("base_sequence"))
    now = live(w.revision).select("document_id", F.col("content").alias("current"))
    d = with_author(with_titles(w.edit_request, w.document, w.namespace), w.actor).join(base, "base_revision_id", "left").join(now, "document_id", "left")
    return d.select("id", display().alias("page"), "author", "status", "base_sequence", F.coalesce("current", F.lit("")).alias("current"), "content", (F.col("status") == "open").alias("is_open"))


def page_views(w, titles: DataFrame, user: int) -> DataFrame:
    """What a page's screen shows of asked titles that are live: its text, redirect, newest revision, how many pages link to it, how
    many threads it has, and whether the user has starred it."""
    now = live(w.revision).select("document_id", "content", "sequence", "kind")
    d = find_documents(w, titles).distinct().join(now, "document_id").join(w.document.select(F.col("id").alias("document_id"), "namespace_id"), "document_id")
    aim = redirects(d.select(F.col("document_id").alias("id"), F.col("content").alias("text"))).select(F.col("id").alias("document_id"), F.col("target").alias("redirect"))
    links = w.reference.groupBy(F.col("target_namespace_id").alias("namespace_id"), F.col("target_title").alias("title")).agg(F.count(F.lit(1)).alias("backlinks"))
    talks = w.thread.groupBy("document_id").agg(F.count(F.lit(1)).alias("threads"))
    mine = w.star.where(F.col("user_id") == user).select("document_id", F.lit(True).alias("starred")).distinct()
    d = d.join(aim, "document_id", "left").join(links, ["namespace_id", "title"], "left").join(talks, "document_id", "left").join(mine, "document_id", "left")
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return d.select(display().alias("page"), F.col("content").alias("source"), "redirect", "sequence", "kind", none("backlinks", 0), none("threads", 0), none("starred", False))


def edit_request_views(w, viewer: int, as_of: str) -> DataFrame:
    """id, page, author, status, diff, may_review for every edit request: how its text differs from what stands there now, line by line
    (= - + before each), and whether the viewer may settle it: it is open, and they may edit the page, so that a request is no way
    around the rules."""
    pages = edit_request_pages(w)
    shown = rows_of(pages.select("id", "current", "content"), ["current", "content"], lambda a, b: [("\n".join(op + line for op, line in diff_lines(a, b)),)], "diff string")
    may = decided(w, w.edit_request.select("id", "document_id", F.lit(viewer).cast("long").alias("actor_id")), "edit", as_of)
    d = pages.select("id", "page", "author", "status", "is_open").join(shown, "id").join(may.select("id", "allowed"), "id")
    return d.select("id", "page", "author", "status", "diff", (F.col("is_open") & F.col("allowed")).alias("may_review"))


def raw_texts(w, titles: DataFrame) -> DataFrame:
    """page, content of asked titles that are live, as they were written."""
    return find_documents(w, titles).join(live(w.revision).select("document_id", "content"), "document_id").select(display().alias("page"), "content")


def session_view(w, user: int) -> DataFrame:
    """One row: the settings, the user's name if there is one, and how many notifications they have not read."""
    s = settings(w).groupBy().pivot("name", [n for n, _ in DEFAULTS]).agg(F.first("data"))
    name = w.actor.where(F.col("id") == user).agg(F.max("user_name").alias("user_name"))
    unread = w.notification.where((F.col("user_id") == user) & F.col("read_at").isNull()).agg(F.count(F.lit(1)).alias("unread"))
    return s.crossJoin(name).crossJoin(unread)


def latest_before(w, titles: DataFrame) -> DataFrame:
    """page, sequence, kind: the newest revision of asked titles, deletions included."""
    d = find_documents(w, titles).join(latest(w.revision).select("document_id", "sequence", "kind"), "document_id")
    return d.select(display().alias("page"), "sequence", "kind")
