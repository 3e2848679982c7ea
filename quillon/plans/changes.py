"""Queries over changes: the rows that a batch appends or the state after it, with SQL twins of the outcome."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import diff as D
from ..operators import access as A
from ..operators import changes as C
from ..sources.world import World, ctes
from .pages import LIVE

AT = datetime(2024, 12, 31)
NOW = datetime(2024, 7, 1)
_AT = "TIMESTAMP '2024-12-31 00:00:00'"
_M = "(SELECT CAST(floor(count(*) * 1.25) AS BIGINT) AS m FROM {documents}) mm"
_TOP = "(SELECT document_id, max(sequence) AS top FROM {revision} GROUP BY 1)"


def _batch(w: World):
    """Purchases as edits, every seventh of them twice."""
    m = int(w.documents.count() * 1.25)
    bought = w.events.where("event_type = 'purchase'")
    return bought.unionByName(bought.where("event_id % 7 = 0")).select(F.col("event_id").alias("id"), F.lit(0).cast("long").alias("namespace_id"), F.concat(F.lit("Doc "), (F.col("event_id") % m).cast("string")).alias("title"), F.lit("edit").alias("kind"), F.col("user_id").alias("actor_id"), F.col("props").alias("content"), F.lit("c").alias("comment"))


_BATCH = f"(SELECT event_id AS id, 0 AS namespace_id, 'Doc ' || CAST(event_id % m AS VARCHAR) AS title, user_id AS actor_id, props AS content FROM {{events}} JOIN (VALUES (1), (2)) AS v(copy) ON copy = 1 OR event_id % 7 = 0, {_M} WHERE event_type = 'purchase')"
_ALL_DOCS = f"(SELECT id, namespace_id, title FROM {{document}} UNION ALL SELECT (SELECT max(id) FROM {{document}}) + row_number() OVER (ORDER BY namespace_id, title), namespace_id, title FROM (SELECT DISTINCT namespace_id, title FROM {_BATCH} b WHERE (namespace_id, title) NOT IN (SELECT (namespace_id, title) FROM {{document}})))"


def _people(w: World):
    return w.customer.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("user"), F.col("c_custkey").cast("string"))).alias("user_name"), F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("10.9.8."), (F.col("c_custkey") % 40).cast("string"))).alias("ip"))


_PEOPLE = "(SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'user' || CAST(c_custkey AS VARCHAR) END AS user_name, CASE WHEN c_custkey % 2 = 1 THEN '10.9.8.' || CAST(c_custkey % 40 AS VARCHAR) END AS ip FROM {customer})"


def _reverts(w: World):
    return w.revision.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("document_id")).otherwise(-1).alias("document_id"), F.col("id").alias("revision_id"), "actor_id")


def _edits(w: World):
    """Of even pages an edit of what stands there, of odd ones an edit of their first text, others having written since."""
    d = w.revision.where("content is not null")
    first, last = (d.groupBy("document_id").agg(f(F.struct("sequence", "id", "actor_id", "content")).alias("r")) for f in (F.min, F.max))
    d = last.where("document_id % 2 = 0").union(first.where("document_id % 2 = 1"))
    return d.select(F.col("r.id").alias("id"), "document_id", F.col("r.id").alias("base_revision_id"), "r.actor_id", F.concat(F.lit("An introduction.\n"), "r.content").alias("content"))


def _many_edits(w: World):
    """Of each page with a text five edits, one twice and one based on another of them, of which the last conflicts; of others one."""
    last = w.revision.groupBy("document_id").agg(F.max(F.struct("sequence", "id", "actor_id", "content")).alias("r")).select("document_id", "r.*")
    has, text = F.col("content").isNotNull(), F.col("content")
    edit = lambda n, base, content, when: F.when(when, F.struct((F.col("id") * 10 + n).alias("id"), base.alias("base_revision_id"), content.alias("content"), F.lit(f"c{n}").alias("comment")))
    top, own = F.concat(F.lit("Top.\n"), text), F.col("id")
    bottom = edit(2, own, F.concat(text, F.lit("\nBottom.")), has)
    edits = [edit(1, own, top, has), bottom, bottom, edit(3, own * 10 + 1, F.concat(F.lit("Higher.\n"), top), has), edit(4, own, F.concat(F.lit("Other.\n"), text), has), edit(5, own, F.lit("Again."), ~has)]
    d = last.select("document_id", "actor_id", F.explode(F.array_compact(F.array(*edits))).alias("e"))
    return d.select("e.id", "document_id", "e.base_revision_id", "actor_id", "e.content", "e.comment")


_NEWEST = "(SELECT document_id, max(sequence) AS sequence, arg_max(id, sequence) AS id, arg_max(actor_id, sequence) AS actor_id, arg_max(coalesce(content, chr(0)), sequence) AS content FROM {revision} GROUP BY 1)"
_MANY_SQL = (
    f"SELECT document_id, sequence + k AS sequence, id * 10 + n AS id, CASE WHEN content = chr(0) THEN 'create' ELSE 'edit' END AS kind, actor_id, "
    f"CASE WHEN content = chr(0) THEN 'Again.' ELSE head || content || tail END AS content, 'c' || CAST(n AS VARCHAR) AS comment "
    f"FROM {_NEWEST} JOIN (VALUES (1, 1, 'Top.' || chr(10), ''), (2, 2, 'Top.' || chr(10), chr(10) || 'Bottom.'), (2, 3, 'Top.' || chr(10), chr(10) || 'Bottom.'), "
    f"(3, 4, 'Higher.' || chr(10) || 'Top.' || chr(10), chr(10) || 'Bottom.'), (5, 1, '', '')) AS v(n, k, head, tail) ON (content = chr(0)) = (n = 5)"
)
_CONFLICT_SQL = (
    f"SELECT id * 10 + 4 AS id, concat_ws(chr(10), '{D.OURS.strip()}', 'Higher.', 'Top.', '{D.BASE.strip()}', '{D.THEIRS.strip()}', 'Other.', '{D.END.strip()}', content, 'Bottom.') AS content, "
    f"id * 10 + 3 AS base_revision_id FROM {_NEWEST} WHERE content <> chr(0)"
)


def _comment_batch(w: World):
    return w.thread_comment.where("sequence <= 2").select((F.col("thread_id") * 10 + F.col("sequence")).alias("id"), "thread_id", "author", F.concat(F.lit("re: "), F.col("sequence").cast("string")).alias("content"))


def _thread_changes(w: World):
    return w.thread.where("id % 2 = 0").select("id", F.col("id").alias("thread_id"), F.lit("mod").alias("author"), F.when(F.col("id") % 4 == 0, "status").otherwise("topic").alias("what"), F.when(F.col("id") % 4 == 0, "close").otherwise("New topic").alias("to"))


def _new_settings(w: World):
    """For every nation its suppliers and customers, some under a name that is new, so that most names come several times."""
    name = lambda key: F.concat(F.when(F.col(key) % 3 == 0, "home.").otherwise("nation."), "n_name").alias("name")
    suppliers = w.supplier.join(w.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(name("s_suppkey"), F.col("s_name").alias("data"))
    return suppliers.union(w.customer.join(w.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(name("c_custkey"), F.col("c_name").alias("data")))


_NEW_SETTINGS_SQL = " UNION ALL ".join(f"SELECT CASE WHEN {k} % 3 = 0 THEN 'home.' ELSE 'nation.' END || n_name AS name, {x}_name AS data FROM {{{t}}} JOIN {{nation}} ON n_nationkey = {x}_nationkey" for t, x, k in (("supplier", "s", "s_suppkey"), ("customer", "c", "c_custkey")))
_MAX_SEQ = "(SELECT thread_id, max(sequence) AS top FROM {thread_comment} GROUP BY 1)"
_WRITTEN = "b.actor_id, b.content, strlen(coalesce(b.content, '')) AS content_bytes"
_Q = {
    "record_revisions_new_pages": (lambda w: C.recorded(w, _batch(w), AT)[0], f"SELECT id, namespace_id, title, {_AT} AS created_at FROM {_ALL_DOCS} a WHERE id > (SELECT max(id) FROM {{document}})"),
    "record_revisions": (lambda w: C.recorded(w, _batch(w), AT)[1].select("document_id", "sequence", "id", "actor_id", "content", "content_bytes"), f"SELECT a.id AS document_id, coalesce(t.top, 0) + row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS sequence, b.id, {_WRITTEN} FROM {_BATCH} b JOIN {_ALL_DOCS} a ON a.namespace_id = b.namespace_id AND a.title = b.title LEFT JOIN {_TOP} t ON t.document_id = a.id"),
    "ensure_actors": (lambda w: C.ensured_actors(w, _people(w)), f"SELECT (SELECT max(id) FROM {{actor}}) + row_number() OVER (ORDER BY coalesce(user_name, ip)) AS id, user_name, ip FROM {_PEOPLE} p WHERE NOT EXISTS (SELECT 1 FROM {{actor}} a WHERE a.user_name IS NOT DISTINCT FROM p.user_name AND a.ip IS NOT DISTINCT FROM p.ip)"),
    "revert_append": (lambda w: C.reverted(w, _reverts(w), AT).select("document_id", "sequence", "id", "content", "comment", "metadata"), f"SELECT b.document_id, t.top + row_number() OVER (PARTITION BY b.document_id ORDER BY b.id) AS sequence, b.id, b.content, '{C.REVERTED}' AS comment, '{{{{\"to_revision\":' || CAST(b.id AS VARCHAR) || '}}}}' AS metadata FROM {{revision}} b JOIN {_TOP} t USING (document_id) WHERE b.id % 6 = 0 AND b.content IS NOT NULL"),
    "batch_revert_append": (lambda w: C.batch_reverted(w, "user7", 9, AT).select("document_id", "sequence", "content", "comment", "metadata"), "WITH h AS (SELECT r.*, coalesce(a.user_name, a.ip, '') AS author, row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) AS rn FROM {revision} r JOIN {actor} a ON a.id = r.actor_id), o AS (SELECT h.*, row_number() OVER (PARTITION BY h.document_id ORDER BY h.sequence DESC) AS k FROM h JOIN h l ON l.document_id = h.document_id AND l.rn = 1 AND l.author = 'user7' WHERE h.rn <= 500 AND h.author <> l.author) SELECT o.document_id, t.top + 1 AS sequence, o.content, '" + C.BATCH_REVERTED.format("user7") + "' AS comment, '{{{{\"batch_revert\":\"user7\"}}}}' AS metadata FROM o JOIN " + _TOP + " t USING (document_id) WHERE k = 1 AND content IS NOT NULL ORDER BY 1 LIMIT 100"),
    "edit_append": (lambda w: C.edited(w, _many_edits(w), AT)[0].select("document_id", "sequence", "id", "kind", "actor_id", "content", "comment"), _MANY_SQL),
    "edit_conflicts": (lambda w: C.edited(w, _many_edits(w), AT)[1], _CONFLICT_SQL),
    "edit_unchanged_base": (lambda w: C.edited(w, _edits(w), AT)[0].join(w.revision.groupBy("document_id").agg(F.max(F.struct("sequence", "id")).alias("m")).select("document_id", F.col("m.id").alias("id")), ["document_id", "id"]).select("document_id", "sequence", "kind", "content"), f"SELECT document_id, sequence + 1 AS sequence, CASE WHEN content = '' THEN 'create' ELSE 'edit' END AS kind, 'An introduction.' || chr(10) || content AS content FROM {LIVE} l WHERE content IS NOT NULL AND (document_id % 2 = 0 OR sequence = 1)"),
    "move_revision": (lambda w: C.move_revision(w, 20, "Doc 30", 9, AT), f"SELECT r.document_id, r.sequence + 1 AS sequence, 'move' AS kind, CAST(9 AS BIGINT) AS actor_id, r.content, '{{{{\"from\":\"' || d.title || '\",\"to\":\"Doc 30\"}}}}' AS metadata, {_AT} AS created_at FROM {LIVE} r JOIN {{document}} d ON d.id = r.document_id WHERE r.document_id = 20"),
    "batch_reference_replace": (lambda w: C.replaced_references_of(w, w.document.where("id % 5 = 0").select(F.col("id").alias("source_id")), w.document.where("id % 5 = 0").select(F.col("id").alias("source_id"), (F.col("id") % 6).alias("target_namespace_id"), F.lit("Doc 1").alias("target_title"), F.lit("link").alias("kind"))), "SELECT source_id, target_namespace_id, target_title, kind FROM {reference} WHERE source_id % 5 <> 0 UNION ALL SELECT id, id % 6, 'Doc 1', 'link' FROM {document} WHERE id % 5 = 0 AND id % 6 < 4"),
    "main_page_seed": (lambda w: C.main_page(w, "대문", "Welcome.", 9, AT).unionByName(C.main_page(w, "Doc 4", "Never.", 9, AT)), f"SELECT '대문' AS title, CAST(1 AS BIGINT) AS sequence, 'create' AS kind, CAST(9 AS BIGINT) AS actor_id, 'Welcome.' AS content, '{C.MAIN_MADE}' AS comment, {_AT} AS created_at"),
    "upload_pages": (lambda w: C.uploaded(w, w.upload)[0], "SELECT id, trim(name) AS title, trim(description) || chr(10) || '[[분류:' || trim(category) || ']]' AS text, sha256(bytes) AS hash, license FROM {upload} WHERE trim(name) <> '' AND license <> '' AND media_type <> 'text/html'"),
    "upload_contents": (lambda w: C.uploaded(w, w.upload)[1], "SELECT sha256(bytes) AS hash, min(media_type) AS media_type, max(strlen(bytes)) AS byte_size FROM {upload} WHERE trim(name) <> '' AND license <> '' AND media_type <> 'text/html' GROUP BY 1"),
    "hide_revision_result": (lambda w: C.hidden_revisions(w, w.revision.where("id % 9 = 0").select("id", (F.col("id") % 2 == 0).alias("hide"))), "SELECT id, CASE WHEN id % 9 = 0 THEN id % 2 = 0 ELSE hidden END AS hidden FROM {revision}"),
    "create_threads": (lambda w: C.created_threads(w, w.thread.select(F.col("id").alias("key"), (F.col("document_id") * 2).alias("document_id"), "topic", F.lit("a").alias("author"), F.lit("first").alias("content")))[0], "SELECT (SELECT max(id) FROM {thread}) + row_number() OVER (ORDER BY id) AS id, document_id * 2 AS document_id, 'normal' AS status, topic FROM {thread} WHERE document_id * 2 IN (SELECT id FROM {document})"),
    "create_thread_comments": (lambda w: C.created_threads(w, w.thread.select(F.col("id").alias("key"), "document_id", "topic", F.col("topic").alias("author"), F.lit("first").alias("content")))[1], "SELECT (SELECT max(id) FROM {thread}) + row_number() OVER (ORDER BY id) AS thread_id, CAST(1 AS BIGINT) AS sequence, 'comment' AS kind, topic AS author, 'first' AS content FROM {thread} WHERE document_id IN (SELECT id FROM {document})"),
    "add_comments": (lambda w: C.added_comments(w, _comment_batch(w)).select("thread_id", "sequence", "author", "content"), f"SELECT c.thread_id, t.top + c.sequence AS sequence, c.author, 're: ' || CAST(c.sequence AS VARCHAR) AS content FROM {{thread_comment}} c JOIN {_MAX_SEQ} t USING (thread_id) JOIN {{thread}} h ON h.id = c.thread_id WHERE c.sequence <= 2 AND h.status = 'normal'"),
    "change_threads": (lambda w: C.changed_threads(w, _thread_changes(w))[0], "SELECT id, document_id, CASE WHEN id % 4 = 0 THEN 'close' ELSE status END AS status, CASE WHEN id % 4 = 2 THEN 'New topic' ELSE topic END AS topic FROM {thread}"),
    "change_thread_comments": (lambda w: C.changed_threads(w, _thread_changes(w))[1], f"SELECT h.id AS thread_id, t.top + 1 AS sequence, CASE WHEN h.id % 4 = 0 THEN 'status_change' ELSE 'topic_change' END AS kind, 'mod' AS author, '' AS content, CASE WHEN h.id % 4 = 0 THEN '{{{{\"to\":\"close\"}}}}' ELSE '{{{{\"topic\":\"New topic\"}}}}' END AS metadata FROM {{thread}} h JOIN {_MAX_SEQ} t ON t.thread_id = h.id WHERE h.id % 2 = 0"),
    "change_details": (lambda w: C.changed_threads(w, _thread_changes(w))[1].select("thread_id", "kind", A.detail(F.col("kind"), F.col("metadata")).alias("detail")), "SELECT id AS thread_id, CASE WHEN id % 4 = 0 THEN 'status_change' ELSE 'topic_change' END AS kind, CASE WHEN id % 4 = 0 THEN 'close' ELSE 'New topic' END AS detail FROM {thread} WHERE id % 2 = 0"),
    "hide_comments": (lambda w: C.hidden_comments(w, w.thread_comment.where("sequence = 2").select("thread_id", "sequence", F.col("thread_id").alias("actor_id")), AT), f"SELECT thread_id, sequence, hidden OR sequence = 2 AS hidden, CASE WHEN sequence = 2 THEN thread_id END AS hidden_by, CASE WHEN sequence = 2 THEN {_AT} END AS hidden_at FROM {{thread_comment}}"),
    "submit_edit_requests": (lambda w: C.submitted_requests(w, w.revision.where("kind = 'edit'").select(F.col("id").alias("key"), (F.col("document_id") * 3).alias("document_id"), (F.col("id") * 2).alias("base_revision_id"), "actor_id", "content"), AT), f"SELECT (SELECT max(id) FROM {{edit_request}}) + row_number() OVER (ORDER BY id) AS id, document_id * 3 AS document_id, CASE WHEN id * 2 IN (SELECT id FROM {{revision}}) THEN id * 2 END AS base_revision_id, actor_id, content, 'open' AS status, {_AT} AS created_at FROM {{revision}} WHERE kind = 'edit' AND document_id * 3 IN (SELECT id FROM {{document}})"),
    "settle_edit_requests": (lambda w: C.settled_requests(w, w.edit_request.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "accepted").otherwise("closed").alias("status"), F.col("actor_id").alias("reviewer"))), "SELECT id, CASE WHEN status = 'open' AND id % 4 = 0 THEN 'accepted' WHEN status = 'open' AND id % 2 = 0 THEN 'closed' ELSE status END AS status, CASE WHEN status = 'open' AND id % 2 = 0 THEN actor_id END AS reviewed_by FROM {edit_request}"),
    "notify_subscribers": (lambda w: C.notified(w, w.revision.where("kind = 'create'").select(F.col("id").alias("revision_id"), "document_id", "actor_id")), "SELECT s.user_id, 'document_edit' AS kind, '{{\"document\":' || CAST(r.document_id AS VARCHAR) || ',\"revision\":' || CAST(r.id AS VARCHAR) || '}}' AS payload FROM {revision} r JOIN {star} s ON s.document_id = r.document_id WHERE r.kind = 'create' AND s.user_id <> r.actor_id"),
    "mark_all_read": (lambda w: C.all_read(w, w.actor.where("id % 2 = 0").select(F.col("id").alias("user_id")), AT), f"SELECT id, user_id, CASE WHEN read_at IS NULL AND user_id % 2 = 0 AND user_id IN (SELECT id FROM {{actor}}) THEN {_AT} ELSE read_at END AS read_at FROM {{notification}}"),
    "grant_permissions": (lambda w: C.granted(w, w.user_permission.select("user_id", F.when(F.col("user_id") % 3 == 0, "config").when(F.col("user_id") % 3 == 1, F.col("permission")).otherwise("nonsense").alias("permission"), F.lit(1).cast("long").alias("granted_by")), AT), f"SELECT user_id, permission, CAST(1 AS BIGINT) AS granted_by, {_AT} AS created_at FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'config' ELSE permission END AS permission FROM {{user_permission}} WHERE user_id % 3 < 2) q WHERE permission IN (SELECT name FROM {{permission_name}}) AND (user_id, permission) NOT IN (SELECT (user_id, permission) FROM {{user_permission}} WHERE revoked_at IS NULL)"),
    "revoke_permissions": (lambda w: C.revoked(w, w.user_permission.where("user_id % 5 = 0").select("user_id", "permission", F.lit(2).cast("long").alias("revoked_by")), AT), "SELECT user_id, permission, revoked_at IS NULL AND user_id % 5 <> 0 AS is_active, CASE WHEN revoked_at IS NULL AND user_id % 5 = 0 THEN CAST(2 AS BIGINT) END AS revoked_by FROM {user_permission}"),
    "issue_tokens": (lambda w: C.issued_tokens(w.customer.select(F.col("c_custkey").alias("user_id"), F.lit("signup").alias("purpose"), F.col("c_name").alias("token")), AT), f"SELECT c_custkey AS user_id, 'signup' AS purpose, sha256(c_name) AS token_hash, {_AT} + INTERVAL '24' HOUR AS expires_at, {_AT} AS created_at FROM {{customer}}"),
    "consume_tokens": (lambda w: C.consumed_tokens(w, w.verification.where("id % 2 = 0").select("token_hash", F.when(F.col("id") % 3 == 0, "signup").otherwise(F.col("purpose")).alias("purpose")), NOW), "SELECT id, consumed_at IS NOT NULL OR now AS consumed, now FROM (SELECT *, consumed_at IS NULL AND expires_at > TIMESTAMP '2024-07-01 00:00:00' AND id % 2 = 0 AND (id % 3 <> 0 OR purpose = 'signup') AS now FROM {verification})"),
    "upsert_settings": (lambda w: C.upserted(w.site_setting, _new_settings(w), ["name"]), f"SELECT name, data FROM {{site_setting}} WHERE name NOT IN (SELECT name FROM ({_NEW_SETTINGS_SQL}) n) UNION ALL SELECT name, max(data) AS data FROM ({_NEW_SETTINGS_SQL}) n GROUP BY name"),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql.replace("{{{{", "\0").replace("}}}}", "\1").replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}") if sql else None) for name, (build, sql) in _Q.items()}
