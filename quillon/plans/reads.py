"""Queries over batched reads, lists and screens, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reads as R
from ..sources import world as V
from ..sources.world import World, ctes
from .access import NOW, labels_sql
from .pages import ASKED, ASKED_SQL, AUTHOR, DISPLAY, LIVE, NAMED

USERS = ("Customer#000000007", "u-9", "nobody", "u-9")
_SHOWN = "CASE WHEN q.namespace = 'main' THEN q.title ELSE q.namespace || ':' || q.title END"
_DOCS = "(SELECT d.id AS document_id, d.namespace_id, ns.name AS namespace, d.title FROM {document} d JOIN {namespace} ns ON ns.id = d.namespace_id)"


def _titles(w: World):
    return w.document.sparkSession.createDataFrame(ASKED, "namespace string, title string")


def _list(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS q({names})"


def _enumeration(w: World):
    kinds = R.enumerated(w.revision_kind, w.revision.select("kind"), "kind")
    return kinds.groupBy("kind", "kind_id").agg(F.count(F.lit(1)).alias("revisions"))


#: Requests of events: from this machine, from others, and from nowhere, with and without a chain of forwarders.
_REQUESTS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '127.0.0.' || CAST(event_id % 200 AS {text}) WHEN 1 THEN '::1' WHEN 2 THEN '10.0.0.' || CAST(event_id % 250 AS {text}) WHEN 3 THEN '2001:db8::' || CAST(user_id % 90 AS {text}) END AS peer,
  CASE event_id % 4 WHEN 0 THEN ' 203.0.113.' || CAST(user_id % 200 AS {text}) || ' , 10.0.0.1' WHEN 1 THEN '198.51.100.7' WHEN 2 THEN ' ' END AS forwarded FROM """


def _guards(w: World):
    requests = w.events.sparkSession.sql(_REQUESTS.format(text="STRING") + "{events}", events=w.events)
    return requests.select("id", "peer", "forwarded", R.client_address(F.col("peer"), F.col("forwarded")).alias("address"))


VIEWER = 4
#: What differs between three lines or none and two lines of which the first may be the same, by hand.
_LINE = "string_split(l.content, chr(10))[{0}]"
_VIEWS_SQL = f"""WITH {labels_sql(True)},
      may AS (SELECT d.id AS document_id, arg_min(r.allowed, (CASE WHEN r.document_id IS NULL THEN 1 ELSE 0 END, r.evaluation_order, r.id)) AS allowed
        FROM {{document}} d JOIN k ON k.actor_id = {VIEWER} JOIN r ON r.who = k.who AND (r.document_id = d.id OR r.namespace_id = d.namespace_id) GROUP BY 1)
      SELECT r.id, {DISPLAY} AS page, {AUTHOR} AS author, r.status, r.status = 'open' AND coalesce(may.allowed, false) AS may_review,
        CASE WHEN coalesce(l.content, '') = '' THEN '+' || replace(r.content, chr(10), chr(10) || '+')
          WHEN {_LINE.format(1)} = string_split(r.content, chr(10))[1] THEN concat_ws(chr(10), '=' || {_LINE.format(1)}, '-' || {_LINE.format(2)}, '-' || {_LINE.format(3)}, '+new')
          ELSE '-' || replace(l.content, chr(10), chr(10) || '-') || chr(10) || '+' || replace(r.content, chr(10), chr(10) || '+') END AS diff
      FROM {{edit_request}} r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id LEFT JOIN {LIVE} l ON l.document_id = r.document_id LEFT JOIN may ON may.document_id = r.document_id"""
_FALLBACK = ", ".join(f"('{n}', '{v}')" for n, v in R.DEFAULTS)
_SETTINGS = f"(SELECT d.name, coalesce(s.data, d.fallback) AS data FROM (VALUES {_FALLBACK}) AS d(name, fallback) LEFT JOIN {{site_setting}} s ON s.name = d.name)"
_OPEN, _STOPPED = (", ".join(f"'{a}'" for a in x) for x in (V.OPEN_ACTIONS, V.BLOCKED_ACTIONS))
_Q = {
    "enumeration_lookup": (_enumeration, "SELECT r.kind, k.id AS kind_id, count(*) AS revisions FROM {revision} r JOIN {revision_kind} k ON k.name = r.kind GROUP BY ALL"),
    "namespace_names": (R.namespace_sizes, "SELECT name, (SELECT count(*) FROM {document} d WHERE d.namespace_id = n.id) AS documents FROM {namespace} n ORDER BY id"),
    "permission_names": (R.permission_holders, "SELECT name, (SELECT count(DISTINCT user_id) FROM {user_permission} u WHERE u.permission = p.name AND revoked_at IS NULL) AS users FROM {permission_name} p ORDER BY name"),
    "licence_list": (R.licence_uses, "SELECT name, display_name, (SELECT count(*) FROM {upload} u WHERE u.license = l.name) AS uploads FROM {licence} l ORDER BY display_name"),
    "site_settings": (R.settings, f"SELECT name, data FROM {_SETTINGS} x"),
    "seeded_rules": (lambda w: R.seeded_rules(w.nation.select(F.col("n_nationkey").cast("long").alias("id")), w.acl_action), f"SELECT n.id AS namespace_id, a.name AS action, CAST(100 AS BIGINT) AS evaluation_order, 'perm' AS kind, 'any' AS value, a.name IN ({_OPEN}) AS allowed FROM (SELECT CAST(n_nationkey AS BIGINT) AS id FROM {{nation}}) n CROSS JOIN {{acl_action}} a UNION ALL SELECT n.id, a.name, 10, 'aclgroup', '{V.BLOCKED}', FALSE FROM (SELECT CAST(n_nationkey AS BIGINT) AS id FROM {{nation}}) n CROSS JOIN {{acl_action}} a WHERE a.name IN ({_STOPPED})"),
    "client_addresses": (_guards, f"SELECT id, peer, forwarded, CASE WHEN peer IS NULL THEN 'unknown' WHEN (starts_with(peer, '127.') OR peer = '::1') AND trim(split_part(coalesce(forwarded, ''), ',', 1)) <> '' THEN trim(split_part(forwarded, ',', 1)) ELSE peer END AS address FROM ({_REQUESTS.format(text='VARCHAR')} {{events}}) q"),
    "input_guards": (lambda w: w.documents.select("doc_id", R.good_reason(F.col("source")).alias("reason"), R.good_user_name(F.col("text")).alias("name"), R.good_password(F.col("lang")).alias("password")), "SELECT doc_id, coalesce(length(source) >= 5, FALSE) AS reason, coalesce(length(trim(text, ' ')) > 0 AND NOT contains(text, '/'), FALSE) AS name, coalesce(strlen(lang) >= 8, FALSE) AS password FROM {documents}"),
    "media_types": (lambda w: w.upload.select("id", R.good_media(F.col("media_type")).alias("taken")), f"SELECT id, media_type IN ({', '.join(repr(m) for m in R.MEDIA)}) AS taken FROM {{upload}}"),
    "consumable_tokens": (lambda w: w.verification.where(R.consumable(F.lit(NOW).cast("timestamp"))).select("id", "purpose"), f"SELECT id, purpose FROM {{verification}} WHERE consumed_at IS NULL AND expires_at > TIMESTAMP '{NOW}'"),
    "find_documents": (lambda w: R.find_documents(w, _titles(w)), f"SELECT q.namespace, q.title, d.document_id FROM {ASKED_SQL} JOIN {_DOCS} d ON d.namespace = q.namespace AND d.title = q.title"),
    "title_presence": (lambda w: R.presence(w, _titles(w)), f"SELECT q.namespace, q.title, (q.namespace, q.title) IN (SELECT (ns.name, d.title) FROM {LIVE} r {NAMED}) AS there FROM {ASKED_SQL}"),
    "unknown_titles": (lambda w: R.unknown(_titles(w).union(_titles(w)), R.sorted_titles(w)), f"SELECT DISTINCT q.namespace, q.title FROM {ASKED_SQL} WHERE (q.namespace, q.title) NOT IN (SELECT (ns.name, d.title) FROM {LIVE} r {NAMED})"),
    "revisions_within": (lambda w: R.revisions_within(w, w.revision.where("id % 5 = 0").select(F.when(F.col("id") % 2 == 0, F.col("document_id")).otherwise(0).alias("document_id"), F.col("id").alias("revision_id"))), "SELECT document_id, id AS revision_id, sequence FROM {revision} WHERE id % 5 = 0 AND (id % 2 = 0 OR document_id = 0)"),
    "revision_texts": (lambda w: R.revision_texts(w, w.revision.select((F.col("id") * 2).alias("revision_id"))), "SELECT q.revision_id, r.id IS NOT NULL AS found, r.content FROM (SELECT id * 2 AS revision_id FROM {revision}) q LEFT JOIN {revision} r ON r.id = q.revision_id"),
    "find_users": (lambda w: R.find_users(w, w.document.sparkSession.createDataFrame([(u,) for u in USERS], "key string")), f"SELECT DISTINCT q.key, u.id, u.external_id, u.name FROM {_list([(u,) for u in USERS], 'key')} JOIN {{wiki_user}} u ON u.name = q.key OR u.external_id = q.key"),
    "is_starred": (lambda w: R.starred_by(w, 7, w.document.join(w.namespace.withColumnRenamed("id", "namespace_id"), "namespace_id").select(F.col("name").alias("namespace"), "title")), f"SELECT d.namespace, d.title, d.document_id IN (SELECT document_id FROM {{star}} WHERE user_id = 7) AS starred FROM {_DOCS} d"),
    "newest_files": (lambda w: R.newest_files(w, w.document.select(F.col("title").alias("name"))), "SELECT name, content_hash FROM (SELECT d.title AS name, f.content_hash, row_number() OVER (PARTITION BY d.title ORDER BY r.sequence DESC) AS k FROM (SELECT DISTINCT title FROM {document}) q JOIN {document} d ON d.title = q.title AND d.namespace_id = 3 JOIN {revision} r ON r.document_id = d.id JOIN {file_revision} f ON f.revision_id = r.id) WHERE k = 1"),
    "attached_files": (lambda w: R.attached(w, w.events.select((F.col("event_id") * 2).alias("revision_id"), F.md5(F.col("event_type")).alias("content_hash"), F.when(F.col("event_id") % 3 == 0, "cc0").otherwise("none").alias("license"))), "SELECT event_id * 2 AS revision_id, md5(event_type) AS content_hash, 'cc0' AS license FROM {events} WHERE event_id % 3 = 0 AND event_id * 2 IN (SELECT id FROM {revision})"),
    "random_page": (lambda w: R.random_page(w, 5), f"SELECT {DISPLAY} AS title FROM (SELECT * FROM {LIVE} ORDER BY md5('5:' || CAST(document_id AS VARCHAR)), document_id LIMIT 1) r {NAMED}"),
    "live_titles_sorted": (R.sorted_titles, f"SELECT ns.name AS namespace, d.title FROM {LIVE} r {NAMED} ORDER BY 1, 2"),
    "block_history": (R.block_history, f"SELECT m.name, {AUTHOR} AS target, m.reason, strftime(m.created_at, '%Y-%m-%d') AS created_at, strftime(m.removed_at, '%Y-%m-%d') AS removed_at FROM (SELECT * FROM {{acl_group_member}} ORDER BY created_at DESC, name, actor_id LIMIT 100) m LEFT JOIN {{actor}} a ON a.id = m.actor_id"),
    "thread_pages": (lambda w: R.thread_pages(w, w.thread.select(F.col("id").alias("thread_id"))), f"SELECT r.id AS thread_id, {DISPLAY} AS page, r.topic, r.status, c.sequence, c.author, CASE WHEN c.hidden THEN '' ELSE c.content END AS content, c.hidden FROM {{thread}} r {NAMED} JOIN {{thread_comment}} c ON c.thread_id = r.id"),
    "edit_request_views": (lambda w: R.edit_request_views(w, VIEWER, NOW), _VIEWS_SQL),
    "edit_request_pages": (R.edit_request_pages, f"SELECT r.id, {DISPLAY} AS page, {AUTHOR} AS author, r.status, b.sequence AS base_sequence, coalesce(l.content, '') AS current, r.content, r.status = 'open' AS is_open FROM {{edit_request}} r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id LEFT JOIN {{revision}} b ON b.id = r.base_revision_id LEFT JOIN {LIVE} l ON l.document_id = r.document_id"),
    "page_views": (lambda w: R.page_views(w, _titles(w), 7), f"SELECT {_SHOWN} AS page, l.content AS source, CAST(NULL AS VARCHAR) AS redirect, l.sequence, l.kind, (SELECT count(*) FROM {{reference}} f WHERE f.target_namespace_id = d.namespace_id AND f.target_title = d.title) AS backlinks, (SELECT count(*) FROM {{thread}} t WHERE t.document_id = d.document_id) AS threads, d.document_id IN (SELECT document_id FROM {{star}} WHERE user_id = 7) AS starred FROM {ASKED_SQL} JOIN {_DOCS} d ON d.namespace = q.namespace AND d.title = q.title JOIN {LIVE} l ON l.document_id = d.document_id"),
    "raw_texts": (lambda w: R.raw_texts(w, _titles(w)), f"SELECT {_SHOWN} AS page, l.content FROM {ASKED_SQL} JOIN {_DOCS} d ON d.namespace = q.namespace AND d.title = q.title JOIN {LIVE} l ON l.document_id = d.document_id"),
    "session_view": (lambda w: R.session_view(w, 10), f"SELECT {', '.join(f'(SELECT data FROM {_SETTINGS} x WHERE name = {chr(39)}{n}{chr(39)}) AS {n}' for n, _ in R.DEFAULTS)}, (SELECT max(user_name) FROM {{actor}} WHERE id = 10) AS user_name, (SELECT count(*) FROM {{notification}} WHERE user_id = 10 AND read_at IS NULL) AS unread"),
    "newest_of_titles": (lambda w: R.latest_before(w, _titles(w)), f"SELECT {_SHOWN} AS page, r.sequence, r.kind FROM {ASKED_SQL} JOIN {_DOCS} d ON d.namespace = q.namespace AND d.title = q.title JOIN (SELECT * FROM {{revision}} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) = 1) r ON r.document_id = d.document_id"),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql)) for name, (build, sql) in _Q.items()}
