"""Queries over permissions, discussions, notifications and search, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import search as S
from ..sources.world import World, ctes
from .pages import AUTHOR, DISPLAY, NAMED

NOW = "2024-07-01 00:00:00"
ACTIVE = f"(SELECT DISTINCT name, actor_id FROM {{acl_group_member}} WHERE removed_at IS NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}'))"
RANGES = ("10.0.0.0/8", "10.1.0.0/16", "10.2.128.0/17", "10.3.17.0/24", "0.0.0.0/0", "10.1.1.1/32", "nonsense")


def _decisions(strict: bool):
    return lambda w: A.class_decisions(w, "edit", NOW, strict)


def labels_sql(strict: bool) -> str:
    """r: rules by whom they are about; k: actors by what rules can know them by."""
    other = "[]" if strict else "['named', 'unnamed']"
    return f"""r AS (SELECT document_id, CASE WHEN document_id IS NULL THEN namespace_id END AS namespace_id, evaluation_order, id, allowed,
        unnest(CASE WHEN kind <> 'perm' THEN [kind || ':' || value] WHEN value = 'any' THEN ['named', 'unnamed'] WHEN value = 'member' THEN ['named'] WHEN value = 'ip' THEN ['unnamed'] ELSE {other} END) AS who
        FROM {{acl_rule}} WHERE action = 'edit'),
      k AS (SELECT id AS actor_id, CASE WHEN user_name IS NULL THEN 'unnamed' ELSE 'named' END AS who FROM {{actor}}
        UNION SELECT actor_id, 'group:' || name FROM {ACTIVE} m WHERE actor_id IN (SELECT id FROM {{actor}}) AND 'group:' || name IN (SELECT who FROM r)
        UNION SELECT a.id, r.who FROM {{actor}} a JOIN r ON r.who = 'user:' || a.user_name OR r.who = 'ip:10.1.0.0/16' AND starts_with(a.ip, '10.1.'))"""


def _decisions_sql(strict: bool) -> str:
    other = "FALSE" if strict else "TRUE"
    return f"""WITH g AS (SELECT actor_id, list_sort(list(DISTINCT name)) AS groups FROM {ACTIVE} m WHERE name IN (SELECT value FROM {{acl_rule}} WHERE action = 'edit' AND kind = 'group') GROUP BY actor_id),
      more AS (SELECT a.id AS actor_id, list(DISTINCT r.kind || ':' || r.value) AS labels FROM {{actor}} a JOIN {{acl_rule}} r ON r.action = 'edit' AND (r.kind = 'user' AND r.value = a.user_name OR r.kind = 'ip' AND r.value = '10.1.0.0/16' AND starts_with(a.ip, '10.1.')) GROUP BY 1),
      who AS (SELECT a.id AS actor_id, a.user_name IS NOT NULL AS named, list_sort(list_concat(coalesce(g.groups, []), coalesce(more.labels, []))) AS groups FROM {{actor}} a LEFT JOIN g ON g.actor_id = a.id LEFT JOIN more ON more.actor_id = a.id),
      k AS (SELECT *, '{{{{"named":' || CAST(named AS VARCHAR) || ',"groups":[' || array_to_string(list_transform(groups, lambda x: '"' || x || '"'), ',') || ']}}}}' AS class FROM who),
      c AS (SELECT DISTINCT class, named, groups FROM k),
      hit AS (SELECT d.id AS document_id, c.class, r.allowed, r.id, row_number() OVER (PARTITION BY d.id, c.class ORDER BY CASE WHEN r.document_id IS NULL THEN 1 ELSE 0 END, r.evaluation_order, r.id) AS n
        FROM {{document}} d JOIN {{acl_rule}} r ON r.action = 'edit' AND (r.document_id = d.id OR r.namespace_id = d.namespace_id)
        JOIN c ON CASE WHEN r.kind = 'group' THEN list_contains(c.groups, r.value) WHEN r.kind <> 'perm' THEN list_contains(c.groups, r.kind || ':' || r.value) WHEN r.value = 'any' THEN TRUE WHEN r.value = 'member' THEN c.named WHEN r.value = 'ip' THEN NOT c.named ELSE {other} END)
      SELECT d.id AS document_id, CAST(NULL AS BIGINT) AS actor_id, c.class, coalesce(h.allowed, FALSE) AS allowed, h.id AS rule_id FROM {{document}} d CROSS JOIN c LEFT JOIN hit h ON h.document_id = d.id AND h.class = c.class AND h.n = 1
      UNION ALL SELECT NULL, actor_id, class, NULL, NULL FROM k"""


def _decide(w: World):
    """May the actor of each event edit the page that it is about?"""
    return A.decided(w, w.revision.select("id", "document_id", "actor_id"), "edit", NOW)


_DECIDE_SQL = f"""WITH {labels_sql(True)},
      q AS (SELECT v.id, v.document_id, v.actor_id, d.namespace_id FROM {{revision}} v JOIN {{document}} d ON d.id = v.document_id),
      hit AS (SELECT q.id, r.allowed, r.id AS rule_id FROM q JOIN k USING (actor_id) JOIN r ON r.who = k.who AND (r.document_id = q.document_id OR r.namespace_id = q.namespace_id)
        QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY CASE WHEN r.document_id IS NULL THEN 1 ELSE 0 END, r.evaluation_order, r.id) = 1)
      SELECT v.id, coalesce(hit.allowed, false) AS allowed, hit.rule_id FROM {{revision}} v LEFT JOIN hit USING (id)"""


def _cidr(w: World):
    spark = w.actor.sparkSession
    ranges = spark.createDataFrame([(r,) for r in RANGES], "net string")  # a fixed list of seven
    return w.actor.select("id", F.coalesce("ip", F.lit("none")).alias("ip")).join(F.broadcast(ranges), A.in_range(F.col("ip"), F.col("net"))).select("id", "net")


def _networks(w: World):
    """Addresses of both families against networks of both."""
    spark = w.actor.sparkSession
    addresses = w.actor.select(F.coalesce("ip", F.concat(F.lit("2001:db8:"), (F.col("id") % 4).cast("string"), F.lit("::"), (F.col("id") % 10).cast("string"))).alias("ip"))
    return A.in_networks(addresses, spark.createDataFrame([(n,) for n in (*RANGES, "2001:db8:1::/48", "2001:0db8:0002:0::3", "::/0", "2001::/129")], "net string"))


_NUMBER = "CAST(split_part({0}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({0}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({0}, '.', 3) AS BIGINT) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"
_CIDR_SQL = (
    "SELECT a.id, n.net FROM {actor} a, (VALUES " + ", ".join(f"('{r}')" for r in RANGES if "/" in r) + ") AS n(net) WHERE a.ip IS NOT NULL AND floor((" + _NUMBER.replace("{0}", "a.ip") + ") / pow(2, 32 - CAST(split_part(n.net, '/', 2) AS INT))) = floor((" + _NUMBER.replace("{0}", "split_part(n.net, '/', 1)") + ") / pow(2, 32 - CAST(split_part(n.net, '/', 2) AS INT)))"
)
_GRAMS = "SELECT doc_id, len, CAST(count(*) AS BIGINT) AS tf, g FROM (SELECT doc_id, 2 * length(text) - 3 AS len, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS g FROM {documents} WHERE length(text) >= 2) WHERE g IN (" + ", ".join(f"'{g}'" for g in S.query_grams("thing éle")) + ") GROUP BY doc_id, len, g"
_Q = {
    "acl_rules_for_docs": (lambda w: A.candidate_rules(w, "edit").select("document_id", "rule_id", F.col("scope").cast("long").alias("scope")), "SELECT d.id AS document_id, r.id AS rule_id, CAST(CASE WHEN r.document_id IS NULL THEN 1 ELSE 0 END AS BIGINT) AS scope FROM {acl_rule} r JOIN {document} d ON r.namespace_id = d.namespace_id UNION ALL SELECT r.document_id, r.id, CAST(0 AS BIGINT) FROM {acl_rule} r WHERE r.document_id IS NOT NULL"),
    "acl_group_membership": (lambda w: A.active_members(w, NOW), f"SELECT * FROM {ACTIVE} g"),
    "acl_decisions": (_decisions(True), _decisions_sql(True)),
    "acl_decisions_compat": (_decisions(False), _decisions_sql(False)),
    "acl_decide": (_decide, _DECIDE_SQL),
    "cidr_v4_matches": (_cidr, _CIDR_SQL),
    "cidr_matches": (_networks, "WITH a AS (SELECT DISTINCT ip, '2001:db8:' || CAST(id % 4 AS VARCHAR) || '::' || CAST(id % 10 AS VARCHAR) AS six FROM {actor}) SELECT DISTINCT ip, net FROM (" + _CIDR_SQL.replace("SELECT a.id, n.net", "SELECT a.ip, n.net") + ") x UNION SELECT six, net FROM a, (VALUES ('2001:db8:1::/48'), ('2001:0db8:0002:0::3'), ('::/0')) AS n(net) WHERE ip IS NULL AND (net = '::/0' OR net = '2001:db8:1::/48' AND starts_with(six, '2001:db8:1::') OR six = '2001:db8:2::3' AND net LIKE '%3')"),
    "permission_log": (A.permission_log, "SELECT user_id, permission, revoked_at IS NOT NULL AS revoked, strftime(coalesce(revoked_at, created_at), '%Y-%m-%d') AS at FROM {user_permission} ORDER BY coalesce(revoked_at, created_at) DESC, user_id LIMIT 100"),
    "granted_permissions": (A.granted_permissions, "SELECT DISTINCT user_id, permission FROM {user_permission} WHERE revoked_at IS NULL"),
    "recent_threads": (A.threads, f"SELECT r.id, r.topic, r.status, {DISPLAY} AS title FROM (SELECT * FROM {{thread}} ORDER BY id DESC LIMIT 100) r {NAMED}"),
    "recent_threads_by_status": (lambda w: A.threads(w, "pause", 20), f"SELECT r.id, r.topic, r.status, {DISPLAY} AS title FROM (SELECT * FROM {{thread}} WHERE status = 'pause' ORDER BY id DESC LIMIT 20) r {NAMED}"),
    "threads_of_document": (lambda w: A.threads_of(w, "main", "Doc 5"), f"SELECT r.id, r.topic, r.status, {DISPLAY} AS title FROM {{thread}} r {NAMED} WHERE d.title = 'Doc 5' AND ns.name = 'main'"),
    "thread_status_counts": (A.thread_status_counts, "SELECT status, count(*) AS n FROM {thread} GROUP BY 1"),
    "thread_timeline_masked": (A.timeline, "SELECT thread_id, sequence, author, CASE WHEN hidden THEN '' ELSE content END AS content, hidden FROM {thread_comment}"),
    "open_edit_requests": (A.open_edit_requests, f"SELECT r.id, {DISPLAY} AS title, {AUTHOR} AS author, r.created_at FROM (SELECT * FROM {{edit_request}} WHERE status = 'open' ORDER BY created_at DESC, id DESC LIMIT 100) r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id"),
    "notifications_feed": (lambda w: A.notifications(w, 10), "SELECT id, kind, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, read_at IS NOT NULL AS is_read, created_at FROM {notification} WHERE user_id = 10 ORDER BY created_at DESC, id DESC LIMIT 100"),
    "unread_counts": (A.unread_counts, "SELECT user_id, count(*) AS unread FROM {notification} WHERE read_at IS NULL GROUP BY 1"),
    "starred_documents": (lambda w: A.starred_documents(w, 7), f"SELECT {DISPLAY} AS title, r.created_at FROM (SELECT * FROM {{star}} WHERE user_id = 7) r {NAMED}"),
    "subscribers_fanout": (A.subscribers_fanout, "SELECT r.id AS revision_id, count(*) AS told FROM {revision} r JOIN {star} s ON s.document_id = r.document_id WHERE s.user_id <> r.actor_id GROUP BY 1"),
    "ngram_document_frequency": (lambda w: S.document_frequency(S.gram_counts(w.documents, S.query_grams("thing éle"))), f"SELECT g AS gram, count(*) AS documents FROM ({_GRAMS}) x GROUP BY 1"),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}")) for name, (build, sql) in _Q.items()}
