"""A wiki world over the generic tables: one portable SELECT per view, read by Spark here and by the SQL twins as CTEs.

A view names the tables and views it reads as {name}. Actors, revisions and notifications come from events, documents and
references from documents, threads from conversations, groups and permissions from customers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMESPACES = ((0, "main"), (1, "template"), (2, "category"), (3, "file"))
KINDS = (("signup", "create"), ("click", "edit"), ("view", "revert"), ("purchase", "move"), ("error", "delete"))
#: id, document, namespace, action, order, kind, value, allowed
RULES = (
    (1, None, 0, "edit", 100, "perm", "any", True), (2, None, 1, "edit", 100, "perm", "member", True), (3, None, 2, "edit", 100, "perm", "any", True), (4, None, 3, "edit", 50, "perm", "ip", False),
    (5, None, 0, "edit", 10, "group", "BUILDING", False), (6, 10, None, "edit", 10, "perm", "ip", False), (7, 20, None, "edit", 5, "group", "MACHINERY", True), (8, None, 1, "edit", 20, "perm", "admin", False), (9, None, 3, "edit", 60, "perm", "any", True),
    (10, None, 0, "edit", 5, "user", "user7", False), (11, None, 1, "edit", 5, "ip", "10.1.0.0/16", False), (12, 30, None, "edit", 1, "user", "user4", False), (13, 20, None, "edit", 1, "ip", "2001:db8::/32", True),
)


#: The enumerations of a wiki, in the order of their ids.
PERMISSIONS = tuple("admin grant aclgroup nsacl delete_thread hide_thread_comment update_thread_status update_thread_document update_thread_topic hide_revision batch_revert login_history config api_access skip_captcha developer".split())
ACTIONS = tuple("read edit move delete create_thread write_thread_comment edit_request acl".split())
REVISION_KINDS = tuple("create edit move delete restore revert import".split())
#: What may be done by anybody where no rule says more, and what a blocked actor may not do.
OPEN_ACTIONS = tuple("read edit create_thread write_thread_comment edit_request".split())
BLOCKED_ACTIONS = tuple("edit create_thread write_thread_comment edit_request".split())
BLOCKED = "차단된 사용자"
#: Licences to choose from: name, shown name, source.
LICENCES = (
    ("cc-by-nc-sa-2.0-kr", "CC BY-NC-SA 2.0 KR", "https://creativecommons.org/licenses/by-nc-sa/2.0/kr/"), ("cc-by-sa-4.0", "CC BY-SA 4.0", "https://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-4.0", "CC BY 4.0", "https://creativecommons.org/licenses/by/4.0/"), ("cc0", "CC0 (퍼블릭 도메인 기증)", "https://creativecommons.org/publicdomain/zero/1.0/"), ("public-domain", "퍼블릭 도메인", None), ("fair-use", "공정 이용", None),
)


def _numbered(names):
    return tuple((i + 1, n) for i, n in enumerate(names))


def _values(rows, names: str) -> str:
    show = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS t({names})"


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS) + " ELSE 'edit' END"
_N = "(SELECT count(*) AS n FROM {documents}) c"
VIEWS = {
    "namespace": f"SELECT CAST(id AS BIGINT) AS id, name FROM {_values(NAMESPACES, 'id, name')}",
    "document": "SELECT doc_id AS id, CASE WHEN doc_id % 10 IN (1, 2, 3) THEN doc_id % 10 ELSE 0 END AS namespace_id, 'Doc ' || CAST(doc_id AS STRING) AS title, n_chars FROM {documents}",
    "page": "SELECT n.name AS namespace, d.title, t.text AS content, d.id FROM {document} d JOIN {namespace} n ON n.id = d.namespace_id JOIN {documents} t ON t.doc_id = d.id",
    "actor": "SELECT user_id AS id, CASE WHEN user_id % 3 <> 0 THEN 'user' || CAST(user_id AS STRING) END AS user_name, CASE WHEN user_id % 3 = 0 THEN '10.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 256 AS STRING) || '.' || CAST(user_id % 100 AS STRING) END AS ip FROM (SELECT DISTINCT user_id FROM {events}) e",
    "revision": f"SELECT event_id AS id, event_id % n AS document_id, CAST(row_number() OVER (PARTITION BY event_id % n ORDER BY ts, event_id) AS BIGINT) AS sequence, {_KIND} AS kind, user_id AS actor_id, value > 200 AS hidden, CAST(round(value) AS BIGINT) AS content_bytes, CASE WHEN event_type <> 'error' THEN 'alpha ' || CAST(event_id % 2 AS STRING) || chr(10) || 'beta ' || CAST(event_id % 3 AS STRING) || chr(10) || 'gamma ' || CAST(user_id % 5 AS STRING) END AS content, 'note ' || CAST(event_id % 9 AS STRING) AS comment, ts AS created_at FROM {{events}}, {_N}",
    "reference": f"SELECT doc_id AS source_id, CASE WHEN k = 2 THEN 2 ELSE (7 * doc_id + 13 * k) % m % 4 END AS target_namespace_id, 'Doc ' || CAST((7 * doc_id + 13 * k) % m AS STRING) AS target_title, CASE k WHEN 0 THEN 'link' WHEN 1 THEN 'include' ELSE 'category' END AS kind FROM (SELECT doc_id, CAST(floor(n * 1.25) AS BIGINT) AS m FROM {{documents}}, {_N}) d CROSS JOIN {_values(((0,), (1,), (2,)), 'k')} WHERE NOT (k = 2 AND doc_id % 3 = 0)",
    "star": f"SELECT user_id, event_id % n AS document_id, min(ts) AS created_at FROM {{events}}, {_N} WHERE event_type = 'view' GROUP BY user_id, event_id % n",
    "permission_name": f"SELECT CAST(id AS BIGINT) AS id, name FROM {_values(_numbered(PERMISSIONS), 'id, name')}",
    "acl_action": f"SELECT CAST(id AS BIGINT) AS id, name FROM {_values(_numbered(ACTIONS), 'id, name')}",
    "revision_kind": f"SELECT CAST(id AS BIGINT) AS id, name FROM {_values(_numbered(REVISION_KINDS), 'id, name')}",
    "licence": f"SELECT name, display_name, source_url FROM {_values(LICENCES, 'name, display_name, source_url')}",
    "site_setting": (
        "SELECT 'wiki_name' AS name, 'Wiki of ' || CAST(count(*) AS STRING) || ' pages' AS data FROM {documents} UNION ALL SELECT 'motd', max(source) FROM {documents} "
        "UNION ALL SELECT 'nation.' || n_name, r_name FROM {nation} JOIN {region} ON r_regionkey = n_regionkey"
    ),
    "wiki_user": "SELECT c_custkey AS id, 'u-' || CAST(c_custkey AS STRING) AS external_id, c_name AS name FROM {customer}",
    "verification": "SELECT c_custkey AS id, c_custkey AS user_id, CASE c_nationkey % 3 WHEN 0 THEN 'signup' WHEN 1 THEN 'password_reset' ELSE 'email_change' END AS purpose, md5('token' || CAST(c_custkey AS STRING)) AS token_hash, CAST('2024-06-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 60 AS INT) AS expires_at, CASE WHEN c_custkey % 4 = 0 THEN CAST('2024-05-01 00:00:00' AS TIMESTAMP) END AS consumed_at FROM {customer}",
    "file_revision": "SELECT event_id AS revision_id, md5(CAST(event_id % 97 AS STRING)) AS content_hash, event_id % 6 AS license_id FROM {events} WHERE event_id % 4 = 1",
    "upload": "SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE ' Picture ' || CAST(doc_id AS STRING) END AS name, CASE WHEN doc_id % 8 = 0 THEN '' ELSE 'cc0' END AS license, lang AS category, ' about ' || source AS description, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'text/html' ELSE 'image/svg+xml' END AS media_type, text AS bytes FROM {documents}",
    "notification": "SELECT event_id AS id, (user_id * 7 + 3) % 101 AS user_id, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN ts END AS read_at, props AS payload, ts AS created_at FROM {events}",
    "thread": f"SELECT conv_id AS id, conv_id % n AS document_id, CASE conv_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'pause' ELSE 'close' END AS status, 'Topic ' || CAST(conv_id AS STRING) AS topic FROM (SELECT DISTINCT conv_id FROM {{conversations}}) v, {_N}",
    "thread_comment": "SELECT conv_id AS thread_id, CAST(turn + 1 AS BIGINT) AS sequence, role AS author, text AS content, (conv_id + turn) % 7 = 0 AS hidden FROM {conversations}",
    "edit_request": f"SELECT event_id AS id, event_id % n AS document_id, user_id AS actor_id, CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'accepted' ELSE 'closed' END AS status, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN event_id - event_id % 7 END AS base_revision_id, 'alpha ' || CAST(event_id % 3 AS STRING) || chr(10) || 'new' AS content FROM {{events}}, {_N} WHERE event_type = 'purchase'",
    "acl_rule": f"SELECT CAST(id AS BIGINT) AS id, CAST(document_id AS BIGINT) AS document_id, CAST(namespace_id AS BIGINT) AS namespace_id, action, evaluation_order, kind, value, allowed FROM {_values(RULES, 'id, document_id, namespace_id, action, evaluation_order, kind, value, allowed')}",
    "acl_group_member": "SELECT c_mktsegment AS name, c_custkey AS actor_id, CASE WHEN c_custkey % 5 = 0 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS removed_at, CASE WHEN c_custkey % 3 = 0 THEN CAST('2024-06-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 60 AS INT) END AS expires_at, 'reason ' || CAST(c_custkey % 7 AS STRING) AS reason, CAST('2023-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 200 AS INT) AS created_at FROM {customer}",
    "user_permission": "SELECT c_custkey AS user_id, CASE c_nationkey % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'delete_thread' WHEN 2 THEN 'hide_revision' ELSE 'acl' END AS permission, CASE WHEN c_custkey % 6 = 0 THEN CAST('2024-03-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 90 AS INT) END AS revoked_at, CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(c_custkey % 365 AS INT) AS created_at FROM {customer}",
    "marked_text": "SELECT doc_id AS id, '== Head ' || lang || ' ==' || chr(10) || 'See [[Doc ' || CAST(7 * doc_id % 100 AS STRING) || '|label]] and [[../Sub ' || CAST(doc_id % 5 AS STRING) || ']] ' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '==== Deep ====' ELSE '=== Next ===' END || chr(10) || '[[분류:' || lang || ']]' || '[include(틀:Box, a=1, b=@who@)] @name=guest@ [* note] [no' || lang || '(1)] ' || repeat(chr(123), 3) || 'code' || repeat(chr(125), 3) || chr(10) || text AS text FROM {documents}",
    "redirects": "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN '#redirect Doc ' || CAST(doc_id + 1 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '#anchor' ELSE '' END ELSE 'plain' END AS text FROM {documents}",
}


def names_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


class World:
    """world.revision and so on: the views as DataFrames, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self._spark.sql(VIEWS[name], **{n: getattr(self, n) for n in names_in(VIEWS[name])})
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def ctes(sql: str) -> str:
    """A query over {views} as plain SQL with the views it needs in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for n in names_in(text):
            if n in VIEWS and n not in needed:
                visit(VIEWS[n])
                needed.append(n)

    visit(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: f"v_{m[1]}" if m[1] in VIEWS else m[1], s)
    if not needed:
        return plain(sql)
    head = ", ".join(f"v_{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start) :]}"
    return f"WITH {head} {body}"
