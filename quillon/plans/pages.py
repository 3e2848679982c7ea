"""Queries over pages, revisions and references with their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import pages as P
from ..sources.world import World, ctes

DISPLAY = "CASE WHEN ns.name = 'main' THEN d.title ELSE ns.name || ':' || d.title END"
NAMED = "JOIN {document} d ON d.id = r.document_id JOIN {namespace} ns ON ns.id = d.namespace_id"
AUTHOR = "coalesce(a.user_name, a.ip, '')"
LATEST = "(SELECT * FROM {revision} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) = 1)"
LIVE = f"(SELECT * FROM {LATEST} WHERE kind <> 'delete')"
AT = datetime(2024, 12, 31)
ASKED = [("main", "Doc 4"), ("main", "Doc 5"), ("template", "Doc 11"), ("template", "Doc 12"), ("file", "Doc 3"), ("main", "Nowhere")]
ASKED_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ASKED) + ") AS q(namespace, title)"


def _asked(w: World):
    return w.document.sparkSession.createDataFrame(ASKED, "namespace string, title string")


def _batch(w: World):
    return w.events.where("event_type = 'purchase'").select((F.col("event_id") % 50).alias("document_id"), F.col("event_id").alias("id"))


def _titles(w: World):
    return w.documents.select("doc_id", F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, ["문서:", "template:", "category:", "other:", ""])), (F.col("doc_id") % 5 + 1).cast("int")), F.lit("Doc "), F.col("doc_id").cast("string"), F.lit(" ")).alias("raw"))


_RAW = "(SELECT doc_id, ' ' || CASE doc_id % 5 WHEN 0 THEN '문서:' WHEN 1 THEN 'template:' WHEN 2 THEN 'category:' WHEN 3 THEN 'other:' ELSE '' END || 'Doc ' || CAST(doc_id AS VARCHAR) || ' ' AS raw FROM {documents})"

_Q = {
    "recent_changes": (P.recent_changes, f"SELECT r.id, {DISPLAY} AS title, r.sequence, r.kind, {AUTHOR} AS author, r.comment, r.content_bytes, r.created_at FROM {{revision}} r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id ORDER BY r.created_at DESC, r.id DESC LIMIT 100"),
    "revision_history": (lambda w: P.revision_history(w, 7), f"SELECT r.sequence, r.kind, {AUTHOR} AS author, r.comment, r.content_bytes, r.hidden, r.created_at FROM {{revision}} r JOIN {{actor}} a ON a.id = r.actor_id WHERE r.document_id = 7 ORDER BY r.sequence DESC LIMIT 100"),
    "latest_revision": (lambda w: P.latest(w.revision).select("document_id", "id", "sequence", "kind"), f"SELECT document_id, id, sequence, kind FROM {LATEST}"),
    "contributions": (lambda w: P.contributions(w, "user7"), f"SELECT r.id, {DISPLAY} AS title, r.sequence, r.kind, r.created_at FROM {{revision}} r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id WHERE a.user_name = 'user7' OR a.ip = 'user7' ORDER BY r.created_at DESC, r.id DESC LIMIT 200"),
    "live_titles": (P.live_titles, f"SELECT ns.name AS namespace, d.title FROM {LIVE} r {NAMED}"),
    "existing_titles": (lambda w: P.existing_titles(w, _asked(w)), f"SELECT q.namespace, q.title FROM {ASKED_SQL} WHERE (q.namespace, q.title) IN (SELECT (ns.name, d.title) FROM {LIVE} r {NAMED})"),
    "read_sources": (lambda w: P.read_sources(w, _asked(w)), f"SELECT ns.name AS namespace, d.title, r.sequence, r.content FROM {LIVE} r {NAMED} JOIN {ASKED_SQL} ON q.namespace = ns.name AND q.title = d.title"),
    "stale_pages": (P.stale_pages, f"SELECT {DISPLAY} AS title, r.created_at FROM (SELECT * FROM {LIVE} ORDER BY created_at, document_id LIMIT 200) r {NAMED}"),
    "shortest_pages": (lambda w: P.pages_by_length(w, False), f"SELECT {DISPLAY} AS title, r.content_bytes FROM (SELECT * FROM {LIVE} ORDER BY content_bytes, document_id LIMIT 200) r {NAMED}"),
    "longest_pages": (lambda w: P.pages_by_length(w, True), f"SELECT {DISPLAY} AS title, r.content_bytes FROM (SELECT * FROM {LIVE} ORDER BY content_bytes DESC, document_id LIMIT 200) r {NAMED}"),
    "title_suggest": (lambda w: P.title_suggest(w, "dOC 1"), f"SELECT ns.name AS namespace, d.title FROM {LIVE} r {NAMED} WHERE d.title ILIKE 'dOC 1%' ORDER BY length(d.title), d.title, ns.name LIMIT 10"),
    "needed_pages": (P.needed_pages, f"SELECT {DISPLAY} AS title, d.wanted FROM (SELECT target_namespace_id, target_title AS title, count(*) AS wanted FROM {{reference}} f WHERE NOT EXISTS (SELECT 1 FROM {{document}} x WHERE x.namespace_id = f.target_namespace_id AND x.title = f.target_title) GROUP BY ALL ORDER BY wanted DESC, target_title, target_namespace_id LIMIT 200) d JOIN {{namespace}} ns ON ns.id = d.target_namespace_id"),
    "orphaned_pages": (P.orphaned_pages, f"SELECT d.namespace_id, d.title FROM {{document}} d JOIN {LIVE} r ON r.document_id = d.id WHERE NOT EXISTS (SELECT 1 FROM {{reference}} f WHERE f.target_namespace_id = d.namespace_id AND f.target_title = d.title) ORDER BY 1, 2 LIMIT 200"),
    "uncategorized_pages": (P.uncategorized_pages, f"SELECT d.namespace_id, d.title FROM {{document}} d JOIN {LIVE} r ON r.document_id = d.id WHERE d.id NOT IN (SELECT source_id FROM {{reference}} WHERE kind = 'category') ORDER BY 1, 2 LIMIT 200"),
    "backlinks": (lambda w: P.backlinks(w, 0, "Doc 40"), f"SELECT {DISPLAY} AS title, r.kind FROM (SELECT source_id AS document_id, kind FROM {{reference}} WHERE target_namespace_id = 0 AND target_title = 'Doc 40') r {NAMED}"),
    "backlinks_live_only": (lambda w: P.backlinks(w, 0, "Doc 40", live_only=True), f"SELECT {DISPLAY} AS title, r.kind FROM (SELECT source_id AS document_id, kind FROM {{reference}} WHERE target_namespace_id = 0 AND target_title = 'Doc 40' AND source_id IN (SELECT document_id FROM {LIVE})) r {NAMED}"),
    "backlink_counts": (P.backlink_counts, "SELECT target_namespace_id, target_title, count(*) AS links, count(DISTINCT kind) AS kinds FROM {reference} GROUP BY ALL"),
    "category_members": (P.category_members, f"SELECT r.target_title AS category, {DISPLAY} AS member FROM (SELECT source_id AS document_id, target_title FROM {{reference}} WHERE kind = 'category' AND target_namespace_id = 2) r {NAMED}"),
    "last_edited_by": (lambda w: P.last_edited_by(w, "user7"), f"SELECT {DISPLAY} AS title, r.sequence FROM {LATEST} r {NAMED} JOIN {{actor}} a ON a.id = r.actor_id WHERE a.user_name = 'user7' OR a.ip = 'user7'"),
    "previous_revision_pairs": (P.previous_revisions, "SELECT document_id, sequence, coalesce(lag(content) OVER (PARTITION BY document_id ORDER BY sequence), '') AS before, coalesce(content, '') AS after FROM (SELECT * FROM {revision} QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) <= 500)"),
    "content_before_author": (P.content_before, f"WITH h AS (SELECT r.*, {AUTHOR} AS author, row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) AS rn FROM {{revision}} r JOIN {{actor}} a ON a.id = r.actor_id), o AS (SELECT h.*, l.author AS last_author, row_number() OVER (PARTITION BY h.document_id ORDER BY h.sequence DESC) AS k FROM h JOIN h l ON l.document_id = h.document_id AND l.rn = 1 WHERE h.rn <= 500 AND h.author <> l.author) SELECT document_id, last_author, author, sequence, content FROM o WHERE k = 1 AND content IS NOT NULL"),
    "batch_revert_plan": (lambda w: P.content_before(w).where("last_author = 'user7'").select("document_id", "sequence"), f"WITH h AS (SELECT r.*, {AUTHOR} AS author, row_number() OVER (PARTITION BY document_id ORDER BY sequence DESC) AS rn FROM {{revision}} r JOIN {{actor}} a ON a.id = r.actor_id), o AS (SELECT h.*, row_number() OVER (PARTITION BY h.document_id ORDER BY h.sequence DESC) AS k FROM h JOIN h l ON l.document_id = h.document_id AND l.rn = 1 AND l.author = 'user7' WHERE h.rn <= 500 AND h.author <> 'user7') SELECT document_id, sequence FROM o WHERE k = 1 AND content IS NOT NULL"),
    "blame_lines": (P.blame, "WITH RECURSIVE v AS (SELECT document_id, sequence, actor_id, string_split(content, chr(10)) AS ls, row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS i FROM {revision} WHERE content IS NOT NULL), f AS (SELECT document_id, i, ls, list_transform(ls, lambda x: {{'s': sequence, 'a': actor_id}}) AS o FROM v WHERE i = 1 UNION ALL SELECT v.document_id, v.i, v.ls, list_transform(range(1, len(v.ls) + 1), lambda k: CASE WHEN k <= len(f.ls) AND f.ls[k] = v.ls[k] THEN f.o[k] ELSE {{'s': v.sequence, 'a': v.actor_id}} END) FROM f JOIN v ON v.document_id = f.document_id AND v.i = f.i + 1), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY i DESC) = 1), u AS (SELECT document_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS text, unnest(o) AS o FROM l) SELECT document_id, line, text, o.s AS since, o.a AS actor_id FROM u"),
    "next_sequence": (lambda w: P.next_sequence(w, _batch(w)), "WITH b AS (SELECT event_id % 50 AS document_id, event_id AS id FROM {events} WHERE event_type = 'purchase'), t AS (SELECT document_id, max(sequence) AS top FROM {revision} GROUP BY 1) SELECT b.document_id, b.id, CAST(coalesce(t.top, 0) + row_number() OVER (PARTITION BY b.document_id ORDER BY b.id) AS BIGINT) AS sequence FROM b LEFT JOIN t USING (document_id)"),
    "content_hash_dedup": (lambda w: P.content_dedup(w.documents), "SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS copies, max(strlen(text)) AS byte_size FROM {documents} GROUP BY sha256(text)"),
    "move_swap_result": (lambda w: P.moved(w, 20, "Doc 30"), "SELECT id, namespace_id, CASE WHEN id = 20 THEN 'Doc 30' WHEN title = 'Doc 30' AND namespace_id = (SELECT namespace_id FROM {document} WHERE id = 20) THEN (SELECT title FROM {document} WHERE id = 20) ELSE title END AS title FROM {document}"),
    "reference_replace_result": (lambda w: P.replaced_references(w, 5, w.document.where("id < 4").select(F.col("namespace_id").alias("target_namespace_id"), F.col("title").alias("target_title"), F.lit("link").alias("kind"))), "SELECT source_id, target_namespace_id, target_title, kind FROM {reference} WHERE source_id <> 5 UNION ALL SELECT DISTINCT CAST(5 AS BIGINT), namespace_id, title, 'link' FROM {document} WHERE id < 4"),
    "star_toggle_result": (lambda w: P.toggled_stars(w, 7, [7, 57, 3], AT), "SELECT * FROM {star} WHERE NOT (user_id = 7 AND document_id IN (7, 57, 3)) UNION ALL SELECT CAST(7 AS BIGINT), CAST(k AS BIGINT), TIMESTAMP '2024-12-31 00:00:00' FROM (VALUES (7), (57), (3)) AS p(k) WHERE (7, k) NOT IN (SELECT (user_id, document_id) FROM {star})"),
    "delete_append_result": (lambda w: P.deleted(w, [1, 2, 3, 4], 9, AT), f"SELECT r.document_id, r.sequence + 1 AS sequence, 'delete' AS kind, CAST(9 AS BIGINT) AS actor_id, TIMESTAMP '2024-12-31 00:00:00' AS created_at FROM {LIVE} r WHERE r.document_id IN (1, 2, 3, 4)"),
    "title_parse": (lambda w: _titles(w).select("doc_id", *T.parse_title(F.col("raw"))), f"SELECT doc_id, CASE WHEN split_part(t, ':', 1) IN ('template', 'category', 'file') AND contains(t, ':') THEN split_part(t, ':', 1) ELSE 'main' END AS namespace, CASE WHEN contains(t, ':') AND split_part(t, ':', 1) IN ('문서', 'template', 'category', 'file') THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END AS title FROM (SELECT doc_id, trim(raw) AS t FROM {_RAW}) x"),
    "title_display": (lambda w: P.with_titles(w.document.select(F.col("id").alias("document_id")), w.document, w.namespace).select("document_id", P.display().alias("shown")), "SELECT d.id AS document_id, CASE WHEN ns.name = 'main' THEN d.title ELSE ns.name || ':' || d.title END AS shown FROM {document} d JOIN {namespace} ns ON ns.id = d.namespace_id"),
}

from ..functions import text as T  # noqa: E402

_MARKS = "|".join("=" * k + f + " .+ " + f + "=" * k for k in range(1, 7) for f in ("", "#"))
_HEADS = f"(SELECT id, p, l, CAST(length(regexp_extract(l, '^=+')) AS BIGINT) AS level, CASE WHEN regexp_matches(l, '^=+#') THEN 1 ELSE 0 END AS folded FROM (SELECT id, unnest(range(0, len(ls))) AS p, unnest(ls) AS l FROM (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM {{marked_text}})) WHERE regexp_matches(l, '^(?:{_MARKS})$'))"

_Q |= {
    "byte_lengths": (lambda w: w.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("characters")), "SELECT doc_id, strlen(text) AS bytes, length(text) AS characters FROM {documents}"),
    "percent_encode_titles": (lambda w: w.documents.select("doc_id", T.percent_encode_path(F.col("text")).alias("encoded")), "SELECT doc_id, replace(replace(replace(replace(url_encode(text), '%3A', ':'), '%2F', '/'), '%28', '('), '%29', ')') AS encoded FROM {documents}"),
    "percent_encode_anchors": (lambda w: w.documents.select("doc_id", T.percent_encode_anchor(F.col("text")).alias("encoded")), f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CASE WHEN contains('{T.UNRESERVED}', chr(CAST('0x' || h AS INTEGER))) AND CAST('0x' || h AS INTEGER) < 128 THEN chr(CAST('0x' || h AS INTEGER)) ELSE '%' || lower(h) END), '') AS encoded FROM {{documents}}"),
    "html_escape_text": (lambda w: w.documents.select("doc_id", T.escape_text(F.col("text")).alias("escaped"), T.escape_attribute(F.col("text")).alias("quoted")), "SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\'\'', '&#x27;') AS quoted FROM {documents}"),
    "heading_outline": (lambda w: T.headings(w.marked_text), f"SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY p) AS BIGINT) AS n, level, substr(l, level + 2 + folded, length(l) - 2 * (level + 1 + folded)) AS heading, folded = 1 AS folded FROM {_HEADS}"),
    "heading_level_skips": (lambda w: T.level_skips(T.headings(w.marked_text)), f"WITH h AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY p) AS n, level FROM {_HEADS}) SELECT id, CAST(n AS BIGINT) AS n, level, before FROM (SELECT id, n, level, lag(level) OVER (PARTITION BY id ORDER BY n) AS before FROM h) WHERE level > before + 1"),
    "link_targets": (lambda w: T.links(w.marked_text), "SELECT id, CASE WHEN contains(x, '|') THEN split_part(x, '|', 1) ELSE x END AS target FROM (SELECT id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]*)\\]\\]', 1)) AS x FROM {marked_text})"),
    "relative_link_targets": (lambda w: T.links(w.marked_text).select("id", "target", T.relative_title(F.col("target"), F.concat(F.lit("Page/"), F.col("id").cast("string"))).alias("resolved")), "SELECT id, target, CASE WHEN starts_with(target, '문서:') THEN substr(target, 4) WHEN starts_with(target, '../') THEN 'Page' || CASE WHEN length(target) > 3 THEN '/' || substr(target, 4) ELSE '' END WHEN starts_with(target, '/') THEN 'Page/' || CAST(id AS VARCHAR) || target ELSE target END AS resolved FROM (SELECT id, CASE WHEN contains(x, '|') THEN split_part(x, '|', 1) ELSE x END AS target FROM (SELECT id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]*)\\]\\]', 1)) AS x FROM {marked_text}))"),
    "category_extract": (lambda w: T.links(w.marked_text).where(F.col("target").startswith("분류:")).select("id", F.substr("target", F.lit(4)).alias("category")), "SELECT id, regexp_extract(text, '\\[\\[분류:([^\\[\\]]*)\\]\\]', 1) AS category FROM {marked_text} WHERE contains(text, '[[분류:')"),
    "redirect_extract": (lambda w: T.redirects(w.redirects), "SELECT id, split_part(substr(text, 11), '#', 1) AS target, CASE WHEN contains(substr(text, 11), '#') THEN split_part(substr(text, 11), '#', 2) END AS anchor FROM {redirects} WHERE starts_with(text, '#redirect ')"),
    "template_variables": (lambda w: w.marked_text.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"@([^@=\s]+)(?:=[^@\n]*)?@"), F.lit(1))).alias("variable")).distinct(), "SELECT DISTINCT id, unnest(regexp_extract_all(text, '@([^@=\\s]+)(?:=[^@\\n]*)?@', 1)) AS variable FROM {marked_text}"),
    "marker_residue": (lambda w: T.residue(w.marked_text), "SELECT id, " + ", ".join(f"CAST((length(text) - length(replace(text, '{m.replace(chr(39), chr(39) * 2)}', ''))) / {len(m)} AS BIGINT) AS {n}" for n, m in T.MARKERS) + " FROM {marked_text}"),
    "html_link_backlinks": (lambda w: w.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages")), "SELECT target, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM {pages}) GROUP BY 1"),
    "age_and_dday": (lambda w: w.orders.select("o_orderkey", T.age(F.col("o_orderdate").cast("date"), F.lit("2026-07-17").cast("date")).cast("long").alias("age"), T.dday(F.col("o_orderdate").cast("date"), F.lit("1996-07-17").cast("date")).alias("dday")), "SELECT o_orderkey, CAST(2026 - year(d) - CASE WHEN (7, 17) < (month(d), day(d)) THEN 1 ELSE 0 END AS BIGINT) AS age, CASE WHEN n = 0 THEN 'D-Day' WHEN n > 0 THEN 'D+' || CAST(n AS VARCHAR) ELSE 'D' || CAST(n AS VARCHAR) END AS dday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1996-07-17' - CAST(o_orderdate AS DATE) AS n FROM {orders})"),
    "julian_day": (lambda w: w.orders.select("o_orderkey", T.julian_day(F.col("o_orderdate").cast("date")).cast("long").alias("jd")), "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' + 2440588 AS BIGINT) AS jd FROM {orders}"),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql.replace("{{", "\0").replace("}}", "\1")).replace("\0", "{").replace("\1", "}")) for name, (build, sql) in _Q.items()}
