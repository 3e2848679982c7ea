"""Streaming queries, checked against their batch definitions."""

from __future__ import annotations

from ..sources.world import VIEWS, World, ctes
from ..streaming import changes as C
from . import markup

QUERIES = {
    "latest_revision_stream": (C.latest_stream, "SELECT event_id % n AS document_id, event_id, event_type FROM events, (SELECT count(*) AS n FROM documents) c QUALIFY row_number() OVER (PARTITION BY event_id % n ORDER BY ts DESC, event_id DESC) = 1"),
    "change_counts_windowed": (C.windowed_stream, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, max(value) AS top FROM events WHERE date_trunc('day', ts) + INTERVAL '1' DAY <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events) GROUP BY 1, 2"),
    "change_counts_sliding": (C.sliding_stream, "WITH w AS (SELECT date_trunc('day', ts) - INTERVAL '1' DAY * k AS start, event_type, value FROM events, (VALUES (0), (1)) AS s(k)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, max(value) AS top FROM w WHERE start + INTERVAL '2' DAY <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events) GROUP BY 1, 2"),
    "change_sessions": (C.session_stream, "WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6' HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, max(value) AS top FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL '6' HOUR <= (SELECT max(ts) - INTERVAL '1' HOUR FROM events)"),
    "reference_stream": (lambda spark, sf_dir: C.references_stream(spark, sf_dir, VIEWS["marked_text"]), markup.QUERIES["scan_refs"][1]),
    "notify_stream": (lambda spark, sf_dir: C.notify_stream(spark, sf_dir, World(spark, sf_dir).star), ctes("SELECT r.id AS revision_id, s.user_id AS follower FROM {revision} r JOIN {star} s ON s.document_id = r.document_id WHERE s.user_id <> r.actor_id")),
}
