"""Queries over full-text search, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_title
from ..operators import search as S
from ..sources.storage import shared_path
from ..sources.world import World, ctes
from .pages import LIVE, NAMED

QUERY = "thing éle Doc 77"
ASKED = ("Doc 4", "template:Doc 11", "문서:Doc 5", "file:Doc 3", "Nowhere", "category:Doc 4", " Doc 7 ")


#: The same titles with the namespaces that they stand for.
_ASKED_SQL = ", ".join(f"('{q}', '{n}', '{t}')" for q, n, t in zip(ASKED, ("main", "template", "main", "file", "main", "category", "main"), ("Doc 4", "Doc 11", "Doc 5", "Doc 3", "Nowhere", "Doc 4", "Doc 7"), strict=True))


def _ranked_sql(pages: str) -> str:
    """BM25 over pages(namespace, title, content), by all grams of all fields."""
    wanted = ", ".join(f"'{g}'" for g in S.query_grams(QUERY))
    words = ", ".join(f"('{w}', '{g}', {len(S.grams(w))})" for w in QUERY.split() for g in S.grams(w))
    return f"""WITH w AS (SELECT row_number() OVER () AS n, namespace, title, content, alive FROM (SELECT *, true AS alive FROM ({pages}))),
      f AS (SELECT n, alive, namespace, title, 'title' AS field, title AS text FROM w UNION ALL SELECT n, alive, namespace, title, 'content', content FROM w),
      l AS (SELECT *, greatest(coalesce(length(text), 0) - 1, 0) + greatest(coalesce(length(text), 0) - 2, 0) AS len FROM f),
      every AS (SELECT n, alive, namespace, title, field, len, unnest(list_concat(
        list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS gram FROM l WHERE length(text) >= 2),
      g AS (SELECT n, alive, namespace, title, field, len, gram, count(*) AS tf FROM every WHERE gram IN ({wanted}) GROUP BY ALL),
      s AS (SELECT field, count(*) AS pages, avg(len) AS mean FROM l GROUP BY field),
      df AS (SELECT field, gram, count(*) AS df FROM g GROUP BY ALL),
      words AS (SELECT * FROM (VALUES {words}) AS v(word, gram, size)),
      ok AS (SELECT DISTINCT n FROM (SELECT n, field, word FROM g JOIN words USING (gram) GROUP BY ALL HAVING count(*) = max(size)) z)
      SELECT namespace, title, round(sum(ln(1 + (pages - df + 0.5) / (df + 0.5)) * tf * {S.K1 + 1} / (tf + {S.K1} * ({1 - S.B} + {S.B} * len / mean))), 6) AS score
      FROM g JOIN df USING (field, gram) JOIN s USING (field) JOIN ok USING (n) WHERE alive GROUP BY n, namespace, title ORDER BY score DESC, namespace, title LIMIT 50"""


#: A query of all kinds of parts; the twin says by hand what they mean.
PARTS = '+title:"Doc 1" (thing OR éle) AND NOT title:"Doc 15" -namespace:file'
_HAS = "list_has_all(list_concat(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)), list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))), {1})"


def _has(column: str, phrase: str) -> str:
    return _HAS.format(f"coalesce({column}, '')", str(S.grams(phrase)))


_PARTS_SQL = f"SELECT namespace, title FROM {{page}} WHERE {_has('title', 'Doc 1')} AND namespace <> 'file'"


def _put_remove(w: World):
    """An index of all pages, of which then some are replaced and others removed, asked afterwards. Some are put and then removed, or
    removed and then put, before the same commit."""
    index = S.Index(w.page.sparkSession, shared_path(w.page.sparkSession))
    index.put(w.page)
    index.commit()
    replaced = w.page.where("id % 7 = 0").withColumn("content", F.concat(F.lit("a thing that replaces "), "title"))
    index.remove(replaced)
    index.put(w.page.where("id % 11 = 0 and id % 7 <> 0").withColumn("content", F.lit("never seen")))
    index.put(replaced)
    index.remove(w.page.where("id % 11 = 0 and id % 7 <> 0"))
    index.commit()
    return index


_REPLACED = "SELECT namespace, title, 'a thing that replaces ' || title AS content FROM {page} WHERE id % 7 = 0"
_IN_FORCE = f"SELECT namespace, title, content FROM {{page}} WHERE id % 7 <> 0 AND id % 11 <> 0 UNION ALL {_REPLACED}"


def _merged(w: World):
    index = _put_remove(w)
    index.merge()
    return index.search(QUERY)


def _matching(w: World):
    index = S.Index(w.page.sparkSession, shared_path(w.page.sparkSession))
    index.put(w.page)
    index.commit()
    return index.search(PARTS, w.page.count()).select("namespace", "title")


def _asked(w: World):
    d = w.document.sparkSession.createDataFrame([(q,) for q in ASKED], "query string")
    return d.select("query", *parse_title(F.col("query")))


_Q = {
    "bm25_search_topk": (lambda w: S.search(w.page, QUERY), _ranked_sql("SELECT namespace, title, content FROM {page}")),
    "search_index_put_remove": (lambda w: _put_remove(w).search(QUERY), _ranked_sql("SELECT namespace, title, CASE WHEN id % 7 = 0 THEN 'a thing that replaces ' || title ELSE content END AS content FROM {page} WHERE id % 7 = 0 OR id % 11 <> 0")),
    "search_index_merge": (_merged, _ranked_sql(_IN_FORCE)),
    "search_boolean": (_matching, _PARTS_SQL),
    "search_index_rebuild": (lambda w: S.rebuilt(w, shared_path(w.page.sparkSession)).postings().groupBy("field", "gram").agg(F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("times")), f"WITH p AS (SELECT d.title, r.content FROM {LIVE} r {NAMED}), f AS (SELECT 'title' AS field, title AS text, row_number() OVER () AS k FROM p UNION ALL SELECT 'content', content, row_number() OVER () FROM p), e AS (SELECT field, k, unnest(list_concat(list_transform(range(1, length(text)), lambda i: substr(text, i, 2)), list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)))) AS gram FROM f WHERE length(text) >= 2) SELECT field, gram, count(DISTINCT k) AS documents, count(*) AS times FROM e GROUP BY field, gram"),
    "exact_title_redirect": (lambda w: S.redirects_to(w, _asked(w)), f"SELECT q.query, CASE WHEN r.ns = 'main' THEN r.title WHEN r.title IS NOT NULL THEN r.ns || ':' || r.title END AS redirect FROM (VALUES {_ASKED_SQL}) AS q(query, namespace, title) LEFT JOIN (SELECT ns.name AS ns, d.title FROM {LIVE} r {NAMED}) r ON r.ns = q.namespace AND r.title = q.title"),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql)) for name, (build, sql) in _Q.items()}
