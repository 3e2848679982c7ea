"""Queries over markup; where regular expressions can say the same on this text, a SQL twin is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registered import register, scalar
from ..functions.values import COLOURS, colour_of, dimension_of
from ..operators import markup as M
from ..operators import pages as P
from ..operators import rendering as N
from ..sources.world import World, ctes


_PAIR = ("document_id", "sequence")


def _diff(w: World):
    return M.diff_lines(P.previous_revisions(w), _PAIR)


def _merge(w: World):
    p = P.previous_revisions(w)
    nxt = p.select("document_id", (F.col("sequence") - 1).alias("sequence"), F.col("after").alias("proposed"))
    return M.merge_edits(p.join(nxt, ["document_id", "sequence"]).select(*_PAIR, F.col("before").alias("base"), F.col("after").alias("current"), "proposed"), _PAIR)


#: Values as people write them, from the sizes and names of parts.
_VALUES = """SELECT DISTINCT CASE p_partkey % 10 WHEN 0 THEN '#' || substr(md5(p_name), 1, 3) WHEN 1 THEN ' #' || upper(substr(md5(p_name), 1, 6)) WHEN 2 THEN CAST(p_size AS {text}) || 'px' WHEN 3 THEN CAST(p_size AS {text}) || '%'
  WHEN 4 THEN CAST(p_size AS {text}) || '.6px' WHEN 5 THEN '0' || CAST(p_size AS {text}) WHEN 6 THEN CAST(p_size AS {text}) || 'em' WHEN 7 THEN '#' || substr(md5(p_name), 1, 2) WHEN 8 THEN CAST(p_size AS {text}) || '.3'
  ELSE CASE p_size % 6 WHEN 0 THEN 'red' WHEN 1 THEN ' Navy ' WHEN 2 THEN 'RebeccaPurple' WHEN 3 THEN 'transparent' WHEN 4 THEN 'nocolour' ELSE '' END END AS v FROM """
TEMPLATES = (("틀:Box", "Boxed @a=none@ [[Doc 3]] [include(틀:Other)] {{{#!if a == '1'\nyes}}}"), ("틀:Other", "never seen"))


def _titled(w: World):
    names = P.with_titles(w.document.select(F.col("id").alias("document_id")), w.document, w.namespace).select(F.col("document_id").alias("id"), P.display().alias("title"))
    return w.marked_text.join(names, "id")


def _rendered(w: World):
    return N.rendered(w, _titled(w), w.document.sparkSession.createDataFrame(TEMPLATES, "name string, text string"))


def _values(w: World):
    d = w.part.sparkSession.sql(_VALUES.format(text="STRING") + "{part}", part=w.part)
    return d.select("v", colour_of(F.col("v")).alias("colour"), dimension_of(F.col("v")).alias("dimension"))


def _styles(w: World):
    """Styles as people write them, from parts, by either filter."""
    size, tone = F.col("p_size").cast("string"), F.concat(F.lit("#"), F.substr(F.md5("p_name"), F.lit(1), F.lit(3)))
    kinds = ("color: {t}; display: 5ine", "background: url(/{t}.png)", "image-rendering: pixelated; width: {s}px", "background: linear-gradient(0deg, rgba({s}, 2, 3, 0.5))", "a: b; color: ex/**/pression({s})", "no declaration", "DISPLAY: Block; WIDTH: {s}%")
    made = F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % len(kinds) + 1).cast("int"))
    d = w.part.select(F.replace(F.replace(made, F.lit("{t}"), tone), F.lit("{s}"), size).alias("style")).distinct()
    d = d.select("style", F.explode(F.array(F.lit("wiki"), F.lit("html"))).alias("kind"))
    return d.select("style", "kind", scalar("taken_style")("style", "kind").alias("taken"))


def _lateral(w: World):
    register(w.document.sparkSession)
    return w.document.sparkSession.sql("SELECT m.id, o.number, o.level, o.title FROM {m} m, LATERAL outline(m.text) o", m=w.marked_text)


_COLOURS = ", ".join(f"'{c}'" for c in sorted(COLOURS))
_PAGES = lambda w: w.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))
_Q = {
    "parse_tokens": (lambda w: M.parse_tokens(w.marked_text), None),
    "token_headings": (lambda w: M.parse_tokens(w.marked_text).where("kind = 'heading'").groupBy("id").agg(F.count(F.lit(1)).alias("headings")), "SELECT id, count(*) AS headings FROM (SELECT id, unnest(string_split(text, chr(10))) AS l FROM {marked_text}) WHERE regexp_matches(l, '^={1,6} .* ={1,6}$') GROUP BY 1"),
    "scan_refs": (lambda w: M.scan_references(w.marked_text), "SELECT DISTINCT id, kind, target FROM (SELECT id, 'link' AS kind, CASE WHEN starts_with(x, '../') THEN 'Page/' || substr(x, 4) ELSE x END AS target FROM (SELECT id, split_part(unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]]*)\\]\\]', 1)), '|', 1) AS x FROM {marked_text}) WHERE NOT starts_with(x, '분류:') UNION ALL SELECT id, 'category', regexp_extract(text, '\\[\\[분류:([^\\[\\]]*)\\]\\]', 1) FROM {marked_text} UNION ALL SELECT id, 'include', '틀:Box' FROM {marked_text})"),
    "diagnose": (lambda w: M.diagnose(w.marked_text), None),
    "unknown_macros": (lambda w: M.diagnose(w.marked_text).where("code = 'unsupported-macro'").groupBy("detail").agg(F.count(F.lit(1)).alias("n")), "SELECT 'no' || lang AS detail, count(*) AS n FROM {documents} GROUP BY 1"),
    "render_html": (lambda w: N.html_of(_rendered(w)), None),
    "plain_text": (lambda w: M.plain_text(w.marked_text), None),
    "sanitize_pages": (lambda w: M.sanitize(_PAGES(w)), None),
    "render_json": (lambda w: M.render_json(w.marked_text), None),
    "expand_includes": (lambda w: M.expand_includes(w.marked_text, {"틀:Box": "{{{#!if a == '1'\nA=@a@ B=@b@ @c=none@ [include(틀:Box)]\n}}}"}), None),
    "condition_eval": (lambda w: M.conditions(w.document.select("id", F.concat(F.lit("top = name != null ? name : title; "), (F.col("id") % 3).cast("string"), F.lit(" == n")).alias("text")), {"n": 1, "title": "Page"}).select("id", "holds", F.array_join("names", ",").alias("names")), "SELECT id, id % 3 = 1 AS holds, CASE WHEN id % 3 = 1 THEN 'n=1,title=Page,top=Page' ELSE '' END AS names FROM {document}"),
    "render_ir": (lambda w: _rendered(w).select("id", "tree"), None),
    "render_ir_lookups": (lambda w: _rendered(w).select("id", F.array_join("categories", "|").alias("categories"), F.col("unknown").alias("missed")), "SELECT doc_id AS id, lang AS categories, CAST(0 AS BIGINT) AS missed FROM {documents}"),
    "references_asked": (lambda w: N.references_asked(_titled(w)), f"WITH t AS (SELECT x.doc_id AS id, x.lang, CASE WHEN ns.name = 'main' THEN d.title ELSE ns.name || ':' || d.title END AS title FROM {{documents}} x JOIN {{document}} d ON d.id = x.doc_id JOIN {{namespace}} ns ON ns.id = d.namespace_id) SELECT id, 'link' AS kind, 'Doc ' || CAST(7 * id % 100 AS VARCHAR) AS target FROM t WHERE title <> 'Doc ' || CAST(7 * id % 100 AS VARCHAR) UNION SELECT id, 'link', title || '/Sub ' || CAST(id % 5 AS VARCHAR) FROM t UNION SELECT id, 'include', '틀:Box' FROM t UNION SELECT id, 'category', lang FROM t"),
    "resolve_problems": (lambda w: N.problems(_titled(w)), "SELECT id, CAST(strpos(text, '[include(') - 1 AS INTEGER) AS start, 'include-target-missing' AS code, '틀:Box' AS detail FROM {marked_text} UNION ALL SELECT m.id, CAST(strpos(m.text, '[no' || d.lang || '(') - 1 AS INTEGER), 'unsupported-macro', 'no' || d.lang FROM {marked_text} m JOIN {documents} d ON d.doc_id = m.id"),
    "macro_report": (lambda w: N.macro_report(w.marked_text), "SELECT 'macro' AS what, 'no' || lang AS name, count(*) AS n FROM {documents} GROUP BY 2"),
    "plain_residue": (lambda w: N.plain_residue(w.marked_text), None),
    "residue_totals": (lambda w: N.residue_totals(w.marked_text), None),
    "outline_lateral": (_lateral, "SELECT id, CASE WHEN k = 1 THEN '1' ELSE '1.1' END AS number, CAST(length(regexp_extract(l, '^=+')) AS INTEGER) AS level, trim(l, '= ') AS title FROM (SELECT id, l, row_number() OVER (PARTITION BY id ORDER BY p) AS k FROM (SELECT id, unnest(range(0, len(ls))) AS p, unnest(ls) AS l FROM (SELECT id, string_split(text, chr(10)) AS ls FROM {marked_text})) WHERE regexp_matches(l, '^={1,6} .* ={1,6}$'))"),
    "value_parse": (_values, f"SELECT v, CASE WHEN regexp_matches(trim(v), '^#[0-9a-fA-F]\x02$') THEN '#' || repeat(lower(trim(v)[2]), 2) || repeat(lower(trim(v)[3]), 2) || repeat(lower(trim(v)[4]), 2) WHEN regexp_matches(trim(v), '^#[0-9a-fA-F]\x03$') THEN lower(trim(v)) WHEN lower(trim(v)) IN ({_COLOURS}, 'transparent') THEN trim(v) END AS colour, CASE WHEN regexp_matches(trim(v), '^[0-9]+%$') THEN CAST(CAST(replace(trim(v), '%', '') AS BIGINT) AS VARCHAR) || '%' WHEN regexp_matches(trim(v), '^[0-9]+(\\.[0-9]*)?px$') THEN CAST(CAST(regexp_extract(trim(v), '^[0-9]+') AS BIGINT) AS VARCHAR) || 'px' WHEN regexp_matches(trim(v), '^[0-9]+$') THEN CAST(CAST(trim(v) AS BIGINT) AS VARCHAR) || 'px' ELSE trim(v) END AS dimension FROM ({_VALUES.format(text='VARCHAR')} {{part}}) t"),
    "style_filters": (_styles, None),
    "html_fingerprint_diff": (lambda w: M.html_differences(_PAGES(w).select("id", F.col("text").alias("left"), F.replace(F.replace("text", F.lit("<h1>"), F.lit("<h2 id='x'>")), F.lit("</h1>"), F.lit("</h2>")).alias("right"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("left").alias("sample")), None),
    "diff_lines": (_diff, None),
    "diff_hunks": (lambda w: M.diff_hunks(P.previous_revisions(w), _PAIR), None),
    "merge_edits": (_merge, None),
}


def _query(build):
    return lambda spark, sf_dir: build(World(spark, sf_dir))


QUERIES = {name: (_query(build), ctes(sql.replace("{1,6}", "\0")).replace("\0", "{1,6}").replace("\x02", "{3}").replace("\x03", "{6}") if sql else None) for name, (build, sql) in _Q.items()}
