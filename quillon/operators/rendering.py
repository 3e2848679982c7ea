"""Pages rendered against the wiki. A page is rendered once, with what it asks about written down; the answers are joined to the rendered
rows and put into their trees. So titles that only come up while a page is rendered (built from a template's arguments, relative to
the page) are looked up like any others, and nothing is guessed beforehand.

Answers are looked up among the revisions of the documents that are asked about, and are put into the trees' JSON as text. If they are few
(ANSWER_BYTES), they go to every task and no tree is shuffled; else they are joined to the rows.

Templates are shared: the most used ones, up to SHARED_BYTES, go to every task as one dictionary, with what their fixed links refer to,
and leave no copy in any page's row. Only pages that include other templates are rendered a second time, with these joined to them.
Templates don't expand what they include in turn, so two rounds are all there can be.

Defined results: a null text is an empty page; a page may ask for nothing; repeated rows are rendered row by row; of templates of one name
the least text counts, null being empty; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import resolve as R
from ..functions.deep import from_json
from ..functions.emit import to_html
from ..functions.text import MARKERS, parse_title
from ..sources.storage import stored
from .markup import STEP, rows_of
from .pages import live

SHARED_BYTES = 32 << 20  # of templates that go to every task
ANSWER_BYTES = 8 << 20  # of answers that go to every task


def candidates(pages: DataFrame) -> DataFrame:
    """(id, kind, target) that pages(id, title, text) may ask about: links relative to their page, includes, files."""
    return rows_of(pages, ["text", "title"], M.references, "kind string, target string")


def meant(w, asked: DataFrame) -> DataFrame:
    """(kind, target, document_id) of asked(kind, target): the documents that links and images mean, whether they are live or not."""
    names = w.document.select(F.col("id").alias("document_id"), "namespace_id", "title").join(F.broadcast(w.namespace.select(F.col("id").alias("namespace_id"), F.col("name").alias("namespace"))), "namespace_id")
    links = asked.where("kind = 'link'").select("kind", "target", *parse_title(F.col("target")))
    images = asked.where("kind = 'image'").select("kind", "target", F.lit("file").alias("namespace"), F.col("target").alias("title"))
    return links.union(images).join(names, ["namespace", "title"]).select("kind", "target", "document_id")


def answered(w, documents: DataFrame) -> DataFrame:
    """(kind, target), each once, of meant() documents that are live; only their revisions are sorted by age."""
    alive = live(w.revision.join(documents.select("document_id").distinct(), "document_id", "left_semi")).select("document_id")
    return documents.join(alive, "document_id", "left_semi").select("kind", "target").distinct()


def file_url(name: str) -> str:
    """Where a file is served; a fixed form."""
    return f"/file/{name}"


def shared_templates(pages: DataFrame, templates: DataFrame, most: int) -> tuple[dict[str, str], DataFrame | None]:
    """Templates for every task, and the table of the others if there are any: all of them if they are small enough, else those of the
    highest classes of use that together are."""
    texts = templates.where("name is not null").groupBy("name").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    if (texts.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0) <= most:
        return {r.name: r.text for r in texts.collect()}, None
    uses = candidates(pages).where("kind = 'include'").groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    used = stored(texts.join(uses, "name").withColumn("class", F.floor(4 * F.log2("uses")).cast("int")))
    sizes = used.groupBy("class").agg(F.sum(F.octet_length("text") + F.octet_length("name")).alias("n")).collect()  # some hundred classes at most
    least = None
    for r in sorted(sizes, key=lambda r: -r["class"]):
        if r.n > most:
            break
        least, most = r["class"], most - r.n
    if least is None:
        return {}, used.select("name", "text")
    return {r.name: r.text for r in used.where(F.col("class") >= least).select("name", "text").collect()}, used.where(F.col("class") < least).select("name", "text")


FIRST = "id long, title string, text string, tree string, redirect string, categories array<string>, links array<string>, images array<string>, wanting array<string>, unknown long"
LIST = pa.list_(pa.string())


def _in_steps(batches: Iterator[pa.RecordBatch], columns: list[str], make, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """make(values) of each row as rows of batches that end after some text."""
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
    for batch in batches:
        out, size = [], 0
        for values in zip(*(batch.column(c) for c in columns), strict=True):
            out.append(make(*(v.as_py() for v in values)))
            size += sum(len(v) for v in out[-1] if isinstance(v, str))
            if size >= STEP:
                yield pack(out)
                out, size = [], 0
        yield pack(out)


def rendered(w, pages: DataFrame, templates: DataFrame, now: datetime | None = None, most: int = SHARED_BYTES, at_hand: int = ANSWER_BYTES) -> DataFrame:
    """id, tree (JSON of what is shown), redirect, categories, unknown (how many titles the page asked about that were not looked up)."""
    spark = pages.sparkSession
    pages = pages.select(F.col("id").cast("long").alias("id"), F.col("title").cast("string").alias("title"), F.col("text").cast("string").alias("text"))
    hot, others = shared_templates(pages, templates, most)
    fixed = {(k, t) for source in hot.values() for k, t in M.references(source) if k in ("link", "image") and t[:3] != "../" and t[:1] != "/"}
    known = answered(w, meant(w, spark.createDataFrame(sorted(fixed), "kind string, target string"))).collect() if fixed else []
    shared = spark.sparkContext.broadcast((hot, fixed, frozenset(t for k, t in known if k == "link"), {t: file_url(t) for k, t in known if k == "image"}))
    complete = others is None

    def render(id_: int, title: str | None, text: str | None, own: list[dict] | None, last: bool, read: dict) -> tuple:
        given, asked, exists, files = shared.value
        mine = ChainMap({t["name"]: t["text"] for t in own}, given) if own else given
        tree, r = R.resolve(text or "", R.Context(exists, mine, files, title or "", now, read))
        wanting = [] if last else sorted(t for t in r.asked["include"] if t not in mine)
        left = [sorted(t for t in r.asked[k] if (k, t) not in asked) for k in ("link", "image")]
        return id_, title, text if wanting else None, R.to_json(tree), tree["redirect"], tree["categories"], *left, wanting, 0

    names = [c.split(" ")[0] for c in FIRST.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, *[LIST] * 4, pa.int64()]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict = {}
        yield from _in_steps(batches, ["id", "title", "text"], lambda *v: render(*v, None, complete, read), names, kinds)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict = {}
        yield from _in_steps(batches, ["id", "title", "text", "own"], lambda *v: render(*v, True, read), names, kinds)

    rows = stored(pages.mapInArrow(once, FIRST).withColumn("row", F.monotonically_increasing_id()))
    if not complete:
        more = rows.where(F.size("wanting") > 0)
        own = more.select("row", F.explode("wanting").alias("name")).join(others, "name").groupBy("row").agg(F.collect_list(F.struct("name", "text")).alias("own"))
        second = more.select("row", "id", "title", "text").join(own, "row").select("id", "title", "text", "own").mapInArrow(again, FIRST)
        settled = rows.join(own.select("row"), "row", "left_anti").drop("row")
        rows = stored(settled.unionByName(second).withColumn("row", F.monotonically_increasing_id()))
    of_kind = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target"))
    every = F.concat(F.transform("links", of_kind("link")), F.transform("images", of_kind("image")))
    asked = rows.select("row", F.explode(every).alias("a")).select("row", "a.*")
    documents = stored(meant(w, asked.select("kind", "target").distinct()))
    answers = answered(w, documents)
    out = "id long, tree string, redirect string, categories array<string>, unknown long"
    columns, kinds_out = [c.split(" ")[0] for c in out.split(", ")], [pa.int64(), pa.string(), pa.string(), LIST, pa.int64()]

    def settle(batches: Iterator[pa.RecordBatch], told, *given: str) -> Iterator[pa.RecordBatch]:
        def make(id_: int, tree: str, redirect: str | None, categories: list[str], unknown: int, *about) -> tuple:
            links, images = told(*about)
            return id_, R.answered_in(tree, links, {t: file_url(t) for t in images}), redirect, categories, unknown

        yield from _in_steps(batches, [*columns, *given], make, columns, kinds_out)

    if (documents.agg(F.sum(F.octet_length("target") + 64)).first()[0] or 0) <= at_hand:  # the trees stay where they are
        found = answers.collect()
        there = spark.sparkContext.broadcast(tuple(frozenset(r.target for r in found if r.kind == kind) for kind in ("link", "image")))
        among = lambda *asked_for: [[t for t in titles or () if t in known] for titles, known in zip(asked_for, there.value, strict=True)]
        return rows.select(*columns, "links", "images").mapInArrow(lambda batches: settle(batches, among, "links", "images"), out)
    told = asked.join(answers, ["kind", "target"]).groupBy("row").agg(F.collect_list(F.struct("kind", "target")).alias("told"))
    of_row = lambda told: [[t["target"] for t in told or () if t["kind"] == kind] for kind in ("link", "image")]
    return rows.join(told, "row", "left").select(*columns, "told").mapInArrow(lambda batches: settle(batches, of_row, "told"), out)


def html_of(trees: DataFrame) -> DataFrame:
    """id and html of rendered(id, tree)."""
    return rows_of(trees, ["tree"], lambda tree: [(to_html(from_json(tree)),)], "html string")


def references_asked(pages: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(id, kind, target) that pages(id, title, text) ask for when they are rendered."""
    return rows_of(pages, ["text", "title"], lambda text, title: R.references(text, R.Context(title=title)), "kind string, target string")


def problems(pages: DataFrame) -> DataFrame:
    """(id, start, code, detail) of what can't be resolved in pages(id, title, text)."""

    def find(text: str, title: str) -> list[tuple]:
        _, r = R.resolve(text, R.Context(title=title))
        return sorted(r.problems)

    return rows_of(pages, ["text", "title"], find, "start int, code string, detail string")


def macro_report(pages: DataFrame) -> DataFrame:
    """what, name, n: unknown macros and ignored options of images over pages(id, text), the most frequent first."""
    options = ("width", "height", "align", "bgcolor", "theme")

    def find(text: str) -> list[tuple]:
        out = []
        for n, _ in M.walk(M.parse(text)):
            if n.kind == "macro" and n.value.lower() not in M.MACROS:
                out.append(("macro", n.value))
            elif n.kind == "image" and n.children:
                out += [("image option", k) for k in (p.partition("=")[0].strip() for p in n.children[0].value.split("&")) if k and k not in options]
        return out

    d = rows_of(pages, ["text"], find, "what string, name string")
    return d.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "what", "name")


def plain_residue(pages: DataFrame) -> DataFrame:
    """id and how many of each marker are left in the plain text of pages(id, text)."""
    return rows_of(pages, ["text"], lambda text: [_counts(text)], ", ".join(f"{n} long" for n, _ in MARKERS))


def _counts(text: str) -> tuple[int, ...]:
    leaves = [n.value for n, _ in M.walk(M.parse(text)) if n.kind == "text"]
    return tuple(sum(leaf.count(m) for leaf in leaves) for _, m in MARKERS)


def residue_totals(pages: DataFrame) -> DataFrame:
    """marker, n, pages: what is left in all plain texts, and in how many pages."""
    d = plain_residue(pages)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("marker"), F.col(n).alias("n")) for n, _ in MARKERS]))
    return d.select(each.alias("m")).groupBy("m.marker").agg(F.sum("m.n").alias("n"), F.count_if(F.col("m.n") > 0).alias("pages"))

