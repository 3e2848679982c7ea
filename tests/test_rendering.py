"""Pages against the wiki: answers come for whatever a page asks while it is rendered."""

import json
from types import SimpleNamespace

import pytest

from quillon.functions import resolve as R
from quillon.operators import rendering as N

PAGES = "id long, title string, text string"
ALIVE = {"A", "B", "Sub/Deep", "C d"}


@pytest.fixture(scope="module")
def wiki(spark):
    frame = spark.createDataFrame
    documents = [(1, 0, "A"), (2, 0, "B"), (3, 0, "Sub/Deep"), (4, 0, "Gone"), (5, 3, "p.png"), (6, 3, "gone.png"), (7, 0, "C d")]
    revisions = [(i, i, 1, "delete" if title.lower().startswith("gone") else "create") for i, _, title in documents]
    return SimpleNamespace(
        document=frame(documents, "id long, namespace_id long, title string"), namespace=frame([(0, "main"), (1, "template"), (3, "file")], "id long, name string"),
        revision=frame(revisions, "id long, document_id long, sequence long, kind string"),
    )


def found(tree):
    """Links with their state, and images with their url."""
    out, todo = [], [json.loads(tree)]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if x.get("type") == "documentLink":
                out.append((x["title"], x["kind"]))
            elif x.get("type") == "image":
                out.append((x["fileName"], x["url"]))
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(out, key=str)


TEMPLATES = [("Arg", "[[@a@]] [[B]] [[Gone]] [[/Deep]] [[파일:@f=p.png@]]"), ("Arg", "zz"), ("Nest", "[include(Arg, a=A)] [[A]]"), ("Null", None), (None, "x"), ("Big", "[[A]] " * 40)]
TEXTS = [
    (1, "Sub", "[include(Arg, a=A)] [[Gone]]", [("A", "existing"), ("B", "existing"), ("Gone", "missing"), ("Gone", "missing"), ("Sub/Deep", "existing"), ("p.png", "/file/p.png")]),
    (2, "Other", "[include(Arg, a=C d, f=gone.png)]", [("B", "existing"), ("C d", "existing"), ("Gone", "missing"), ("Other/Deep", "missing"), ("gone.png", None)]),
    (3, "T", "[[파일:p.png]] [[파일:none.png]] [[A]] [[A]] [[T]]", [("A", "existing"), ("A", "existing"), ("T", "current"), ("none.png", None), ("p.png", "/file/p.png")]),
    (4, "T", "[include(Nest)] [include(Null)] [include(Nowhere)]", [("A", "existing")]), (5, None, None, []), (6, "x", "", []), (6, "x", "[[A]]", [("A", "existing")]), (6, "x", "[[A]]", [("A", "existing")]), (None, "x", "[[B]]", [("B", "existing")]),
    (7, "x", "[include(Big)]", [("A", "existing")] * 40),
]


@pytest.mark.parametrize("most", [1 << 20, 150, 60, 0])
def test_everything_asked_is_answered(spark, wiki, most):
    pages = spark.createDataFrame([t[:3] for t in TEXTS], PAGES)
    templates = spark.createDataFrame(TEMPLATES, "name string, text string")
    got = [(r.id, found(r.tree), r.unknown) for r in N.rendered(wiki, pages, templates, most=most).collect()]
    assert sorted(map(str, got)) == sorted(str((i, sorted(want, key=str), 0)) for i, _, _, want in TEXTS)


def test_trees_equal_those_that_know_everything(spark, wiki):
    pages = spark.createDataFrame([t[:3] for t in TEXTS], PAGES)
    templates = {"Arg": TEMPLATES[0][1], "Nest": TEMPLATES[2][1], "Null": "", "Big": TEMPLATES[5][1]}
    want = sorted(json.dumps(R.resolve(text or "", R.Context(frozenset(ALIVE), templates, {"p.png": "/file/p.png"}, title or ""))[0], sort_keys=True) for _, title, text, _ in TEXTS)
    for most in (1 << 20, 0):
        rows = N.rendered(wiki, pages, spark.createDataFrame(TEMPLATES, "name string, text string"), most=most).collect()
        assert sorted(json.dumps(json.loads(r.tree), sort_keys=True) for r in rows) == want


def test_a_template_of_all_pages_leaves_no_copy(spark, wiki):
    """Neither its text nor its links are in any row that is shuffled or stored."""
    seen = []
    plain, N.stored = N.stored, lambda d: seen.append(plain(d)) or seen[-1]
    try:
        pages = spark.createDataFrame([(i, f"P{i}", "[include(Big)] [[C d]]") for i in range(50)], PAGES)
        assert all(len(found(r.tree)) == 41 for r in N.rendered(wiki, pages, spark.createDataFrame(TEMPLATES, "name string, text string")).collect())
    finally:
        N.stored = plain
    first = seen[0].collect()
    assert all(r.links == ["C d"] and r.text is None and not r.wanting for r in first) and len(seen) == 2


def test_no_pages(spark, wiki):
    assert N.rendered(wiki, spark.createDataFrame([], PAGES), spark.createDataFrame([], "name string, text string")).collect() == []


def test_few_answers_move_no_tree(spark, wiki):
    """Few answers go to every task, and many are joined: the rows are the same, but only the latter are shuffled."""
    pages = spark.createDataFrame([t[:3] for t in TEXTS], PAGES)
    few, many = (N.rendered(wiki, pages, spark.createDataFrame(TEMPLATES, "name string, text string"), **k) for k in ({}, {"at_hand": 0}))
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (few, many)]
    assert "Join" not in plans[0] and "Join" in plans[1]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_answers_in_the_text_of_a_tree():
    """Only what a node has asked is answered, whatever is written elsewhere."""
    odd = ['q"t', "b\\s", '"kind": "missing"', "줄", '"type": "image", "fileName": "p.png", "url": null', "x#y"]
    source = "== [[A]] ==\n" + "\n".join(f"[[{t}]] [[B|{t} [[{t}]]]] {t} [[{t}#a\"b]] [[파일:{t}]] {{{{{{{t}}}}}}}" for t in odd) + "\n[[파일:p.png]] [* [[A]] [[파일:p.png]]]"
    tree, r = R.resolve(source, R.Context(title="T"))
    assert R.answered_in(R.to_json(tree), [], {}) == R.to_json(tree)
    links, images = r.asked["link"] - {"B"}, {n: f'/"{n}' for n in r.asked["image"] if n != "줄"}
    want, _ = R.resolve(source, R.Context(frozenset(links), {}, images, "T"))
    assert len(links) > 4 and len(images) > 4 and R.answered_in(R.to_json(tree), links, images) == R.to_json(want)
