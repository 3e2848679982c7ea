"""Pages that are rendered whole however deep their parts lie within each other, and however many rows a row of a table holds."""

import json

import pytest

from quillon.functions import deep
from quillon.functions import markup as M
from quillon.functions.condition import evaluate
from quillon.functions.deep import from_json, to_json
from quillon.functions.emit import to_html
from quillon.functions.resolve import Context, resolve
from quillon.operators import markup as O
from quillon.operators import rendering as N
from test_rendering import PAGES, wiki  # noqa: F401

DEEP = 6_000


def blocks(source):
    return resolve(source, Context())[0]["blocks"]


def nested_rows(n):
    return "||a||{{{#!wiki\n" + "||x||\n" * n + "}}}||\n||b||"


@pytest.mark.parametrize("n", [8, 9, 10, 300])
def test_a_row_holds_any_number_of_rows(n):
    """The end of a row is looked for past all ends that its groups hide."""
    (outer,) = blocks(nested_rows(n))
    cells = outer["table"]["rows"][0]["cells"]
    assert len(outer["table"]["rows"]) == 2 and len(cells) == 2 and len(cells[1]["blocks"][0]["content"][0]["blocks"][0]["table"]["rows"]) == n
    assert [b["type"] for b in blocks("||{{{" + "x||\n" * n + "}}}||")] == ["table"] and [b["type"] for b in blocks("||" + "x\\||\n" * n + "||")] == ["table"]
    assert [b["type"] for b in blocks("||x\\||\n" * n)] == ["paragraph"]


def test_links_hide_what_follows_them_alone():
    """A link that is closed on a later line is no link for a row that ends before."""
    kinds = lambda s: [b["type"] for b in blocks(s)]
    assert kinds("||[[a||\nb]] ||") == ["table", "paragraph"] and kinds("||[[a|| c\nb]] ||") == ["table"] and kinds("||[[a {{{ || \n ]] }}} b\n||") == ["table"]


def test_many_rows_that_never_end_are_passed_over():
    """Rows are looked for once from each place: 20,000 lines that begin one take no time worth naming."""
    for line in ("||x\\||\n", "||[[x\\||]]\n", "||{{{x||}}}\n"):
        assert [b["type"] for b in blocks(line * 20_000)] == ["paragraph"]


@pytest.mark.parametrize(
    ("source", "kind"),
    [
        (">" * DEEP + "x", "quote"), ("> " * DEEP + "x", "indent"), (" " * DEEP + "x", "indent"), (" * " * DEEP + "x", "list"), ("[* " * DEEP + "x" + "]" * DEEP, "footnoteReference"), ("[[a|" * DEEP + "x" + "]]" * DEEP, "documentLink"),
        ("{{{+1 " * DEEP + "x" + "}}}" * DEEP, "sized"), ("{{{#red " * DEEP + "x" + "}}}" * DEEP, "colored"), ("{{{#!wiki\n" * DEEP + "x" + "}}}" * DEEP, "wikiStyle"), ("{{{#!folding s\n" * DEEP + "x" + "\n}}}" * DEEP, "folding"),
        ("||{{{#!wiki\n" * DEEP + "x" + "\n}}}||" * DEEP, "table"),
    ],
    ids=lambda v: v if len(v) < 20 else "",
)
def test_pages_of_any_depth(source, kind):
    shown = to_json(resolve(source, Context())[0])
    assert shown.count(f'"type": "{kind}"') == DEEP and shown.count('"text": "x"') == 1
    assert to_json(from_json(shown)) == shown and "x" in to_html(from_json(shown))


def test_deep_trees_give_back_the_source():
    for source in (">" * 3_000 + "x", "{{{#!wiki\n" * 3_000 + "x" + "}}}" * 3_000, "||{{{#!wiki\n" * 1_000 + "x" + "\n}}}||" * 1_000):
        assert M.pieces(M.parse(source), source) == source and json.loads(M.tree_json(source[:300]))


def test_conditions_of_any_depth():
    for n in (10, 5_000):
        assert evaluate("(" * n + "a" + ")" * n, {"a": 1}) == {"a": 1} and evaluate("!" * (2 * n) + "a", {"a": 1}) == {"a": 1} and evaluate("!" * (2 * n + 1) + "a", {"a": 1}) is None


def test_deep_json_is_that_of_the_library():
    """Where the library's functions give up, trees are written and read in the same form."""
    value = {"a": [1, -2.5, None, True, False, "q\"\\ {[,:]} 줄\n", [], {}, [[]], {"": {}}], "b c": {"x": [{"y": "]"}]}}
    assert deep._written(value) == to_json(value) == json.dumps(value, ensure_ascii=False) and deep._read(to_json(value)) == value
    assert deep._read(" 3 ") == 3 and deep._read('"a"') == "a" and deep._written([]) == "[]"
    nest = None
    for _ in range(50_000):
        nest = {"k": [nest]}
    text = to_json(nest)
    assert text == '{"k": [' * 50_000 + "null" + "]}" * 50_000 and to_json(from_json(text)) == text


@pytest.mark.parametrize("at_hand", [N.ANSWER_BYTES, 0])
def test_rendered_whole(spark, wiki, at_hand):  # noqa: F811
    """Answers reach the innermost link of a page, and the rows in a row, in tasks as well; trees become HTML."""
    texts = [nested_rows(40).replace("b||", "[[A]]||"), "{{{#!wiki\n" * DEEP + "[[A]] [[Gone]]" + "}}}" * DEEP, "[include(Deep)]"]
    templates = spark.createDataFrame([("Deep", ">" * 2_000 + "[[A]]")], "name string, text string")
    trees = N.rendered(wiki, spark.createDataFrame([(i, f"P{i}", t) for i, t in enumerate(texts)], PAGES), templates, at_hand=at_hand).select("id", "tree")
    got = {r.id: r.tree for r in trees.collect()}
    assert [got[i].count(f'"type": "{k}"') for i, k in enumerate(("table", "wikiStyle", "quote"))] == [2, DEEP, 2_000]
    assert [(got[i].count('"kind": "existing"'), got[i].count('"kind": "missing"')) for i in range(3)] == [(1, 0), (1, 1), (1, 0)]
    assert sorted((r.id, r.html.count("wiki-link-internal")) for r in N.html_of(trees).collect()) == [(0, 1), (1, 2), (2, 1)]


def test_tokens_of_deep_pages_come_in_parts(spark):
    """Texts of all nodes are as long as the source times its depth; they are not held together."""
    d = spark.createDataFrame([(1, ">" * 3_000 + "x")], "id long, text string").coalesce(1)
    rows = O.parse_tokens(d).selectExpr("count(*) AS n", "count_if(kind = 'quote') AS quotes", "sum(length(text)) AS length").first()
    assert (rows.n, rows.quotes, rows.length) == (3_003, 3_000, 3_001 + sum(range(2, 3_002)) + 2)
