"""What pages resolve to, case by case, and values inside markup."""

from datetime import date, datetime, timedelta

import pytest

from quillon.functions import markup as M
from quillon.functions.emit import render_html
from quillon.functions import values as V
from quillon.functions.registered import contains
from quillon.functions.resolve import Context, day_number, lax_date, resolve, split_anchor, to_json, unescaped

CONTEXT = Context(frozenset({"문서", "알파위키"}), {"틀:T": "<@a@|@b=d@>[include(틀:T)]", "틀:A": "[[#here]] [[분류:Inner]] [nope]", "틀:If": "{{{#!if top = a != null ? a : calleeTitle\n@top@}}}"}, {"e.png": "/file/e.png"}, "부모/자식", datetime(2026, 7, 17, 12))


def tree(source, context=CONTEXT):
    return resolve(source, context)[0]


def shape(blocks):
    """Types alone, of blocks and what they hold."""
    return [(b["type"], shape(b["blocks"])) if "blocks" in b else (b["type"], [shape(i["blocks"]) for i in b["items"]]) if b["type"] == "list" else b["type"] for b in blocks]


def content(source):
    (p,) = tree(source)["blocks"]
    return p["content"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("=공백없음=", ["paragraph"]), ("==# x #==", ["heading"]), ("----", ["horizontalRule"]), ("---", ["paragraph"]), ("바람이 분다\n물이 흐른다\n\n밤이 온다", ["paragraph"]),
        (" * 항목\n\n문단", [("list", [["paragraph"]]), "paragraph"]), (" 1. 하나\n 2. 둘", [("list", [["paragraph"]])]), (" 1. a\n a. b", [("list", [["paragraph"]]), ("list", [["paragraph"]])]),
        (" * a\n  * b\n * c", [("list", [["paragraph", ("list", [["paragraph"]])], ["paragraph"]])]), ("> x", [("quote", [("indent", ["paragraph"])])]), (">x", [("quote", ["paragraph"])]), ("> a\n>> b", [("quote", [("indent", ["paragraph"]), ("quote", [("indent", ["paragraph"])])])]),
        ("a\n## c\nb", ["paragraph"]), ("||a\nb||\n## c\n||d||", ["table"]), ("||open\nnever", ["paragraph"]), ("#redirect X", []), ("  deep", [("indent", [("indent", ["paragraph"])])]),
    ],
)
def test_blocks(source, want):
    assert shape(tree(source)["blocks"]) == want
    assert M.pieces(M.parse(source), source) == source


def test_paragraphs():
    kinds = lambda s: [x["type"] for x in content(s)]
    assert kinds("바람이 분다\n물이 흐른다\n\n밤이 온다") == ["text", "lineBreak", "text", "lineBreak", "lineBreak", "text"]
    assert [x["text"] for x in content("a\n## c\nb") if x["type"] == "text"] == ["a", "b"]
    t = tree("[[분류:X]]\n[include(틀:T)]\n[목차]\n[clearfix]")
    assert t["categories"] == ["X"] and [x["type"] for x in t["blocks"][-1]["content"]] == ["tableOfContents", "lineBreak", "clearFix"]
    assert [b["content"] for b in tree("내용.\n\n== 다음 ==")["blocks"]][0][1:] == [{"type": "lineBreak"}]


def test_styles_nest_and_stay_closed():
    assert content("'''a ''b'' a'''") == [{"type": "styled", "style": "bold", "content": [{"type": "text", "text": "a "}, {"type": "styled", "style": "italic", "content": [{"type": "text", "text": "b"}]}, {"type": "text", "text": " a"}]}]
    assert content("'''open") == [{"type": "text", "text": "'''open"}] and content("{{{#212529}}}") == [{"type": "literal", "text": "#212529"}]
    assert content("{{{#red,#FFF x}}}")[0]["color"] == {"light": "red", "dark": "#ffffff"} and content("{{{+2 x}}}")[0]["level"] == 2


def test_footnotes():
    t = tree("[* a][*A b][*A]")
    assert [(f["label"], f["referenceNumbers"]) for f in t["footnotes"]] == [("1", [1]), ("A", [2, 3])]
    t = tree("[*A x]\n[각주]\n[*A y]\n[각주]")
    assert [(f["label"], f["referenceNumbers"]) for f in t["footnotes"]] == [("A", [1]), ("A", [2])]
    assert [x["notes"] for x in t["blocks"][0]["content"] if x["type"] == "footnoteSection"] == [[0], [1]]


def test_headings():
    assert [h["number"] for h in tree("== 1 ==\n=== 1-1 ===\n== 2 ==")["blocks"]] == ["1", "1.1", "2"]
    t = tree("== a --b-- [anchor(z)] ==\n==== b ====")
    assert [e["number"] for e in t["tableOfContents"]] == ["1", "1.1"] and [x["type"] for x in t["tableOfContents"][0]["title"]] == ["text", "text", "text"]


def test_includes():
    assert ["".join(x["text"] for x in b["content"]) for b in tree("[include(틀:T, a=1)]")["blocks"]] == ["<1|d>"]
    t, r = resolve("[include(틀:A)][include(틀:A)]\n[include(틀:없음)] [nope]", CONTEXT)
    anchors = [x["anchor"] for b in t["blocks"] for x in b["content"] if x["type"] == "documentLink"]
    assert anchors == ["i1-here", "i2-here"] and t["categories"] == ["Inner"] and r.asked["include"] == {"틀:A", "틀:없음"}
    assert [p[1:] for p in r.problems] == [("include-target-missing", "틀:없음"), ("unsupported-macro", "nope")]
    assert "부모/자식" in to_json(tree("[include(틀:If)]")) and '"text": "7"' in to_json(tree("[include(틀:If, a=7)]"))


def test_links_and_images():
    links = [(x["title"], x["anchor"], x["kind"]) for x in content("[[/하위]][[../]][[../형제]][[문서:/절대]][[문서#a]][[알파위키|x]][[부모/자식]][[#s]]")]
    assert links == [("부모/자식/하위", None, "missing"), ("부모", None, "missing"), ("부모/형제", None, "missing"), ("/절대", None, "missing"), ("문서", "a", "existing"), ("알파위키", None, "existing"), ("부모/자식", None, "current"), ("", "s", "existing")]
    assert content("[[HTTP://x.y|z]]")[0]["type"] == "externalLink" and split_anchor("http://a#b") == ("http://a#b", None)
    assert split_anchor("a#b#c") == ("a#b", "c") and split_anchor(r"a\#b") == (r"a\#b", None) and split_anchor("##") == ("#", None) and unescaped(r"\|a\\") == "|a\\"
    (image,) = content("[[파일:e.png|width=21.6&height=5em&align=left&bgcolor=#FFF&theme=dark&other=1]]")
    assert image == {"type": "image", "fileName": "e.png", "url": "/file/e.png", "layout": {"width": "21px", "height": "5em", "align": "left", "backgroundColor": "#ffffff", "theme": "dark"}}


def test_tables():
    (t,) = tree("|cap|<colbgcolor=red><rowbgcolor=#12><-2> a ||<|2>b||\n||c||<bgcolor=blue>d||\n||e||f||<tablewidth=33.3>||g||")["blocks"]
    rows = t["table"]["rows"]
    assert t["table"]["caption"] == [{"type": "text", "text": "cap"}] and rows[0]["cells"][0]["columnSpan"] == 2 and rows[0]["cells"][0]["horizontalAlignment"] == "center" and rows[0]["cells"][1]["rowSpan"] == 2
    shades = [[a["property"].get("color") for a in c["attributes"]] for r in rows for c in r["cells"]]
    assert shades == [["red"], [], ["red"], ["blue"], ["red"], ["red"], [None], []]


def test_macros():
    assert [x.get("text") or x["type"] for x in content("[dday(2026-07-18)]\n[dday(2026-07-16)]\n[dday(2026-07-17)]\n[age(2000-07-18)]\n[age(2000-07-17)]\n[DATE]") if x["type"] != "lineBreak"] == ["D-1", "D+1", "D-Day", "25", "26", "2026-07-17 12:00:00"]
    assert content("[youtube(id, width=3, height=4)]")[0] == {"type": "video", "provider": "youtube", "identifier": "id", "width": "3", "height": "4"}
    assert content("[ruby(a, ruby=b, color=RED)]")[0] == {"type": "ruby", "content": "a", "ruby": "b", "color": "RED"}
    assert {x["type"] for s in ("[youtube]", "[math]", "[anchor]", "[age(x)]", "[dday(2023-13-01)]", "[ruby(a)]", "[nope(1)]") for x in content(s)} == {"unresolved"}
    assert lax_date("2023-02-31") == (2023, 2, 31) and lax_date("2023-1") is None and day_number(2023, 2, 31) - day_number(2023, 2, 28) == 3
    start = date(1, 3, 1)
    assert all(day_number(d.year, d.month, d.day) - day_number(1, 3, 1) == n for n in range(0, 900_000, 977) for d in [start + timedelta(n)])


def test_deep_pages():
    for source in (">" * 300 + "x", "".join(" " * k + "* a\n" for k in range(1, 200)), "{{{#!wiki\n" * 150 + "x" + "}}}" * 150):
        assert to_json(tree(source)) and render_html(source)


def test_values():
    assert [V.colour(c) for c in ("#fff", " #FFAA00 ", "red", "Transparent", "#ffff", "nope", "")] == ["#ffffff", "#ffaa00", "red", "Transparent", None, None, None]
    assert [V.dimension(d) for d in ("50%", "21.6px", "1000", "33.3", "1em", "")] == ["50%", "21px", "1000px", "33.3", "1em", ""] and V.dimension("21.6", image=True) == "21px"
    assert V.wiki_style("display: 5ine; color: red; image-rendering: x; a: f(g(1)); b: (g(1))") == [("color", "red")]
    assert V.html_style("color: red; background: ur/**/l(x)") is None and V.html_style("image-rendering: pixelated") == [("image-rendering", "pixelated")]
    assert V.decoded("&lt;&#65;&#x42&nbsp;&copy;&amp") == "<AB &copy;&" and V.strictly_decoded("&lt;&nbsp;&lt &#39;&copy;") == "< &lt '&copy;"
    assert V.normal_style("Color: RGB(255, 0, 0); border: 2px  solid #FFF;x") == "border:2px solid #ffffff;color:#ff0000"
    assert contains("2001:db8::/32", "2001:db8:1::5") and not contains("10.0.0.0/8", "::1") and not contains("nonsense", "1.2.3.4") and contains("1.2.3.4", "1.2.3.4") and not contains("10.0.0.0/8", None)


def words(source):
    """Paragraphs and cells as text, other things by their type: enough to tell trees apart."""

    def inline(x):
        return x["text"] if x["type"] == "text" else "/" if x["type"] == "lineBreak" else (x["type"], x.get("style"), [inline(y) for y in x["content"]]) if x["type"] in ("styled", "colored", "sized") else (x["type"], block(x["blocks"])) if "blocks" in x else x["type"]

    def block(blocks):
        out = []
        for b in blocks:
            if b["type"] == "table":
                out.append([[block(c["blocks"]) for c in r["cells"]] for r in b["table"]["rows"]])
            elif b["type"] == "list":
                out.append((b["kind"], [(i["startNumber"], block(i["blocks"])) for i in b["items"]]))
            else:
                out.append((b["type"], block(b["blocks"])) if "blocks" in b else [inline(x) for x in b.get("content", [])])
        return out

    return block(tree(source)["blocks"])


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("'''far ''near''' near''", [[("styled", "bold", ["far ''near"]), " near''"]]), ("''''''", [["''''''"]]), ("--one~~", [["--one~~"]]), ("'''two\nlines'''", [[("styled", "bold", ["two", "/", "lines"])]]),
        ("text }}}", [["text }}}"]]), ("text ]]", [["text ]]"]]), ("[[open", [["[[open"]]), ("[* open", [["[* open"]]), ("{{{#!wiki style=\"open", [["{{{#!wiki style=\"open"]]),
        (">>>", [("quote", [("quote", [("quote", [[]])])])]), (">a[br]b", [("quote", [["a", "/", "b"]])]), (">* a", [("quote", [["* a"]])]), ("> * a", [("quote", [("unordered", [(None, [["a"]])])])]), (">a\n>>b", [("quote", [["a"], ("quote", [["b"]])])]),
        (" one\n  two", [("indent", [["one"], ("indent", [["two"]])])]), (" ## no comment", [("indent", [["## no comment"]])]), ("##@ pinned\ntext", [["text"]]),
        (" I.#11 x", [("upperRoman", [(11, [["x"]])])]), (" a. x\n a. y", [("lowerAlphabet", [(None, [["x"]]), (None, [["y"]])])]),
        ("|| == head == ||", [[[[["head"]]]]]), ("||<-1>\n * item\n||", [[[[[], ("unordered", [(None, [["item"]])])]]]]), ("||<odd=1> cell ||", [[[[["<odd=1> cell"]]]]]), ("|| [* open ||", [[[[["[* open"]]]]]), ("|| a || b", [["|| a || b"]]), ("> || a ||", [("quote", [("indent", [[[[["a"]]]]])])]),
        ("{{{\ncode '''as is'''\n}}}", [["codeBlock"]]), ("{{{#!folding\nx\n}}}", [[("folding", [["x"]])]]), ("{{{#!wiki style=\"color:red\" x}}}", [[("wikiStyle", [["x"]])]]), ("{{{#!wiki style='color: red'\nx\n}}}", [[("wikiStyle", [["x"]])]]), ("{{{{{{}}}}}}", [["literal"]]), ("{{{#!if null\nx}}}", []), ("{{{#!if 1\nx}}}", [["x"]]),
        ("\\|| no table \\||", [["|| no table ||"]]), ("---- x", [["---- x"]]), ("before\n#redirect X", [["before"]]), ("before\n\nafter", [["before", "/", "/", "after"]]),
    ],
)
def test_trees(source, want):
    assert words(source) == want
    assert M.pieces(M.parse(source), source) == source


def test_details_of_trees():
    cell = lambda s: tree(s)["blocks"][0]["table"]["rows"][0]["cells"][0]
    assert cell("||<colbgcolor=#FF0000> x ||")["attributes"] == [{"scope": {"type": "column", "columns": 1}, "property": {"type": "backgroundColor", "color": "#ff0000"}}]
    assert cell("||<#f00> x ||")["attributes"][0]["scope"] == {"type": "cell"} and cell("||<bgcolor=#fff,#000> x ||")["attributes"][0]["property"]["color"] == "#ffffff"
    assert [cell(s)["horizontalAlignment"] for s in ("|| x ||", "|| x||", "||x ||", "||x||", "||<)> x ||")] == ["center", "right", "left", None, "right"]
    assert (cell("||<^|1> x ||")["rowSpan"], cell("||<^|1> x ||")["verticalAlignment"], cell("||<v|2>x||")["verticalAlignment"]) == (1, "top", "bottom")
    assert tree("[[분류:Kinds#blur]][[분류:More|key]]")["categories"] == ["Kinds#blur", "More"] and tree("#넘겨주기 Far away#s-1")["redirect"] == "Far away#s-1"
    assert tree("== One --two-- ==")["blocks"][0]["anchor"] == "One two" and content("{{{#!syntax lua\nprint(1 < 2)\n}}}")[0]["source"] == "print(1 < 2)"
    links = [(x["title"], x["anchor"], x["kind"], x["display"][0]["text"]) for x in content("[[#part]][[##]][[|shown]][[\\#1]][[a\\|b]][[ 파일:x]]")]
    assert links == [("", "part", "existing", "#part"), ("#", None, "missing", "#"), ("", None, "current", "shown"), ("#1", None, "missing", "#1"), ("a|b", None, "missing", "a|b"), (" 파일:x", None, "missing", " 파일:x")]
    nested = tree("[* outer [* inner]]\n[각주]")
    assert [(f["label"], f["referenceNumbers"]) for f in nested["footnotes"]] == [("1", [1]), ("2", [2])] and nested["footnotes"][0]["content"] == [{"type": "text", "text": "inner"}]


def test_a_template_is_read_once(monkeypatch):
    """Contexts of a task share what was read; long templates are read anew, so that what is kept is bounded."""
    seen, plain = [], M.parse
    monkeypatch.setattr(M, "parse", lambda source: seen.append(source) or plain(source))
    templates, read = {"T": "{{{#!if a == '1'\nx @a@\n}}} [[@a@]]", "Long": "y" * 5_000}, {}
    pages = [f"[include(T, a={i % 3})] [include(T, a=1)] [include(Long)]" for i in range(20)]
    got = [resolve(p, Context(templates=templates, read=read))[0] for p in pages]
    assert seen.count(templates["T"]) == 1 and seen.count(templates["Long"]) == 20 and len(read) == 1
    assert got == [resolve(p, Context(templates=templates))[0] for p in pages]


def test_plain_text_is_passed_over():
    """Blanks and lines are no marks to be listed: a footnote's name and a link's bar are looked for inside of them only."""
    reader = M.Reader("[*n a note] [[A|b]]\n" + "many words | here\n" * 1_000)
    reader.document()
    assert not {" ", "|", "\n"} & set(reader.places)
