import difflib
import random

from quillon.functions import markup as M


def kinds(source):
    return [n.kind for n in M.parse(source).children]


def test_tree_gives_back_the_source():
    rng = random.Random(1)
    parts = ["'''", "''", "{{{", "}}}", "[[", "]]", "[*", "]", "||", "= ", " =", "\n", "> ", " * ", "#!wiki ", "@a@", "|", "\\", "##", "x y", "파일:", "[목차]", "--", "----", "__", "<-2>"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert M.pieces(M.parse(s), s) == s


def test_floods_end():
    for s in ("[[" * 2000, "{{{" * 2000, "'''" * 2001, "[*" * 3000, "||" * 3000, ">" * 3000, "{{{#!wiki \n" * 500, "@" * 4000, "]]" * 2000 + "[[" * 2000):
        assert M.pieces(M.parse(s), s) == s


def test_blocks():
    assert kinds("=no=") == ["paragraph"] and kinds("== h ==") == ["heading"] and M.parse("==# x #==").children[0].value == "2#"
    assert kinds("a\n\nb") == ["paragraph"] and kinds(" * a\n * b") == ["list"] and len(kinds(" 1. a\n a. b")) == 2
    assert kinds("----") == ["rule"] and kinds("---") == ["paragraph"] and kinds("> q\n>r") == ["quote"]
    assert kinds("#redirect X#y") == ["redirect"] and kinds("||a||b||") == ["table"] and kinds("##c") == ["comment"]
    assert kinds("x {{{#!wiki\n== in ==\n}}} y") == ["paragraph"]


def test_inline():
    p = M.parse("'''a ''b'' a'''").children[0].children
    assert [n.kind for n in p] == ["bold"] and [n.kind for n in p[0].children] == ["text", "italic", "text"]
    assert [n.kind for n in M.parse("'''open").children[0].children] == ["text"]
    assert M.parse("{{{#212529}}}").children[0].children[0].kind == "literal"
    assert M.plain_text(M.parse("a [[X|'''y''']] [[Z]] {{{code}}}")) == "a y Z "


def test_references_and_diagnostics():
    s = "[[/sub]] [[../]] [[../sib]] [[문서:/abs]] [[#a]] [[https://x.y]] [[@t@]] [include(틀:A, b=1)] [[파일:f.png|width=1]] [[분류:C]] [[:분류:D]]"
    got = M.references(s, "up/child")
    assert set(got) == {("link", "up/child/sub"), ("link", "up"), ("link", "up/sib"), ("link", "/abs"), ("include", "틀:A"), ("image", "f.png"), ("category", "C"), ("link", "분류:D")}
    codes = [c for _, c, _ in M.diagnostics("#redirect A\n#redirect B\n== a ==\n==== b ====\n[[분류:X]][[분류:X]][*n a][*n b][nope]")]
    assert codes == ["duplicate-redirect", "redirect-trailing-content", "heading-level-skip", "duplicate-category", "duplicate-footnote-definition", "unsupported-macro"]


def test_render():
    assert M.heading_numbers([2, 3, 2]) == ["1", "1.1", "2"] and M.heading_numbers([2, 4]) == ["1", "1.1"]
    assert M.sanitize("<script>x</script><b onclick=1>y<blink>z</blink><a href='javascript:1'>q") == "<b>yzq</b>"
    assert M.sanitize("<a href=HTTP://x.y class=c id=i style='color: red; x'>q</b></a></a>&lt;&copy;<br/><video src='ftp://v' controls width=3 onplay=x>") == '<a href="HTTP://x.y" class="c" style="color: red">q</a>&lt;&amp;copy;<br><video src="ftp://v" controls width="3"></video>'
    assert M.sanitize("a<iframe>b</IFRAME >c<p>d</p>1 < 2<b>") == "acd1 &lt; 2&lt;b&gt;" and M.sanitize("<span style='background:url(x)'>s") == "<span>s</span>"


def test_conditions():
    from quillon.functions.condition import evaluate

    assert evaluate("top = a != null ? a : b", {"b": "B"}) == {"b": "B", "top": "B"}
    assert evaluate("(x == null) == (y == null)", {}) is not None and evaluate("x == 'a' || y", {"x": "b"}) is None
    assert evaluate("s.length == 3 && s.startsWith('a') && s.indexOf('c') == 2 && s.substr(-2, 1) == 'b'", {"s": "abc"}) is not None
    assert evaluate("n?.length == null", {}) is not None and evaluate("1 + 2 == 3 & '1' + 2 == '12'", {}) is not None
    for broken in ("a ==", "(", "a.b()", "'open", "1 2", "a.length", "@"):
        assert evaluate(broken, {}) is None


def test_includes():
    t = {"틀:T": "<@a@|@b=d@>[include(틀:T)]{{{#!if a == '1'\nyes}}}"}
    assert M.expand("x [include(틀:T, a=1)] y [include(틀:없음)]", t) == "x <1|d>yes y "
    assert M.expand("[include(틀:T, b=2)]", t) == "<|2>"


def test_fingerprints():
    from quillon.functions.fingerprint import differences, fingerprint

    a = fingerprint("<p id=1 class=b>x  y<script>q</script><br></p>")
    assert fingerprint("<div class='wiki-categories'><p>no</p></div><span id=a>x</span><b style='COLOR: #FFF;' data-v-1=2>y</b>") == ["x", "<b style=color:#ffffff>", "y", "</b>"]
    assert a == ["<p class=b>", "x y", "<br>", "</p>"] and differences(a, a) == []
    assert differences(["a", "b", "c"], ["a", "x", "c", "d"]) == [("b", "x"), ("", "d")] and differences(["k1"], ["k2"], known=("k",)) == []
