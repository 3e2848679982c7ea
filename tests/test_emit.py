"""HTML by kind of markup; each case is a page and what its HTML is or has."""

from datetime import datetime
from html.parser import HTMLParser

import pytest

from quillon.functions.emit import render_html
from quillon.functions.resolve import Context

WORLD = Context(frozenset({"Here", "Up/Down"}), {"틀:T": "[@x=none@]"}, {"cat.png": "/file/cat.png"}, "Up", datetime(2026, 7, 17, 12))
P = '<div class="wiki-paragraph">{}</div>\n'.format


def html(source):
    return render_html(source, WORLD)


@pytest.mark.parametrize(("source", "want"), [
    # inline
    ("a '''b''' ''c'' ~~d~~ __e__ ^^f^^ ,,g,, <&>\"'", P("a <strong>b</strong> <em>c</em> <del>d</del> <u>e</u> <sup>f</sup> <sub>g</sub> &lt;&amp;&gt;\"'")), ("one\ntwo", P("one<br>two")), ("{{{code <b>}}}", P("<code>code &lt;b&gt;</code>")),
    # size and colour
    ("{{{+2 big}}} {{{-1 small}}}", P('<span class="wiki-size-up-2">big</span> <span class="wiki-size-down-1">small</span>')), ("{{{#red,#blue x}}}", P('<span style="color:red" data-dark-style="color:blue;">x</span>')), ("{{{#0f0 x}}}", P('<span style="color:#00ff00" data-dark-style="color:#00ff00;">x</span>')),
    # links
    ("[[Here|there]]", P('<a class="wiki-link-internal" href="/w/Here" title="Here">there</a>')), ("[[No page#s 1]]", P('<a class="wiki-link-internal not-exist" href="/w/No%20page#s%201" rel="nofollow" title="No page">No page</a>')),
    ("[[Up]]", P('<a class="wiki-self-link" href="/w/Up" title="Up">Up</a>')), ("[[/Down]]", P('<a class="wiki-link-internal" href="/w/Up/Down" title="Up/Down">/Down</a>')), ("[[#here]]", P('<a class="wiki-link-internal" href="#here" title="">#here</a>')),
    ("[[https://a.b/c?d=1#e|x]]", P('<a class="wiki-link-external" href="https://a.b/c?d=1#e" target="_blank" rel="nofollow noopener ugc" title="https://a.b/c?d=1">x</a>')),
    # images
    ("[[파일:cat.png|width=50%&align=left]]", P('<span class="wiki-image-align-left" style="width: 50%;"><span class="wiki-image-wrapper" style="width: 100%;"><img width="100%" src="/file/cat.png" alt="파일:cat.png"></span></span>')),
    ("[[파일:cat.png|theme=dark]]", P('<span class="wiki-image-align-normal wiki-theme-dark" style=""><span class="wiki-image-wrapper"><img src="/file/cat.png" alt="파일:cat.png"></span></span>')),
    ("[[파일:no.png]]", P('<a class="wiki-link-internal not-exist" href="/w/%ED%8C%8C%EC%9D%BC:no.png" rel="nofollow" title="파일:no.png">파일:no.png</a>')),
    # headings
    ("== A ==\nx\n==# B #==\ny", '<h2 class="wiki-heading"><a id="s-1" href="#toc">1.</a> <span id="A">A</span></h2>\n<div class="wiki-heading-content">' + P("x") + '</div>\n<h2 class="wiki-heading wiki-heading-folded"><a id="s-2" href="#toc">2.</a> <span id="B">B</span></h2>\n<div class="wiki-heading-content">' + P("y") + "</div>\n"),
    # lists, quotes, indents, rules
    (" * a\n * b", '<ul class="wiki-list"><li>' + P("a") + "</li><li>" + P("b") + "</li></ul>\n"), (" I.#11 x", '<ol class="wiki-list wiki-list-upper-roman" start="11"><li>' + P("x") + "</li></ol>\n"), (">q", '<blockquote class="wiki-quote">' + P("q") + "</blockquote>\n"), (" in", '<div class="wiki-indent">' + P("in") + "</div>\n"), ("----", "<hr>\n"),
    # tables
    ("|| a ||<-2>b ||", '<div class="wiki-table-wrap"><table class="wiki-table"><tbody><tr class="wiki-table-tr"><td style="text-align: center;">' + P("a") + '</td><td colspan="2" style="text-align: left;">' + P("b") + "</td></tr></tbody></table></div>\n"),
    ("||<tablealign=center><tablewidth=50%><tablebgcolor=red><tablebordercolor=blue><rowbgcolor=#fff><nopad>a||", '<div class="wiki-table-wrap table-center" style="width: 50%;"><table class="wiki-table" style=" width: 100%; background-color: red; border: 2px solid blue;"><tbody><tr class="wiki-table-tr" style=" background-color: #ffffff;"><td class="wiki-table-nopadding" style="">' + P("a") + "</td></tr></tbody></table></div>\n"),
    ("||<bgcolor=red><colbgcolor=blue>a||", None), ("||<^|2>||", None),
    # macros
    ("[br][clearfix][anchor(x)][math(a<b)]", P('<br><div class="wiki-clearfix"></div><a id="x"></a><span class="wiki-math" data-formula="a&lt;b">\\(a&lt;b\\)</span>')), ("[date] [nope(1)] [nope]", P("2026-07-17 12:00:00 [nope(1)] [nope]")),
    ("[youtube(a/b?, width=3)]", P('<iframe class="wiki-media" src="//www.youtube.com/embed/a/b%3F" width="3" height="360" frameborder="0" allowfullscreen loading="lazy"></iframe>')), ("[nicovideo(x)]", P('<iframe class="wiki-media" src="//embed.nicovideo.jp/watch/x" width="640" height="360" frameborder="0" allowfullscreen loading="lazy"></iframe>')),
    ("[ruby(a, ruby=b, color=red)]", P('<ruby>a<rp>(</rp><rt><span style="color:red">b</span></rt><rp>)</rp></ruby>')), ("[include(틀:T, x=1)]", None),
    # groups
    ("{{{#!syntax python\nx < 1\n}}}", P('<pre><code class="hljs" data-language="python">x &lt; 1</code></pre>')), ("{{{#!folding\nx\n}}}", P('<details class="wiki-folding"><summary>More</summary><div>x</div></details>')), ("{{{#!folding Show\nx\n}}}", P('<details class="wiki-folding"><summary>Show</summary><div>x</div></details>')),
    ('{{{#!wiki style="color: red" dark-style="color: blue"\nx}}}', P('<div style="color: red" data-dark-style="color: blue">x</div>')), ("{{{#!wiki\nx}}}", P("<div>x</div>")), ("{{{#!html\n<b>x</b><a href='http://a.b' class='c'>l</a>}}}", P('<b>x</b><a href="http://a.b" target="_blank" rel="nofollow noopener ugc" class="wiki-link-external">l</a>')),
    # categories
    ("x[[분류:A b]][[분류:C]]", P("x") + '<div class="wiki-categories">분류: <a href="/w/%EB%B6%84%EB%A5%98%3AA%20b">A b</a> |  <a href="/w/%EB%B6%84%EB%A5%98%3AC">C</a></div>\n'),
    # broken
    ("'''open", P("'''open")), ("[[open", P("[[open")), ("", ""),
])
def test_pages(source, want):
    got = html(source)
    if want is not None:
        assert got == want
    assert balanced(got)


class Balance(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open, self.good = [], True

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "hr", "img", "wbr"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        self.good &= bool(self.open) and self.open.pop() == tag


def balanced(text):
    b = Balance()
    b.feed(text)
    return b.good and not b.open


def test_footnotes():
    got = html("a[* one] b[*n two] c[*n]\n== H ==\nx")
    assert '<a class="wiki-fn-content" title="one" href="#fn-1"><span id="rfn-1"></span>[1]</a>' in got
    notes = '<div class="wiki-macro-footnote"><span class="footnote-list"><span id="fn-1"></span><a href="#rfn-1">[1]</a> one</span><span class="footnote-list"><span id="fn-n"></span>[n] <a href="#rfn-2"><sup>2.1</sup></a> <a href="#rfn-3"><sup>2.2</sup></a> two</span></div>\n'
    assert got.endswith("</div>\n" + notes) and balanced(got)  # outside of the last section
    assert html("a[* x][각주]b") .count("wiki-macro-footnote") == 1 and "wiki-macro-footnote" not in html("[각주]")


def test_contents():
    got = html("[목차]\n== A ==\n=== B ===\n==== C ====\n== D ==")
    item = lambda n, t: f'<span class="toc-item"><a href="#s-{n}">{n}</a>. {t}</span>'
    want = '<div class="wiki-macro-toc" id="toc"><details open><summary></summary><div class="toc-indent">' + item("1", "A") + '<div class="toc-indent">' + item("1.1", "B") + '<div class="toc-indent">' + item("1.1.1", "C") + "</div></div>" + item("2", "D") + "</div></details></div>\n"
    assert want in got and balanced(got)
    assert '<div class="wiki-macro-toc" id="toc"><details open><summary></summary></details></div>' in html("[목차]")


def test_cells_and_columns():
    got = html("||<colbgcolor=blue>a||b||\n||<bgcolor=red>c||d||")
    assert got.count("background-color: blue;") == 1 and got.count("background-color: red;") == 1
    assert html("|| ||").count(P("")) == 1 and 'rowspan="2" style=" vertical-align: top;"' in html("||<^|2>||")


def test_many_named_notes_take_one_pass():
    import time

    began = time.process_time()
    assert html(" ".join(f"[*n{i} x][*n{i}]" for i in range(10_000))).count("footnote-list") == 10_000
    assert time.process_time() - began < 15


def test_nothing_a_page_writes_becomes_markup():
    for source in ("[[<script>]]", '[[a"onclick=x|y]]', "[[파일:\"><script>]]", "[nope(<script>)]", "{{{#!folding <script>\nx\n}}}", "[* <script>]", "== <script> ==", "[[분류:<script>]]", "[ruby(<script>, ruby=<script>)]", "{{{#!html\n<script>x</script><img onerror=1>}}}"):
        assert "<script" not in html(source) and "onclick=x|" not in html(source) and balanced(html(source))
    assert 'href="#"' not in html("[[https://x]]")
