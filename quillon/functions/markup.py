"""Wiki markup in pure Python: a lossless block and inline reader, and what is derived from its tree.

A node is (kind, start, end, value, children); offsets are characters of the source. Closing marks are looked up in tables made once per
text, and a group that is never closed is plain text. Groups, quotes and lists are read however deep they lie within each other, and
a row of a table however many others stand in its groups; what a level holds while the ones below are read doesn't grow with them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from operator import itemgetter

from .condition import evaluate
from .deep import room, to_json
from .values import COLOURS, decoded, html_style

Span = tuple[int, int]
#: Characters of a group whose lines are listed; those of longer ones are looked up.
LISTED = 1_000
HEADING = re.compile(r"^(={1,6})(#?) (.+) \2\1$")
RULE = re.compile(r"^-{4,9}$")
REDIRECT = re.compile(r"^#(?:redirect|넘겨주기) (.+)$")
CAPTION = re.compile(r"^\|([^|\n]+)\|(?!\|)")
#: What a line begins with that may be more than a line of a paragraph.
BLOCK_MARKS = frozenset("#=->| ")
LIST = re.compile(r"^( ++)(\*|1\.|a\.|A\.|i\.|I\.)(#\d+)? ?(.*)$")
VARIABLE = re.compile(r"@([^@=\s]+)(?:=([^@\n]*))?@")
MACRO = re.compile(r"\[(\w+)(?:\(([^\n]*?)\))?\]")
#: Inline styles: mark and name, longer marks first.
STYLES = (("'''", "bold"), ("''", "italic"), ("~~", "strike"), ("--", "strike"), ("__", "underline"), ("^^", "superscript"), (",,", "subscript"))
MACROS = frozenset("목차 tableofcontents 각주 footnote br clearfix anchor math date datetime age dday youtube kakaotv nicovideo ruby include pagecount".split())
STYLE_TAGS = {"bold": "strong", "italic": "em", "strike": "del", "underline": "u", "superscript": "sup", "subscript": "sub"}


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int
    value: str = ""
    children: list[Node] = field(default_factory=list)


class Lines(Sequence):
    """The lines of a stretch of text, by the places where the text's lines begin: no level of groups holds a copy of those below it."""

    def __init__(self, starts: list[int], start: int, end: int):
        self.starts, self.start, self.end = starts, start, end
        self.first = bisect_right(starts, start)
        self.n = bisect_left(starts, end) - self.first + 1 if start < end else 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[i] for i in range(*k.indices(self.n))]
        k += self.n if k < 0 else 0
        if not 0 <= k < self.n:
            raise IndexError(k)
        return (self.starts[self.first + k - 1] if k else self.start, self.starts[self.first + k] if k < self.n - 1 else self.end)


class Reader:
    def __init__(self, source: str):
        self.s = source
        self.places: dict[str, list[int]] = {}
        self.pairs: dict[str, tuple[list[int], list[int]]] = {}
        self.starts: list[int] | None = None

    def all_of(self, mark: str) -> list[int]:
        at = self.places.get(mark)
        if at is None:
            at, i = [], self.s.find(mark)
            while i >= 0:
                at.append(i)
                i = self.s.find(mark, i + 1)
            self.places[mark] = at
        return at

    def next_of(self, mark: str, start: int, end: int) -> int:
        """The first place of mark in [start, end), or -1."""
        at = self.all_of(mark)
        k = bisect_left(at, start)
        return at[k] if k < len(at) and at[k] + len(mark) <= end else -1

    def closing(self, opening: str, shutting: str, start: int, end: int) -> int:
        """Where the group that begins just before start is closed, minding nested groups of the same kind; -1 if never."""
        if opening not in self.pairs:
            self.pairs[opening] = self.paired(opening, shutting)
        marks, shut = self.pairs[opening]
        at = shut[bisect_left(marks, start)]
        return at if at >= 0 and at + len(shutting) <= end else -1

    def paired(self, opening: str, shutting: str) -> tuple[list[int], list[int]]:
        """The marks of a kind of groups, and for each which mark closes a group that is open before it: from the last to the first, so that
        every mark is looked at once, however deep it lies."""
        marks = sorted(self.all_of(opening) + self.all_of(shutting))
        shut = [-1] * (len(marks) + 1)
        for k in range(len(marks) - 1, -1, -1):
            if self.s.startswith(shutting, marks[k]):
                shut[k] = marks[k]
            elif (inner := shut[bisect_left(marks, marks[k] + len(opening), k)]) >= 0:
                shut[k] = shut[bisect_left(marks, inner + len(shutting), k)]
        return marks, shut

    # --- blocks ------------------------------------------------------------------------------------------------

    def document(self) -> Node:
        return Node("document", 0, len(self.s), "", self.blocks(list(self.lines(0, len(self.s)))))

    def lines(self, start: int, end: int) -> Iterator[Span]:
        while start < end:
            to = self.s.find("\n", start, end) + 1 or end
            yield start, to
            start = to

    def within(self, start: int, end: int) -> Sequence[Span]:
        """The lines of a group or a cell."""
        if end - start <= LISTED:
            return list(self.lines(start, end))
        if self.starts is None:
            self.starts = [to for _, to in self.lines(0, len(self.s))]
        return Lines(self.starts, start, end)

    def logical(self, spans: Sequence[Span], i: int) -> tuple[int, int]:
        """Where line i ends, and the line after it: one that leaves a brace group open goes on to the line that closes it."""
        at, to = spans[i]
        limit, k = spans[-1][1], i + 1
        while (opened := self.s.find("{{{", at, to)) >= 0:
            shut = self.closing("{{{", "}}}", opened + 3, limit)
            if shut < 0:
                break
            at = shut + 3
            if to < at:
                k = bisect_left(spans, at, k, key=itemgetter(1)) + 1
                to = spans[k - 1][1]
        return to, k

    def body(self, a: int, b: int) -> str:
        return self.s[a:b].removesuffix("\n").removesuffix("\r")

    def blocks(self, spans: Sequence[Span]) -> list[Node]:
        """Blocks of the given lines, each from where its own text begins: what outer quotes and lists took from it lies before."""
        out: list[Node] = []
        hopeless: set[int] = set()  # places from which no row ends
        run: Span | None = None  # lines of the last paragraph that lie side by side and wait to be read together
        i = 0

        def read() -> None:
            nonlocal run
            if run is not None:
                out[-1].children += self.inline(run[0], run[1])
                run = None

        def paragraph(a: int, b: int) -> None:
            nonlocal run
            if not out or out[-1].kind != "paragraph":
                out.append(Node("paragraph", a, b))
            elif run is not None and run[1] != a:
                read()
            run = (run[0] if run is not None else a, b)
            out[-1].end = b

        while i < len(spans):
            a = spans[i][0]
            b, after = self.logical(spans, i)
            if a >= b or self.s[a] not in BLOCK_MARKS:
                paragraph(a, b)
                i = after
                continue
            kind, node, inside = self.kind_of(a, b, *spans[i])
            if kind == "row":
                row = self.row(spans, i, hopeless)
                kind = "paragraph" if row is None else kind
            if kind == "paragraph":
                paragraph(a, b)
                i = after
                continue
            read()
            last = out[-1] if out else None
            if kind == "comment" and last is not None and last.kind in ("paragraph", "table"):  # it breaks neither
                last.children.append(node)
                last.end = b
            elif kind == "row":
                begin, end, caption, after = row
                node = Node("row", a, spans[after - 1][1], caption, self.cells(begin, end))
                if last is not None and last.kind == "table" and not node.value:
                    last.children.append(node)
                    last.end = node.end
                else:
                    out.append(Node("table", node.start, node.end, node.value, [node]))
            elif kind in FITS:
                node, after = self.nested(kind, spans, i, FITS[kind])
                out.append(node)
            elif kind == "list":
                node, after = self.list(spans, i)
                out.append(node)
            else:
                if inside is not None:
                    node.children = self.inline(inside[0], inside[1])
                out.append(node)
            i = after
        read()
        return out

    def kind_of(self, a: int, b: int, *first: int) -> tuple[str, Node | None, Span | None]:
        """What begins on a line, its node if that can be made at once, and what is to be read for it. Texts of lines are looked at here
        alone, so that none is held while what it contains is read."""
        text, line = self.body(a, b), self.body(*first)
        if text.startswith("##") and self.s[a - 1 : a] in ("", "\n"):
            return "comment", Node("comment", a, b, text[2:]), None
        if m := REDIRECT.match(text):
            return "redirect", Node("redirect", a, b, m[1].strip()), None
        if m := HEADING.match(text):
            return "heading", Node("heading", a, b, f"{len(m[1])}{m[2]}"), (a + m.start(3), a + m.end(3))
        if RULE.match(text):
            return "rule", Node("rule", a, b), None
        if text[:1] == ">":
            return "quote", None, None
        if LIST.match(line):
            return "list", None, None
        if line[:1] == " " and line.strip():
            return "indent", None, None
        return "row" if text[:2] == "||" or CAPTION.match(line) else "paragraph", None, None

    def marked(self, spans: Sequence[Span], i: int, fits: Callable[[str], bool]) -> tuple[list[Span], int]:
        """Lines from i on that fit, without their first character, and the lines that groups opened in them go on to."""
        inner: list[Span] = []
        while i < len(spans) and fits(self.body(*spans[i])):
            _, after = self.logical(spans, i)
            inner += [(spans[i][0] + 1, spans[i][1]), *spans[i + 1 : after]]
            i = after
        return inner, i

    def nested(self, kind: str, spans: Sequence[Span], i: int, fits: Callable[[str], bool]) -> tuple[Node, int]:
        """A quote or an indent. While it holds nothing but another one, that is gone into at once."""
        inner, after = self.marked(spans, i, fits)
        first = last = Node(kind, spans[i][0], inner[-1][1])
        while fits(self.body(*inner[0])):
            deeper, to = self.marked(inner, 0, fits)
            if to < len(inner):
                break
            last.children = [Node(kind, inner[0][0], deeper[-1][1])]
            last, inner = last.children[0], deeper
        last.children = self.blocks(inner)
        return first, after

    def list(self, spans: Sequence[Span], i: int) -> tuple[Node, int]:
        """A list of one kind at one depth of spaces. What stands deeper, or as deep without a mark, belongs to the item before it."""
        first = spans[i][0]
        kind, items, i = self.items(spans, i)
        node = Node("list", first, items[-1][2][-1][1], kind)
        for a, start, inner in items:
            node.children.append(Node("item", a, inner[-1][1], start, self.blocks(inner)))
        return node, i

    def items(self, spans: Sequence[Span], i: int) -> tuple[str, list[tuple[int, str, list[Span]]], int]:
        """The kind of a list, where each item begins, its number and its lines, and the line after the list."""
        m = LIST.match(self.body(*spans[i]))
        kind, margin = m[2], len(m[1])
        items: list[tuple[int, str, list[Span]]] = []
        while i < len(spans):
            a, b = spans[i]
            text = self.body(a, b)
            deep = len(text) - len(text.lstrip(" "))
            m = LIST.match(text)
            if not text.strip() or deep < margin or (deep == margin and m and m[2] != kind):
                break
            _, after = self.logical(spans, i)
            if deep == margin and m:
                items.append((a, (m[3] or "")[1:], [(a + m.start(4), b)]))
            else:
                items[-1][2].append((a + margin, b))
            items[-1][2].extend(spans[i + 1 : after])
            i = after
        return kind, items, i

    EDGE = re.compile(r"\{\{\{|\[\[|\\|\|\|")
    BLANK = re.compile(r"[^\S\n]*(?:\n|\Z)")
    SHUT = {"{{{": "}}}", "[[": "]]"}

    def row(self, spans: Sequence[Span], i: int, hopeless: set[int]) -> tuple[int, int, str, int] | None:
        """A row of a table, over as many lines as it takes until one ends with its mark: where its cells begin and end, its caption, and the
        line after it; None if none does."""
        a, b = spans[i]
        m = CAPTION.match(self.body(a, b))
        begin = a + (m.end() if m else 2)
        end = self.row_end(begin, spans[-1][1], hopeless)
        return None if end < 0 else (begin, end, m[1] if m else "", bisect_left(spans, end, i, key=itemgetter(1)) + 1)

    def row_end(self, begin: int, limit: int, hopeless: set[int]) -> int:
        """The end of the first mark from begin on that stands at the end of a line and in no group; -1 if there is none. A brace group that is
        closed anywhere hides what it holds. A link hides it from what follows the link only: before its end it is plain text."""
        at, passed = begin, []
        links: list[int] = []  # where the links end that are being looked into
        while True:
            m = self.EDGE.search(self.s, at, min(limit, links[-1]) if links else limit)
            if m is None:
                if not links:
                    break
                at = links.pop()
                continue
            i, mark = m.span()[0], m[0]
            if not links:
                if i in hopeless:
                    break
                passed.append(i)
            if mark == "||":
                if self.BLANK.match(self.s, i + 2, limit):
                    return i + 2
                at = i + 2
            elif mark == "\\":
                at = i + 2
            else:
                shut = self.closing(mark, self.SHUT[mark], m.end(), len(self.s))
                at = i + 1
                if shut >= 0 and mark == "{{{":
                    at = shut + 3
                elif shut >= 0 and (not links or shut + 2 <= links[-1]):
                    links.append(shut + 2)
        hopeless.update(passed)
        return -1

    def cells(self, start: int, end: int) -> list[Node]:
        """The cells of a row; empty ones before a cell widen it."""
        cells, at, begin, wide = [], start, start, 1
        while m := self.EDGE.search(self.s, at, end):
            at = m.start()
            if m[0] == "\\":
                at += 2
            elif m[0] == "||":
                if at == begin and at + 2 < end:
                    wide += 1
                else:
                    cells.append(self.cell(begin, at, wide))
                    wide = 1
                at = begin = at + 2
            else:
                shut = self.closing(m[0], self.SHUT[m[0]], m.end(), end)
                at = shut + len(m[0]) if shut >= 0 else at + 1  # both marks are as long
        return cells

    OPTION = re.compile(r"[(:)]|-\d+|[v^]?\|\d+|nopad|(?:row|col)?keepall|#\w+(?:,#\w+)?|[A-Za-z]+|(?:table|row|col)? ?(?:bgcolor|color|bordercolor|width|height|textalign|align|class) ?=[^<>]*", re.I)

    def cell(self, start: int, end: int, wide: int = 1) -> Node:
        """A cell with its options, one a line, and its blocks. Blanks at its ends say how it is set, unless an option does."""
        options, first, last = self.options(start, end, wide)
        return Node("cell", start, end, options, self.blocks(self.within(first, last)))

    def options(self, start: int, end: int, wide: int) -> tuple[str, int, int]:
        """The options of a cell, and where its blocks begin and end."""
        options, at = [f"-{wide}"] if wide > 1 else [], start
        while (m := re.compile(r"<([^<>\n]+)>").match(self.s, at, end)) and self.OPTION.fullmatch(m[1].strip()):
            if m[1].strip().isalpha() and m[1].strip().lower() not in ("nopad", "keepall", "rowkeepall", "colkeepall", "transparent", *COLOURS):
                break
            options.append(m[1].strip())
            at = m.end()
        text = self.s[at:end]
        left, right = text[:1] == " ", text[-1:] == " "
        if (left or right) and not {"(", ":", ")"} & set(options):
            options.append(":" if left and right else ")" if left else "(")
        return "\n".join(options), at + len(text) - len(text.lstrip(" ")), end - len(text) + len(text.rstrip(" "))

    # --- inline ------------------------------------------------------------------------------------------------

    MARK = re.compile(r"\\[^\r\n]|\{\{\{|\[\[|\[\*|@|\[|'''|''|~~|--|__|\^\^|,,|\r\n|\n")  # each begins with a fixed character, so that others are passed over at once

    def inline(self, start: int, end: int) -> list[Node]:
        out: list[Node] = []
        plain = at = start

        def flush(to: int) -> None:
            if to > plain:
                out.append(Node("text", plain, to, self.s[plain:to]))

        while at < end and (m := self.MARK.search(self.s, at, end)):
            i, mark = m.start(), m[0]
            node = None
            if mark[0] == "\\":
                node = Node("escape", i, m.end(), mark[1])
            elif mark[-1] == "\n":
                node = Node("break", i, m.end())
            else:
                node = self.group(mark, i, end)
            if node is None:
                at = m.end() if mark != "''" and mark != "[" else i + len(mark)
                continue
            flush(i)
            out.append(node)
            plain = at = node.end
        flush(end)
        return out

    def group(self, mark: str, i: int, end: int) -> Node | None:
        s = self.s
        if mark == "{{{":
            shut = self.closing("{{{", "}}}", i + 3, end)
            return None if shut < 0 else self.brace(i, shut)
        if mark == "[[":
            shut = self.closing("[[", "]]", i + 2, end)
            if shut < 0:
                return None
            bar = s.find("|", i + 2, shut)
            while bar > 0 and (bar - len(s[i + 2 : bar].rstrip("\\")) - i) % 2 == 1:  # an escaped bar is a letter
                bar = s.find("|", bar + 1, shut)
            target = s[i + 2 : bar if bar >= 0 else shut]
            kind = "image" if target.startswith(("파일:", "file:")) else "category" if target.startswith(("분류:", "category:")) else "link"
            shown = self.inline(bar + 1, shut) if bar >= 0 and kind == "link" else [Node("options", bar + 1, shut, s[bar + 1 : shut])] if bar >= 0 else []
            return Node(kind, i, shut + 2, target.removeprefix(":"), shown)
        if mark == "[*":
            shut = self.closing("[", "]", i + 2, end)
            if shut < 0:
                return None
            space = s.find(" ", i + 2, shut)
            name = s[i + 2 : space if space >= 0 else shut]
            return Node("footnote", i, shut + 1, name, self.inline(space + 1, shut) if space >= 0 else [])
        if mark == "@":
            m = VARIABLE.match(s, i, end)
            return m and Node("variable", i, m.end(), m[1], [Node("default", m.start(2), m.end(2), m[2])] if m[2] is not None else [])
        if mark == "[":
            m = MACRO.match(s, i, end)
            return m and Node("macro", i, m.end(), m[1], [Node("arguments", m.start(2), m.end(2), m[2])] if m[2] is not None else [])
        name = dict(STYLES)[mark]
        shut = self.next_of(mark, i + len(mark), end)
        if shut <= i + len(mark):
            return None
        return Node(name, i, shut + len(mark), mark, self.inline(i + len(mark), shut))

    DIRECTIVE = re.compile(r"#!(syntax|wiki|if|folding|html)(?:[ \t]+([^\n]*))?(\n|$| )?")
    WIKI_STYLES = re.compile(r"(?:\s*[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*")
    SIZE = re.compile(r"([+-][1-5]) ")
    COLOR = re.compile(r"(#[0-9A-Za-z]+(?:,#[0-9A-Za-z]+)?) ")

    def brace(self, i: int, shut: int) -> Node:
        s = self.s
        if m := self.DIRECTIVE.match(s, i + 3, shut):
            kind, inner = m[1], m.end()
            if kind == "wiki" and m[3] != "\n":
                value, begin, to = "", *m.span(2)
                if begin < to:
                    given = self.WIKI_STYLES.match(s, begin, to)
                    value, inner = given[0], given.end() + s.startswith(" ", given.end(), to)
                return Node("wiki", i, shut + 3, value, self.blocks(self.within(inner, shut)))
            if kind in ("wiki", "folding", "if"):
                return Node(kind, i, shut + 3, m[2] or "", self.blocks(self.within(inner, shut)))
            return Node(kind, i, shut + 3, (m[2] or "") + "\n" + s[inner:shut])
        if m := self.SIZE.match(s, i + 3, shut) or self.COLOR.match(s, i + 3, shut):
            return Node("size" if s[i + 3] != "#" else "color", i, shut + 3, m[1], self.inline(m.end(), shut))
        return Node("literal", i, shut + 3, s[i + 3 : shut])


#: Which lines go on with a quote or an indent.
FITS: dict[str, Callable[[str], bool]] = {"quote": lambda t: t[:1] == ">", "indent": lambda t: t[:1] == " " and bool(t.strip()) and not LIST.match(t)}


def parse(source: str) -> Node:
    room(len(source))
    return Reader(source).document()


def walk(node: Node, parent: str = ""):
    todo = [(node, parent)]
    while todo:
        n, p = todo.pop()
        yield n, p
        todo += [(c, n.kind) for c in reversed(n.children)]


# --- derived -------------------------------------------------------------------------------------------------------


def token_rows(source: str) -> Iterator[tuple[int, str, str, int, int, str]]:
    """(pos, kind, parent, start, end, text) of every node, one after the other: their texts are as long as the source times its depth. Leaves and
    gaps between them give back the source."""
    return ((i, n.kind, p, n.start, n.end, source[n.start : n.end]) for i, (n, p) in enumerate(walk(parse(source))))


def pieces(node: Node, source: str) -> str:
    """The source put together from the tree: each node's own text between its children."""
    out, at = [], node.start
    for c in node.children:
        out += [source[at : c.start], pieces(c, source)]
        at = c.end
    return "".join([*out, source[at : node.end]])


def relative(target: str, page: str) -> str:
    if target.startswith("문서:"):
        return target[3:]
    if target.startswith("../"):
        up = page.rpartition("/")[0] or page
        return f"{up}/{target[3:]}" if target[3:] else up
    return page + target if target.startswith("/") else target


def references(source: str, page: str = "") -> list[tuple[str, str]]:
    """Distinct (kind, target), sorted: link, include, image, category, redirect. Templated, local and outside targets are left out."""
    out, redirected = set(), False
    for n, _ in walk(parse(source)):
        kind, target = n.kind, n.value.strip()
        if kind == "macro" and n.value.lower() == "include" and n.children:
            kind, target = "include", n.children[0].value.split(",")[0].strip()
        elif kind == "link":
            target = relative(target, page).split("#")[0] if target[:1] != "#" else ""
        elif kind == "category":
            target = target.split(":", 1)[1].split("#")[0]
        elif kind == "image":
            target = target.split(":", 1)[1].strip()
        elif kind == "redirect":
            if redirected:
                continue
            redirected, target = True, target.split("#")[0]
        else:
            continue
        if target and "://" not in target and not re.search(r"@[^@\s]+@", target):
            out.add((kind, target))
    return sorted(out)


def plain_text(node: Node) -> str:
    out = []
    for n, _ in walk(node):
        if n.kind in ("text", "escape"):
            out.append(n.value)
        elif n.kind == "link" and not n.children:
            out.append(n.value)
    return "".join(out)


#: How grave each finding is, and of what kind.
GRADES = {
    "redirect-trailing-content": ("warning", "correctness"), "duplicate-redirect": ("warning", "correctness"), "heading-level-skip": ("suggestion", "style"), "duplicate-category": ("suggestion", "style"), "duplicate-footnote-definition": ("warning", "correctness"),
    "unsupported-macro": ("info", "unsupported"), "invalid-macro-argument": ("warning", "correctness"), "include-target-missing": ("warning", "correctness"), "self-redirect": ("warning", "correctness"),
}


def findings(source: str) -> list[tuple[int, int, str, str]]:
    """(start, end, code, detail) of what can be said without knowing other pages, in order of start."""
    tree, out = parse(source), []
    redirects = [n for n in tree.children if n.kind == "redirect"]
    if redirects:
        after = [n for n in tree.children if n.start >= redirects[0].end and n.kind not in ("redirect", "comment") and source[n.start : n.end].strip()]
        if after:
            out.append((after[0].start, after[-1].end, "redirect-trailing-content", redirects[0].value))
    out += [(n.start, n.end, "duplicate-redirect", n.value) for n in redirects[1:]]
    level, seen, notes = 0, set(), set()
    for n in tree.children:
        if n.kind == "heading":
            now = int(n.value[0])
            if level and now > level + 1:
                out.append((n.start, n.end, "heading-level-skip", f"{level}->{now}"))
            level = now
    for n, _ in walk(tree):
        if n.kind == "category":
            if n.value in seen:
                out.append((n.start, n.end, "duplicate-category", n.value))
            seen.add(n.value)
        elif n.kind == "footnote" and n.value and any(c.kind != "text" or c.value.strip() for c in n.children):
            if n.value in notes:
                out.append((n.start, n.end, "duplicate-footnote-definition", n.value))
            notes.add(n.value)
        elif n.kind == "macro" and n.value.lower() not in MACROS:
            out.append((n.start, n.end, "unsupported-macro", n.value))
    return sorted(out, key=lambda d: d[0])


def graded(source: str) -> list[tuple[int, int, str, str, str, str]]:
    """(start, end, code, severity, category, detail)."""
    return [(a, b, code, *GRADES[code], detail) for a, b, code, detail in findings(source)]


def diagnostics(source: str) -> list[tuple[int, str, str]]:
    """(start, code, detail) in order of start."""
    return [(a, code, detail) for a, _, code, detail in findings(source)]


def outline(source: str) -> list[tuple[str, int, str]]:
    """(number, level, title) of the headings in order."""
    heads = [n for n, _ in walk(parse(source)) if n.kind == "heading"]
    levels = [int(n.value[0]) for n in heads]
    return list(zip(heading_numbers(levels), levels, [plain_text(n) for n in heads], strict=True))


def heading_numbers(levels: list[int]) -> list[str]:
    """1, 1.1, 2 ...; a level that skips depths counts as one deeper."""
    stack: list[list[int]] = []
    out = []
    for level in levels:
        while stack and stack[-1][0] > level:
            stack.pop()
        if stack and stack[-1][0] == level:
            stack[-1][1] += 1
        else:
            stack.append([level, 1])
        out.append(".".join(str(n) for _, n in stack))
    return out



def expand(source: str, templates: dict[str, str]) -> str:
    """Includes replaced by their templates, one level deep: an include inside a template is dropped. Arguments fill @name@ and
    @name=default@; conditional groups keep their body if the condition holds, with what it binds."""
    return _filled(source, parse(source), {}, templates)


def _filled(source: str, node: Node, names: dict, templates: dict[str, str] | None) -> str:
    out, at = [], node.start
    for c in node.children:
        out.append(source[at : c.start])
        at = c.end
        if c.kind == "macro" and c.value.lower() == "include" and c.children:
            if templates is None:
                continue
            name, *args = c.children[0].value.split(",")
            body = templates.get(name.strip())
            if body is not None:
                given = {"calleeTitle": name.strip()} | {k.strip(): v.strip() for k, s, v in (a.partition("=") for a in args) if s}
                out.append(_filled(body, parse(body), given, None))
        elif c.kind == "variable" and templates is None:
            value = names.get(c.value)
            out.append(str(value) if value is not None else c.children[0].value if c.children else "")
        elif c.kind == "if" and templates is None:
            bound = evaluate(c.value, names)
            if bound is not None:
                out.append("".join(_filled(source, b, bound, None) for b in c.children))
        else:
            out.append(_filled(source, c, names, templates))
    return "".join([*out, source[at : node.end]])


def tree_json(source: str) -> str:
    """The tree as JSON: type, start, end, value and children where there are any."""
    show = lambda n: {"type": n.kind, "start": n.start, "end": n.end} | ({"value": n.value} if n.value else {}) | ({"children": [show(c) for c in n.children]} if n.children else {})
    return to_json(show(parse(source)))


#: Elements that may stand in a page, those whose content is code, and those without content.
ALLOWED = frozenset("a b i u s strong em sub sup br span div code small big wbr video".split())
CODE_BEARING = frozenset("script style iframe object embed".split())
VOID = frozenset("br wbr".split())
_TAG = re.compile(r"<((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTRIBUTE = re.compile(r"([^\s=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S*)))?")


def _kept_attributes(name: str, source: str) -> dict[str, str | None]:
    """The first value of each attribute that the element may have."""
    out: dict[str, str | None] = {}
    for m in _ATTRIBUTE.finditer(source):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key == "style":
            if not out.get("style") and (taken := html_style(value)):
                out["style"] = "; ".join(f"{p}: {v}" for p, v in taken)
        elif key in ("href", "src"):
            if (name, key) in (("a", "href"), ("video", "src")) and key not in out and re.match(r"(?:https?|ftp)://", value.strip(), re.I):
                out[key] = value.strip()
        elif key == "class" or name == "video" and key in ("width", "height"):
            out.setdefault(key, value)
        elif name == "video" and key == "controls":
            out["controls"] = None
    return out


def sanitize(source: str) -> str:
    """Allowed elements and attributes only. Code is dropped with its content, other elements are unwrapped, and so is a link that leads
    nowhere; an end tag closes the innermost element or nothing, what is open at the end is closed, and from a tag that never ends
    on everything is text."""
    out, stack, at = [], [], 0
    say = lambda text: out.append(html.escape(decoded(text), quote=False))
    shown = lambda attributes: "".join(f" {k}" if v is None else f' {k}="{html.escape(v)}"' for k, v in attributes.items())
    while (begin := source.find("<", at)) >= 0:
        say(source[at:begin])
        m = _TAG.match(source, begin)
        if not m:
            at = begin
            break
        inner, at = m[1], m.end()
        if inner[:1] == "/":
            if stack and stack[-1] == inner[1:].strip().lower():
                out.append(f"</{stack.pop()}>")
            continue
        if inner[:1] == "!":
            continue
        name, *more = re.split(r"(?=\s)", inner.removesuffix("/"), maxsplit=1)
        name = name.lower()
        if name in CODE_BEARING:
            shut = re.compile(rf"</{name}[^>]*>", re.I).search(source, at)
            at = shut.end() if shut else len(source)
            continue
        if name not in ALLOWED:
            continue
        attributes = _kept_attributes(name, more[0] if more else "")
        if name == "a" and "href" not in attributes:
            continue
        out.append(f"<{name}{shown(attributes)}>")
        if name not in VOID:
            stack.append(name)
    say(source[at:])
    return "".join(out + [f"</{t}>" for t in reversed(stack)])
