"""Pages as trees of what is shown: markup is resolved against a context (which pages exist, templates, files, the time), laid out
(numbers of headings and footnotes, the table of contents), and given as plain dictionaries ready for JSON.

What was asked of the context is remembered: these are the page's references, and a caller can tell whether it knew them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime

from . import markup as M
from .condition import evaluate
from .deep import STRING, to_json
from .markup import VARIABLE, Node
from .values import colour, colours, dimension, wiki_style

STYLES = {"bold": "bold", "italic": "italic", "strike": "strikethrough", "underline": "underline", "superscript": "superscript", "subscript": "subscript"}
VIDEOS = {"youtube": "youtube", "kakaotv": "kakaoTv", "nicovideo": "nicoVideo"}
LISTS = {"*": "unordered", "1.": "decimal", "a.": "lowerAlphabet", "A.": "upperAlphabet", "i.": "lowerRoman", "I.": "upperRoman"}
EXTERNAL = re.compile(r"(?:https?|ftp)://", re.I)
#: Templates that stay read, and characters of one at most: a tree takes some hundred bytes a character at worst.
READ, LONG = 128, 4_096


@dataclass
class Context:
    exists: frozenset[str] = frozenset()
    templates: dict[str, str] = field(default_factory=dict)
    files: dict[str, str] = field(default_factory=dict)
    title: str = ""
    now: datetime | None = None
    read: dict[str, Node] = field(default_factory=dict)  # templates that were read before, by their text; may be shared by contexts

    def template(self, source: str) -> Node:
        """What is read is not changed, so one reading serves all includes; long ones, and those after the first READ, are read anew."""
        if (known := self.read.get(source)) is None:
            known = M.parse(source)
            if len(source) <= LONG and len(self.read) < READ:
                self.read[source] = known
        return known


def lax_date(text: str | None) -> tuple[int, int, int] | None:
    """`y-m-d` with a month to 12 and a day to 31, whether or not the month has it."""
    m = re.fullmatch(r"([+-]?\d+)-(\d+)-(\d+)", (text or "").strip())
    d = m and tuple(map(int, m.groups()))
    return d if d and 1 <= d[1] <= 12 and 1 <= d[2] <= 31 else None


def day_number(y: int, m: int, d: int) -> int:
    """Days of the civil calendar, for any day that lax_date takes."""
    return date(2000 + (y + (m > 2) - 1) % 400, 3, 1).toordinal() + (y + (m > 2) - 1) // 400 * 146097 + (153 * ((m + 9) % 12) + 2) // 5 + d


def split_anchor(target: str) -> tuple[str, str | None]:
    """Cut at the last `#` that isn't escaped; addresses are not cut."""
    if "#" not in target or EXTERNAL.match(target):
        return target, None
    places = [m.start() for m in re.finditer(r"\\.|#", target) if m[0] == "#"]
    return (target[: places[-1]], target[places[-1] + 1 :] or None) if places else (target, None)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.?)", r"\1", text, flags=re.S) if "\\" in text else text


def text_of(content: list[dict]) -> str:
    """The text of inlines, as in tooltips: links by what they show, no literals, no breaks."""
    out = []
    for x in content:
        if x["type"] == "text":
            out.append(x["text"])
        else:
            out.append(text_of(x.get("content") or x.get("display") or []) if isinstance(x.get("content") or x.get("display"), list) else "")
    return "".join(out)


def contents_title(content: list[dict]) -> list[dict]:
    """A heading in the table of contents: without anchors, and with what is struck through as plain."""
    out = []
    for x in content:
        if x["type"] == "styled" and x["style"] == "strikethrough":
            out += contents_title(x["content"])
        elif x["type"] != "anchor":
            out.append(x)
    return out


class Resolver:
    def __init__(self, context: Context):
        self.c = context
        self.redirect: str | None = None
        self.categories: list[str] = []
        self.asked: dict[str, set[str]] = {"link": set(), "include": set(), "image": set()}
        self.problems: list[tuple[int, str, str]] = []
        self.instances = 0

    # --- blocks ------------------------------------------------------------------------------------------------

    def blocks(self, nodes: list[Node], scope: dict | None) -> list[dict]:
        out: list[dict] = []
        for n in nodes:
            if n.kind == "redirect":
                if self.redirect is None and scope is None:
                    self.redirect = n.value
            elif n.kind == "heading":
                out.append({"type": "heading", "level": int(n.value[0]), "folded": n.value.endswith("#"), "number": "", "anchor": "", "content": self.inlines(n.children, scope)})
            elif n.kind == "rule":
                out.append({"type": "horizontalRule"})
            elif n.kind in ("quote", "indent"):
                out.append({"type": n.kind, "blocks": self.blocks(n.children, scope)})
            elif n.kind == "list":
                out.append({"type": "list", "kind": LISTS[n.value], "items": [{"startNumber": int(i.value) if i.value else None, "blocks": self.blocks(i.children, scope)} for i in n.children]})
            elif n.kind == "table":
                out.append({"type": "table", "table": self.table(n, scope)})
            elif n.kind == "paragraph":
                out += self.paragraph(n.children, scope)
        return out

    def paragraph(self, nodes: list[Node], scope: dict | None) -> list[dict]:
        """Lines that hold nothing but categories, includes and conditional groups vanish; an include or a group that begins a line becomes
        blocks of its own."""
        lines: list[list[Node]] = [[]]
        for n in nodes:
            if n.kind == "break":
                lines.append([])
            elif n.kind != "comment":
                lines[-1].append(n)
        if nodes and nodes[-1].kind == "break":
            lines.pop()
        out, now = [], []

        def flush() -> None:
            if now:
                content = []
                for i, line in enumerate(now):
                    content += ([{"type": "lineBreak"}] if i else []) + line
                out.append({"type": "paragraph", "content": content})
                now.clear()

        for line in lines:
            special = [n for n in line if n.kind in ("category", "if") or self.is_include(n)]
            if special and not any(n.kind != "text" or n.value.strip() for n in line if n not in special):
                for n in special:
                    if n.kind == "category":
                        self.category(n, scope)
                    else:
                        flush()
                        out.extend(self.promoted(n, scope))
            elif line and (line[0].kind == "if" or self.is_include(line[0])):
                flush()
                out.extend(self.promoted(line[0], scope))
                now.append(self.inlines(line[1:], scope))
            else:
                now.append(self.inlines(line, scope))
        flush()
        return out

    def promoted(self, n: Node, scope: dict | None) -> list[dict]:
        return self.include(n) if n.kind == "macro" else self.condition(n, scope)

    def condition(self, n: Node, scope: dict | None) -> list[dict]:
        """The blocks of a conditional group, if its condition holds; what it binds holds for what follows in the template."""
        names = scope if scope is not None else {}
        bound = evaluate(n.value, names)
        if bound is None:
            return []
        names.update(bound)
        return self.blocks(n.children, names)

    @staticmethod
    def is_include(n: Node) -> bool:
        return n.kind == "macro" and n.value.lower() == "include"

    def table(self, n: Node, scope: dict | None) -> dict:
        rows = []
        for r in n.children:
            if r.kind == "row":
                rows.append({"cells": [self.cell(c, scope) for c in r.children]})
        inherit(rows)
        return {"caption": self.inlines(M.parse(n.value).children[0].children, scope) if n.value.strip() else None, "rows": rows}

    def cell(self, c: Node, scope: dict | None) -> dict:
        out = {"columnSpan": None, "rowSpan": None, "horizontalAlignment": None, "verticalAlignment": None, "attributes": []}
        for o in filter(None, c.value.split("\n")):
            if o in ("(", ":", ")"):
                out["horizontalAlignment"] = {"(": "left", ":": "center", ")": "right"}[o]
            elif m := re.fullmatch(r"-(\d+)", o):
                out["columnSpan"] = max(1, int(m[1]))
            elif m := re.fullmatch(r"([v^]?)\|(\d+)", o):
                out["rowSpan"] = max(1, int(m[2]))
                out["verticalAlignment"] = {"^": "top", "v": "bottom", "": None}[m[1]]
            elif o == "nopad":
                out["attributes"].append({"scope": {"type": "cell"}, "property": {"type": "noPadding"}})
            elif o[0] == "#" or "=" not in o:
                if shade := colour(o.split(",")[0]):
                    out["attributes"].append({"scope": {"type": "cell"}, "property": {"type": "backgroundColor", "color": shade}})
            elif p := table_property(*map(str.strip, self.fill(o, scope).split("=", 1))):
                out["attributes"].append(p)
        for a in out["attributes"]:
            if a["scope"]["type"] == "column":
                a["scope"]["columns"] = out["columnSpan"] or 1
        return out | {"blocks": self.blocks(c.children, scope)}

    # --- inlines -----------------------------------------------------------------------------------------------

    def fill(self, text: str, scope: dict | None) -> str:
        """Variables by what the include gives, else by their default, else nothing."""
        return text if "@" not in text else VARIABLE.sub(lambda m: str(scope[m[1]]) if scope and scope.get(m[1]) is not None else m[2] or "", text)

    def inlines(self, nodes: list[Node], scope: dict | None) -> list[dict]:
        out: list[dict] = []
        before = None
        for n in nodes:
            new = self.inline(n, scope)
            if before is not None and before.kind in ("text", "escape") and n.kind in ("text", "escape"):
                out[-1] = {"type": "text", "text": out[-1]["text"] + new[0]["text"]}
            else:
                out += new
            before = n
        return out

    def inline(self, n: Node, scope: dict | None) -> list[dict]:
        kind = n.kind
        if kind in ("text", "escape"):
            return [{"type": "text", "text": n.value}]
        if kind == "break":
            return [{"type": "lineBreak"}]
        if kind in STYLES:
            return [{"type": "styled", "style": STYLES[kind], "content": self.inlines(n.children, scope)}]
        if kind == "variable":
            return [{"type": "text", "text": self.fill(f"@{n.value}{'=' + n.children[0].value if n.children else ''}@", scope)}]
        if kind == "literal":
            if n.value[:1] == "\n":
                return [{"type": "codeBlock", "language": None, "source": n.value[1:].removesuffix("\n")}]
            return [{"type": "literal", "text": n.value}]
        if kind == "color":
            both = colours(n.value)
            inside = self.inlines(n.children, scope)
            return [{"type": "colored", "color": {"light": both[0], "dark": both[1]}, "content": inside}] if both else [{"type": "text", "text": f"{n.value} "}, *inside]
        if kind == "size":
            return [{"type": "sized", "level": int(n.value), "content": self.inlines(n.children, scope)}]
        if kind == "footnote":
            return [{"type": "footnote", "name": n.value or None, "content": self.inlines(n.children, scope)}]
        if kind == "category":
            self.category(n, scope)
            return []
        if kind == "link":
            return self.link(n, scope)
        if kind == "image":
            return [self.image(n, scope)]
        if kind == "syntax":
            language, _, source = n.value.partition("\n")
            return [{"type": "codeBlock", "language": language.strip() or None, "source": source.removesuffix("\n")}]
        if kind == "html":
            return [{"type": "html", "html": M.sanitize(self.fill(n.value.partition("\n")[2], scope))}]
        if kind == "wiki":
            styles = {m[1]: m[2] or m[3] or "" for m in re.finditer(r"""([\w-]*style)\s*=\s*(?:"([^"]*)"|'([^']*)')""", self.fill(n.value, scope))}
            shown = lambda k: [{"property": p, "value": v} for p, v in wiki_style(styles.get(k, ""))]
            return [{"type": "wikiStyle", "style": shown("style"), "darkStyle": shown("dark-style"), "blocks": self.blocks(n.children, scope)}]
        if kind == "folding":
            return [{"type": "folding", "summary": n.value, "blocks": self.blocks(n.children, scope)}]
        if kind == "if":
            return [{"type": "blocks", "blocks": b}] if (b := self.condition(n, scope)) else []
        if kind == "macro":
            return self.macro(n, scope)
        return []

    def category(self, n: Node, scope: dict | None) -> None:
        name = self.fill(n.value.split(":", 1)[1], scope).strip()
        if name and name not in self.categories:
            self.categories.append(name)

    def link(self, n: Node, scope: dict | None) -> list[dict]:
        written = self.fill(n.value, scope)
        shown = self.inlines(n.children, scope)
        if EXTERNAL.match(written):
            return [{"type": "externalLink", "url": written, "display": shown or None}]
        target, anchor = split_anchor(written)
        title = unescaped(M.relative(target, self.c.title)) if target else ""
        written = unescaped(target) or f"#{anchor or ''}"
        if anchor and not target and scope is not None:
            anchor = f"i{self.instances}-{anchor}"
        if not target and anchor:
            state = "existing"
        elif title in ("", self.c.title):
            state = "current"
            if scope is None and self.redirect is not None and not anchor:
                self.problems.append((n.start, "self-redirect", title))
        else:
            self.asked["link"].add(title)
            state = "existing" if title in self.c.exists else "missing"
        return [{"type": "documentLink", "title": title, "anchor": anchor, "kind": state, "display": shown or [{"type": "text", "text": written}]}]

    def image(self, n: Node, scope: dict | None) -> dict:
        name = self.fill(n.value.split(":", 1)[1], scope).strip()
        self.asked["image"].add(name)
        layout = {"width": None, "height": None, "align": None, "backgroundColor": None, "theme": None}
        for part in self.fill(n.children[0].value if n.children else "", scope).split("&"):
            key, _, value = (x.strip() for x in part.partition("="))
            if key in ("width", "height") and value:
                layout[key] = dimension(value, image=True)
            elif key == "align" and value in ("left", "center", "right"):
                layout["align"] = value
            elif key == "bgcolor" and colour(value):
                layout["backgroundColor"] = colour(value)
            elif key == "theme" and value in ("light", "dark"):
                layout["theme"] = value
        return {"type": "image", "fileName": name, "url": self.c.files.get(name), "layout": layout}

    def macro(self, n: Node, scope: dict | None) -> list[dict]:
        name, given = n.value.lower(), self.fill(n.children[0].value, scope) if n.children else None
        unresolved = {"type": "unresolved", "name": n.value, "argument": given}

        def wrong() -> list[dict]:
            if scope is None:
                self.problems.append((n.start, "invalid-macro-argument", n.value))
            return [unresolved]

        if name in ("목차", "tableofcontents"):
            return [{"type": "tableOfContents"}]
        if name in ("각주", "footnote"):
            return [{"type": "footnoteSection", "notes": []}]
        if name == "br":
            return [{"type": "lineBreak"}]
        if name == "clearfix":
            return [{"type": "clearFix"}]
        if name == "include":
            return [{"type": "blocks", "blocks": b}] if (b := self.include(n)) else []
        if name in ("anchor", "math"):
            return wrong() if given is None else [{"type": "anchor", "name": given} if name == "anchor" else {"type": "math", "formula": given}]
        now = self.c.now
        if name in ("date", "datetime"):
            return [{"type": "text", "text": now.strftime("%Y-%m-%d %H:%M:%S")}] if now else [unresolved]
        if name in ("age", "dday"):
            d = lax_date(given)
            if d is None:
                return wrong()
            if now is None:
                return [unresolved]
            if name == "age":
                return [{"type": "text", "text": str(now.year - d[0] - ((now.month, now.day) < d[1:]))}]
            left = day_number(now.year, now.month, now.day) - day_number(*d)
            return [{"type": "text", "text": "D-Day" if not left else f"D{left:+d}"}]
        if name in VIDEOS:
            first, *more = (given or "").split(",")
            options = {k.strip(): v.strip() for k, s, v in (m.partition("=") for m in more) if s}
            return wrong() if not first.strip() else [{"type": "video", "provider": VIDEOS[name], "identifier": first.strip(), "width": options.get("width"), "height": options.get("height")}]
        if name == "ruby":
            content, comma, more = (given or "").partition(",")
            options = {k.strip(): v.strip() for k, s, v in (m.partition("=") for m in more.split(",")) if s}
            return [{"type": "ruby", "content": content.strip(), "ruby": options["ruby"], "color": colour(options.get("color", ""))}] if comma and "ruby" in options else wrong()
        if scope is None:
            self.problems.append((n.start, "unsupported-macro", n.value))
        return [unresolved]

    def include(self, n: Node) -> list[dict]:
        """A template's blocks, one level deep: what it includes in turn is dropped."""
        if self.instances < 0:
            return []
        given = n.children[0].value if n.children else None
        title, *more = (given or "").split(",")
        title = title.strip()
        missing = [{"type": "paragraph", "content": [{"type": "unresolved", "name": "include", "argument": given}]}]
        if not title:
            self.problems.append((n.start, "invalid-macro-argument", "include"))
            return missing
        self.asked["include"].add(title)
        source = self.c.templates.get(title)
        if source is None:
            self.problems.append((n.start, "include-target-missing", title))
            return missing
        scope = {"calleeTitle": self.c.title} | {k.strip(): v.strip() for k, s, v in (m.partition("=") for m in more) if s}
        self.instances += 1
        inner = _Included(self)
        return inner.blocks(self.c.template(source).children, scope)


class _Included(Resolver):
    """Reads a template for a page: what it finds belongs to the page, but includes and problems of its own count for nothing."""

    def __init__(self, page: Resolver):
        self.c, self.categories, self.asked, self.instances = page.c, page.categories, page.asked, page.instances
        self.redirect, self.problems = None, []

    def include(self, n: Node) -> list[dict]:
        return []


def table_property(name: str, value: str) -> dict | None:
    """`bgcolor=red`, `tablewidth=50%` and the like: what they set and for what; None if the name or the value isn't known."""
    name, value = name.replace(" ", "").lower(), value.strip().strip('"')
    scope = next((k for k in ("table", "row", "col") if name.startswith(k) and name not in ("color",)), "")
    what, first = name[len(scope) :], value.split(",")[0]
    if what in ("bgcolor", "color", "bordercolor"):
        shade = colour(first)
        p = shade and {"type": {"bgcolor": "backgroundColor", "color": "color", "bordercolor": "borderColor"}[what], "color": shade}
    elif what in ("width", "height"):
        p = {"type": what, what: dimension(value)}
    elif what in ("textalign", "align"):
        p = {"type": "textAlign" if what == "textalign" else "align", "alignment": value} if value in ("left", "center", "right") else None
    else:
        p = None
    return {"scope": {"type": {"table": "table", "row": "row", "col": "column", "": "cell"}[scope]}, "property": p} if p else None


def inherit(rows: list[dict]) -> None:
    """What a cell sets for its column holds for the cells below it, unless they set the same for themselves; columns that a cell from
    above reaches into are passed over."""
    columns: dict[int, dict[str, dict]] = {}
    taken: dict[int, int] = {}  # column to rows still reached into
    for row in rows:
        at = 0
        reached = {c for c, n in taken.items() if n > 0}
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row["cells"]:
            while at in reached:
                at += 1
            wide = cell["columnSpan"] or 1
            own = {a["property"]["type"] for a in cell["attributes"]}
            new = {a["property"]["type"]: a["property"] for a in cell["attributes"] if a["scope"]["type"] == "column"}
            cell["attributes"] += [{"scope": {"type": "cell"}, "property": p} for k, p in columns.get(at, {}).items() if k not in own]
            for c in range(at, at + wide):
                columns[c] = columns.get(c, {}) | new
                if (cell["rowSpan"] or 1) > 1:
                    taken[c] = cell["rowSpan"] - 1
            at += wide


class Layout:
    """Numbers of headings and footnotes, in the order of the page."""

    def __init__(self):
        self.stack: list[list[int]] = []
        self.contents: list[dict] = []
        self.footnotes: list[dict] = []
        self.waiting: list[dict] = []
        self.named: dict[str | None, dict] = {}  # of those that wait, by label
        self.references = 0

    def walk(self, nodes: list[dict]) -> None:
        for x in nodes:
            kind = x["type"]
            if kind == "text" or kind == "lineBreak":
                continue
            if kind == "heading":
                while self.stack and self.stack[-1][0] > x["level"]:
                    self.stack.pop()
                if self.stack and self.stack[-1][0] == x["level"]:
                    self.stack[-1][1] += 1
                else:
                    self.stack.append([x["level"], 1])
                x["number"] = ".".join(str(n) for _, n in self.stack)
                self.walk(x["content"])
                x["anchor"] = text_of(x["content"])
                self.contents.append({"number": x["number"], "depth": len(self.stack), "title": contents_title(x["content"])})
            elif kind == "footnote":
                self.note(x)
            elif kind == "footnoteSection":
                x["notes"] = self.flush()
            elif kind == "table":
                if x["table"]["caption"]:
                    self.walk(x["table"]["caption"])
                for row in x["table"]["rows"]:
                    for cell in row["cells"]:
                        self.walk(cell["blocks"])
            elif kind == "list":
                for item in x["items"]:
                    self.walk(item["blocks"])
            else:
                for part in ("content", "display", "blocks"):
                    if isinstance(x.get(part), list):
                        self.walk(x[part])

    def note(self, x: dict) -> None:
        name, content = x.pop("name"), x.pop("content")
        self.walk(content)
        self.references += 1
        number = self.references
        known = self.named.get(name)
        if known:
            known["referenceNumbers"].append(number)
            known["content"] = known["content"] or content
        else:
            known = {"label": name or str(number), "referenceNumbers": [number], "content": content}
            self.waiting.append(known)
            self.named.setdefault(known["label"], known)
        x |= {"type": "footnoteReference", "label": known["label"], "number": number, "tooltip": text_of(known["content"])}

    def flush(self) -> list[int]:
        first = len(self.footnotes)
        self.footnotes += self.waiting
        self.waiting, self.named = [], {}
        return list(range(first, len(self.footnotes)))


def resolve(source: str, context: Context) -> tuple[dict, Resolver]:
    """The page's tree, and the resolver that knows what was asked."""
    r, layout = Resolver(context), Layout()
    blocks = r.blocks(M.parse(source).children, None)
    layout.walk(blocks)
    if layout.waiting:  # what no macro has shown stands at the end
        blocks.append({"type": "paragraph", "content": [{"type": "footnoteSection", "notes": layout.flush()}]})
    return {"redirect": r.redirect, "blocks": blocks, "categories": r.categories, "tableOfContents": layout.contents, "footnotes": layout.footnotes}, r


#: What a tree of to_json() has asked in vain. Inside of strings quotes are escaped, so that only a node's own keys are met.
_OPEN = re.compile(rf'"type": "(?:documentLink", "title": ({STRING}), "anchor": (?:null|{STRING}), "kind": "missing"|image", "fileName": ({STRING}), "url": null)')


def answered_in(tree: str, links: Iterable[str], images: dict[str, str]) -> str:
    """The JSON of a tree with answers to what it asked: links to pages that are there, images with their addresses."""
    there, urls = set(map(to_json, links)), {to_json(name): to_json(url) for name, url in images.items()}

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return f'{m[0][:-9]}"existing"' if m[1] in there else m[0]
        return f"{m[0][:-4]}{urls[m[2]]}" if m[2] in urls else m[0]

    return _OPEN.sub(one, tree) if there or urls else tree


def references(source: str, context: Context) -> list[tuple[str, str]]:
    """(kind, target) of what the page asks for when it is rendered: links to other pages, includes, files, categories, a redirect."""
    tree, r = resolve(source, context)
    out = {(kind, t) for kind, titles in r.asked.items() for t in titles} | {("category", c) for c in tree["categories"]}
    if tree["redirect"]:
        out.add(("redirect", split_anchor(tree["redirect"])[0]))
    return sorted(out)
