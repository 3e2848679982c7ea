"""HTML of a page from its tree (functions/resolve.py). Class names, addresses and the places of attributes are the wiki's own; text and
values are escaped, and what a page wrote as HTML has passed the sanitizer already.

Defined results: a tree without blocks and categories gives an empty text; what could not be resolved is shown as it was written.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape
from urllib.parse import quote

from .resolve import Context, resolve

#: Elements and class names of the wiki's markup.
STYLES = {"bold": "strong", "italic": "em", "strikethrough": "del", "underline": "u", "superscript": "sup", "subscript": "sub"}
LISTS = {
    "unordered": "wiki-list", "decimal": "wiki-list wiki-list", "lowerAlphabet": "wiki-list wiki-list-alpha", "upperAlphabet": "wiki-list wiki-list-upper-alpha", "lowerRoman": "wiki-list wiki-list-roman", "upperRoman": "wiki-list wiki-list-upper-roman",
}
LINKS = {"existing": "wiki-link-internal", "missing": "wiki-link-internal not-exist", "current": "wiki-self-link"}
PLAYERS = {"youtube": "//www.youtube.com/embed/", "kakaotv": "//tv.kakao.com/embed/player/cliplink/", "nicovideo": "//embed.nicovideo.jp/watch/"}
CATEGORY, FILE = "분류:", "파일:"
#: What table properties are in CSS, and which of them count for cells and rows.
CSS = {"backgroundColor": ("background-color", "color"), "color": ("color", "color"), "width": ("width", "width"), "height": ("height", "height"), "textAlign": ("text-align", "alignment")}

Attributes = dict[str, str | None]


def path_of(title: str, anchor: str | None = None) -> str:
    """Where a page is, and a place in it."""
    coded = lambda text: quote(text, safe="~:/()")
    return (f"/w/{coded(title)}" if title else "") + (f"#{coded(anchor)}" if anchor is not None else "")


def declared(style: list[dict]) -> str:
    return "; ".join(f"{d['property']}: {d['value']}" for d in style)


class Emitter:
    """Each kind of block and inline has a method of its name; all write to one list."""

    def __init__(self, tree: dict):
        self.tree, self.out = tree, []

    # --- elements ---------------------------------------------------------------------------------------------------

    def text(self, text: str) -> None:
        self.out.append(escape(text, quote=False))

    def start(self, name: str, attributes: Attributes | None = None) -> None:
        """None leaves an attribute out; True is a flag."""
        shown = "".join(f" {k}" if v is True else f' {k}="{escape(str(v))}"' for k, v in (attributes or {}).items() if v is not None)
        self.out.append(f"<{name}{shown}>")

    def element(self, name: str, attributes: Attributes | None, inside: Callable[[], None] | str | None, end: str = "") -> None:
        self.start(name, attributes)
        if callable(inside):
            inside()
        elif inside:
            self.text(inside)
        self.out.append(f"</{name}>{end}")

    def all(self, nodes: list[dict]) -> None:
        for x in nodes:
            getattr(self, f"on_{x['type']}")(x)

    def into(self, nodes: list[dict]) -> Callable[[], None]:
        return lambda: self.all(nodes)

    # --- page -------------------------------------------------------------------------------------------------------

    def page(self) -> str:
        """What follows a heading stands in a section up to the next heading; the page's last footnotes stand outside of it."""
        section = False
        for b in self.tree["blocks"]:
            heads = b["type"] == "heading"
            if section and (heads or self.only_notes(b)):
                self.out.append("</div>\n")
                section = False
            self.all([b])
            if heads:
                self.start("div", {"class": "wiki-heading-content"})
                section = True
        if section:
            self.out.append("</div>\n")
        if self.tree["categories"]:
            self.element("div", {"class": "wiki-categories"}, self.categories, "\n")
        return "".join(self.out)

    @staticmethod
    def only_notes(b: dict) -> bool:
        return b["type"] == "paragraph" and [x["type"] for x in b["content"]] == ["footnoteSection"]

    def categories(self) -> None:
        self.text(CATEGORY)
        for i, name in enumerate(self.tree["categories"]):
            self.text(" | " if i else "")
            self.text(" ")
            self.element("a", {"href": "/w/" + quote(CATEGORY, safe="") + quote(name, safe="~:/()")}, name)

    # --- blocks -----------------------------------------------------------------------------------------------------

    def on_heading(self, x: dict) -> None:
        def inside() -> None:
            self.element("a", {"id": f"s-{x['number']}", "href": "#toc"}, f"{x['number']}.")
            self.text(" ")
            self.element("span", {"id": x["anchor"]}, self.into(x["content"]))

        self.element(f"h{min(max(x['level'], 1), 6)}", {"class": "wiki-heading" + (" wiki-heading-folded" if x["folded"] else "")}, inside, "\n")

    def on_paragraph(self, x: dict) -> None:
        if self.only_notes(x):
            self.all(x["content"])
        else:
            self.element("div", {"class": "wiki-paragraph"}, self.into(x["content"]), "\n")

    def on_horizontalRule(self, x: dict) -> None:  # noqa: N802
        self.start("hr")
        self.out.append("\n")

    def on_quote(self, x: dict) -> None:
        self.element("blockquote", {"class": "wiki-quote"}, self.into(x["blocks"]), "\n")

    def on_indent(self, x: dict) -> None:
        self.element("div", {"class": "wiki-indent"}, self.into(x["blocks"]), "\n")

    def on_list(self, x: dict) -> None:
        ordered = x["kind"] != "unordered"
        first = next((i["startNumber"] for i in x["items"][:1] if i["startNumber"] is not None), 1)

        def items() -> None:
            for item in x["items"]:
                self.element("li", None, self.into(item["blocks"]))

        self.element("ol" if ordered else "ul", {"class": LISTS[x["kind"]], "start": str(first) if ordered else None}, items, "\n")

    def on_table(self, x: dict) -> None:
        rows, caption = x["table"]["rows"], x["table"]["caption"]
        whole = [a["property"] for r in rows for c in r["cells"] for a in c["attributes"] if a["scope"]["type"] == "table"]
        sides = [p["alignment"] for p in whole if p["type"] == "align"]
        widths = [p["width"] for p in whole if p["type"] == "width"]
        # A width is the wrapper's, and the table fills it; sides are classes of the wrapper; the rest is the table's style.
        style = "".join(" width: 100%;" if p["type"] == "width" else f" border: 2px solid {p['color']};" if p["type"] == "borderColor" else self.css(p) for p in whole)

        def body() -> None:
            for r in rows:
                style = "".join(self.css(a["property"]) for c in r["cells"] for a in c["attributes"] if a["scope"]["type"] == "row")
                self.element("tr", {"class": "wiki-table-tr", "style": style or None}, lambda r=r: [self.cell(c) for c in r["cells"]] and None)

        def inside() -> None:
            if caption is not None:
                self.element("caption", None, self.into(caption))
            self.element("tbody", None, body)

        wrapper = {"class": "wiki-table-wrap" + (f" table-{sides[-1]}" if sides else ""), "style": "".join(f"width: {w};" for w in widths) or None}
        self.element("div", wrapper, lambda: self.element("table", {"class": "wiki-table", "style": style or None}, inside), "\n")

    @staticmethod
    def css(p: dict) -> str:
        name, value = CSS.get(p["type"], (None, None))
        return f" {name}: {p[value]};" if name else ""

    def cell(self, c: dict) -> None:
        own = {a["property"]["type"] for a in c["attributes"] if a["scope"]["type"] == "cell"}
        style = f"text-align: {c['horizontalAlignment']};" if c["horizontalAlignment"] else ""
        style += f" vertical-align: {c['verticalAlignment']};" if c["verticalAlignment"] else ""
        for a in c["attributes"]:
            # What a cell sets for itself comes before what it sets for its column.
            if a["scope"]["type"] == "cell" or a["scope"]["type"] == "column" and a["property"]["type"] not in own:
                style += self.css(a["property"])
        attributes = {"class": "wiki-table-nopadding" if "noPadding" in own else None, "colspan": c["columnSpan"], "rowspan": c["rowSpan"], "style": style}
        self.element("td", attributes, self.into(c["blocks"] or [{"type": "paragraph", "content": []}]))

    # --- inlines ----------------------------------------------------------------------------------------------------

    def on_text(self, x: dict) -> None:
        self.text(x["text"])

    def on_lineBreak(self, x: dict) -> None:  # noqa: N802
        self.start("br")

    def on_styled(self, x: dict) -> None:
        self.element(STYLES[x["style"]], None, self.into(x["content"]))

    def on_literal(self, x: dict) -> None:
        code = lambda: self.element("code", None, x["text"])
        if "\n" in x["text"]:
            self.element("pre", None, code)
        else:
            code()

    def on_codeBlock(self, x: dict) -> None:  # noqa: N802
        language = x["language"]
        self.element("pre", None, lambda: self.element("code", {"class": "hljs" if language is not None else None, "data-language": language}, x["source"]))

    def on_colored(self, x: dict) -> None:
        shade = x["color"]
        self.element("span", {"style": f"color:{shade['light']}", "data-dark-style": f"color:{shade['dark'] or shade['light']};"}, self.into(x["content"]))

    def on_sized(self, x: dict) -> None:
        n = x["level"]
        self.element("span", {"class": f"wiki-size-{'up' if n >= 0 else 'down'}-{abs(n)}"}, self.into(x["content"]))

    def on_documentLink(self, x: dict) -> None:  # noqa: N802
        attributes = {"class": LINKS[x["kind"]], "href": path_of(x["title"], x["anchor"]), "rel": "nofollow" if x["kind"] == "missing" else None, "title": x["title"]}
        self.element("a", attributes, self.into(x["display"]))

    def on_externalLink(self, x: dict) -> None:  # noqa: N802
        url, shown = x["url"], x["display"]
        image = bool(shown) and [d["type"] for d in shown] == ["image"]
        safe = "#" if url.lstrip()[:11].lower() == "javascript:" else url
        attributes = {"class": "wiki-link-external-image" if image else "wiki-link-external", "href": safe, "target": "_blank", "rel": "nofollow noopener ugc", "title": url.partition("#")[0]}
        self.element("a", attributes, self.into(shown) if shown is not None else url)

    def on_image(self, x: dict) -> None:
        name = FILE + x["fileName"]
        if x["url"] is None:
            self.element("a", {"class": LINKS["missing"], "href": path_of(name), "rel": "nofollow", "title": name}, name)
            return
        layout = x["layout"]
        style = "".join(f"{css}: {layout[k]};" for k, css in (("width", "width"), ("height", "height"), ("backgroundColor", "background-color")) if layout[k])
        full = [k for k in ("height", "width") if layout[k] is not None]  # what the outer element sets, the inner ones fill
        picture = {**dict.fromkeys(full, "100%"), "src": x["url"], "alt": name}
        wrapper = {"class": "wiki-image-wrapper", "style": " ".join(f"{k}: 100%;" for k in full) or None}
        outer = {"class": f"wiki-image-align-{layout['align'] or 'normal'}" + (f" wiki-theme-{layout['theme']}" if layout["theme"] else ""), "style": style}
        self.element("span", outer, lambda: self.element("span", wrapper, lambda: self.start("img", picture)))

    def on_footnoteReference(self, x: dict) -> None:  # noqa: N802
        def inside() -> None:
            self.element("span", {"id": f"rfn-{x['number']}"}, None)
            self.text(f"[{x['label']}]")

        coded = re.sub(r"%..", lambda m: m[0].lower(), quote(x["label"], safe="~"))
        self.element("a", {"class": "wiki-fn-content", "title": x["tooltip"], "href": f"#fn-{coded}"}, inside)

    def on_footnoteSection(self, x: dict) -> None:  # noqa: N802
        known = self.tree["footnotes"]
        notes = [known[i] for i in x["notes"] if i < len(known)]
        if notes:
            self.element("div", {"class": "wiki-macro-footnote"}, lambda: [self.note(n) for n in notes] and None, "\n")

    def note(self, n: dict) -> None:
        def inside() -> None:
            self.element("span", {"id": f"fn-{n['label']}"}, None)
            numbers = n["referenceNumbers"]
            if len(numbers) == 1:  # the label itself leads back
                self.element("a", {"href": f"#rfn-{numbers[0]}"}, f"[{n['label']}]")
            else:
                self.text(f"[{n['label']}]")
                for i, number in enumerate(numbers, 1):
                    self.text(" ")
                    self.element("a", {"href": f"#rfn-{number}"}, lambda i=i: self.element("sup", None, f"{numbers[0]}.{i}"))
            self.text(" ")
            self.all(n["content"])

        self.element("span", {"class": "footnote-list"}, inside)

    def on_footnote(self, x: dict) -> None:
        """Laid out as a reference everywhere."""

    def on_video(self, x: dict) -> None:
        source = PLAYERS[x["provider"].lower()] + quote(x["identifier"], safe="~:/()")
        attributes = {"class": "wiki-media", "src": source, "width": x["width"] or "640", "height": x["height"] or "360", "frameborder": "0", "allowfullscreen": True, "loading": "lazy"}
        self.element("iframe", attributes, None)

    def on_ruby(self, x: dict) -> None:
        def inside() -> None:
            self.text(x["content"])
            self.element("rp", None, "(")
            above = (lambda: self.element("span", {"style": f"color:{x['color']}"}, x["ruby"])) if x["color"] else x["ruby"]
            self.element("rt", None, above)
            self.element("rp", None, ")")

        self.element("ruby", None, inside)

    def on_math(self, x: dict) -> None:
        self.element("span", {"class": "wiki-math", "data-formula": x["formula"]}, f"\\({x['formula']}\\)")

    def on_anchor(self, x: dict) -> None:
        self.element("a", {"id": x["name"]}, None)

    def flowing(self, blocks: list[dict]) -> None:
        """Blocks within a frame: paragraphs have no element of their own, and one that follows something begins on a new line."""
        for i, b in enumerate(blocks):
            if b["type"] == "paragraph":
                if i:
                    self.start("br")
                self.all(b["content"])
            else:
                self.all([b])

    def on_wikiStyle(self, x: dict) -> None:  # noqa: N802
        attributes = {"style": declared(x["style"]) or None, "data-dark-style": declared(x["darkStyle"]) or None}
        self.element("div", attributes, lambda: self.flowing(x["blocks"]))

    def on_folding(self, x: dict) -> None:
        def inside() -> None:
            self.element("summary", None, x["summary"] or "More")
            self.element("div", None, lambda: self.flowing(x["blocks"]))

        self.element("details", {"class": "wiki-folding"}, inside)

    def on_blocks(self, x: dict) -> None:
        self.all(x["blocks"])

    def on_html(self, x: dict) -> None:
        hard = lambda m: "<a" + re.sub(r' class="[^"]*"', "", m[1]) + ' target="_blank" rel="nofollow noopener ugc" class="wiki-link-external">'
        self.out.append(re.sub(r"<a((?: [^<>]*)?)>", hard, x["html"]))

    def on_clearFix(self, x: dict) -> None:  # noqa: N802
        self.element("div", {"class": "wiki-clearfix"}, None)

    def on_unresolved(self, x: dict) -> None:
        self.text(f"[{x['name']}]" if x["argument"] is None else f"[{x['name']}({x['argument']})]")

    def on_tableOfContents(self, x: dict) -> None:  # noqa: N802
        entries = self.tree["tableOfContents"]

        def inside() -> None:
            self.element("summary", None, None)
            open_ = []  # depths of the levels that are open; those below an entry stand beside it
            for e in entries:
                while open_ and open_[-1] > e["depth"]:
                    self.out.append("</div>")
                    open_.pop()
                if not open_ or e["depth"] > open_[-1]:
                    self.start("div", {"class": "toc-indent"})
                    open_.append(e["depth"])

                def item(e=e) -> None:
                    self.element("a", {"href": f"#s-{e['number']}"}, e["number"])
                    self.text(". ")
                    self.all(e["title"])

                self.element("span", {"class": "toc-item"}, item)
            self.out.append("</div>" * len(open_))

        self.element("div", {"class": "wiki-macro-toc", "id": "toc"}, lambda: self.element("details", {"open": True}, inside), "\n")


def to_html(tree: dict) -> str:
    return Emitter(tree).page()


def render_html(source: str, context: Context | None = None) -> str:
    """A page's HTML against what is known of the wiki; nothing, if nothing is given."""
    return to_html(resolve(source, context or Context())[0])
