"""Structural fingerprints of rendered HTML and their differences."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .values import normal_style

SKIPPED = frozenset("script style noscript template".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Attributes that say nothing about structure, and classes of parts that belong to the screen and not to the page.
IGNORED = frozenset("id data-dark-style".split())
SCREEN = frozenset("wiki-edit-section wiki-categories".split())


def unwrapped(tag: str, attributes: dict[str, str]) -> bool:
    """Spans that only anchor a paragraph or colour a word of code."""
    return tag == "span" and ("id" in attributes and not {"style", "class"} & set(attributes) or any(c.startswith("hljs-") for c in attributes.get("class", "").split()))


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.stack: list[tuple[str, bool]] = []  # element, whether it leaves a line
        self.skipping: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if self.skipping or tag in SKIPPED or SCREEN & set(given.get("class", "").split()):
            if tag not in EMPTY:
                self.skipping.append(tag)
            return
        shown = not unwrapped(tag, given)
        if shown:
            kept = {k: normal_style(v) if k == "style" else " ".join(v.split()) for k, v in given.items() if k not in IGNORED and not k.startswith(("on", "data-v-"))}
            self.lines.append(f"<{tag}{''.join(f' {k}={v}' for k, v in sorted(kept.items()) if k != 'style' or v)}>")
        if tag not in EMPTY:
            self.stack.append((tag, shown))

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
        elif any(t == tag for t, _ in self.stack):
            while True:
                top, shown = self.stack.pop()
                if shown:
                    self.lines.append(f"</{top}>")
                if top == tag:
                    break

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and not self.skipping:
            if self.lines and not self.lines[-1].startswith("<"):
                self.lines[-1] += " " + text
            else:
                self.lines.append(text)


def fingerprint(source: str) -> list[str]:
    """One line for each tag and text, in order: names and attributes without looks, text with single spaces."""
    p = _Lines()
    p.feed(source)
    p.close()
    return p.lines + [f"</{t}>" for t, shown in reversed(p.stack) if shown]


def differences(left: list[str], right: list[str], window: int = 8, known: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Pairs (left, right) that differ, an empty side for what is missing; sides meet again within window lines. Pairs in which a
    known text stands are left out."""
    out, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i] == right[j]:
            i, j = i + 1, j + 1
            continue
        meet = next(((d, a) for d in range(1, 2 * window) for a in range(max(0, d - window), min(d, window) + 1) if i + a < len(left) and j + d - a < len(right) and left[i + a] == right[j + d - a]), None)
        a, b = (meet[1], meet[0] - meet[1]) if meet else (min(1, len(left) - i), min(1, len(right) - j))
        for k in range(max(a, b)):
            out.append((left[i + k] if k < a else "", right[j + k] if k < b else ""))
        i, j = i + a, j + b
    return [p for p in out if not any(k in p[0] or k in p[1] for k in known)]


def kind_of(pair: tuple[str, str]) -> str:
    name = lambda s: (re.match(r"</?[\w-]+", s) or [""])[0] + (">" if s.startswith("<") else "") or ("text" if s else "nothing")
    return f"{name(pair[0])} / {name(pair[1])}"

