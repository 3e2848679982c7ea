"""Values inside markup: colours, sizes, styles and character references."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The colour names of CSS.
COLOURS = frozenset((
    "aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral "
    "cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange "
    "darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey "
    "dodgerblue firebrick floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo "
    "ivory khaki lavender lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink "
    "lightsalmon lightseagreen lightskyblue lightslategray lightslategrey lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine "
    "mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose "
    "moccasin navajowhite navy oldlace olive olivedrab orange orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff "
    "peru pink plum powderblue purple rebeccapurple red rosybrown royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue "
    "slategray slategrey snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white whitesmoke yellow yellowgreen "
).split())
#: What `display` may be.
DISPLAYS = frozenset("block contents flex flow-root grid inline inline-block inline-flex inline-grid inline-table list-item none table table-caption table-cell table-column table-column-group table-footer-group table-header-group table-row table-row-group".split())
#: What makes a style call code.
CODE = ("url(", "expression(", "javascript:", "@import", "behavior:")
#: The character references that have names.
ENTITIES = {"nbsp": "\u00a0", "ZeroWidthSpace": "\u200b", "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "ensp": "\u2002", "emsp": "\u2003", "thinsp": "\u2009", "shy": "\u00ad", "middot": "\u00b7", "hellip": "\u2026", "mdash": "\u2014", "ndash": "\u2013", "commat": "@"}


def colour(source: str) -> str | None:
    """`#fff` and `#FF0000` as six small digits, a colour's name as it is; None for anything else."""
    s = source.strip()
    if re.fullmatch(r"#[0-9a-fA-F]{3}", s):
        return "#" + "".join(c + c for c in s[1:].lower())
    if re.fullmatch(r"#[0-9a-fA-F]{6}", s):
        return s.lower()
    return s if s.lower() in COLOURS or s.lower() == "transparent" else None


def colour_of(c: Column) -> Column:
    """The same as a column expression."""
    s, lower = F.trim(c), F.lower(F.trim(c))
    short = F.regexp_replace(lower, "^#(.)(.)(.)$", "#$1$1$2$2$3$3")
    return F.when(F.rlike(lower, F.lit("^#[0-9a-f]{3}$")), short).when(F.rlike(lower, F.lit("^#[0-9a-f]{6}$")), lower).when(lower.isin(*sorted(COLOURS), "transparent"), s)


def colours(specification: str) -> tuple[str, str | None] | None:
    """`#red` or `#red,#000`: light and dark."""
    if not specification.startswith("#"):
        return None
    read = lambda s: colour(s) if re.fullmatch(r"#[0-9a-fA-F]+", s) and colour(s) else s[1:] if s[:1] == "#" and s[1:].lower() in COLOURS else None
    light, comma, dark = specification.partition(",")
    both = read(light), read(dark) if comma else None
    return None if both[0] is None or comma and both[1] is None else both


def _pixels(digits: str) -> str | None:
    m = re.fullmatch(r"\s*\+?(\d*)(?:\.\d*)?\s*", digits)
    return f"{int(m[1] or 0)}px" if m and re.search(r"\d", digits) else None


def dimension(source: str, image: bool = False) -> str:
    """`50%` and `50px` without fractions, a bare whole number in pixels, of an image any bare number; anything else as it is."""
    s = source.strip()
    if re.fullmatch(r"\d+%", s):
        return f"{int(s[:-1])}%"
    if s.endswith("px") and (p := _pixels(s[:-2])):
        return p
    if image:
        return _pixels(s) or s
    return f"{int(s)}px" if re.fullmatch(r"\d+", s) else s


def dimension_of(c: Column) -> Column:
    """The same as a column expression, for cells of tables."""
    s = F.trim(c)
    whole = lambda pattern: F.regexp_replace(F.regexp_extract(s, pattern, 1), "^0+(?=.)", "")
    return F.when(F.rlike(s, F.lit(r"^[0-9]+%$")), F.concat(whole(r"^([0-9]+)%$"), F.lit("%"))).when(F.rlike(s, F.lit(r"^[0-9]+(?:\.[0-9]*)?px$")), F.concat(whole(r"^([0-9]+)"), F.lit("px"))).when(F.rlike(s, F.lit(r"^[0-9]+$")), F.concat(whole(r"^([0-9]+)$"), F.lit("px"))).otherwise(s)


def declarations(source: str) -> list[tuple[str, str]]:
    parts = [(p.strip(), v.strip()) for p, colon, v in (d.partition(":") for d in source.split(";")) if colon]
    return [(p, v) for p, v in parts if p and v]


def nested_call(value: str) -> bool:
    depth, before = 0, " "
    for c in value:
        if c == "(":
            if depth and (before.isalnum() or before == "-"):
                return True
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        before = c
    return False


def wiki_style(source: str) -> list[tuple[str, str]]:
    """The declarations of a wiki group's style that are taken: no image-rendering, known displays, no call within a call."""
    return [(p, v) for p, v in declarations(source) if not nested_call(v) and p.lower() != "image-rendering" and (p.lower() != "display" or v.lower() in DISPLAYS)]


def html_style(source: str) -> list[tuple[str, str]] | None:
    """The declarations of an element's style; None if any of it could call code, comments aside."""
    seen = re.sub(r"/\*.*?(?:\*/|\Z)", "", source, flags=re.S).lower()
    return None if any(c in seen for c in CODE) else declarations(source)


def decoded(text: str) -> str:
    """Character references by number or by one of the known names; the semicolon may be missing."""

    def one(m: re.Match) -> str:
        name = m[1]
        try:
            if name[:2] in ("#x", "#X"):
                return chr(int(name[2:], 16)) if re.fullmatch(r"[0-9a-fA-F]+", name[2:]) and not 0xD800 <= int(name[2:], 16) < 0xE000 else m[0]
            if name[0] == "#":
                return chr(int(name[1:])) if re.fullmatch(r"[0-9]+", name[1:]) and not 0xD800 <= int(name[1:]) < 0xE000 else m[0]
        except (ValueError, OverflowError):
            return m[0]
        return ENTITIES.get(name, m[0])

    return re.sub(r"&([0-9A-Za-z#]+);?", one, text)


def strictly_decoded(text: str) -> str:
    """As a comparer of pages reads references: the semicolon must stand within twelve characters, and nbsp is a space."""
    names = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": " "}

    def one(m: re.Match) -> str:
        return names[m[1]] if m[1] in names else decoded(m[0]) if m[1][0] == "#" else m[0]

    return re.sub(r"&([^;&]{1,10});", one, text)


def normal_style(style: str) -> str:
    """Declarations in the order of their names, small letters, single spaces, colours as six digits where they are digits or rgb()."""

    def value(v: str) -> str:
        v = " ".join(v.split()).lower()
        if m := re.fullmatch(r"rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)", v):
            return "#{:02x}{:02x}{:02x}".format(*map(int, m.groups())) if max(map(int, m.groups())) < 256 else v
        return " ".join(colour(t) or t if t[:1] == "#" else t for t in v.split(" "))

    return ";".join(sorted(f"{p.lower()}:{value(v)}" for p, v in declarations(strictly_decoded(style))))
