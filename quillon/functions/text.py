"""Text functions of a wiki as column expressions, and line-level readers of markup built from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KNOWN = ("template", "category", "file")
MAIN = "문서"
#: Markers that should not be left in plain text.
MARKERS = (("n_link_open", "[["), ("n_link_close", "]]"), ("n_brace_open", "{{{"), ("n_brace_close", "}}}"), ("n_bold", "'''"), ("n_table", "||"), ("n_note", "[*"), ("n_hashbang", "#!"))


def parse_title(raw: Column) -> tuple[Column, Column]:
    """Namespace and bare title: the part before the first colon counts if it is a known namespace; the main one's is dropped."""
    t = F.trim(raw)
    prefix, has = F.split_part(t, F.lit(":"), F.lit(1)), F.contains(t, F.lit(":"))
    rest = F.trim(F.substr(t, F.instr(t, ":") + 1))
    return F.when(has & prefix.isin(*KNOWN), prefix).otherwise("main").alias("namespace"), F.when(has & prefix.isin(MAIN, *KNOWN), rest).otherwise(t).alias("title")


def relative_title(target: Column, page: Column) -> Column:
    """`문서:` wins; `../x` hangs on the parent of the page, `/x` on the page; anything else stands as it is."""
    rest = F.substr(target, F.lit(4))
    slash = F.length(page) - F.length(F.substring_index(page, "/", -1))
    parent = F.when(F.contains(page, F.lit("/")), F.substr(page, F.lit(1), slash - 1)).otherwise(page)
    up = F.when(F.length(rest) > 0, F.concat(parent, F.lit("/"), rest)).otherwise(parent)
    return F.when(F.startswith(target, F.lit("문서:")), rest).when(F.startswith(target, F.lit("../")), up).when(F.startswith(target, F.lit("/")), F.concat(page, target)).otherwise(target)


def percent_encode(c: Column) -> Column:
    """RFC 3986: everything but unreserved characters as %XX of UTF-8."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_encode_path(c: Column) -> Column:
    """Of a page's path: the marks of namespaces, subpages and brackets stay as they are, too."""
    c = percent_encode(c)
    for shown, plain in (("%3A", ":"), ("%2F", "/"), ("%28", "("), ("%29", ")")):
        c = F.replace(c, F.lit(shown), F.lit(plain))
    return c


#: Characters that an anchor keeps.
UNRESERVED = "".join(chr(b) for b in range(128) if chr(b).isalnum() or chr(b) in "-_.~")
_SHOWN = [chr(b) if chr(b) in UNRESERVED else f"%{b:02x}" for b in range(256)]


def percent_encode_anchor(c: Column) -> Column:
    """Everything but unreserved characters as lower-case %xx of UTF-8: a byte at a time by one table."""

    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shown = _SHOWN.__getitem__
        for batch in texts:
            yield pa.array([None if t is None else "".join(map(shown, t.encode())) for t in batch.to_pylist()], pa.string())

    return F.arrow_udf(encode, returnType="string")(c)


def escape_text(c: Column) -> Column:
    """Of text between tags: quotes stay."""
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    return c


def escape_attribute(c: Column) -> Column:
    return F.replace(F.replace(escape_text(c), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))


def age(birth: Column, now: Column) -> Column:
    early = (F.month(now) * 100 + F.day(now)) < (F.month(birth) * 100 + F.day(birth))
    return F.year(now) - F.year(birth) - early.cast("int")


def dday(target: Column, now: Column) -> Column:
    n = F.datediff(now, target)
    return F.when(n == 0, "D-Day").when(n > 0, F.concat(F.lit("D+"), n.cast("string"))).otherwise(F.concat(F.lit("D"), n.cast("string")))


def julian_day(d: Column) -> Column:
    return F.datediff(d, F.lit("1970-01-01").cast("date")) + 2440588


def headings(d: DataFrame) -> DataFrame:
    """id, n, level, heading, folded of (id, text): lines with the same marks at both ends, one space inside each; `==# x #==` is
    folded. A null or heading-free text has no row."""
    lines = d.select("id", F.posexplode(F.split("text", "\r?\n")).alias("p", "l")).where(F.rlike("l", F.lit(r"^(={1,6})(#?) (.+) \2\1$")))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("p")).cast("long")
    part = lambda k: F.regexp_extract("l", r"^(={1,6})(#?) (.+) \2\1$", k)
    return lines.select("id", nth.alias("n"), F.length(part(1)).cast("long").alias("level"), part(3).alias("heading"), (part(2) == "#").alias("folded"))


def level_skips(h: DataFrame) -> DataFrame:
    before = F.lag("level").over(Window.partitionBy("id").orderBy("n"))
    return h.select("id", "n", "level", before.alias("before")).where("level > before + 1")


def links(d: DataFrame) -> DataFrame:
    inner = F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]]*)\]\]"), F.lit(1)))
    return d.select("id", inner.alias("x")).select("id", F.substring_index("x", "|", 1).alias("target"))


def redirects(d: DataFrame) -> DataFrame:
    """id, target, anchor: the first line that is a redirect, cut at its last `#`; without one the anchor is null."""
    found = F.trim(F.regexp_extract("text", r"(?m)^#(?:redirect|넘겨주기) ([^\n]*)", 1))
    d = d.withColumn("x", found).where("x <> ''")
    anchor = F.nullif(F.substring_index("x", "#", -1), F.lit(""))
    return d.select("id", F.regexp_replace("x", "#[^#]*$", "").alias("target"), F.when(F.contains("x", F.lit("#")), anchor).alias("anchor"))


def residue(d: DataFrame) -> DataFrame:
    """Markers left in a text, not overlapping."""
    count = lambda m: ((F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))) / len(m)).cast("long")
    return d.select("id", *[count(m).alias(n) for n, m in MARKERS])
