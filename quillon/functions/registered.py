"""The text functions under names in SQL: scalar functions in Arrow batches, and table functions for LATERAL joins."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import diff as D
from . import emit as E
from . import markup as M
from .condition import evaluate
from .values import html_style, wiki_style


def address_bits(address: str | None) -> str | None:
    """The family of an address, 4 or 6, and its bits as digits; None if it can't be read."""
    try:
        ip = ipaddress.ip_address((address or "").strip())
    except ValueError:
        return None
    return f"{ip.version}{int(ip):0{ip.max_prefixlen}b}"


def network_bits(network: str | None) -> str | None:
    """The family of a network and the bits that its addresses share; None if it can't be read."""
    try:
        net = ipaddress.ip_network((network or "").strip(), strict=False)
    except ValueError:
        return None
    return f"{net.version}{int(net.network_address):0{net.max_prefixlen}b}"[: 1 + net.prefixlen]


def contains(network: str | None, address: str | None) -> bool:
    bits, shared = address_bits(address), network_bits(network)
    return bits is not None and shared is not None and bits.startswith(shared)


def _each(make, *columns: pd.Series) -> pd.Series:
    return pd.Series([make(*(None if pd.isna(v) else v for v in row)) for row in zip(*columns, strict=True)], dtype=object)


def render_html(text: pd.Series) -> pd.Series:
    return _each(lambda t: E.render_html(t or ""), text)


def render_json(text: pd.Series) -> pd.Series:
    return _each(lambda t: M.tree_json(t or ""), text)


def plain_text(text: pd.Series) -> pd.Series:
    return _each(lambda t: M.plain_text(M.parse(t or "")), text)


def sanitize_html(html: pd.Series) -> pd.Series:
    return _each(lambda t: M.sanitize(t or ""), html)


def eval_condition(condition: pd.Series) -> pd.Series:
    return _each(lambda t: evaluate(t or "", {}) is not None, condition)


def merge3(base: pd.Series, current: pd.Series, proposed: pd.Series) -> pd.DataFrame:
    rows = [D.merge3(*(v or "" for v in row)) for row in zip(base, current, proposed, strict=True)]
    return pd.DataFrame(rows, columns=["merged", "conflict"])


def diff_lines(before: pd.Series, after: pd.Series) -> pd.Series:
    return _each(lambda a, b: [{"op": op, "line": line} for op, line in D.diff_lines(a or "", b or "")], before, after)


def cidr_contains(network: pd.Series, address: pd.Series) -> pd.Series:
    return _each(contains, network, address)


def ip_bits(address: pd.Series) -> pd.Series:
    return _each(address_bits, address)


def net_bits(network: pd.Series) -> pd.Series:
    return _each(network_bits, network)


def taken_style(style: pd.Series, kind: pd.Series) -> pd.Series:
    """The declarations that are taken of a style, of a wiki group or of an html element; null if all of it is refused."""

    def one(s: str | None, k: str | None) -> str | None:
        taken = (wiki_style if k == "wiki" else html_style)(s or "")
        return None if taken is None else "; ".join(f"{p}: {v}" for p, v in taken)

    return _each(one, style, kind)


class ParseTokens:
    def eval(self, text: str):
        yield from M.token_rows(text or "")


class ScanRefs:
    def eval(self, title: str, text: str):
        yield from M.references(text or "", title or "")


class Diagnose:
    def eval(self, text: str):
        yield from M.diagnostics(text or "")


class Outline:
    def eval(self, text: str):
        yield from M.outline(text or "")


#: Name to function and type of its results.
SCALARS = {
    "render_html": (render_html, "string"),
    "render_json": (render_json, "string"),
    "plain_text": (plain_text, "string"),
    "sanitize_html": (sanitize_html, "string"),
    "eval_condition": (eval_condition, "boolean"),
    "merge3": (merge3, "merged string, conflict boolean"),
    "diff_lines": (diff_lines, "array<struct<op: string, line: string>>"),
    "cidr_contains": (cidr_contains, "boolean"),
    "ip_bits": (ip_bits, "string"),
    "net_bits": (net_bits, "string"),
    "taken_style": (taken_style, "string"),
}
TABLES = {
    "parse_tokens": (ParseTokens, "pos int, kind string, parent string, start int, end int, text string"),
    "scan_refs": (ScanRefs, "kind string, target string"),
    "diagnose": (Diagnose, "start int, code string, detail string"),
    "outline": (Outline, "number string, level int, title string"),
}


def scalar(name: str):
    """One of SCALARS as a function of columns; made once there is a session."""
    function, kind = SCALARS[name]
    return F.pandas_udf(function, returnType=kind)


def register(spark: SparkSession) -> None:
    """Makes all of them known to SQL of this session."""
    for name in SCALARS:
        spark.udf.register(name, scalar(name))
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
