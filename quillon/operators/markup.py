"""The markup functions over tables of (id, text), in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import diff as D
from ..functions import emit as E
from ..functions import fingerprint as H
from ..functions import markup as M
from ..functions.condition import evaluate

#: Characters of text whose rows are held at once.
STEP = 1_000_000


def rows_of(d: DataFrame, columns: list[str], make: Callable[..., Iterable[tuple]], schema: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """make(text columns) gives rows; each comes with its keys (longs). Nulls are empty texts; a row whose key is null keeps it; other
    columns are ignored; repeated rows are worked on one by one."""
    kind = StructType.fromDDL(", ".join([*(f"{k} long" for k in keys), schema]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(kind)
        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns_out = list(zip(*out, strict=True)) or [[] for _ in out_schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_out, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            out, size = [], 0
            for values in zip(*(batch.column(c) for c in [*keys, *columns]), strict=True):
                key = tuple(v.as_py() for v in values[: len(keys)])
                texts = [v.as_py() or "" for v in values[len(keys) :]]
                size += sum(map(len, texts))
                for row in make(*texts):
                    out.append((*key, *row))
                    size += sum(len(v) for v in row if isinstance(v, str))
                    if size >= STEP:  # whole texts: the rows of a batch go out in parts
                        yield packed(out)
                        out, size = [], 0
            yield packed(out)

    return d.select(*(F.col(k).cast("long").alias(k) for k in keys), *columns).mapInArrow(run, kind)


def parse_tokens(d: DataFrame) -> DataFrame:
    return rows_of(d, ["text"], M.token_rows, "pos int, kind string, parent string, start int, end int, text string")


def scan_references(d: DataFrame, page: str = "Page/Sub") -> DataFrame:
    return rows_of(d, ["text"], lambda t: M.references(t, page), "kind string, target string")


def diagnose(d: DataFrame) -> DataFrame:
    """What can be said of a page without knowing others, where, and how grave it is."""
    return rows_of(d, ["text"], M.graded, "start int, end int, code string, severity string, category string, detail string")


def render_html(d: DataFrame) -> DataFrame:
    return rows_of(d, ["text"], lambda t: [(E.render_html(t),)], "html string")


def plain_text(d: DataFrame) -> DataFrame:
    return rows_of(d, ["text"], lambda t: [(M.plain_text(M.parse(t)),)], "plain string")


def sanitize(d: DataFrame) -> DataFrame:
    return rows_of(d, ["text"], lambda t: [(M.sanitize(t),)], "html string")


def diff_lines(d: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of (keys, before, after): numbered lines with = - or +."""
    return rows_of(d, ["before", "after"], lambda a, b: [(i, op, line) for i, (op, line) in enumerate(D.diff_lines(a, b))], "n int, op string, line string", keys)


def diff_hunks(d: DataFrame, keys: tuple[str, ...] = ("id",), context: int = 3) -> DataFrame:
    """Of (keys, before, after): the lines of unified hunks, by number of hunk, with where each side's hunk begins."""
    return rows_of(d, ["before", "after"], lambda a, b: D.hunks(a, b, context), "hunk int, old_start int, new_start int, op string, line string", keys)


def merge_edits(d: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Of (keys, base, current, proposed): both changes together, or with marks of conflict."""
    return rows_of(d, ["base", "current", "proposed"], lambda o, a, b: [D.merge3(o, a, b)], "merged string, conflict boolean", keys)


def render_json(d: DataFrame) -> DataFrame:
    return rows_of(d, ["text"], lambda t: [(M.tree_json(t),)], "tree string")


def expand_includes(d: DataFrame, templates: dict[str, str]) -> DataFrame:
    """templates: those that the pages ask for, a bounded choice made by the caller."""
    return rows_of(d, ["text"], lambda t: [(M.expand(t, templates),)], "text string")


def conditions(d: DataFrame, bindings: dict) -> DataFrame:
    """Of (id, text): whether the condition holds, and the bindings it leaves as sorted name=value texts."""

    def run(text: str) -> list[tuple]:
        bound = evaluate(text, bindings)
        return [(bound is not None, sorted(f"{k}={v}" for k, v in (bound or {}).items()))]

    return rows_of(d, ["text"], run, "holds boolean, names array<string>")


def html_differences(d: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Of (id, left, right): each pair of fingerprint lines that differ, with its kind."""
    return rows_of(d, ["left", "right"], lambda a, b: [(*p, H.kind_of(p)) for p in H.differences(H.fingerprint(a), H.fingerprint(b), known=known)], "left string, right string, kind string")
