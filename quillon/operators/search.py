"""Ranked full-text search over character bigrams and trigrams, by BM25: straight over texts, or through a stored index.

Queries are words and "phrases" with AND, OR, NOT, + (must), - (must not), brackets, field: before a word, phrase or bracket, and * for all
pages; without an operator any may match. A word or phrase matches a field (title or content) that holds all of its grams; those of a
phrase go across its spaces. namespace: and key: (namespace:title) match whole values. A page's score adds up over its fields and the
query's grams outside NOT. Order: score, namespace, title.

Defined results: null and very short texts have no grams; a word of one character matches nothing; an empty query or table finds nothing;
a query of NOT alone finds nothing. Rows of one put that share a key are one page of the index, and the one that comes last by text
counts; of several puts and removals the last call counts. Null namespaces and titles are empty ones. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifests
from ..sources.storage import stored
from .pages import live, with_titles

K1, B = 1.2, 0.75
BUCKETS = 16  # folders of an index's postings, by gram
FIELDS = ("title", "content")
WHOLE = ("namespace", "key")  # fields of one value

# --- queries ---------------------------------------------------------------------------------------------------------


def grams(word: str) -> list[str]:
    return sorted({word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)})


def query_grams(query: str) -> list[str]:
    return sorted({g for w in query.split() for g in grams(w)})


@dataclass(frozen=True)
class Word:
    """What a word or phrase asks for: all terms in one of the fields."""

    fields: tuple[str, ...]
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Every:
    """All pages."""


@dataclass(frozen=True)
class Clauses:
    """must: all of them; should: any of them, if nothing is a must; never: none of them."""

    must: tuple = ()
    should: tuple = ()
    never: tuple = ()


_TOKEN = re.compile(r'\s*(?:(?P<mark>[()])|(?P<sign>[+-](?=\S))|(?P<field>\w+):(?P<empty>(?=\s|$))?|"(?P<phrase>[^"]*)"|(?P<word>(?:\\.|[^\s()":\\])+))')


def parsed(query: str) -> Word | Every | Clauses:
    """The plan of a query, or an error that says what can't be read in it."""
    if query.count('"') % 2:
        raise ValueError("a quotation mark is not closed")
    tokens: list[tuple[str, str]] = []
    at, end = 0, len(query.rstrip())
    while at < end:
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"can't be read from {query[at:]!r} on")
        if m["empty"] is not None:
            raise ValueError(f"nothing to look for in {m['field']}")
        kind = next(k for k in ("mark", "sign", "field", "phrase", "word") if m[k] is not None)
        if kind == "field" and m["field"] not in FIELDS + WHOLE:
            raise ValueError(f"there is no field {m['field']}")
        if kind == "word" and m["word"] in ("AND", "OR", "NOT"):
            kind = m["word"]
        tokens.append((kind, re.sub(r"\\(.)", r"\1", m[kind]) if kind == "word" else m[kind if kind in m.groupdict() else "word"]))
        at = m.end()
    rest = tokens[::-1]

    def peek() -> str:
        return rest[-1][0] if rest else ""

    def either(of: str | None) -> Word | Every | Clauses:
        """Operands with or without OR between them."""
        must, should, never = [], [], []
        while True:
            sign = rest.pop()[1] if peek() == "sign" else ""
            negated = both(of)
            (must if sign == "+" else never if sign == "-" else should).append(negated)
            if peek() == "OR":
                rest.pop()
            elif not rest or rest[-1] == ("mark", ")"):
                break
        if not must and not never and len(should) == 1:
            return should[0]
        # NOT stands for its operand being absent, next to others.
        for group in (must, should):
            for c in [c for c in group if isinstance(c, Clauses) and c.never and not c.must and not c.should]:
                group.remove(c)
                never += c.never
        return Clauses(tuple(must), tuple(should), tuple(never))

    def both(of: str | None) -> Word | Every | Clauses:
        parts = [one(of)]
        while peek() == "AND":
            rest.pop()
            parts.append(one(of))
        if len(parts) == 1:
            return Clauses(never=(parts[0][1],)) if parts[0][0] else parts[0][1]
        return Clauses(must=tuple(p for gone, p in parts if not gone), never=tuple(p for gone, p in parts if gone))

    def one(of: str | None) -> tuple[bool, Word | Every | Clauses]:
        gone = False
        while peek() == "NOT":
            rest.pop()
            gone = not gone
        if not rest or peek() in ("AND", "OR") or rest[-1] == ("mark", ")"):
            raise ValueError("an operator needs a word on both sides" if rest or tokens[-1][0] in ("AND", "OR", "NOT") else "there is nothing in the brackets")
        kind, text = rest.pop()
        if kind == "field":
            if of is not None:
                raise ValueError("a field within a field")
            inner, plan = one(text)
            return gone != inner, plan
        if kind == "sign":
            inner, plan = one(of)
            return gone != (inner != (text == "-")), plan
        if kind == "mark":
            plan = either(of)
            if not rest:
                raise ValueError("brackets do not match")
            rest.pop()
            return gone, plan
        if kind == "word" and text == "*" and of is None:
            return gone, Every()
        if of in WHOLE:
            return gone, Word((of,), (text,))
        return gone, Word((of,) if of else FIELDS, tuple(grams(text)))

    if not tokens:
        return Clauses()
    plan = either(None)
    if rest:
        raise ValueError("brackets do not match")
    return plan


def wanted(plan: Word | Every | Clauses, all_of_it: bool = True) -> set[tuple[str, str]]:
    """(field, term) of a plan; only of what may add to a score, if not all of it."""
    if isinstance(plan, Word):
        return {(f, t) for f in plan.fields for t in plan.terms}
    if isinstance(plan, Clauses):
        return set().union(*(wanted(p, all_of_it) for p in plan.must + plan.should + (plan.never if all_of_it else ())))
    return set()


def matches(plan: Word | Every | Clauses, have: Callable[[str, str], Column], possible: bool = False) -> Column:
    """Whether a page matches, by which terms it has. possible: whether any page might, of which only some may have each term."""
    yes, no = F.lit(True), F.lit(False)
    if isinstance(plan, Every):
        return yes
    if isinstance(plan, Word):
        fields = [reduce(Column.__and__, [have(f, t) for t in plan.terms]) for f in plan.fields if plan.terms]
        return reduce(Column.__or__, fields) if fields else no
    parts = [matches(p, have, possible) for p in plan.must]
    if not plan.must:
        parts.append(reduce(Column.__or__, [matches(p, have, possible) for p in plan.should]) if plan.should else no)
    if not possible:
        parts += [~matches(p, have) for p in plan.never]
    return reduce(Column.__and__, parts)


# --- counts ----------------------------------------------------------------------------------------------------------


def n_grams(text: Column) -> Column:
    """How many bigrams and trigrams a text has, repeats counted."""
    n = F.coalesce(F.length(text), F.lit(0))
    return (F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).cast("long")


def times(text: Column, gram: str) -> Column:
    """How often a gram stands in a text, overlaps included: one pass over its bytes. Only grams that begin as they end can overlap
    themselves, and these are counted by a look-ahead."""
    if gram[0] == gram[-1]:
        return F.regexp_count(text, F.lit(f"(?={re.escape(gram)})")).cast("long")
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(gram), F.lit("")))
    return (gone / len(gram.encode())).cast("long")


def hits(fields: DataFrame, wanted: list[str], keys: list[str]) -> DataFrame:
    """keys, field, len, gram, tf of fields(keys, field, text); nothing is shuffled."""
    count = lambda g: F.struct(F.lit(g).alias("gram"), times(F.col("text"), g).alias("tf"))
    found = F.filter(F.array(*map(count, wanted)), lambda h: h["tf"] > 0) if wanted else F.array().cast("array<struct<gram: string, tf: bigint>>")
    return fields.select(*keys, "field", n_grams(F.col("text")).alias("len"), F.explode(found).alias("h")).select(*keys, "field", "len", "h.gram", "h.tf")


def gram_counts(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """doc_id, len, gram, tf of (doc_id, text)."""
    return hits(docs.withColumn("field", F.lit("content")), wanted, ["doc_id"]).drop("field")


def document_frequency(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("documents"))


# --- straight over texts ------------------------------------------------------------------------------------------------


def idf(n: float, df: float) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def part(weight: Column, tf: Column, length: Column, mean: Column | float) -> Column:
    """What a term adds to a page's score."""
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def search(pages: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """namespace, title, score over pages(namespace, title, content), read straight: texts are read once, for the counts of the query's
    grams; these are added up to one row of frequencies, and each page is scored where it is. Nothing is shuffled."""
    plan = parsed(query)
    terms = {f: sorted(t for g, t in wanted(plan) if g == f) for f in FIELDS + WHOLE}
    key = {"namespace": F.col("namespace"), "key": F.concat_ws(":", "namespace", "title")}
    count = lambda f, t: F.coalesce(times(F.col(f), t), F.lit(0)) if f in FIELDS else (key[f] == t).cast("long")
    counts = [F.array(*[count(f, t) for t in terms[f]]).cast("array<bigint>").alias(f"{f}_tf") for f in terms]
    d = pages.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("namespace", "title")], "content")
    seen = stored(d.select("namespace", "title", *counts, *[n_grams(F.col(f)).alias(f"{f}_len") for f in FIELDS], *[F.lit(1).alias(f"{f}_len") for f in WHOLE]))
    totals = seen.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"{f}_len").alias(f"{f}_mean") for f in terms], *[F.count_if(F.col(f"{f}_tf")[i] > 0).alias(f"{f}_{i}") for f in terms for i in range(len(terms[f]))]).first()
    tf = lambda f, t: F.col(f"{f}_tf")[terms[f].index(t)]
    score = F.lit(0.0)
    for f, t in sorted(wanted(plan, False)):
        if df := totals[f"{f}_{terms[f].index(t)}"]:
            score = score + part(F.lit(idf(totals["n"], df)), tf(f, t), F.col(f"{f}_len"), totals[f"{f}_mean"])
    found = seen.where(matches(plan, lambda f, t: tf(f, t) > 0))
    return found.select("namespace", "title", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "namespace", "title").limit(limit)


def live_pages(w) -> DataFrame:
    """namespace, title, content of all live pages."""
    return with_titles(live(w.revision).select("document_id", "content"), w.document, w.namespace).select("namespace", "title", "content")


def redirects_to(w, queries: DataFrame) -> DataFrame:
    """Of queries(query, namespace, title), titles read already: query, redirect, the shown title of the live page that is called so."""
    shown = F.when(F.col("namespace") == "main", F.col("title")).otherwise(F.concat_ws(":", "namespace", "title"))
    alive = live_pages(w).select("namespace", "title", shown.alias("redirect"))
    return queries.join(alive, ["namespace", "title"], "left").select("query", "redirect")


# --- stored index -------------------------------------------------------------------------------------------------------

RANGE = 1024  # pages whose postings lie together; a block has their places in the range
SLICE = 256  # rows that are Python's at a time, besides those of a range
FIRST = 16  # ranges that a search scores to learn what the others must reach
BLOCK = "field string, gram string, range long, pages array<smallint>, tfs array<int>, n long, top long, short long"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages(ord, namespace, title, content) in stretches in order of ord: for each term of a range of pages a row with the pages that have
    it, and what bounds its part of a score, its highest count and shortest text. Ranges of many megabytes, and those that two tasks
    read, come in several rows."""

    def packed(t: str, size: int) -> np.ndarray:
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        pairs = code[:-1] << np.uint64(21) | code[1:]
        return pairs if size == 2 else pairs[:-1] << np.uint64(21) | code[2:]

    def gram(code: int) -> str:
        out = ""
        while code:
            out = chr((code & 0x1FFFFF) - 1) + out
            code >>= 21
        return out

    def written(number: int, rows: list[tuple[int, dict[str, str]]]) -> Iterator[pa.RecordBatch]:
        lens = np.zeros(RANGE, np.int64)
        for name, size in ((f, k) for f in FIELDS for k in (2, 3)):  # one kind of grams at a time, in narrow columns
            codes, places, tfs = [], [], []
            for place, texts in rows:
                t = texts[name]
                if len(t) >= size:
                    own, n = np.unique(packed(t, size), return_counts=True)
                    codes.append(own)
                    tfs.append(n.astype(np.int32))
                    places.append(np.full(len(own), place - number * RANGE, np.int16))
                    lens[place - number * RANGE] = 2 * len(t) - 3
            if codes:
                c, o, n = map(np.concatenate, (codes, places, tfs))
                del codes, places, tfs
                order = np.argsort(c, kind="stable")
                c, o, n = c[order], o[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                yield block(number, name, [gram(int(x)) for x in c[first]], first, o, n, lens[o])
        for name in WHOLE:
            own: dict[str, list[int]] = {}
            for place, texts in rows:
                own.setdefault(texts["namespace"] if name == "namespace" else f"{texts['namespace']}:{texts['title']}", []).append(place - number * RANGE)
            if own:
                first = np.cumsum([0, *map(len, own.values())])[:-1]
                o = np.concatenate(list(own.values()))
                yield block(number, name, list(own), first, o, np.ones(len(o), np.int64), np.ones(len(o), np.int64))

    def block(number: int, name: str, terms: list[str], first: np.ndarray, o: np.ndarray, n: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.append(first, len(o)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (o.astype(np.int16), n.astype(np.int32))]
        whole = [np.diff(np.append(first, len(o))), np.maximum.reduceat(n, first), np.minimum.reduceat(k, first)]
        columns = [pa.array([name] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([number] * len(terms), pa.int64()), *lists, *(pa.array(x.astype(np.int64)) for x in whole)]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in BLOCK.split(", ")])

    number, rows, size = -1, [], 0
    slices = (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE))
    for batch in slices:
        for place, *texts in zip(*(batch.column(c).to_pylist() for c in ("ord", "namespace", "title", "content")), strict=True):
            if place // RANGE != number or size > 4_000_000:
                yield from written(number, rows)
                number, rows, size = place // RANGE, [], 0
            rows.append((place, dict(zip(("namespace", "title", "content"), (t or "" for t in texts), strict=True))))
            size += sum(len(t or "") for t in texts)
        pa.default_memory_pool().release_unused()
    yield from written(number, rows)


class Index:
    """A stored index of pages by (namespace, title).

    Puts and removals are numbered as they are called, and show after commit(), which settles each key by its last call and writes one
    segment: its pages in order of length, their postings by bucket of term and range of pages, and which pages of older segments
    it puts out of force. A manifest names the segments that count, with their statistics, and switches in one step. merge()
    writes what is in force as one segment, which replaces all others.

    A search first reads the heads of its terms' blocks: they tell the frequencies, which ranges of pages may match at all, and what each
    range can score at most. The most promising ranges are scored, and then only those whose bound reaches the last place of
    what was found. Frequencies and lengths are those of the pages in force: what pages out of force add is taken off, their lengths as
    they are put out of force, their postings as a search reads those of its terms.
    """

    KEYS = ["namespace", "title"]
    PAGE = "ord long, namespace string, title string, content string, title_len long, content_len long"
    DEAD = "segment long, ord long, title_len long, content_len long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.manifests = Manifests(spark, f"{path}/manifests")
        self._log: list[DataFrame] = []

    def segments(self) -> list[dict[str, Any]]:
        return self.manifests.newest()[1].get("segments", [])

    def _read(self, what: str, schema: str, segments: list[dict[str, Any]]) -> DataFrame:
        """Of all segments, with their numbers."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/segments/{s['number']}/{what}").withColumn("segment", F.lit(s["number"]).cast("long")) for s in segments if s[what]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, segment long")

    def _dead(self, segments: list[dict[str, Any]]) -> DataFrame | None:
        paths = [f"{self.path}/segments/{s['number']}/dead" for s in segments if s["dead"]]
        return self.spark.read.schema(self.DEAD).parquet(*paths) if paths else None

    def _alive(self, d: DataFrame, segments: list[dict[str, Any]]) -> DataFrame:
        """Rows (segment, ord, ...) of pages in force."""
        dead = self._dead(segments)
        return d if dead is None else d.join(dead.select("segment", "ord"), ["segment", "ord"], "left_anti")

    def pages(self) -> DataFrame:
        """The pages in force, with their contents."""
        segments = self.segments()
        return self._alive(self._read("pages", self.PAGE, segments), segments)

    def entries(self) -> DataFrame:
        return self.pages().select(*self.KEYS, "title_len", "content_len", "segment")

    def is_empty(self) -> bool:
        return self.pages().isEmpty()

    def _note(self, d: DataFrame, content: Column, there: bool) -> None:
        keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in self.KEYS]
        self._log.append(d.select(*keys, content.cast("string").alias("content"), F.lit(there).alias("there"), F.lit(len(self._log)).alias("call")))

    def put(self, pages: DataFrame) -> None:
        """Pages (namespace, title, content) that take the place of what the index has by their keys, after the next commit."""
        self._note(pages, F.col("content"), True)

    def remove(self, keys: DataFrame) -> None:
        self._note(keys, F.lit(None), False)

    def commit(self) -> None:
        if not self._log:
            return
        calls = reduce(DataFrame.unionByName, self._log)
        # Keys alone are grouped. Contents move only where several rows have a key.
        keys = stored(calls.groupBy(*self.KEYS).agg(F.max("call").alias("last"), F.count(F.lit(1)).alias("rows"), F.max_by("there", "call").alias("there")))
        several = keys.where("rows > 1").select(*self.KEYS, "last")
        put = calls.where("there").select(*self.KEYS, "content", "call")
        if not several.isEmpty():
            settled = put.join(several, self.KEYS).where(F.col("call") == F.col("last")).groupBy(*self.KEYS).agg(F.max("content").alias("content"))
            put = put.join(several, self.KEYS, "left_anti").select(*self.KEYS, "content").unionByName(settled)
        number, content = self.manifests.newest()
        older, number = content.get("segments", []), number + 1
        gone = self._gone()
        if older:
            out = self._alive(self._read("pages", self.PAGE, older).drop("content"), older).join(keys.select(*self.KEYS), self.KEYS, "left_semi")
            out.select(*(c.split(" ")[0] for c in self.DEAD.split(", "))).write.mode("overwrite").parquet(f"{self.path}/segments/{number}/dead")
            d = self.spark.read.schema(self.DEAD).parquet(f"{self.path}/segments/{number}/dead")
            gone = self._gone(*d.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"{f}_len"), F.lit(0)) for f in FIELDS]).first())
        new = self._segment(number, put.select(*self.KEYS, "content")) | gone
        self.manifests.publish(number, {"segments": older + [new]})
        self._log = []

    @staticmethod
    def _gone(n: int = 0, *sums: int) -> dict[str, int]:
        """What a manifest says of the pages that a segment puts out of force."""
        return {"dead": n, **{f"dead_{f}_len": k for f, k in zip(FIELDS, sums or [0] * len(FIELDS), strict=True)}}

    def merge(self) -> None:
        """Everything in force as one segment, in place of all others."""
        number = self.manifests.newest()[0] + 1
        new = self._segment(number, self.pages().select(*self.KEYS, "content")) | self._gone()
        self.manifests.publish(number, {"segments": [new]})

    def vacuum(self) -> None:
        """Deletes segments and manifests that the newest manifest doesn't need. No reader may be at work on these."""
        newest, content = self.manifests.newest()
        named = {str(s["number"]) for s in content.get("segments", [])}
        for n in self.manifests.children(f"{self.path}/segments"):
            if n not in named:
                self.manifests.delete(f"{self.path}/segments/{n}")
        for n in self.manifests.numbers():
            if n < newest:
                self.manifests.delete(f"{self.manifests.folder}/{n}")

    def _segment(self, number: int, pages: DataFrame) -> dict[str, Any]:
        """Writes a segment of pages(namespace, title, content), each key once; what the manifest says of it."""
        path = f"{self.path}/segments/{number}"
        sized = pages.select(*self.KEYS, "content", *[n_grams(F.col(f)).alias(f"{f}_len") for f in FIELDS])
        # Short texts score high: in order of length, ranges differ in what they can score. This is the one move of contents.
        order = ["content_len", *self.KEYS]
        ordered = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("ord", F.monotonically_increasing_id())
        ordered.select(*(c.split(" ")[0] for c in self.PAGE.split(", "))).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/pages")
        d = self.spark.read.schema(self.PAGE).parquet(f"{path}/pages")
        n, *sums = d.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"{f}_len"), F.lit(0)) for f in FIELDS]).first()
        rows = d.select("ord", *self.KEYS, "content").mapInArrow(blocks, BLOCK)  # files are in order of ord
        rows = rows.withColumn("bucket", F.pmod(F.hash("gram"), F.lit(BUCKETS)))
        spread = max(1, sum(sums) // (BUCKETS << 24))  # files of a bucket: some 16 million postings each
        # Terms lie sorted in their files, whose statistics then keep a search from reading other terms' rows.
        rows = rows.repartition(BUCKETS * spread, "bucket", F.pmod(F.hash("range"), F.lit(spread))).sortWithinPartitions("bucket", "gram", "field", "range")
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        return {"number": number, "pages": n, "postings": n, **{f"{f}_len": k for f, k in zip(FIELDS, sums, strict=True)}}

    def _blocks(self, terms: list[str] | None, segments: list[dict[str, Any]]) -> DataFrame:
        d = self._read("postings", f"{BLOCK}, bucket int", segments)
        if terms is None:
            return d
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "gram string").select(F.pmod(F.hash("gram"), F.lit(BUCKETS))).distinct().collect()] if terms else []
        return d.where(F.col("bucket").isin(buckets) & F.col("gram").isin(terms)) if terms else d.where("false")

    @staticmethod
    def _rows(d: DataFrame) -> DataFrame:
        place = (F.col("range") * RANGE + F.col("p.pages")).alias("ord")
        return d.select("segment", "field", "gram", "range", F.explode(F.arrays_zip("pages", "tfs")).alias("p")).select("segment", "field", "gram", place, F.col("p.tfs").cast("long").alias("tf"))

    def postings(self) -> DataFrame:
        """namespace, title, field, gram, tf of the pages in force."""
        segments = self.segments()
        rows = self._rows(self._blocks(None, segments).where(F.col("field").isin(*FIELDS)))
        return rows.join(self.pages().select("segment", "ord", *self.KEYS), ["segment", "ord"]).select(*self.KEYS, "field", "gram", "tf")

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """namespace, title, score."""
        plan, segments = parsed(query), self.segments()
        n = sum(s["pages"] - s["dead"] for s in segments)
        empty = self.spark.createDataFrame([], "namespace string, title string, score double")
        if not n or not isinstance(plan, Every) and not wanted(plan):
            return empty
        means = {f: sum(s[f"{f}_len"] - s[f"dead_{f}_len"] for s in segments) / n for f in FIELDS} | dict.fromkeys(WHOLE, 1.0)
        terms, scoring = wanted(plan), wanted(plan, False)
        of_it = reduce(Column.__or__, [(F.col("field") == f) & (F.col("gram") == t) for f, t in sorted(terms)], F.lit(False))
        all_blocks = self._blocks(sorted({t for _, t in terms}), segments).where(of_it)
        # The heads of blocks: a few numbers for each term and range.
        heads = stored(all_blocks.select("segment", "range", "field", "gram", "n", "top", "short"))
        df = heads.groupBy("field", "gram").agg(F.sum("n").alias("df"))
        dead = self._dead(segments)
        if dead is not None:
            part_of = dead.select("segment", F.floor(F.col("ord") / RANGE).alias("range")).distinct()
            gone = self._rows(all_blocks.join(part_of, ["segment", "range"], "left_semi")).join(dead, ["segment", "ord"], "left_semi").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("gone"))
            df = df.join(gone, ["field", "gram"], "left").select("field", "gram", (F.col("df") - F.coalesce("gone", F.lit(0))).alias("df"))
        weights = {(r.field, r.gram): idf(n, r.df) for r in df.collect() if r.df and (r.field, r.gram) in scoring}
        term = F.concat("field", F.lit(":"), "gram")
        weight = F.create_map(*[F.lit(x) for f, t in sorted(scoring) for x in (f"{f}:{t}", weights.get((f, t), 0.0))]) if scoring else F.create_map(F.lit(""), F.lit(0.0))
        mean = F.create_map(*[F.lit(x) for f, v in means.items() for x in (f, v or 1.0)])
        adds = lambda name, tf, field, length: F.coalesce(part(weight[name], tf, length, mean[field]), F.lit(0.0))
        have = lambda f, t: F.array_contains("have", f"{f}:{t}")
        if isinstance(plan, Every) or self._free(plan):
            ranges = None  # pages without any of the terms may match: all of them are looked at
        else:
            tops = heads.groupBy("segment", "range", "field", "gram").agg(F.max(adds(term, F.col("top"), F.col("field"), F.col("short"))).alias("most"))
            ranges = tops.groupBy("segment", "range").agg(F.collect_set(term).alias("have"), F.sum("most").alias("bound"))
            ranges = stored(ranges.where(matches(plan, have, possible=True)).select("segment", "range", "bound"))

        of_page = lambda t: F.when(t["field"] == "title", F.col("title_len")).when(t["field"] == "content", F.col("content_len")).otherwise(1)
        pages = self._read("pages", self.PAGE, segments).select("segment", "ord", *[f"{f}_len" for f in FIELDS])

        def scored(chosen: DataFrame | None) -> DataFrame:
            b = all_blocks if chosen is None else all_blocks.join(chosen.select("segment", "range"), ["segment", "range"], "left_semi")
            found = self._rows(b).groupBy("segment", "ord").agg(F.collect_list(F.struct(term.alias("term"), "field", "tf")).alias("terms"))
            have = lambda f, t: F.exists("terms", lambda x: x["term"] == f"{f}:{t}")
            if chosen is None:
                none = F.array().cast(found.schema["terms"].dataType)
                found = pages.join(found, ["segment", "ord"], "left").withColumn("terms", F.coalesce("terms", none)).where(matches(plan, have))
            else:
                found = pages.join(found.where(matches(plan, have)), ["segment", "ord"])
            score = F.aggregate("terms", F.lit(0.0), lambda sum_, t: sum_ + adds(t["term"], t["tf"], t["field"], of_page(t)))
            return self._alive(found.select("segment", "ord", F.round(score, 6).alias("score")), segments)

        def last_place(d: DataFrame) -> float | None:
            first = d.orderBy(F.desc("score")).limit(limit).agg(F.min("score"), F.count(F.lit(1))).first()
            return first[0] if first[1] == limit else None

        chosen = ranges
        if ranges is not None:
            best = ranges.orderBy(F.desc("bound"), "segment", "range").limit(FIRST)
            reach = last_place(scored(best))
            if reach is not None:
                chosen = ranges.where(F.col("bound") >= reach - 1e-6)
        found = stored(scored(chosen))
        reach = last_place(found)
        if reach is not None:
            found = found.where(F.col("score") >= reach)  # ties are settled by name
        named = found.join(self._read("pages", self.PAGE, segments).select("segment", "ord", *self.KEYS), ["segment", "ord"])
        return named.orderBy(F.desc("score"), *self.KEYS).limit(limit).select(*self.KEYS, "score")

    @staticmethod
    def _free(plan: Word | Every | Clauses) -> bool:
        """Whether a page without any of its terms may match."""
        if isinstance(plan, Clauses):
            return all(map(Index._free, plan.must)) if plan.must else any(map(Index._free, plan.should))
        return isinstance(plan, Every)


def rebuilt(w, path: str) -> Index:
    """An index of all live pages."""
    index = Index(w.document.sparkSession, path)
    index.put(live_pages(w))
    index.commit()
    return index
