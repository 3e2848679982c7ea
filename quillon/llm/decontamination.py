"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, which scans each text once.

Normalising maps every byte that separates words to a space and A-Z to a-z, one byte for one byte, so that an offset in
the normalised text is an offset in the original until runs of spaces are closed up; word numbers carry hits back across
that. The automaton's letters are words: each distinct word of the items has a number, and a text's words are looked up.
Every window of an item holds one of the item's seeds, the pieces half a window long that it falls into, so the automaton
has a node a word of the items instead of one a letter of each window; around a seed that it meets, words are compared.

An automaton takes about 130 bytes a benchmark word (measured: 13 MB for 100,000 words). Items are grouped into automata of at
most MAX_WORDS words, built once per process, so what is broadcast and held has a bound whatever the benchmark.

Defined results: null or word-free texts have no words and no hits; a word-free item has no window and never occurs.
Repeated items are found under each of their ids. Items with a null id are found and count in n_items, and are left out of
the list of ids. Repeated documents are judged row by row. Extra columns are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, pieces, stored, table, texts

WINDOW = 10  # words
CROWD = 16  # places of a seed that are compared one by one; a seed of more has its windows in a table
MAX_WORDS = 1_000_000  # of benchmark text in one automaton
MAX_CHARACTERS = 12_000_000  # of benchmark text that is broadcast at all

RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hits"]
SPANS, RUNS = "array<struct<start: long, end: long>>", "array<struct<first: long, last: long>>"
SPAN_LIST, RUN_LIST = (pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())])) for a, b in (("start", "end"), ("first", "last")))

#: Every UTF-8 byte below 0x80 that is no digit or letter becomes a space; A-Z become a-z. Bytes from 0x80 on belong to words.
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: The same classes, for texts that must stay as they are.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Items:
    """The automaton over items (place, text), and what is needed to tell windows from seeds."""

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        import ahocorasick

        self.size, self.half = size, max(1, size // 2)
        self.number: dict[bytes, int] = {}
        self.words: list[int] = [-1]  # of all items, one after another, with a mark between
        self.places: list[int] = [-1]
        seeds: dict[tuple[int, ...], list[int]] = {}
        for place, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in normal_words(text)]
            n, first = len(words), len(self.words)
            step = self.half if n >= size else max(n, 1)
            for at in range(0, n - step + 1, step):
                seeds.setdefault(tuple(words[at : at + step]), []).append(first + at)
            self.words += [*words, -1]
            self.places += [place] * (n + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seed, at in seeds.items():
            self.automaton.add_word(seed, (len(seed), at, self._windows(len(seed), at) if len(at) > CROWD else None))
        self.automaton.make_automaton()
        self.empty = not seeds

    def _windows(self, n: int, places: list[int]) -> dict[tuple[int, ...], list[int]]:
        """The windows around a seed that many items share, and items that are no more than the seed, with their items."""
        own, size, found = self.words, self.size, {}
        for at in places:
            if own[at - 1] == -1 and own[at + n] == -1:
                found.setdefault(tuple(own[at : at + n]), []).append(self.places[at])
                continue
            for first in range(at + n - size, at + 1):
                if first > 0 and len(window := tuple(own[first : first + size])) == size and -1 not in window:
                    items = found.setdefault(window, [])
                    if not items or items[-1] != self.places[at]:
                        items.append(self.places[at])
        return found

    def hits(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(first, end, place): runs of words in which windows of an item lie."""
        own, size = self.words, self.size
        met: set[tuple[int, ...]] = set()
        for last, (n, places, windows) in self.automaton.iter(tuple(words)):
            if windows is not None:
                # However many items share the seed, each window around it is looked up once, and its items are told once a text.
                end = last + 1
                for first, to in {(end - n, end), *((a, a + size) for a in range(max(0, end - size), end - n + 1) if a + size <= len(words))}:
                    window = tuple(words[first:to])
                    items = windows.get(window)
                    if items:
                        for place in items[:1] if window in met else items:
                            yield first, to, place
                        met.add(window)
                continue
            for at in places:
                first, a, b, end = last - n + 1, at, at + n, last + 1
                most = max(0, size - n)
                if own[at - 1] == -1 and own[b] == -1:  # the item has no further words
                    yield first, end, self.places[at]
                    continue
                low = max(0, first - most)
                while first > low and words[first - 1] == own[a - 1]:
                    first, a = first - 1, a - 1
                high = min(len(words), end + most)
                while end < high and words[end] == own[b]:
                    end, b = end + 1, b + 1
                if end - first >= size:
                    yield first, end, self.places[at]


_BUILT: dict[str, list[Items]] = {}


def built(key: str, groups: list[list[tuple[int, str | None]]], size: int) -> list[Items]:
    """The automata of a scan, made once per process; those of another scan make room."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [a for g in groups if not (a := Items(g, size)).empty]
    return _BUILT[key]


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_words: int = MAX_WORDS, more: tuple[str, ...] = (), max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (ids), and hits (byte spans of the text, joined where they
    touch in words); the columns in more are carried along. Up to max_characters of benchmark text are broadcast; a larger
    benchmark is taken in blocks of that size, each scanned for in turn, and what the blocks found is joined by row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= max_characters:
        return _scan(docs, items, size, max_words, more).drop("runs", "nameless")
    blocks = -(-2 * total // max_characters)  # half full on average, as a hash fills them
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    parts = [_scan(numbered, items.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == b), size, max_words, ("_row",)) for b in range(blocks)]
    each = reduce(DataFrame.union, [p.select("_row", "n_words", "items", "nameless", "runs") for p in parts])
    found = each.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("items"))).alias("items"), F.sum("nameless").alias("nameless"), F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    # Sorted runs of words: those that touch become one.
    joined = F.aggregate(
        "runs",
        F.array().cast("array<struct<first: long, last: long>>"),
        lambda done, r: F.when(
            F.get(done, F.size(done) - 1)["last"] + 1 >= r["first"],
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.get(done, F.size(done) - 1)["first"].alias("first"), F.greatest(F.get(done, F.size(done) - 1)["last"], r["last"]).alias("last")))),
        ).otherwise(F.concat(done, F.array(r))),
    )
    found = found.withColumn("runs", joined)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    found = found.select("_row", "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items", "runs")
    met = numbered.join(found, "_row")
    return _with_spans(met.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *RESULT[:6], "runs", *[c for c in more if c != "text"]), more)


def _with_spans(d: DataFrame, more: tuple[str, ...]) -> DataFrame:
    """Word runs as byte spans of the text."""
    names = ["doc_id", *RESULT, *more]
    types = {f.name: f.dataType.simpleString() for f in d.schema.fields} | {"hits": SPANS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                at = [m.span() for m in WORD.finditer((text or "").encode().lower())] if runs else []
                hits.append([{"start": at[r["first"]][0], "end": at[r["last"]][1]} for r in runs])
            yield pa.RecordBatch.from_arrays([pa.array(hits, SPAN_LIST) if c == "hits" else batch.column(c) for c in names], names)

    return d.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names))


def _scan(docs: DataFrame, items: DataFrame, size: int, max_words: int, more: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    rows = sorted((r.id is None, r.id or "", r.text) for r in items.collect())
    names = [None if none else name for none, name, _ in rows]
    groups: list[list[int]] = [[]]
    words = 0
    for i, (_, _, text) in enumerate(rows):
        n = len(normal_words(text))
        if words + n > max_words and groups[-1]:
            groups.append([])
            words = 0
        groups[-1].append(i)
        words += n
    shared = spark.sparkContext.broadcast([[(i, rows[i][2]) for i in g] for g in groups])
    key = uuid.uuid4().hex
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = built(key, shared.value, size)
        for big in batches:
            for batch in pieces(big):
                out = []
                for text in batch.column("text").to_pylist():
                    raw = (text or "").encode()
                    words = raw.translate(NORMAL).split()
                    n, places, runs, spans_, n_hit = len(words), set(), [], [], 0
                    mark = None
                    for a in automata if n else ():
                        for first, end, place in a.hits([a.number.get(w, 0) for w in words]):
                            mark = np.zeros(n + 1, np.int32) if mark is None else mark
                            mark[first] += 1
                            mark[end] -= 1
                            places.add(place)
                    if mark is not None:
                        on = np.cumsum(mark[:n]) > 0
                        n_hit = int(on.sum())
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
                        at = [m.span() for m in WORD.finditer(raw.lower())]
                        runs = [{"first": i, "last": j - 1} for i, j in edge.reshape(-1, 2).tolist()]
                        spans_ = [(at[r["first"]][0], at[r["last"]][1]) for r in runs]
                    ids = [names[p] for p in sorted(places)]
                    out.append((n, n_hit, len(ids), [x for x in ids if x is not None], [{"start": s, "end": e} for s, e in spans_], runs, ids.count(None)))
                n, n_hit, n_items, ids, hits, runs, nameless = (list(c) for c in zip(*out, strict=True))
                sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]
                arrays = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array([x > 0 for x in n_hit]), pa.array(ids, pa.list_(pa.string())), pa.array(hits, SPAN_LIST), pa.array(runs, RUN_LIST), pa.array(nameless, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays, *(batch.column(c) for c in more)], ["doc_id", *RESULT, "runs", "nameless", *more])

    schema = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hits {SPANS}, runs {RUNS}, nameless long"
    return texts(docs, *[c for c in more if c != "text"]).mapInArrow(scan, ", ".join([schema, *(f"`{c}` {types[c]}" for c in more)]))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", *RESULT[:5])


_DUCK_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH b AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_DUCK_WORDS} AS w FROM documents),
  dw AS (SELECT rid, n, i AS p, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  h AS MATERIALIZED (SELECT dw.rid, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
  c AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
  i AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)"""

QUERIES = {"op3_decontamination": (op3_decontamination, ORACLE_SQL)}
