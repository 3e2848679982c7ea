"""The search language, and the stored index against a dictionary that is told the same."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillon.operators import search as S
from quillon.sources.storage import shared_path

PAGE = "namespace string, title string, content string"
W = lambda text, *fields: S.Word(fields or S.FIELDS, tuple(S.grams(text)))
A, BB, C = W("aaa"), W("bbb"), W("ccc")


@pytest.mark.parametrize(("query", "plan"), [
    ("aaa", A), ("aaa bbb", S.Clauses(should=(A, BB))), ("aaa OR bbb", S.Clauses(should=(A, BB))), ("aaa AND bbb", S.Clauses(must=(A, BB))),
    ("aaa AND bbb OR ccc", S.Clauses(should=(S.Clauses(must=(A, BB)), C))), ("aaa OR bbb AND ccc", S.Clauses(should=(A, S.Clauses(must=(BB, C))))), ("(aaa OR bbb) AND ccc", S.Clauses(must=(S.Clauses(should=(A, BB)), C))),
    ("+aaa bbb -ccc", S.Clauses((A,), (BB,), (C,))), ("aaa AND NOT bbb", S.Clauses(must=(A,), never=(BB,))), ("NOT aaa", S.Clauses(never=(A,))), ("aaa NOT bbb", S.Clauses(should=(A,), never=(BB,))), ("NOT NOT aaa", A),
    ('"aaa bbb"', W("aaa bbb")), ("title:aaa", W("aaa", "title")), ('content:"a b" ccc', S.Clauses(should=(W("a b", "content"), C))), ("title:(aaa bbb)", S.Clauses(should=(W("aaa", "title"), W("bbb", "title")))),
    ("namespace:file", S.Word(("namespace",), ("file",))), ('key:"main:One two"', S.Word(("key",), ("main:One two",))), ("*", S.Every()), ("* -aaa", S.Clauses(should=(S.Every(),), never=(A,))), ("", S.Clauses()), ("((aaa))", A), (r"a\:b", W("a:b")), ("c++", W("c++")),
    ("AND" + "x", W("ANDx")), ("- aaa", S.Clauses(should=(W("-"), A))),
])
def test_queries_are_read(query, plan):
    assert S.parsed(query) == plan


@pytest.mark.parametrize("query", ['a "b', "(a", "a)", "a) (b", "a AND", "OR b", "AND", "NOT", "a AND OR b", "title: x", "title:", "()", "nowhere:x", "title:(content:x)"])
def test_queries_that_cannot_be_read(query):
    with pytest.raises(ValueError, match=r"."):
        S.parsed(query)


def plainly(plan, page):
    """Whether a page matches."""
    texts = {"title": page[1], "content": page[2] or "", "namespace": page[0], "key": f"{page[0]}:{page[1]}"}
    if isinstance(plan, S.Every):
        return True
    if isinstance(plan, S.Word):
        return bool(plan.terms) and any(all(t in texts[f] if f in S.FIELDS else t == texts[f] for t in plan.terms) for f in plan.fields)
    need = all(plainly(p, page) for p in plan.must) if plan.must else any(plainly(p, page) for p in plan.should)
    return need and not any(plainly(p, page) for p in plan.never)


def scores(query, pages):
    """By plain BM25 over the pages given."""
    plan, rows = S.parsed(query), list(pages)
    text = lambda p, f: {"title": p[1], "content": p[2] or "", "namespace": p[0], "key": f"{p[0]}:{p[1]}"}[f]
    length = lambda p, f: max(len(text(p, f)) - 1, 0) + max(len(text(p, f)) - 2, 0) if f in S.FIELDS else 1
    count = lambda p, f, t: len(re.findall(f"(?={re.escape(t)})", text(p, f))) if f in S.FIELDS else int(text(p, f) == t)
    out = {}
    for p in rows:
        if not plainly(plan, p):
            continue
        total = 0.0
        for f, t in S.wanted(plan, False):
            df, mean = sum(count(q, f, t) > 0 for q in rows), sum(length(q, f) for q in rows) / len(rows)
            if tf := count(p, f, t):
                total += math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * (S.K1 + 1) / (tf + S.K1 * (1 - S.B + S.B * length(p, f) / mean))
        out[p[0], p[1]] = round(total, 6)
    return out


QUERIES = ["wiki", "wiki OR page", "wiki AND page", "+wiki page -old", '"wi ki"', "title:T1 content:page", "* -wiki", "namespace:file wiki", "namespace:file AND NOT page", "x", "x AND wiki", "NOT wiki", "(wiki page) AND (old new)", "nowhere to be found", 'key:"main:T1"', "aaaa"]


def texts(rng):
    return None if rng.random() < 0.1 else " ".join(rng.choice(["wiki", "page", "old", "new", "wi ki", "aaaaa", "x", "한국어 위키"]) for _ in range(rng.randrange(12)))


def test_index_equals_a_dictionary(spark):
    rng, known = random.Random(4), {}
    index = S.Index(spark, shared_path(spark))
    assert index.is_empty() and index.search("any").collect() == []
    for step in range(3):
        for _ in range(rng.randrange(2, 6)):
            keys = [(rng.choice(["main", "file"]), f"T{rng.randrange(25)}") for _ in range(rng.randrange(1, 15))]
            if rng.random() < 0.6:
                pages = {k: texts(rng) for k in keys}
                index.put(spark.createDataFrame([(*k, t, 1) for k, t in pages.items()], PAGE + ", ord int"))
                known |= pages
            else:
                index.remove(spark.createDataFrame([(*k, "") for k in keys], PAGE))
                for k in keys:
                    known.pop(k, None)
        before = {(r.namespace, r.title) for r in index.entries().collect()}
        index.commit()
        assert {(r.namespace, r.title): r.content for r in index.pages().collect()} == known and (before != set(known) or not step)
        for q in rng.sample(QUERIES, 2):
            assert {(r.namespace, r.title) for r in index.search(q, 100).collect()} == {k for k, t in known.items() if plainly(S.parsed(q), (*k, t))}, q
    pages = [(*k, t) for k, t in known.items()]
    index.merge()
    for q in QUERIES:
        want = sorted(((-s, *k) for k, s in scores(q, pages).items()))
        for found in (index.search(q, 100).collect(), S.search(spark.createDataFrame(pages, PAGE), q, 100).collect()):
            assert [-r.score for r in found] == pytest.approx([w[0] for w in want], abs=2e-6), q
            assert {(r.namespace, r.title) for r in found} == {w[1:] for w in want}, q


def test_a_search_after_a_merge_opens_the_merged_segment_alone(spark):
    index = S.Index(spark, shared_path(spark))
    for n in range(3):
        index.put(spark.createDataFrame([("main", f"P{n}", "some words"), ("main", "same", f"text {n}")], PAGE))
        index.commit()
    index.remove(spark.createDataFrame([("main", "P0", "")], PAGE))
    index.commit()
    index.merge()
    (segment,) = index.segments()
    opened = [f for what, schema in (("pages", index.PAGE), ("postings", S.BLOCK)) for f in index._read(what, schema, index.segments()).inputFiles()]
    assert opened and all(f"/segments/{segment['number']}/" in f for f in opened) and segment["dead"] == 0 and segment["pages"] == 3
    assert [r.title for r in index.search("text").collect()] == ["same"]
    index.vacuum()
    assert index.manifests.children(f"{index.path}/segments") == [str(segment["number"])] and [r.title for r in index.search("words").collect()] == ["P1", "P2"]


def test_only_ranges_that_can_reach_the_last_place_are_scored(spark, monkeypatch):
    """Exact with bounds, and most postings of a common gram stay unread."""
    monkeypatch.setattr(S, "RANGE", 16)
    monkeypatch.setattr(S, "FIRST", 2)
    rng = random.Random(6)
    pages = [("main", f"T{n:04}", "wiki " * rng.choice([1, 1, 2]) + "filler text " * (n // 10)) for n in range(600)]
    index = S.Index(spark, shared_path(spark))
    index.put(spark.createDataFrame(pages, PAGE))
    index.commit()
    seen = []
    plain = S.Index._rows
    monkeypatch.setattr(S.Index, "_rows", staticmethod(lambda d: seen.append(d) or plain(d)))
    got = [(r.namespace, r.title) for r in index.search("wiki", 5).collect()]
    want = sorted(scores("wiki", pages).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert got == [k for k, _ in want]
    ranges = [d.select("range").distinct().count() for d in seen]
    assert len(ranges) == 2 and max(ranges) < 0.3 * 600 / 16, ranges


def test_last_call_counts_within_a_commit(spark):
    index = S.Index(spark, shared_path(spark))
    one = lambda text: spark.createDataFrame([("main", "A", text)], PAGE)
    index.put(one("zzzz old"))
    index.put(one("aaaa new"))
    index.commit()
    assert [r.title for r in index.search("aaaa").collect()] == ["A"] and index.search("zzzz").collect() == []
    index.put(one("later"))
    index.remove(one(""))
    index.commit()
    assert index.is_empty() and index.search("later aaaa").collect() == []
    index.remove(one(""))
    index.put(one("back again"))
    index.commit()
    assert [r.title for r in index.search("again").collect()] == ["A"]
    index.commit()  # nothing was called
    assert len(index.segments()) == 3


def test_frequencies_are_those_of_the_pages_in_force(spark):
    """Before any merge: neither pages removed nor older texts of replaced ones weigh in."""
    index, known = S.Index(spark, shared_path(spark)), {("main", f"T{n}"): "wiki " * (n % 5) + "some page" for n in range(40)}
    index.put(spark.createDataFrame([(*k, t) for k, t in known.items()], PAGE))
    index.commit()
    for removed, replaced in (("T1", "T2"), ("T3", "T4")):
        gone = [k for k in known if k[1].startswith(removed)]
        new = {k: "a new wiki" for k in known if k[1].startswith(replaced)}
        index.remove(spark.createDataFrame([(*k, "") for k in gone], PAGE))
        index.put(spark.createDataFrame([(*k, t) for k, t in new.items()], PAGE))
        index.commit()
        known = {k: t for k, t in known.items() if k not in gone} | new
        for q in ("wiki", "wiki page -new", "title:T2 content:new"):
            want = scores(q, [(*k, t) for k, t in known.items()])
            assert {(r.namespace, r.title): r.score for r in index.search(q, 100).collect()} == pytest.approx(want, abs=2e-6), q
    index.remove(spark.createDataFrame([(*k, "") for k in known], PAGE))
    index.commit()
    assert index.search("wiki").collect() == []


def test_postings_of_a_range_are_made_in_little_memory():
    """Of 4 MB of text in one batch: 132 MB measured, of 426 before grams were taken by kind."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) for _ in range(1000)]
    batch = pa.RecordBatch.from_pydict({"ord": list(range(1000)), "namespace": ["main"] * 1000, "title": [f"T{n}" for n in range(1000)], "content": texts})
    tracemalloc.start()
    n = sum(sum(b.column("n").to_pylist()) for b in S.blocks(iter([batch])) if b.column("field")[0].as_py() == "content")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == sum(len({t[i : i + k] for k in (2, 3) for i in range(len(t) - k + 1)}) for t in texts)
    assert peak < 250 << 20
