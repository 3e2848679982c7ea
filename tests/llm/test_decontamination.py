import hashlib
import random
import re
from collections import Counter

from quillon.llm.decontamination import find

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(doc, items, size=10):
    words = SPLIT.findall(lower(doc))
    hit, ids = set(), []
    for item_id, text in items:
        w = SPLIT.findall(lower(text))
        wins = [w[i : i + size] for i in range(max(1, len(w) - size + 1))] if w else []
        at = {i + k for x in wins for i in range(len(words) - len(x) + 1) if words[i : i + len(x)] == x for k in range(len(x))}
        hit |= at
        if at:
            ids.append(str(item_id))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_equals_brute_force(spark, odd, empty):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "cc", "é", "7", "Dd"])
    items = [(i, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(40)] + [(50, None), (51, "!!"), (52, items_twice := "One two, three"), (52, items_twice)]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(80))) + rng.choice(["", " " + (rng.choice(items)[1] or "").upper() + "!"])) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: brute(t, items) for i, t in docs}
    for limits in ({}, {"max_words": 30}, {"max_characters": 900}):
        rows = find(d, bench, **limits).collect()
        assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
        for r in rows:  # spans are in the original
            text = dict(docs)[r.doc_id].encode()
            assert sum(len(SPLIT.findall(lower(text[h.start : h.end].decode()))) for h in r.hits) == r.n_hit
    got = Counter(tuple(r)[:6] for r in find(odd, bench).collect())
    assert got == Counter((r.doc_id, *brute(r.text, items)) for r in odd.collect())
    assert find(empty, bench).collect() == []
    assert not any(r.contaminated for r in find(d, bench.limit(0)).collect())


def test_items_that_share_their_beginning():
    """Hot seeds: each window around one is looked up once, however many items share the seed."""
    import time

    from quillon.llm import decontamination as D

    phrase = "which of the following is the"
    items = [(i, f"{phrase} thing number {i} of kind {i % 7} {'x ' * (i % 3)}") for i in range(20_000)]
    built = D.Items(items, 10)
    number = lambda text: [built.number.get(w, 0) for w in D.normal_words(text)]
    hot, plain = number(f"{phrase} other " * 200), number("what of a thing which is " * 200)
    times = []
    for words in (hot, plain):
        began = time.process_time()
        assert list(built.hits(words)) == []
        times.append(time.process_time() - began)
    assert times[0] < 0.1
    found = set(built.hits(number(f"so {phrase} thing number 77 of kind 0 x x here")))
    assert {place for *_, place in found} == {77} and min(a for a, *_ in found) == 1


def test_crowded_seeds_equal_brute_force(monkeypatch):
    from quillon.llm import decontamination as D

    rng = random.Random(5)
    for crowd in (0, 1, 3):
        monkeypatch.setattr(D, "CROWD", crowd)
        for _ in range(60):
            word = lambda: rng.choice(["a", "b", "c"])
            items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9])))) for i in range(12)]
            doc = " ".join(word() for _ in range(rng.randrange(30)))
            built = D.Items(list(items), 4)
            words = [built.number.get(w, 0) for w in D.normal_words(doc)]
            found = list(built.hits(words))
            n_words, n_hit, n_items, digest, _ = brute(doc, items, 4)
            assert len({i for a, b, _ in found for i in range(a, b)}) == n_hit
            ids = sorted({str(items[place][0]) for *_, place in found})
            assert (len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()) == (n_items, digest)
