import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from quillon.llm.exact_dedup import Trie, common, exact_duplicates


def lowered(text):
    return (text or "").encode().lower()


def expected(rows, stays=max):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    keep = {t: stays([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return Counter((r[0], keep[lowered(r[1])], len(groups[lowered(r[1])]), r[0] == keep[lowered(r[1])], sha256(lowered(r[1])).hexdigest()) for r in rows)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abAB") for _ in range(rng.randrange(9))) for _ in range(n)]
    return made + [rng.choice(["x", "long " * 400, "é" * 300]) * rng.randrange(3) + rng.choice(made) for _ in range(n)]


def test_common_beginning():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(2))
        assert common(a, b) == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_trie_equals_a_dictionary():
    trie, numbers = Trie(), {}
    for text in random_texts(3000):
        owner = trie.insert(text.encode())
        assert numbers.setdefault(text, owner[0]) == owner[0]
    assert {t.decode(): o[0] for t, o, _ in trie.all()} == numbers
    assert trie.held == sum(w for w in [trie._weights()[id(trie.root)]]) - 300  # the root's own


def test_subtrees_that_leave_are_whole_and_stay_away():
    trie, out, given = Trie(), Counter(), random_texts(2000, 3)
    for text in given:
        trie.insert(text.encode())[2] += 1
        if trie.held > 40_000:
            for t, owner in trie.spill(20_000):
                out[t] += owner[2]
            assert trie.held <= 20_000
    final = Counter()
    for t, owner, gone in trie.all():
        assert gone == (t in out) or gone  # a text that left once never counts as settled
        (out if gone else final)[t] += owner[2]
    assert not final.keys() & out.keys()
    assert final + out == Counter(t.encode() for t in given)


def test_deep_chains_and_one_huge_text():
    trie = Trie()
    for n in range(1, 3000):
        trie.insert(b"a" * n)
    assert len(list(trie.all())) == 2999 and len(trie._weights()) == 3000
    one = Trie()
    one.insert(b"z" * 100_000)
    assert not list(one.spill(10))


@pytest.mark.parametrize("stays", ["largest", "smallest"])
def test_odd_rows(spark, odd, stays):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, exact_duplicates(odd, stays).collect())) == expected(rows, max if stays == "largest" else min)


def test_empty_table(spark, empty):
    assert exact_duplicates(empty).collect() == []


def test_small_windows_and_several_rounds_of_spilling(spark):
    texts = random_texts(400, 5) + ["Hot"] * 300 + ["hOT"] * 300
    rows = [(i - 500, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact_duplicates(docs, window_bytes=3000, window_rows=50, partition_bytes=1 << 30, trie_bytes=4000)
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_given_documents_by_bytes(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, exact_duplicates(documents).collect())) == expected(rows)
