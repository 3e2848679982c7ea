import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillon.llm import repeats
from quillon.llm._common import Substrings
from quillon.llm.repeats import multikey_quicksort, remove_repeats

W = repeats.WINDOW


def brute(rows):
    """Of (doc_id, text): digest by a dictionary of all windows in document order."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = {}, Counter()
    for doc_id, text in sorted(rows, key=key):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - W + 1):
            first = seen.setdefault(raw[i : i + W], (doc_id, text, i))
            if first != (doc_id, text, i):
                gone[i : i + W] = True
        keep = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc_id, len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(keep).hexdigest()] += 1
    return out


def got(docs):
    return Counter(tuple(r)[:5] for r in remove_repeats(docs).collect())


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, k, 5000).astype(np.uint64) for k in (3, 5, 400, 2)]
    order = multikey_quicksort(keys, 16)
    assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))


def test_real_documents(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


@pytest.mark.parametrize(("bucket", "ranges", "tasks"), [(400_000, 4096, 20_000), (60, 4096, 20_000), (60, 4096, 7), (60, 3, 20_000), (40, 5, 4)])
def test_hard_texts(spark, bucket, ranges, tasks, monkeypatch):
    """One bucket; many; several buckets to a task; ranges that are split once more; all of it."""
    for name, value in (("BUCKET", bucket), ("RANGES", ranges), ("TASKS", tasks)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(bucket)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(60) for _ in range(6)]
    line = text(14)
    rows = []
    for i in range(120):
        b = rng.choice(base)
        a = rng.randrange(len(b))
        piece = b[a : a + rng.choice([40, 90, 97, 100, 101, 102, 130, 250])]
        rows.append((i, rng.choice([piece, text(5) + piece, piece + text(9), text(20) + piece + text(3) + piece, b, line + text(20), text(7) + line, "ab" * rng.randrange(40, 120), "x" * rng.randrange(90, 300)])))
    rows += [(None, base[0]), (3, None), (4, ""), (-7, base[1])]
    rows += rows[5:9]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_tables(odd, empty):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert remove_repeats(empty).collect() == []


def test_splitters_of_suffixes_come_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 60)
    rng, samples, sort = random.Random(3), [], repeats.multikey_quicksort
    monkeypatch.setattr(repeats, "multikey_quicksort", lambda keys, *more: (samples.append(keys), sort(keys, *more))[1])
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, text(300)) for i in range(200)] + [(1000, text(300) * 200)]
    repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of_long = repeats._identity(*(repeats.np.array([v]) for v in (1000, 0, 0)))[0][0]
    assert samples and all((keys[2] == of_long).any() for keys in samples)
    assert len({int(d) for d in samples[0][2]}) > 100


def test_hash_families_are_independent():
    raw = np.frombuffer(b"ab" * 500 + b"ba" * 500, np.uint8)
    start = np.arange(1500)
    one, two = (Substrings(raw, k)(start, start + 100) for k in (0, 1))
    same = lambda h: {(i, j) for i in range(0, 1500, 50) for j in range(0, 1500, 50) if h[i] == h[j]}
    windows = np.array([hash(raw[i : i + 100].tobytes()) for i in start])
    assert same(one) == same(two) == same(windows) and not (one == two).any()
