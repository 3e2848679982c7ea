import random

import pytest

from quillon.llm.components import connected_components
from quillon.llm.near_duplicates import near_duplicates


def brute(rows, size, percent):
    low = {b: b + 32 for b in range(65, 91)}
    sets = []
    for _, text in rows:
        w = bytes(low.get(b, b) for b in (text or "").encode()).split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=repr)


def got(docs, size, percent):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, size, percent).collect()), key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    alone = {a for a in root if not any(a in e and e[0] != e[1] for e in edges)}
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {a: r for a, r in root.items() if a not in alone}
    assert len(rows) == len({r.node for r in rows})


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_families(spark, size, percent):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, base = [], [[word() for _ in range(n)] for n in (2, 8, 30, 120, 200)]
    for i in range(260):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = word()
        if rng.random() < 0.2:
            base.append(b)  # copies of copies
        rows.append((i * 7 % 263, rng.choice([" ", "\n", " \t"]).join(b).upper() if rng.random() < 0.2 else " ".join(b)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One Two"), (905, "one"), rows[0], (None, rows[3][1]), (10, "other text of the same id as another row")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), size, percent) == brute(rows, size, percent)


def test_shingles_that_many_sets_share(spark, monkeypatch):
    """With two shared shingles asked for, the same links are found among far fewer pairs."""
    from quillon.llm import near_duplicates as N

    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = rng.sample(words, 9)
        rows.append((i, " ".join(["same", "start", "here", *own])))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(["same", "start", "here", *own[:8]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pool = docs.withColumn("component", docs["doc_id"])
    linked = {tuple(sorted((a, b))) for a, x in rows for b, y in rows if a < b and near(x, y, 1, 80)}
    found = {}
    for common in (1 << 30, 20, 0):
        monkeypatch.setattr(N, "COMMON", common)
        found[common] = {(r.hub, r.member) for r in N.across_components(pool, 1, 80).collect()}
        assert linked and linked <= found[common]
    assert len(found[0]) < 0.5 * len(found[1 << 30]) and len(found[20]) < len(found[1 << 30])


def near(a, b, size, percent):
    x, y = (frozenset(tuple(t.split()[i : i + size]) for i in range(len(t.split()) - size + 1)) for t in (a, b))
    return 100 * len(x & y) >= percent * len(x | y)


def test_families_with_common_shingles(spark, monkeypatch):
    from quillon.llm import near_duplicates as N

    monkeypatch.setattr(N, "COMMON", 1)
    test_families(spark, 3, 85)


def test_odd_tables(documents, odd, empty):
    for d in (documents, odd):
        assert got(d, 3, 85) == brute([(r.doc_id, r.text) for r in d.collect()], 3, 85)
    assert near_duplicates(empty).collect() == []
