import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillon.llm._tokens import encoder, vocabulary
from quillon.llm.packing import fullest, minimum_bin_slack, pack
from quillon.llm.token_counts import count_tokens

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def library(name, text):
    return encoder(name).library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(documents, odd, empty):
    for docs, hot in ((documents, 1 << 17), (documents, 50), (odd, 3), (odd, 0)):
        want = Counter((r.doc_id, len((r.text or "").encode()), len(library(WORD, r.text)), len(library(WORD, r.text)) > 2048) for r in docs.collect())
        assert Counter(tuple(r) for r in count_tokens(docs, WORD, hot_rows=hot).collect()) == want
    assert count_tokens(empty, WORD).collect() == []


def test_fullest_is_the_best_subset():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.randrange(1, 40)
        available = [(n, rng.randrange(1, 4)) for n in sorted(rng.sample(range(1, 30), rng.randrange(1, 6)), reverse=True)]
        sums = {0}
        for n, c in available:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = fullest(available, room)
        assert sum(n * k for n, k in got) == max(s for s in sums if s <= room)
        assert all(k <= dict(available)[n] for n, k in got)


def test_plan_uses_every_piece():
    histogram = {n: (n * 37) % 11 + 1 for n in range(1, 65)}
    plan = minimum_bin_slack(histogram, 64)
    used = Counter()
    for bins, pattern in plan:
        assert sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            used[n] += bins * k
    assert used == histogram
    assert sum(b for b, _ in plan) <= -(-sum(n * c for n, c in histogram.items()) // 64) * 1.02 + 1


def test_packing_is_whole_and_tight(documents, odd, empty):
    for docs in (documents, odd):
        rows = pack(docs, BYTE).collect()
        ids = defaultdict(list)
        for r in docs.collect():
            ids[r.doc_id].append(library(BYTE, r.text) + [0])
        want = Counter()
        for doc_id, all_ids in ids.items():
            for x in all_ids:
                cuts = [0, *range(len(x) - (len(x) - 1) // 2048 * 2048, len(x) + 1, 2048)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    want[doc_id, i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1
    assert pack(empty, BYTE).collect() == []
