import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm._common import shared_dir
from quillon.llm._tokens import encoder, vocabulary
from quillon.llm.token_output import canonical, code_lengths, decode_block, encode_block, read, write

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def best_cost(counts, limit):
    """Of length-limited prefix codes, by brute force over Kraft-feasible lengths."""
    counts = sorted(counts, reverse=True)
    best = {(Fraction(0), 1): 0}
    for c in counts:
        new = {}
        for (kraft, low), cost in best.items():
            for n in range(low, limit + 1):
                k = kraft + Fraction(1, 2**n)
                if k <= 1 and new.get((k, n), cost + c * n + 1) > cost + c * n:
                    new[k, n] = cost + c * n
        best = new
    return min(best.values())


def test_lengths_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        n, limit = rng.randrange(2, 9), rng.choice([3, 4, 5])
        counts = np.array([rng.choice([1, 2, 5, 50, 1000]) for _ in range(n)])
        lengths = code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0**-x for x in lengths.tolist()) <= 1
        assert int((lengths * counts).sum()) == best_cost(counts.tolist(), limit)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 512, 5000])
@pytest.mark.parametrize("used", [1, 2, 3, 40000])
def test_blocks_round_trip(n, used):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, used - 1) if used < 40000 else rng.integers(0, used, n)
    lengths = code_lengths(np.bincount(ids, minlength=used) if used < 40000 else np.ones(used, np.int64))
    codes, ids_table, bits_table = canonical(lengths)
    per = np.array([n // 3, n - n // 3])
    got, docs, counts = decode_block(encode_block(ids, np.array([-5, 7]), per, codes, lengths), ids_table, bits_table)
    assert got.tolist() == ids.tolist() and docs.tolist() == [-5, 7] and counts.tolist() == per.tolist()


def digest(rows):
    """Rows of (doc_id, start, n, crc) without the order of those that share an id."""
    ids, out = {}, Counter()
    for doc_id, start, n, crc in rows:
        ids.setdefault(doc_id, []).append((start, n, crc))
    for doc_id, of in ids.items():
        of.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(of, of[1:]))
        out[doc_id, of[0][0], tuple(sorted(x[1:] for x in of))] += 1
    return out


def expected(docs, name, end):
    rows = []
    for r in docs.collect():
        ids = encoder(name).library.encode(r.text or "", add_special_tokens=False).ids + [end]
        rows.append((r.doc_id is not None, r.doc_id or 0, np.array(ids, "<u2").tobytes(), ids))
    start, out = 0, Counter()
    for some, doc_id, _, ids in sorted(rows):
        out[doc_id if some else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    return out


def test_files_give_back_every_id(spark, documents, odd, empty):
    for docs, name, end, shard, block, shards in ((documents, WORD, 1, 1 << 23, 1 << 18, 99), (documents, WORD, 1, 9000, 700, 99), (documents, WORD, 1, 9000, 700, 3), (odd, WORD, 1, 2000, 300, 99), (odd, BYTE, 50256, 1 << 20, 1 << 10, 99), (empty, WORD, 1, 100, 100, 99)):
        path = shared_dir(spark)
        write(docs, name, end, path, shard, block, shards)
        assert digest(tuple(r) for r in read(spark, path).collect()) == digest(expected(docs, name, end).elements())


def test_a_hot_id_is_split(spark):
    """Most rows share one id: their shards are as many as their ids ask for."""
    docs = spark.createDataFrame([(7 if i % 10 else i, f"words {i} " * (1 + i % 5 * 9)) for i in range(600)], "doc_id long, text string")
    path = shared_dir(spark)
    write(docs, WORD, 1, path, 2000, 500)
    assert digest(tuple(r) for r in read(spark, path).collect()) == digest(expected(docs, WORD, 1).elements())
    of_shard = [r["sum(n_ids)"] for r in spark.read.parquet(f"{path}/blocks").groupBy("shard").sum("n_ids").collect()]
    assert len(of_shard) > 10 and max(of_shard) < 4 * sum(of_shard) / len(of_shard)
