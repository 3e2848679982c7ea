import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from quillon.llm import token_alignment as T
from quillon.llm._tokens import byte_letters, vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HARD = [
    "", " ", "  ", "a", "a  b", " a", "a ", "a\nb", "a \n b", "a\n\n  b", "<s> x </s>", "<|endoftext|>", "a <|endoftext|> b", "<0x0A>", "日本語 テキスト", "é́ é", "🙂🙂 ok", "a▁b", "▁", "x  y", "\0x y", "﻿ a​",
    "don't I'll", "123 456.7%", "tab\tx y", "\r\n", "ﬁ ²³", "x" * 300, "many   spaces    here", "İstanbul ẞ", "a\x1cb c",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))


def tokens(libraries, text):
    """(id, end) of both by the libraries; none if the bytes differ."""
    if not text:
        return [], []
    a, b = libraries
    back = {c: x for x, c in byte_letters().items()}
    one = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = [(i, bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if b"".join(x for _, x in one) != want or b"".join(x for _, x in two) != want:
        return [], []
    return tuple(list(zip([i for i, _ in t], np.cumsum([len(x) for _, x in t]).tolist(), strict=True)) for t in (one, two))


def expected(libraries, rows):
    seen = [(doc, *tokens(libraries, text)) for doc, text in rows]
    count, links = Counter(), []
    for _, a, b in seen:
        ends = dict((e, i) for i, e in b)
        links.append([(i, ends[e]) for i, e in a if e in ends])
        count.update(links[-1])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = Counter()
    for (doc, a, b), own in zip(seen, links, strict=True):
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        shown = ";".join("|".join(",".join(str(i) for i, e in t if low < e <= high) for t in (a, b)) for low, high in zip([0, *cuts], cuts, strict=False))
        out[doc, len(a), len(b), len(cuts), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), sha256(shown.encode()).hexdigest() if a else ""] += 1
    return out


def made(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "B", " ", " ", "\n", "é", "'s", ".", "7", "\t", "#", "the", "日", "▁"][: 13 + (i % 5 == 0)]) for _ in range(rng.randrange(50))) for i in range(n)]


def test_words_equal_the_libraries_on_whole_texts():
    align = T.Aligner(vocabulary(A), vocabulary(B))
    assert align.by_words
    for texts in ([t] for t in HARD), [HARD + made(3000), [None, "", *made(50, 9)]]:
        for some in texts:
            for text, got in zip(some, align(some), strict=True):
                assert got == (align.whole(text) if text else None), repr(text)
    assert align([" ".join(HARD)]) == [align.whole(" ".join(HARD))]


def test_odd_rows(spark, odd, libraries):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, T.align(odd, vocabulary(A), vocabulary(B)).collect())) == expected(libraries, rows)


def test_empty_table_and_texts_without_tokens(spark, empty):
    assert T.align(empty, vocabulary(A), vocabulary(B)).collect() == []
    none = spark.createDataFrame([(1, None), (2, "▁"), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, T.align(none, vocabulary(A), vocabulary(B)).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_many_shards_and_small_bounds(spark, libraries, monkeypatch):
    for name, value in (("SHARD_ROWS", 40), ("LOOKED_UP", 50)):
        monkeypatch.setattr(T, name, value)
    rows = list(enumerate(HARD + made(150, 4) + ["hot words here"] * 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, T.align(docs, vocabulary(A), vocabulary(B)).collect())) == expected(libraries, rows)


def test_given_documents(spark, documents, libraries):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert Counter(map(tuple, T.align(documents, vocabulary(A), vocabulary(B)).collect())) == expected(libraries, rows)


def test_sums_of_equal_pairs():
    rng = np.random.default_rng(1)
    pairs, n = rng.integers(0, 50, 1000), rng.integers(1, 9, 1000)
    keys, sums = T.summed(pairs, n)
    assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == {k: int(n[pairs == k].sum()) for k in range(50)} and (np.diff(keys) > 0).all()
    assert len(T.summed(pairs[:0], n[:0])[0]) == 0
