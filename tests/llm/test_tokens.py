import random

import numpy as np
import pytest

from quillon.llm._tokens import encoder, vocabulary

HARD = [
    "", " ", "  ", "a  b", "a   b", " a", "a ", "a\n b", "a \nb", "a\n\n b", "\n \n", "don't I'll we've", "<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y",
    "İstanbul ŞıĞ ẞ ΑΣ Σ", "日本語 テキスト", "é á", "a\x1cb", "a b", "a­b", "\0x y", "x \0y", "\x85x", "123 456.7%", "ab###&&& c***", "Ĳ ŉ ǅ ǰ", "🙂 ok 🙂🙂", "a\tb\t c", "　 x", "don' t", "É È çà", "__x__ _", "²³ ½ ٣",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    e = encoder(vocabulary(name))
    rng = random.Random(1)
    made = ["".join(rng.choice(["a", "B", " ", " ", "\n", "é", "'s", ".", "7", "\t", "#", "x", "Ω", " ", "the"]) for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in HARD + made:
        want = e.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.ids(text), "<u4").tolist() == want, repr(text)


def test_words_of_letters_stand_in_one_table():
    from quillon.llm._tokens import Encoder, vocabulary

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, text = Encoder(vocabulary(name)), "Some words, some Words. more words"
        assert e.ids(text) == e.whole(text) and not any(p.strip().isalpha() and p[:1] == " " or e.kind == "word" and p.isalpha() for p in e.pieces)
