"""Token ids of whole texts exactly as the tokenizers library gives them, with what repeats looked up.

Both vocabularies split a text before merging, and never across white space of certain kinds. A text is therefore cut
there, and the ids of each chunk come from a bounded per-process table; a chunk that is new is cut into the library's own
pre-tokens, whose ids come from a second table or from the library's model. Whatever falls outside these assumptions
(control characters, scripts beyond Latin, runs of white space, special tokens, other pre-tokenizers) goes to the
library as it is: whole chunks, or whole texts where the cut itself could be wrong.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
assert array("I").itemsize == 4 and np.array(1, "=u4").astype("<u4").tobytes() == np.array(1, "=u4").tobytes()

#: Entries of a table's younger half; when it is full it becomes the older half. About 150 bytes each.
MAX_CHUNKS, MAX_PIECES = 600_000, 100_000

#: The pre-tokenizer patterns of the two public vocabularies that the fast path knows.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids(text) gives little-endian uint32 ids as bytes. plain: special strings are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.model = self.library.model
        spec = json.loads(self.library.to_str())
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        self.plain = re.compile(r"[\t\n\x20-\x7e\xa1-\xac\xae-ɏ]*").fullmatch
        kind = self._kind(spec)
        self.split = regex.compile(WORD_PATTERN if kind == "word" else BYTE_PATTERN).findall
        special = "|".join(map(re.escape, self.specials)) or r"(?!)"
        if kind == "word":
            self.odd = re.compile(r"[\x1c-\x1f]|" + special).search
        else:
            self.odd = re.compile(r"\0|\s (?!\S)|" + special).search
        self.kind = kind
        self.pieces = _Table(self._piece, MAX_PIECES)
        self.chunks = _Table(self._chunk, MAX_CHUNKS)

    @staticmethod
    def _kind(spec: dict) -> str:
        normal, pre = spec["normalizer"], spec["pre_tokenizer"] or {}
        if normal is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            return "byte"
        steps = [x["type"] for x in (normal or {}).get("normalizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}:
            return "word"
        return "other"

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            shown = piece.encode().decode("latin-1").translate(self.letters)
        elif piece.isalpha():
            shown = piece
        elif piece[0] == " " and piece[1:].isalpha():
            shown = self.letters[0x20] + piece[1:]
        else:
            shown = piece.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _chunk(self, key: str) -> bytes:
        # Letters alone are one piece, and stand in the table of chunks only: in lower case, or without the space before them.
        if key.isalpha() and (key.isascii() or self.plain(key)):
            if self.kind == "byte":
                return self._piece(" " + key)
            lower = key.lower()
            if lower == key:
                return self._piece(key)
            if lower.isalpha():
                return self.chunks[lower]
        if self.kind == "word":
            return self.chunk(key)
        return self.chunk(key[1:] if key[:1] == "\0" else " " + key)

    def chunk(self, chunk: str) -> bytes:
        if not (chunk.isascii() and chunk.isprintable() or self.plain(chunk)):
            return self.whole(chunk)
        return b"".join(map(self.known, self.split(chunk.lower() if self.kind == "word" else chunk)))

    def known(self, piece: str) -> bytes:
        word = piece if self.kind == "word" else piece[1:] if piece[0] == " " else ""
        return self.chunks[word] if word.isalpha() and word.isascii() else self.pieces[piece]

    def cut(self, text: str) -> list[str] | None:
        """Chunks of a text whose ids, one after another, are the text's; None if it must be encoded as a whole."""
        if self.kind == "other" or self.odd(text):
            return None
        if self.kind == "word":
            return text.split()
        first, *rest = text.split(" ")
        # A chunk is looked up without the space before it; the first has none, and a mark keeps it apart.
        return ["\0" + first, *rest] if first else rest

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = self.cut(text)
        return self.whole(text) if chunks is None else b"".join(map(self.chunks.__getitem__, chunks))


class _Table(dict):
    """What make gives for a key, with the last ones asked for at hand: at least size of them and at most twice as many. What is
    asked for often stays, as it moves to the younger half again."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(self) >= self.size:
            self.put(key, ids)
        else:
            self[key] = ids
        return ids

    def put(self, key: str, ids: bytes) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = ids

    def knows(self, key: str) -> bool:
        return key in self or key in self.older


@cache
def encoder(path: str) -> Encoder:
    """One per process and vocabulary, until a task of another kind needs the memory."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
