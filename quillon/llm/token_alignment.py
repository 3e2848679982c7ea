"""Two tokenizers aligned over the same bytes, with how often each pair of ids ends together in the corpus.

A text with a space before it is cut by both tokenizers; where tokens of both end at one byte, they are linked, and these places cut
the tokens into groups. A link is packed into an int64, id of the first times 2^32 plus id of the second. Each task adds up what it has
seen with np.unique; the partial counts are range-partitioned and sorted as a whole, and equal neighbours summed. A range is
then one file of sorted keys and their counts in the shared folder, which tasks map into memory and search with
searchsorted: what a task holds doesn't grow with the number of pairs, and all tasks of a machine share the pages they touch.

Most texts are words with one space between them, which neither tokenizer merges across (for the second this follows from its
pieces, and is checked): a word is aligned once while it is at hand in a bounded table, and the new words of many texts are encoded
as one text and aligned as arrays. Any other text goes to the libraries whole.

Defined results: a null or empty text has no tokens, nor has one whose bytes a tokenizer doesn't give back (a text with U+2581):
all its numbers are 0 and its digest is ''. Repeated rows are rows of their own and count as often as they stand there. Special
strings are plain text. Texts of any length are whole. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, pieces, shared_dir, stored, table, texts
from ._tokens import Encoder, _Table, vocabulary

WORDS, PIECES = 300_000, 20_000  # entries of the tables' younger halves; some 400 bytes a word
TEXTS, CHARS = 512, 2 << 20  # aligned at once
PAIRS = 1 << 20  # different pairs that a task adds up before it passes them on
SHARD_ROWS = 1 << 20  # partial counts to a shard, on average
LOOKED_UP = 1 << 20  # links looked up at once
SPACE = "▁"
FIRST = " a"  # before words that are learnt
LINES = re.compile(r"\S+(?:\n\S+)+").fullmatch

Aligned = tuple[bytes, int, int, bytes]  # packed links, tokens of either, groups as text


def groups(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> Iterator[tuple[list[int], list[int]]]:
    """Ids of both between neighbouring places where both end. Sizes are bytes, 1 at least."""
    i = j = first_a = first_b = at_a = at_b = 0
    while i < len(a) and j < len(b):
        if at_a + a_sizes[i] <= at_b + b_sizes[j]:
            at_a += a_sizes[i]
            i += 1
            if at_a == at_b + b_sizes[j]:
                at_b += b_sizes[j]
                j += 1
                yield a[first_a:i], b[first_b:j]
                first_a, first_b = i, j
        else:
            at_b += b_sizes[j]
            j += 1


class Aligner:
    def __init__(self, first: str, second: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.a = Encoder(first, plain=True)
        self.a.pieces, self.a.chunks = _Table(self.a._piece, PIECES), _Table(self.a._chunk, PIECES)
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        back = {c: b for b, c in self.a.letters.items()}
        self.a_bytes = [bytes(back.get(c, 0) for c in self.a.library.id_to_token(i) or "") for i in range(self.a.library.get_vocab_size())]
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        spec = model.ModelProto()
        with open(second, "rb") as f:
            spec.ParseFromString(f.read())
        normal = spec.normalizer_spec
        #: A space only begins pieces, so that no merge goes across it, and texts are taken as they are.
        self.by_words = (
            self.a.kind == "byte" and spec.trainer_spec.model_type == spec.trainer_spec.BPE and spec.trainer_spec.byte_fallback and not any(p.type == p.USER_DEFINED for p in spec.pieces)
            and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
            and not spec.trainer_spec.treat_whitespace_as_suffix and all(re.fullmatch(f"{SPACE}*[^{SPACE}\n]*", p) for p in names)
        )
        self.words = _Table(self._word, WORDS)
        # Ids as text, with the mark that follows them within a group and at its end; and how long these are.
        self.shown = [f"{i}{mark}" for sizes, marks in ((self.a_sizes, ",|"), (self.b_sizes, ",;")) for mark in marks for i in range(len(sizes))]
        self.widths = np.array(list(map(len, self.shown)))
        self.a_array, self.b_array = np.array(self.a_sizes), np.array(self.b_sizes)

    def learn(self, words: list[str]) -> None:
        """Aligns words, each with a space or line feed before it, as one text; if its bytes don't come back, they are aligned one by one
        when asked for."""
        words = [FIRST, *words]
        text = "".join(words)[1:]
        want = b" " + text.encode()
        a, b = self.a.library.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.a_array[a]), np.cumsum(self.b_array[b])
        marks = np.zeros(len(want) + 1, np.uint8)
        marks[ends_a] += 1
        marks[ends_b] += 1
        common = np.flatnonzero(marks == 2)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = marks[ends_a] == 2, marks[ends_b] == 2
        links = (a[last_a] << 32 | b[last_b]).astype("<i8").tobytes()
        code = np.concatenate([a + last_a * len(self.a_sizes), 2 * len(self.a_sizes) + b + last_b * len(self.b_sizes)])
        code = code[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]
        shown = "".join(map(self.shown.__getitem__, code.tolist())).encode()
        ends = np.cumsum(np.concatenate([[0], self.widths[code]]))
        words_end = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        group = np.searchsorted(common, words_end)  # the last of each word; a word's end is the end of tokens of both
        upto_a, upto_b = np.searchsorted(group_a, group, "right"), np.searchsorted(group_b, group, "right")
        at_link = at_text = at_a = at_b = 0
        for w, g, n_a, n_b, end in zip(words, (8 * (group + 1)).tolist(), upto_a.tolist(), upto_b.tolist(), ends[upto_a + upto_b].tolist(), strict=True):
            self.words.put(w, (links[at_link:g], n_a - at_a, n_b - at_b, shown[at_text : end - 1]))
            at_link, at_text, at_a, at_b = g, end, n_a, n_b

    def _aligned(self, a: list[int], b: list[int], text: str) -> Aligned | None:
        """None if the bytes of either aren't a space and the text."""
        want = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        found = list(groups(a, list(map(self.a_sizes.__getitem__, a)), b, list(map(self.b_sizes.__getitem__, b))))
        links = np.array([x[-1] << 32 | y[-1] for x, y in found], "<i8").tobytes()
        return links, len(a), len(b), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found).encode()

    def _word(self, word: str) -> Aligned | None:
        if word[0] != " ":  # after another, whose part is taken off
            first, both = self.words[FIRST], self.whole(FIRST[1:] + word)
            return both and (both[0][len(first[0]) :], both[1] - first[1], both[2] - first[2], both[3][len(first[3]) + 1 :])
        return self._aligned(np.frombuffer(self.a.chunk(word), "<u4").tolist(), self.b.encode(word[1:]), word[1:])

    def whole(self, text: str) -> Aligned | None:
        """By the libraries alone."""
        return self._aligned(self.a.library.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), text)

    def __call__(self, texts: list[str | None]) -> list[Aligned | None]:
        """None for a text without tokens."""
        cut = [self.cut(t) if t and self.by_words else None for t in texts]
        new = [w for w in set(chain.from_iterable(filter(None, cut))) if not self.words.knows(w)]
        # White space at a word's end could run into the next one's.
        new = sorted(w for w in new if not (w[1].isspace() or w[-1].isspace() or SPACE in w))
        for i in range(0, len(new), WORDS // 4):
            self.learn(new[i : i + WORDS // 4])
        return [(self._joined(words, t) if words else self.whole(t)) if t else None for t, words in zip(texts, cut, strict=True)]

    def cut(self, text: str) -> list[str] | None:
        """Words with the space or line feed before each; None if the text has to be taken as a whole."""
        words = self.a.cut(" " + text)
        if not words or "" in words:
            return None
        if "\n" not in text:
            return [" " + w for w in words]
        out = []
        for w in words:
            if "\n" in w and LINES(w):  # single line feeds between what isn't white space are tokens of their own
                first, *more = w.split("\n")
                out.append(" " + first)
                out += ["\n" + m for m in more]
            else:
                out.append(" " + w)
        return out

    def _joined(self, words: list[str], text: str) -> Aligned | None:
        found = list(map(self.words.__getitem__, words))
        if None in found:
            return self.whole(text)
        links, n_a, n_b, shown = zip(*found, strict=True)
        return b"".join(links), sum(n_a), sum(n_b), b";".join(shown)


@cache
def aligner(first: str, second: str) -> Aligner:
    return Aligner(first, second)


ALIGNED = "doc_id long, n_a long, n_b long, n_links long, pairs binary, times binary, groups_sha256 string"


def alignments(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each document: its numbers, its different links packed (int64) with how often each occurs (int32), its groups' digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(first, second)
        for batch in batches:
            for part in pieces(batch, CHARS, rows=TEXTS):
                rows = []
                for found in align(part.column("text").to_pylist()):
                    if found is None:
                        rows.append((0, 0, 0, b"", b"", ""))
                        continue
                    pairs, times = np.unique(np.frombuffer(found[0], "<i8"), return_counts=True)
                    rows.append((found[1], found[2], len(found[0]) // 8, pairs.tobytes(), times.astype("<i4").tobytes(), sha256(found[3]).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_a", "n_b", "n_links", "pairs", "times", "groups_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def packed(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin (one more entry than rows)."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size, data = np.dtype(kind).itemsize, column.buffers()[2]
    values = np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return values, (at - at[0]) // size


def summed(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, and the sum of each one's counts."""
    order = np.argsort(pairs, kind="stable")
    pairs, counts = pairs[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def partial_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: what each task has seen of a pair, in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def settle() -> None:
            nonlocal known, total, size
            known, total = summed(np.concatenate([known, *(p for p, _ in waiting)]), np.concatenate([total, *(t for _, t in waiting)]))
            waiting.clear()
            size = 0

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                pairs, times = packed(part.column("pairs"), "<i8")[0], packed(part.column("times"), "<i4")[0]
                for low in range(0, len(pairs), PAIRS):
                    found, nth = np.unique(pairs[low : low + PAIRS], return_inverse=True)
                    waiting.append((found, np.bincount(nth, times[low : low + PAIRS], len(found)).astype(np.int64)))
                    size += len(found)
                    if size > PAIRS:
                        settle()
                        if len(known) > PAIRS:
                            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["pair", "n"])
                            known, total = known[:0], total[:0]
        settle()
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(total)], ["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(frugal(run), "pair long, n long")


def _files(path: str):
    """A file system and a path in it; local ones map files into memory."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(system, fs.LocalFileSystem) else system), at


def count_shards(partial: DataFrame, folder: str, shards: int) -> DataFrame:
    """first, last, rows, file: the counts of all pairs, sorted over all shards; a file has its keys, then their counts. A task that runs again
    writes a file of its own, and only the rows of the one that ends are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []  # of runs that have ended
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            pair, n = pair[first], np.add.reduceat(n, first)
            if last == pair[0]:
                n[0] += total
            elif last is not None:
                keys.append(np.array([last]))
                counts.append(np.array([total]))
            keys.append(pair[:-1])
            counts.append(n[:-1])
            last, total = int(pair[-1]), int(n[-1])
        if last is None:
            return
        keys, counts = np.append(np.concatenate(keys), last).astype("<i8"), np.append(np.concatenate(counts), total).astype("<i8")
        system, at = _files(folder)
        system.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with system.open_output_stream(f"{at}/{name}") as f:
            f.write(keys.tobytes())
            f.write(counts.tobytes())
        b = keys & 0xFFFFFFFF
        order = np.lexsort((counts, b))
        highest = order[np.append(b[order][1:] != b[order][:-1], True)]
        row = [[int(keys[0])], [int(keys[-1])], [len(keys)], [name], [b[highest].tolist()], [counts[highest].tolist()]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["first", "last", "rows", "file", "ids", "counts"])

    ordered = partial.repartitionByRange(shards, "pair").sortWithinPartitions("pair")
    return ordered.mapInArrow(frugal(run), "first long, last long, rows long, file string, ids array<long>, counts array<long>")


class Counts:
    """Counts of pairs, looked up in the shards."""

    def __init__(self, folder: str, shards: list[tuple[int, int, int, str]]):
        self.folder, self.shards = folder, sorted(shards)
        self.firsts = np.array([s[0] for s in self.shards], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            _, _, rows, name = self.shards[i]
            system, at = _files(self.folder)
            data = system.open_input_file(f"{at}/{name}").read_buffer()
            self.open[i] = np.frombuffer(data, "<i8", rows), np.frombuffer(data, "<i8", rows, 8 * rows)
        return self.open[i]

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """Of pairs that all occur, in ascending order."""
        out = np.zeros(len(pairs), np.int64)
        ends = np.append(np.searchsorted(pairs, self.firsts[1:]), len(pairs))
        at = 0
        for i, end in enumerate(ends.tolist()):
            if end > at:
                keys, counts = self._shard(i)
                out[at:end] = counts[np.searchsorted(keys, pairs[at:end])]
            at = end
        return out


def align(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    d = texts(docs)
    spark = d.sparkSession
    aligned = stored(alignments(d, first, second))
    partial = stored(partial_counts(aligned))
    folder = shared_dir(spark)
    shards = stored(count_shards(partial, folder, max(1, -(-partial.count() // SHARD_ROWS))))
    # Both are bounded: a row for each shard, and one for each id of the second vocabulary.
    files = [tuple(r) for r in shards.select("first", "last", "rows", "file").collect()]
    ids = shards.select(F.explode(F.arrays_zip("ids", "counts")).alias("b")).groupBy("b.ids").agg(F.max("b.counts").alias("n")).toArrow()
    best = np.zeros(1 + max(ids[0].to_pylist(), default=0), np.int64)
    best[ids[0].to_numpy()] = ids[1].to_numpy()
    highest = spark.sparkContext.broadcast(best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, most = Counts(folder, files), highest.value
        for batch in batches:
            at = 0
            sizes = np.cumsum(np.diff(packed(batch.column("pairs"), "<i8")[1]))
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + LOOKED_UP, "right")))
                part = batch.slice(at, to - at)
                pairs, starts = packed(part.column("pairs"), "<i8")
                times = packed(part.column("times"), "<i4")[0].astype(np.int64)
                known, nth = np.unique(pairs, return_inverse=True)
                n = counts(known)[nth]
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])  # noqa: B023, E731
                links = part.column("n_links")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_a"), part.column("n_b"), links, links, pa.array(sums(times * (n == most[pairs & 0xFFFFFFFF]))), pa.array(sums(times * n)), part.column("groups_sha256")],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )
                at = to

    return aligned.mapInArrow(frugal(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {"op13_tokenizer_alignment": (op13_tokenizer_alignment, None)}
