"""Exact duplicates by tries: texts that are equal after lower-casing A-Z have one owner.

Documents are read in windows of bounded size. A window's texts go into a compressed radix trie (Patricia: a node a branching, whole
byte strings along its edges), so that copies met in one task fall together before anything is shuffled; a text in a third of
all rows travels once a window. What is left is dealt by length and content hash, and each partition inserts whole byte strings
into a trie of its own, whose terminal nodes keep the smallest identifier (of inverted ids, where the largest is to stay) and
how many rows have it. Hashes only deal texts out; equality is by all bytes.

A trie that outgrows its bound spills by subtree: the heaviest subtrees leave it, their texts and whatever comes later under the same
prefixes are written as the input of another round, which deals them to more partitions. Every round is a stored table, so a
lost executor costs its tasks and nothing else. Rows never travel to the owner: windows' links lead to classes of a round, spilled
classes to those of the next, and documents read the answer back along these.

Defined results: a null text counts as empty, and all empty ones are equal. Rows that repeat an id and a text are one document in
several rows: they count as often as they stand there and have the same answer. A null id never stays while another row of its group
has an id; if none has, keep_id is null and the rows are kept. Texts of any length are compared whole. An empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, stored, table, texts

WINDOW_BYTES, WINDOW_ROWS = 16 << 20, 1 << 16  # of a window: distinct bytes, rows
PARTITION_BYTES = 32 << 20  # of distinct text that a trie is dealt, on average
TRIE_BYTES = 96 << 20  # a trie that holds more spills
ROUNDS = 6  # the last one holds what it is dealt; each deals out anew, a quarter of a trie's bound to a partition
NODE = 300  # bytes of a node besides its label
FLUSH = 4 << 20


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] is common, a[:high] isn't
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Node:
    __slots__ = ("label", "children", "owner", "gone")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner: list | None = None  # of the text that ends here: number, smallest identifier, rows
        self.gone: set[int] | None = None  # first bytes of subtrees that have spilled


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root, self.held, self.texts, self.numbers = Node(b""), 0, 0, 0

    def insert(self, text: bytes) -> list:
        """The owner of a text: number, smallest identifier, rows. A new one has none of the last two yet."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            child = node.children.get(text[at])
            if child is None:
                leaf = node.children[text[at]] = Node(text[at:])
                self.held += NODE + n - at
                node = leaf
                break
            label = child.label
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = common(label, text[at : at + len(label)])
            middle = node.children[text[at]] = Node(label[:k])
            child.label = label[k:]
            middle.children[label[k]] = child
            self.held += NODE
            node, at = middle, at + k
        if node.owner is None:
            node.owner = [self.numbers, None, 0]
            self.numbers += 1
            self.texts += 1
        return node.owner

    @staticmethod
    def _below(node: Node, before: bytes, spilled: bool) -> Iterator[tuple[bytes, list, bool]]:
        """text, owner and whether its prefix has spilled, of a node and what is below it. before: the bytes above the node."""
        todo = [(node, before, spilled)]
        while todo:
            node, before, spilled = todo.pop()
            path = before + node.label
            if node.owner is not None:
                yield path, node.owner, spilled
            todo += [(c, path, spilled or bool(node.gone and first in node.gone)) for first, c in node.children.items()]

    def all(self) -> Iterator[tuple[bytes, list, bool]]:
        return self._below(self.root, b"", False)

    def _weights(self) -> dict[int, int]:
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children.values()
        weight: dict[int, int] = {}
        for node in reversed(order):  # children before their parents
            weight[id(node)] = NODE + len(node.label) + sum(weight[id(c)] for c in node.children.values())
        return weight

    def spill(self, most: int) -> Iterator[tuple[bytes, list]]:
        """text and owner of what leaves, subtree by subtree, until the trie holds at most so many bytes or one text."""
        while self.held > most and self.texts > 1:
            weight, node, path = self._weights(), self.root, b""
            while True:
                first, child = max(node.children.items(), key=lambda c: weight[id(c[1])])
                if not child.children or 2 * weight[id(child)] <= self.held:
                    break
                node, path = child, path + child.label
            del node.children[first]
            node.gone = (node.gone or set()) | {first}
            self.held -= weight[id(child)]
            for text, owner, _ in self._below(child, path, True):
                self.texts -= 1
                yield text, owner


def _add(owner: list, identifier: int | None, rows: int) -> None:
    if identifier is not None and (owner[1] is None or identifier < owner[1]):
        owner[1] = identifier
    owner[2] += rows


WINDOW = "key long, n_bytes long, hash long, text binary, sha256 string, owner long, rows long, ids array<long>"
TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, TYPES[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def _flushed(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each of some megabytes of text at most besides its last row."""
    arrow, held, size = _arrow(schema), [], 0
    at = [i for i, f in enumerate(arrow) if f.type == pa.binary()][0]
    for row in rows:
        held.append(row)
        size += 100 + len(row[at] or b"")
        if size > FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)


def windows(docs: DataFrame, largest: bool, window_bytes: int = WINDOW_BYTES, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """A row for each distinct text of a window: its key, its bytes, the owner within the window and the ids of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        trie, ids, n = Trie(), [], 0

        def rows() -> Iterator[tuple]:
            for text, (number, smallest, count), _ in trie.all():
                digest = sha256(text)
                yield key + number, len(text), int.from_bytes(digest.digest()[:8], "little", signed=True), text, digest.hexdigest(), smallest, count, ids[number]

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    owner = trie.insert((text or b"").lower())  # of bytes: A-Z alone
                    if not owner[2]:
                        ids.append([])
                    _add(owner, doc_id if doc_id is None or not largest else ~doc_id, 1)
                    ids[owner[0]].append(doc_id)
                    n += 1
                if trie.held > window_bytes or n >= window_rows:
                    yield from _flushed(rows(), WINDOW)
                    key, trie, ids, n = key + trie.numbers, Trie(), [], 0
        yield from _flushed(rows(), WINDOW)

    return docs.select("doc_id", "text").mapInArrow(frugal(run), WINDOW)


#: Links have a key and the class it belongs to; classes an owner and how many rows; spilled ones also their text.
ROUND = "key long, class long, owner long, rows long, n_bytes long, hash long, text binary"


def classes(keyed: DataFrame, partitions: int, level: int, trie_bytes: int) -> DataFrame:
    """One round over keyed(key, n_bytes, hash, text, owner, rows): links, classes and what has spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, trie, spills = TaskContext.get().partitionId() << 40, Trie(), level < ROUNDS - 1

        def spilled(text: bytes, owner: list) -> tuple:
            return None, first + owner[0], owner[1], owner[2], len(text), int.from_bytes(sha256(text).digest()[:8], "little", signed=True), text

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    for key, text, smallest, count in zip(*(part.column(c).to_pylist() for c in ("key", "text", "owner", "rows")), strict=True):
                        owner = trie.insert(text)
                        _add(owner, smallest, count)
                        yield key, first + owner[0], None, None, None, None, None
                        if spills and trie.held > trie_bytes:
                            for out, its in trie.spill(trie_bytes // 2):
                                yield spilled(out, its)
            for text, owner, gone in trie.all():
                yield spilled(text, owner) if gone else (None, first + owner[0], owner[1], owner[2], None, None, None)

        yield from _flushed(rows(), ROUND)

    dealt = keyed.select("key", "n_bytes", "hash", "text", "owner", "rows").repartition(partitions, "n_bytes", "hash", F.lit(level))
    return dealt.select("key", "text", "owner", "rows").mapInArrow(frugal(run), ROUND)


def exact_duplicates(docs: DataFrame, stays: str = "largest", window_bytes: int = WINDOW_BYTES, window_rows: int = WINDOW_ROWS, partition_bytes: int = PARTITION_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row; stays says which id of equal texts does: largest or smallest."""
    if stays not in ("largest", "smallest"):
        raise ValueError(stays)
    d = texts(docs)
    spark = d.sparkSession
    seen = stored(windows(d, stays == "largest", window_bytes, window_rows))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left, rounds = seen, []
    for level in range(ROUNDS):
        n_bytes = left.agg(F.sum(F.col("n_bytes") + 2 * NODE)).first()[0]
        if n_bytes is None:
            break
        rounds.append(stored(classes(left, max(least, -(-n_bytes // (trie_bytes // 4 if level else partition_bytes))), level, trie_bytes)))
        left = rounds[-1].where("key is null and text is not null").withColumn("key", F.col("class"))
    answer = None
    for r in reversed(rounds):
        links = r.where("key is not null").select("key", "class")
        found = r.where("key is null and text is null").select("class", "owner", "rows")
        if answer is not None:  # what has spilled is a key of the next round
            found = found.union(answer.select(F.col("key").alias("class"), "owner", "rows"))
        answer = links.join(found, "class").select("key", "owner", "rows")
    columns = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
    if answer is None:
        return spark.createDataFrame([], columns)
    keep = F.bitwise_not("owner") if stays == "largest" else F.col("owner")
    every = seen.select("key", "sha256", "ids").join(answer, "key").select(F.explode("ids").alias("doc_id"), keep.alias("keep_id"), F.col("rows").alias("group_size"), F.col("sha256").alias("text_sha256"))
    return every.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
QUERIES = {"op11_exact_dedup": (op11_exact_dedup, ORACLE)}
