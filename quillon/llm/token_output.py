"""Token ids as binary files: canonical length-limited Huffman codes, decoded by table in independent blocks.

The code comes from the counts of all ids of the corpus: package-merge gives optimal lengths of at most MAX_BITS bits, and
canonical numbering makes the lengths alone the whole code table.

File format (version 1). A data set is a folder of Parquet files, so that Spark's own commit protocol and any store it
can reach keep it whole, with two kinds of rows:

* `blocks`: shard, block, start (ids in the shard before it), n_ids, and `data`, the binary block: a header of four
  little-endian uint32 (magic "QHF1", n_ids, n_documents, n_checkpoints), document ids as int64, ids per document as
  uint32, checkpoint bit offsets as uint32, then the bit stream, most significant bit first, padded to 8 bytes.
  Checkpoint i is the bit at which id i * STRIDE begins, so a block decodes from any checkpoint, and all at once.
* `code`: the code lengths, one uint8 per id.

Shards are consecutive ranges of (doc_id, hash of the ids), blocks are consecutive within a shard, and documents are consecutive within a
block, which ends with the document that fills it; a document is never split, so its check sum needs one block.

Defined results: null and empty texts have the end id alone; rows that share a doc_id are written one after another, in the order of a hash of their ids; a null
doc_id sorts first. An empty table gives an empty data set. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_column, ids_of, pieces, shared_dir, stored, table, texts
from ._tokens import encoder, vocabulary

MAX_BITS = 16
STRIDE = 256  # ids between checkpoints
BLOCK = 1 << 18  # ids in a block
SHARD = 1 << 23  # ids that a shard is meant to have
SHARDS = 20_000  # shards at most; larger ones beyond
SAMPLED = 16  # sampled rows per shard
MAGIC = int.from_bytes(b"QHF1", "little")


# --- the code ------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits for the ids with a count, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # levels[k]: sorted weights of the items and packages of a level, and which of them are packages.
    level, is_package = weights, np.zeros(n, bool)
    levels = [is_package]
    for _ in range(limit - 1):
        paired = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, paired])
        rank = np.argsort(merged, kind="stable")
        level, is_package = merged[rank], rank >= n
        levels.append(is_package)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_package in reversed(levels):
        packages = int(is_package[:take].sum())
        lengths[: take - packages] += 1  # items are taken lightest first
        take = 2 * packages
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes by id; and for decoding, the id and its length for every MAX_BITS-bit window."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint32)
    width = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    first = np.cumsum(width) - width
    codes[order] = first >> (MAX_BITS - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    full = int(width.sum())
    ids[:full], bits[:full] = np.repeat(order, width), np.repeat(lengths[order], width)
    return codes, ids, bits


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, per_doc: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits = lengths[ids].astype(np.int64)
    end = np.cumsum(bits)
    start = end - bits
    total = int(end[-1]) if len(end) else 0
    # A code of at most 16 bits lies in one or two 32-bit words; float sums are exact, as no bit is set twice.
    word, at = start >> 5, start & 31
    both = codes[ids].astype(np.uint64) << (64 - at - bits).astype(np.uint64)
    n_words = (total + 63) // 64 * 2
    words = np.bincount(word, (both >> np.uint64(32)).astype(np.float64), n_words + 1) + np.bincount(word + 1, (both & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words + 1)
    head = np.array([MAGIC, len(ids), len(doc_ids), len(range(0, len(ids), STRIDE))], "<u4")
    return b"".join((head.tobytes(), doc_ids.astype("<i8").tobytes(), per_doc.astype("<u4").tobytes(), start[::STRIDE].astype("<u4").tobytes(), words[:n_words].astype(">u4").tobytes()))


def decode_block(data: bytes, ids_table: np.ndarray, bits_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, doc_ids, ids per document. All stretches between checkpoints are decoded side by side, an id of each in turn."""
    magic, n, docs, marks = np.frombuffer(data, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = 16
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    per_doc = np.frombuffer(data, "<u4", docs, at := at + 8 * docs)
    bit = np.frombuffer(data, "<u4", marks, at := at + 4 * docs).astype(np.int64)
    words = np.frombuffer(data, ">u4", offset=at + 4 * marks).astype(np.uint64)
    windows = words[:-1] << np.uint64(32) | words[1:] if len(words) else words
    windows = np.append(windows, words[-1:] << np.uint64(32))
    out = np.zeros((STRIDE, marks), np.uint32)
    for i in range(STRIDE):
        if marks and i == (n - 1) % STRIDE + 1:
            bit = bit[:-1]
        k = len(bit)
        peek = (windows[bit >> 5] >> (48 - (bit & 31)).astype(np.uint64)).astype(np.int64) & 0xFFFF
        out[i, :k] = ids_table[peek]
        bit = bit + bits_table[peek]
    return out.T.reshape(-1)[:n], doc_ids, per_doc


# --- Spark ---------------------------------------------------------------------------------------------------------


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_ids, ids (little-endian; 2 bytes each where the vocabulary allows)."""
    narrow = encoder(tokenizer).library.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of_text, end = encoder(tokenizer).ids, np.uint32(end_id).tobytes()
        for batch in (part for big in batches for part in pieces(big)):
            out = [ids_of_text(t) + end for t in batch.column("text").to_pylist()]
            n = pa.array([len(x) // 4 for x in out], pa.int64())
            if narrow:
                out = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(out, pa.binary())], ["doc_id", "n_ids", "ids"])

    return docs.mapInArrow(encode, "doc_id long, n_ids long, ids binary").withColumn("wide", F.lit(not narrow))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("ids")
    data, offsets = column.buffers()[2], np.frombuffer(column.buffers()[1], np.int32)
    raw = np.frombuffer(data, np.uint8)[offsets[column.offset] : offsets[column.offset + len(column)]]
    return raw.view("<u4" if batch.column("wide")[0].as_py() else "<u2")


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; size bounds what comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_ids(batch), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids", "wide").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def _splitters(tokens: DataFrame, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, tie) at which shards - 1 shards begin, in steps of about equal numbers of ids: from a sample of some SAMPLED rows a
    shard in which a row's chance grows with its ids, so stretches of long documents and ids that many rows share are split."""
    step = total / (shards * SAMPLED)
    chance = F.least(F.lit(1.0), F.col("n_ids") / step)
    dice = F.pmod(F.xxhash64("doc_id", "tie", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    rows = tokens.where(dice < chance).select("doc_id", "tie", F.greatest(F.col("n_ids").cast("double"), F.lit(step)).alias("weight")).toArrow()
    doc, tie, weight = ids_of(rows["doc_id"].combine_chunks()), rows["tie"].to_numpy(), rows["weight"].to_numpy()
    order = np.lexsort((tie, doc))
    sums = np.cumsum(weight[order])
    at = order[np.unique(np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards))] if len(order) else order
    return doc[at], tie[at]


def write(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard: int = SHARD, block: int = BLOCK, shards: int = SHARDS) -> None:
    """Writes blocks and code below path; ids in ascending doc_id order. There are at most so many shards, so what the driver holds of
    them has a bound; a task streams its shard block by block, so a larger shard needs no more memory."""
    spark = docs.sparkSession
    tokens = stored(tokenized(texts(docs), tokenizer, end_id).withColumn("tie", F.xxhash64("ids")))
    size = max(encoder(tokenizer).library.get_vocab_size(with_added_tokens=True), end_id + 1)
    lengths = code_lengths(id_counts(tokens, size))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    total = tokens.agg(F.sum("n_ids")).first()[0] or 0
    n_shards = min(-(-total // shard), shards)
    bounds = spark.sparkContext.broadcast(_splitters(tokens, total, n_shards) if n_shards > 1 else (np.zeros(0, np.int64),) * 2)
    code = spark.sparkContext.broadcast(lengths)
    names = ["doc_id", "n_ids", "ids", "wide", "tie"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_doc, cut_tie = bounds.value
        for batch in batches:
            doc, tie = ids_of(batch.column("doc_id")), batch.column("tie").to_numpy()
            low, high = np.searchsorted(cut_doc, doc, "left"), np.searchsorted(cut_doc, doc, "right")
            to = low + 0
            for i in np.flatnonzero(low < high):  # ids at which a shard begins
                to[i] = low[i] + np.searchsorted(cut_tie[low[i] : high[i]], tie[i], "right")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(to, pa.int32())], [*names, "shard"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = code.value
        codes = canonical(lengths)[0]
        shard_no, done, number = 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_id, count and ids of what awaits a block

        def flush() -> pa.RecordBatch:
            nonlocal done, number
            doc, per, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            row = ((shard_no, pa.int32()), (number, pa.int32()), (done, pa.int64()), (len(ids), pa.int64()), (encode_block(ids, doc, per, codes, lengths), pa.binary()))
            done, number = done + len(ids), number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["shard", "block", "start", "n_ids", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shard_no = batch.column("shard")[0].as_py()
            doc, per, ids = ids_of(batch.column("doc_id")), batch.column("n_ids").to_numpy(), _ids(batch)
            ends, at = np.cumsum(per), 0
            while at < len(doc):  # whole documents, up to the first that fills the block
                room = block - sum(len(x) for _, _, x in held)
                begin = int(ends[at - 1]) if at else 0
                to = min(len(doc), int(np.searchsorted(ends, begin + room)) + 1)
                held.append((doc[at:to], per[at:to], ids[begin : ends[to - 1]]))
                at = to
                if ends[to - 1] - begin >= room:
                    yield flush()
        if held:
            yield flush()

    dealt = tokens.select(names).mapInArrow(deal, "doc_id long, n_ids long, ids binary, wide boolean, tie long, shard int").repartitionById(max(1, n_shards), F.col("shard"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "ids")
    ordered.mapInArrow(blocks, "shard int, block int, start long, n_ids long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone."""
    blocks = spark.read.schema("shard int, block int, start long, n_ids long, data binary").parquet(f"{path}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()[0], np.uint8)
    # The ids before each shard: one row for each of at most SHARDS shards comes to the driver.
    sums = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip([s for s, _ in sums], np.cumsum([0, *[n for _, n in sums]]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((lengths, base))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, base = shared.value
        _, ids_table, bits_table = canonical(lengths)
        for batch in batches:
            for shard, start, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "data")), strict=True):
                ids, docs, per = decode_block(data, ids_table, bits_table)
                raw, end = memoryview(ids.astype("<u4").tobytes()), np.cumsum(per.astype(np.int64))
                begin = end - per
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([id_column(docs), pa.array(begin + (start + base[shard]), pa.int64()), pa.array(per.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, path)
    return read(spark, path)


QUERIES = {"op4_token_output": (op4_token_output, None)}
