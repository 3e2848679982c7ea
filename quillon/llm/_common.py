"""What several operators share: byte-level hashing, ragged arrays, bounded slices of batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import clear_stored, stored  # noqa: F401
from ..sources.storage import shared_path as shared_dir  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs, under fixed names; any others are left behind before they can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that doesn't tokenize: it drops tokenizers that earlier tasks left in its process, and gives working memory
    back at its end. Python workers outlive their tasks, and what they keep would be missing to others on the same executor."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kept in (("_tokens", "encoder"), ("token_alignment", "aligner")):
            if module := sys.modules.get(f"quillon.llm.{name}"):
                getattr(module, kept).cache_clear()
        yield from run(batches)
        Substrings.forget()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return tidy


def n_bytes_of(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


# --- hashing of byte strings -------------------------------------------------------------------------------------

#: Two independent families: an odd base each, and what each byte counts for.
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))
VALUES = tuple(np.random.default_rng(k).integers(0, 1 << 63, 256, np.uint64) * U64(2) + U64(1) for k in (1, 2))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, U64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Substrings:
    """64-bit hashes of any substrings of one buffer, each from two prefix sums; equal bytes hash alike in every buffer. Hashes of the
    two families are independent of each other."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def forget() -> None:
        Substrings._tables.clear()

    def __init__(self, raw: np.ndarray, family: int = 0):
        n = len(raw) + 1
        if family not in self._tables or len(self._tables[family][0]) < n:
            size, base = max(n, 1 << 16) * 5 // 4, BASES[family]
            self._tables[family] = _powers(base, size), _powers(U64(pow(int(base), -1, 1 << 64)), size)
        up, self.down = self._tables[family]
        self.sums = np.zeros(n, U64)
        np.cumsum(VALUES[family][raw] * up[: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, width: int) -> np.ndarray:
        """Of each substring of this width, by where it starts."""
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, counts)


# --- Arrow ---------------------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins (one more entry than rows). Nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def ids_of(column: pa.Array) -> np.ndarray:
    """doc_id as int64; a null counts as the smallest value."""
    column = column.cast(pa.int64())
    return column.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == -(2**63))


def pieces(batch: pa.RecordBatch, limit: int = 1 << 20, column: str = "text", rows: int = 1 << 14):
    """Slices of a batch with about limit bytes of text (a longer text stands alone) and at most rows rows each, to bound the working
    arrays."""
    if not batch.num_rows:
        return
    lengths = batch.column(column).cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1))
        yield batch.slice(at, to - at)
        at = to
