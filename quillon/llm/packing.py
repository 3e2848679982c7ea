"""Best-fit packing by minimum bin slack over the histogram of lengths.

Which lengths go together depends on the counts of lengths alone, at most capacity of them, so the search runs once on the
driver whatever the corpus: per bin a subset-sum dynamic programme over the available lengths, a bitset of reachable
sums, finds the fullest feasible combination; the combination is removed as often as the counts allow and becomes a
pattern with a multiplicity. There are few patterns (each use exhausts a length), so the plan is small, and pieces are
dealt to it by their rank within their length. The rank needs no sort: a piece counts within its own task, and the
tasks' counts are added up per length.

Defined results: null and empty texts have the end id alone. Repeated rows are packed row by row. Longer documents are
cut so that only the first piece is short. An empty table packs into nothing. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import pieces, stored, table, texts
from ._tokens import encoder, vocabulary


def fullest(available: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """Of (length, count), longest first, a choice [(length, times)] whose sum is as large as it can be, at most room.

    Bit s of reach[i] says that sum s can be made from the first i lengths; counts enter by binary splitting.
    """
    mask = (1 << (room + 1)) - 1
    reach, parts = [1], []
    for length, count in available:
        if length > room:
            continue
        left, step = min(count, room // length), 1
        while left:
            take = min(step, left)
            parts.append((length, take))
            reach.append((reach[-1] | reach[-1] << length * take) & mask)
            left -= take
            step *= 2
        if reach[-1] >> room & 1:
            break
    total = reach[-1].bit_length() - 1
    chosen: dict[int, int] = {}
    for i in range(len(parts) - 1, -1, -1):
        if not reach[i] >> total & 1:
            length, take = parts[i]
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return sorted(chosen.items(), reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, times in each bin)])]. The longest length left is always in the bin, as in the published heuristic."""
    left, plan = dict(histogram), []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest([(n, c) for n, c in sorted(left.items(), reverse=True) if c], capacity - longest)
        left[longest] += 1
        pattern = dict(rest)
        pattern[longest] = pattern.get(longest, 0) + 1
        bins = min(left[n] // times for n, times in pattern.items())
        for n, times in pattern.items():
            left[n] -= bins * times
            if not left[n]:
                del left[n]
        plan.append((bins, sorted(pattern.items(), reverse=True)))
    return plan


def slots(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by length: from rank on, the pieces of this length go to the bins from first_bin, times each, at offset."""
    rows, used, first = [], {}, 0
    for bins, pattern in plan:
        at = 0
        for n, times in pattern:
            rows.append((n, used.get(n, 0), first, times, at))
            used[n] = used.get(n, 0) + bins * times
            at += n * times
        first += bins
    rows.sort()
    return dict(zip(("length", "rank", "bin", "times", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with its task and its rank among the task's pieces of the same length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, task = encoder(tokenizer).ids, np.uint32(end_id).tobytes(), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in (part for big in batches for part in pieces(big)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = ids_of(text) + end
                n = len(ids) // 4
                start, to, piece = 0, n - (n - 1) // capacity * capacity, 0
                while start < n:
                    rows.append((doc_id, piece, start, to - start, zlib.crc32(ids[4 * start : 4 * to]), task, int(seen[to - start])))
                    seen[to - start] += 1
                    start, to, piece = to, to + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (1, 5) else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    cut = stored(cut_pieces(texts(docs), tokenizer, capacity, end_id))
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = spark.sparkContext.broadcast(slots(minimum_bin_slack(histogram, capacity)))
    # Rank of a task's first piece of a length: the counts of the tasks before it. A row per task and length, not per piece.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            # Slots are ordered by length, then rank: the last one at or before (length, rank) is the piece's.
            lo, hi = np.searchsorted(p["length"], length), np.searchsorted(p["length"], length, "right")
            while (lo + 1 < hi).any():
                mid = (lo + hi) // 2
                up = (lo + 1 < hi) & (p["rank"][np.minimum(mid, len(p["rank"]) - 1)] <= rank)
                lo, hi = np.where(up, mid, lo), np.where(up | (lo + 1 >= hi), hi, mid)
            nth, times = rank - p["rank"][lo], p["times"][lo]
            sequence, offset = p["bin"][lo] + nth // times, p["offset"][lo] + nth % times * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], OUT)

    ranked = cut.join(first, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


OUT = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES = {"op5_best_fit_packing": (op5_best_fit_packing, None)}
