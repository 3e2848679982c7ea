"""Suffix-array dedup: bytes of strings of WINDOW bytes that also start earlier are found exactly and removed.

Sorting every suffix would move a hundred times the corpus, so suffixes are sampled by content: each window of WINDOW bytes
belongs to the suffix at its least KGRAM-byte hash (its leftmost minimizer), which equal windows share. Consecutive windows
of one suffix are a run. Two rounds of the same suffix sort decide all windows:

1. Suffixes, with the hash of their run's bytes. A run that also occurs earlier repeats as a whole. Runs that share their
   leading bytes with other runs, and more of either side, go on to round 2, one of each kind.
2. The single windows of those runs.

In each round sampled splitters range-partition the suffixes by their leading bytes (then by hash, document and place, so
that a very common passage is split as well); a bucket sorts locally by multikey quicksort and compares neighbours, and
the first suffix of a bucket is compared with the last one before it. Records travel packed, some thousands to a row.
Past the leading bytes suffixes are ordered by hash, which brings equal ones together, and that is all that dedup needs.

What the driver holds has a bound: at most RANGES splitters. Where that many ranges would be larger than a bucket, each range
is split once more by splitters of its own, which meet its records in Spark and never the driver. A task takes its buckets
one after another, so its memory is that of one bucket.

Equality is by leading bytes, 64 bits of one hash family and 32 bits or more of an independent one.

Defined results: null and empty texts, and texts under WINDOW bytes, lose nothing. Rows with equal id and text count as one
document, and each gets its result; rows with equal id and different texts are ordered by a hash of the text. A null
doc_id sorts first. Extra columns are ignored. Very long texts are treated whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Substrings, frugal, mixed, n_bytes_of, pieces, spans, stored, table, texts, utf8

WINDOW = 100
KGRAM = 32
HALF = (WINDOW - KGRAM) // 2
BUCKET = 400_000  # suffixes that a bucket is meant to have
SAMPLED = 64  # sampled suffixes per bucket
RANGES = 4096  # ranges whose splitters the driver makes
TASKS = 20_000  # tasks that a round's buckets are dealt to
STEP = 1 << 20  # bytes of text worked on at once
NULL = -(2**63)

#: A record's parts: four 8-byte sort keys, then what goes along.
KEYS = 4
FIELDS = [("k", "<u8")] * KEYS + [("left", "u1"), ("more", "u1"), ("before", "<u4"), ("after", "<u4")]
WIDTH = sum(np.dtype(t).itemsize for _, t in FIELDS)


def multikey_quicksort(keys: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """The order of records by keys[0], then keys[1], ...: three-way radix quicksort (Bentley and Sedgewick) on 8-byte
    characters. A range is split by its pivot's character; only the equal part goes on to the next character."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        c = keys[depth][part]
        pivot = np.sort(c[[0, len(c) // 4, len(c) // 2, 3 * len(c) // 4, -1]])[2]
        less, more = c < pivot, c > pivot
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _leading(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(at), U64)
    for i in range(4):
        lead = lead << U64(8) | raw[at + i].astype(U64)
    return lead


def _identity(doc: np.ndarray, tie: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys in document order: the id with its sign bit turned, then tie and place."""
    return doc.astype(np.int64).view(U64) ^ U64(1 << 63), (tie.astype(np.int64).astype(np.uint32).astype(U64) << U64(32)) | place.astype(U64)


def run_records(raw: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tie: np.ndarray) -> list[np.ndarray]:
    """Round 1: one record per run of windows that share their suffix."""
    n = len(raw)
    if n < WINDOW:
        return [np.zeros(0, t) for _, t in FIELDS]
    sub = Substrings(raw)
    value = sub.every(KGRAM)
    where, span, width = np.arange(n - KGRAM + 1, dtype=np.int32), 1, WINDOW - KGRAM + 1
    while span < width:  # leftmost least value of span, then of twice as many
        shift = min(span, width - span)
        right = value[shift:] < value[:-shift]
        value, where = np.where(right, value[shift:], value[:-shift]), np.where(right, where[shift:], where[:-shift])
        span += shift
    row = np.repeat(np.arange(len(doc)), np.diff(offsets))[: len(where)]
    fits = np.arange(len(where)) + WINDOW <= offsets[row + 1]
    new = np.ones(len(where), bool)
    new[1:] = where[1:] != where[:-1]
    new[1:] |= ~fits[:-1]
    start = np.flatnonzero(new & fits)
    last = np.flatnonzero(fits & np.concatenate([(new | ~fits)[1:], [True]]))
    a, row = where[start].astype(np.int64), row[start]
    left, more = a - start, last - start
    run = Substrings(raw, 1)(start, last + WINDOW) ^ mixed((left << 8 | more).astype(U64))
    gram = sub(a, a + KGRAM)
    has_left, has_right = left >= HALF, a - last < HALF
    low = np.maximum(a - HALF, 0)
    high = np.minimum(a + KGRAM + HALF, n)
    before = np.where(has_left, sub(low, a + KGRAM) | U64(1), U64(0)).astype(np.uint32)
    after = np.where(has_right, sub(a, high) | U64(1), U64(0)).astype(np.uint32)
    k2, k3 = _identity(doc[row], tie[row], a - offsets[row])
    return [_leading(raw, a) << U64(32) | gram & U64(0xFFFFFFFF), run, k2, k3, left.astype(np.uint8), more.astype(np.uint8), before, after]


def window_records(raw: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tie: np.ndarray, row: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Round 2: one record per window, given by row and place in it."""
    start = offsets[row] + place
    h, other = (Substrings(raw, k)(start, start + WINDOW) if len(start) else np.zeros(0, U64) for k in (0, 1))
    k2, k3 = _identity(doc[row], tie[row], place)
    zero = np.zeros(len(start), np.uint32)
    return [_leading(raw, start) << U64(32) | h >> U64(32), other, k2, k3, zero.astype(np.uint8), zero.astype(np.uint8), zero, zero]


def _pack(fields: list[np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(f.astype(t)).tobytes() for f, (_, t) in zip(fields, FIELDS, strict=True))


def _unpack(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in FIELDS]
    for blob in blobs:
        n, at = len(blob) // WIDTH, 0
        for part, (_, t) in zip(parts, FIELDS, strict=True):
            part.append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, (_, t) in zip(parts, FIELDS, strict=True)]


def _bucket(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or before each record."""
    m = len(splitters[0])
    lo, hi = np.zeros(len(keys[0]), np.int64), np.full(len(keys[0]), m)
    while m and (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, m - 1)
        at_or_before = np.zeros(len(lo), bool)
        same = np.ones(len(lo), bool)
        for k, s in zip(keys, splitters, strict=True):
            at_or_before |= same & (s[mid] < k)
            same &= s[mid] == k
        up = (at_or_before | same) & (lo < hi)
        lo, hi = np.where(up, mid + 1, lo), np.where(up | (lo >= hi), hi, mid)
    return lo


def _cut(keys: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """parts - 1 splitters of a sample, or all of it if it is smaller."""
    order = multikey_quicksort(keys)
    at = order[np.linspace(0, len(order), parts + 1).astype(int)[1:-1]] if len(order) >= parts else order
    return [k[at] for k in keys]


def gathered(parts: Iterator[list[np.ndarray]], least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Lists of FIELDS put together until they have so many records: fewer and larger blobs travel, and these are smaller in all."""
    held, n = [], 0
    for fields in parts:
        held.append(fields)
        n += len(fields[0])
        if n >= least:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _dealt(fields: list[np.ndarray], to: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Packed records by where they go."""
    if not len(to):
        return to, []
    order = np.argsort(to, kind="stable")
    fields, to = [f[order] for f in fields], to[order]
    begin = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    return to[begin], [_pack([f[a:b] for f in fields]) for a, b in zip(begin, [*begin[1:], len(to)], strict=True)]


def compared(fields: list[np.ndarray], before_it: tuple[int, int] | None, unsure: bool) -> tuple[list[np.ndarray], tuple[int, int]]:
    """The results of one bucket, (k2, k3, place, length, kind, k0, k1), and the keys of its last suffix. before_it: those of the last
    suffix before the bucket, if it is known; else the bucket's first suffix comes along as kind 2."""
    order = multikey_quicksort(fields[:KEYS])
    k0, k1, k2, k3, left, more, before, after = (f[order] for f in fields)
    n = len(k0)
    new_group = np.concatenate([[True], k0[1:] != k0[:-1]])
    new_class = new_group | np.concatenate([[True], k1[1:] != k1[:-1]])
    first = np.flatnonzero(new_class)[np.cumsum(new_class) - 1]
    repeat = (k2 != k2[first]) | (k3 != k3[first])
    repeat[0] = (int(k0[0]), int(k1[0])) == before_it
    out = [(np.flatnonzero(repeat), 0, None)]
    if unsure:
        group = np.cumsum(new_group) - 1
        reps = np.flatnonzero(new_class)
        several = np.bincount(group[reps])[group[reps]] > 1
        edge = (group[reps] == 0) | (group[reps] == group[-1])  # these may go on in the next bucket
        reps, several, edge = reps[several | edge], several[several | edge], edge[several | edge]
        twice = []
        for side in (before, after):
            _, inverse, count = np.unique(group[reps].astype(U64) << U64(32) | side[reps].astype(U64), return_inverse=True, return_counts=True)
            twice.append((count[inverse] > 1) & (side[reps] > 0) | edge)
        # Windows that reach HALF bytes or more before the suffix, and the others, which reach as far after it.
        lo = np.where(twice[0], 0, np.maximum(left[reps].astype(np.int64) - HALF + 1, 0))
        hi = np.where(twice[1], more[reps].astype(np.int64), np.minimum(more[reps], left[reps].astype(np.int64) - HALF))
        some = lo <= hi
        out.append((reps[some], 1, (lo[some], hi[some])))
    out += [(np.array([at]), kind, None) for at, kind in ((0, 2), (n - 1, 3)) if kind == 3 or before_it is None]
    rows = []
    for at, kind, bounds in out:
        lo, hi = bounds if bounds else (np.zeros(len(at), np.int64), more[at].astype(np.int64))
        start = (k3[at] & U64(0xFFFFFFFF)).astype(np.int64) - left[at]
        rows.append((k2[at], k3[at], start + lo, hi - lo + 1, np.full(len(at), kind), k0[at], k1[at]))
    return [np.concatenate(c) for c in zip(*rows, strict=True)], (int(k0[-1]), int(k1[-1]))


def sorted_round(records, source: DataFrame, n_records: int, unsure: bool) -> DataFrame:
    """records: from an iterator of batches of source to lists of FIELDS. Returns rows (doc, tie, place, length, kind): kind 0
    repeats as a whole (length windows from place on), kind 1 needs a look at its single windows (if unsure)."""
    spark = source.sparkSession
    n_buckets = max(1, -(-n_records // BUCKET))
    n_ranges = min(n_buckets, RANGES)
    inner = -(-n_buckets // n_ranges)  # buckets in a range

    def sample(share: float):
        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for fields in records(batches):
                # The suffixes with the least hashes of their identity: a sample that is the same in every attempt.
                chosen = mixed(fields[2] * U64(31) + fields[3]) < U64(min(int(min(1.0, share) * 2**64), 2**64 - 1))
                yield pa.RecordBatch.from_arrays([pa.array(f[chosen].view(np.int64)) for f in fields[:KEYS]], list("abcd"))

        return source.mapInArrow(run, "a long, b long, c long, d long")

    def keys_of(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
        return [rows.column(i).to_numpy(zero_copy_only=False).view(U64) for i in range(KEYS)] if rows.num_rows else [np.zeros(0, U64)] * KEYS

    splitters = [np.zeros(0, U64)] * KEYS
    if n_ranges > 1:
        splitters = _cut(keys_of(sample(n_ranges * SAMPLED * 4 / n_records).toArrow()), n_ranges)
    shared = spark.sparkContext.broadcast(splitters)

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fields in gathered(records(batches)):
            to, blobs = _dealt(fields, _bucket(fields[:KEYS], shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "records"])

    packed = source.mapInArrow(deal, "bucket long, records binary")
    if inner > 1:

        @frugal
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """From samples in the order of their ranges: the splitters of each range, as records of keys alone."""
            held: list[pa.RecordBatch] = []
            flush = lambda: pa.RecordBatch.from_arrays([pa.array([held[0].column("bucket")[0].as_py()], pa.int64()), pa.array([b"".join(k.tobytes() for k in _cut(keys_of(pa.Table.from_batches(held).select(list("abcd"))), inner))], pa.binary())], ["bucket", "records"])
            for part in by_bucket(batches):
                if held and held[0].column("bucket")[0] != part.column("bucket")[0]:
                    yield flush()
                    held = []
                held.append(part)
            if held:
                yield flush()

        @frugal
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with_range = lambda keys: _bucket(keys, shared.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(with_range(keys_of(batch)), pa.int64()), *batch.columns], ["bucket", *"abcd"])

        @frugal
        def deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each range's splitters come before its records."""
            known, own = -1, splitters
            for batch in batches:
                for which, is_record, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "is_record", "records")), strict=True):
                    if not is_record:
                        known, own = which, list(np.frombuffer(blob, U64).reshape(KEYS, -1))
                        continue
                    fields = _unpack([blob])
                    sub = _bucket(fields[:KEYS], own) if which == known else np.zeros(len(fields[0]), np.int64)
                    to, blobs = _dealt(fields, which * inner + sub)
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "records"])

        ranged = sample(n_buckets * SAMPLED * 4 / n_records).mapInArrow(place, "bucket long, a long, b long, c long, d long")
        chosen = ranged.repartitionById(n_ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(choose, "bucket long, records binary")
        both = chosen.select("bucket", F.lit(False).alias("is_record"), "records").union(packed.select("bucket", F.lit(True).alias("is_record"), "records"))
        packed = both.repartitionById(n_ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "is_record").mapInArrow(deal_again, "bucket long, records binary")
    total = n_ranges * inner
    tasks = min(total, TASKS)

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, bucket, last = [], -1, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal last
            fields = _unpack(blobs)
            blobs.clear()
            (k2, k3, start, length, kind, k0, k1), last = compared(fields, last, unsure)
            for a in range(0, len(k2), 100_000):
                b = a + 100_000
                edge = kind[a:b] >= 2
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((k2[a:b] ^ U64(1 << 63)).view(np.int64)), pa.array((k3[a:b] >> U64(32)).astype(np.uint32).view(np.int32)), pa.array(start[a:b].astype(np.int64)), pa.array(length[a:b].astype(np.int64)), pa.array(kind[a:b].astype(np.int32)),
                        pa.array(np.full(len(edge), bucket, np.int64)), pa.array(k0[a:b].view(np.int64), mask=~edge), pa.array(k1[a:b].view(np.int64), mask=~edge),
                    ],
                    ["doc", "tie", "place", "length", "kind", "bucket", "k0", "k1"],
                )

        for part in by_bucket(batches):
            if blobs and part.column("bucket")[0].as_py() != bucket:
                yield from flush()
            bucket = part.column("bucket")[0].as_py()
            blobs += part.column("records").to_pylist()
        if blobs:
            yield from flush()

    schema = "doc long, tie int, place long, length long, kind int, bucket long, k0 long, k1 long"
    task = F.floor(F.col("bucket") * tasks / total).cast("int")
    packed = packed.repartitionById(tasks, task)
    found = stored((packed.sortWithinPartitions("bucket") if tasks < total else packed).mapInArrow(compare, schema))
    # Does the first suffix of a task's buckets repeat the last one before it? Two rows for each of at most TASKS tasks come back.
    ends = found.where("kind >= 2").groupBy(task.alias("task")).agg(F.min(F.when(F.col("kind") == 2, F.struct("k0", "k1", "doc", "tie", "place", "length"))).alias("first"), F.max(F.when(F.col("kind") == 3, F.struct("bucket", "k0", "k1"))).alias("last"))
    across, last = [], None
    for r in sorted(ends.collect(), key=lambda r: r.task):
        if last is not None and (last.k0, last.k1) == (r.first.k0, r.first.k1):
            across.append((r.first.doc, r.first.tie, r.first.place, r.first.length, 0))
        last = r["last"]
    found = found.where("kind < 2").select("doc", "tie", "place", "length", "kind")
    return found.union(spark.createDataFrame(across, found.schema)) if across else found


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches that are sorted by bucket, each of one bucket."""
    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for a, b in zip(begin, [*begin[1:], len(bucket)], strict=True) if len(bucket) else []:
            yield batch.slice(a, b - a)


def _keyed(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    return texts(docs, *more).select(F.coalesce("doc_id", F.lit(NULL)).alias("doc"), F.hash("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"), *more)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    counts = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(counts)), counts)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, tie, starts): packed spans of windows that also start earlier, place << 16 | number of windows, per document."""
    keyed = _keyed(docs)

    def runs(batches: Iterator[pa.RecordBatch]):
        for big in batches:
            for batch in pieces(big, STEP):
                yield run_records(*utf8(batch.column("text")), *_numbers(batch))

    n_runs = n_bytes_of(keyed) * 2 // (WINDOW - KGRAM + 2)
    long_enough = keyed.where(F.octet_length("text") >= WINDOW)
    first = sorted_round(runs, long_enough, n_runs, True)
    packed = F.shiftleft("place", 16).bitwiseOR(F.col("length"))
    unsure = first.where("kind = 1")
    todo = unsure.groupBy("doc", "tie").agg(F.collect_list(packed).alias("spans"))

    def windows(batches: Iterator[pa.RecordBatch]):
        for big in batches:
            for batch in pieces(big, STEP):
                values, row = _lists(batch.column("spans"))
                place, n = values >> 16, values & 0xFFFF
                yield window_records(*utf8(batch.column("text")), *_numbers(batch), np.repeat(row, n), spans(place, n))

    n_windows = int(unsure.agg(F.sum("length")).first()[0] or 0)
    parts = first.where("kind = 0")
    if n_windows:
        second = sorted_round(windows, long_enough.join(todo, ["doc", "tie"]).select("doc", "tie", "text", "spans"), n_windows, False)
        parts = parts.union(second)
    return parts.select("doc", "tie", packed.alias("span")).groupBy("doc", "tie").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), text (what is left; bytes that are no whole
    character any more are left out), and the columns in more."""
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    met = _keyed(docs, more).join(repeated(docs), ["doc", "tie"], "left")

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, STEP):
                raw, offsets = utf8(batch.column("text"))
                values, row = _lists(batch.column("spans"))
                begin = offsets[row] + (values >> 16)
                mark = np.zeros(len(raw) + 1, np.int32)
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + (values & 0xFFFF) + WINDOW - 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                edge = np.zeros(len(raw) + 1, bool)
                edge[offsets] = True
                starts = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1]])[: len(gone)] | gone & edge[:-1])
                ends = np.flatnonzero(gone & (np.concatenate([~gone[1:], [True]])[: len(gone)] | edge[1:])) + 1
                of = np.searchsorted(starts, offsets)
                out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "spans": [], "text": []}
                for i in range(batch.num_rows):
                    a, b = offsets[i], offsets[i + 1]
                    keep = raw[a:b][~gone[a:b]].tobytes()
                    out["n_bytes"].append(int(b - a))
                    out["n_removed"].append(int(b - a) - len(keep))
                    out["n_spans"].append(int(of[i + 1] - of[i]))
                    out["kept_sha256"].append(hashlib.sha256(keep).hexdigest())
                    out["spans"].append([{"start": int(s - a), "end": int(e - a)} for s, e in zip(starts[of[i] : of[i + 1]], ends[of[i] : of[i + 1]], strict=True)])
                    out["text"].append(keep.decode(errors="ignore"))
                kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NULL), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)), *(batch.column(c) for c in more)], ["doc_id", *out, *more])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, text string"
    return met.mapInArrow(cut, ", ".join([schema, *(f"`{c}` {types[c]}" for c in more)]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: By all windows of all texts, for small tables with an id a row. Bytes are pairs of hexadecimal digits.
ORACLE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
  w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * WINDOW})) AS g FROM (SELECT doc_id, x, unnest(range(0, n - {WINDOW - 1})) AS i FROM d)),
  r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
  s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new FROM r),
  k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
  gone AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM k GROUP BY doc_id, run),
  edges AS (SELECT doc_id, a, b FROM gone UNION ALL SELECT doc_id, n, n FROM d),
  kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS begin FROM edges),
  t AS (SELECT kept.doc_id, string_agg(substr(x, 2 * begin + 1, 2 * (a - begin)), '' ORDER BY a, b) AS left_over, sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM kept JOIN d USING (doc_id) GROUP BY kept.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(left_over)) AS kept_sha256 FROM d JOIN t USING (doc_id)"""

QUERIES = {"op2_suffix_dedup": (op2_suffix_dedup, ORACLE_SQL)}
