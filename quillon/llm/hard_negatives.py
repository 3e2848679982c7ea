"""Hard negatives by a dual-tree search.

Vectors lie in ball trees: rows are dealt by label and by the nearest of some sampled pivots (a range sort over label, cell and a hash of the
id, so that a common vector is spread), and each task packs its rows into trees of bounded size, a subtree a label. Trees over
anchors are made alike. Anchors are taken in blocks of bounded size, each against all trees of candidates: two nodes have an
interval that holds all inner products between them (centres, radii), and where it can't improve any anchor of the node on one
side, the whole pair of nodes is left out; pairs of leaves are scored exactly. First the positives are found, then, with their
scores as caps, the negatives. What tasks found is merged by rank, so that only candidates' trees are ever read again, never
shuffled.

A block of anchors is searched with two jobs; the driver holds one block at a time, its positives, and SAMPLE rows, which only give bounds
to begin with. Nothing is approximate.

Defined results: rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Shorter vectors
count as followed by zeros, an empty one as all zeros. Ties of score go by the smaller id; rows with an anchor's own id are never its
positives. A repeated anchor row has its results as often as it stands there, a repeated candidate row counts as another row. An
empty table, or one without anchors, gives an empty result. Components of 2^31 / 256 and more, and inner products that may pass 2^56, are
an error, since scores would no longer be exact. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import frugal, shared_dir, stored, table

TREE_ROWS, ANCHOR_ROWS = 8192, 8192  # rows of a tree at most
TREE_BYTES = 16 << 20  # of its vectors; long vectors make trees of fewer rows
LEAF, ANCHOR_LEAF = 128, 16
PIVOTS, SAMPLE = 128, 1024
NONE = -(1 << 62)
NO_ID = (1 << 63) - 1


class Tree:
    """Rows ordered so that every node is a range of them. The roots are the labels' subtrees."""

    FIELDS = "ids labels v start end left right center radius least roots".split()
    KINDS = dict.fromkeys(FIELDS, "<i8") | {"v": "<i4", "center": "<f8", "radius": "<f8"}

    def __init__(self, **arrays: np.ndarray):
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self.norm = np.sqrt((self.center**2).sum(1))
        self.values = self.v.astype(np.float64)
        self.most = int(np.abs(self.v).max(initial=0))

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int) -> Tree:
        order = np.lexsort((ids, labels))
        x = v.astype(np.float64)
        start, end, left, right, center, radius, least, roots = ([] for _ in range(8))

        def node(a: int, b: int) -> int:
            rows = x[order[a:b]]
            middle = rows.mean(0)
            start.append(a)
            end.append(b)
            left.append(-1)
            right.append(-1)
            center.append(middle)
            radius.append(float(np.sqrt(((rows - middle) ** 2).sum(1).max())))
            least.append(int(ids[order[a:b]].min()))
            return len(start) - 1

        cuts = np.flatnonzero(np.concatenate([[True], labels[order][1:] != labels[order][:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            roots.append(node(a, b))
            todo = [roots[-1]]
            while todo:
                k = todo.pop()
                a, b = start[k], end[k]
                if b - a <= leaf:
                    continue
                rows = x[order[a:b]]
                one = rows[((rows - center[k]) ** 2).sum(1).argmax()]
                other = rows[((rows - one) ** 2).sum(1).argmax()]
                along = rows @ (other - one)
                order[a:b] = order[a:b][np.lexsort((ids[order[a:b]], along))]  # equal vectors by id
                # Between the two, or in the middle where that would leave little on one side.
                cut = a + int((along < (one + other) @ (other - one) / 2).sum())
                if min(cut - a, b - cut) * 20 < b - a:
                    cut = (a + b) // 2
                left[k], right[k] = node(a, cut), node(cut, b)
                todo += [left[k], right[k]]
        whole = [np.array(c, np.int64) for c in (start, end, left, right)]
        return cls(ids=ids[order], labels=labels[order], v=v[order], **dict(zip("start end left right".split(), whole, strict=True)), center=np.array(center), radius=np.array(radius), least=np.array(least, np.int64), roots=np.array(roots, np.int64))

    def packed(self) -> list[bytes]:
        return [getattr(self, f).astype(self.KINDS[f]).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, dims: int, row: list[bytes]) -> Tree:
        got = {f: np.frombuffer(x, cls.KINDS[f]) for f, x in zip(cls.FIELDS, row, strict=True)}
        return cls(**got | {f: got[f].reshape(-1, dims) for f in ("v", "center")})


class Best:
    """For each place the first k by score and id, and what a score must reach to begin with."""

    def __init__(self, places: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores, self.ids = np.full((places, k), NONE, np.int64), np.full((places, k), NO_ID, np.int64)
        self.floor = np.full(places, NONE, np.int64) if floor is None else floor

    def bounds(self, places: slice) -> tuple[np.ndarray, np.ndarray]:
        """What a score must exceed, or reach with a smaller id."""
        last, ids, floor = self.scores[places, -1], self.ids[places, -1], self.floor[places]
        return np.maximum(last, floor), np.where(last < floor, NO_ID, ids)

    def add(self, places: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        own, nth = np.unique(places, return_inverse=True)
        k = self.k
        at = np.concatenate([np.repeat(np.arange(len(own)), k), nth])
        s, i = np.concatenate([self.scores[own].ravel(), scores]), np.concatenate([self.ids[own].ravel(), ids])
        order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        first = np.searchsorted(at, np.arange(len(own)))
        rank = np.arange(len(at)) - first[at]
        kept = rank < k
        self.scores[own[at[kept]], rank[kept]], self.ids[own[at[kept]], rank[kept]] = s[kept], i[kept]


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as integers. exact: doubles hold them."""
    return np.rint(a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.T.astype(np.int64)


def is_exact(a: Tree, b: Tree) -> bool:
    bound = a.most * b.most * max(1, a.v.shape[1])
    if bound >= 1 << 56:
        raise ValueError("inner products may pass 2^56")
    return bound < 1 << 53


def walk(anchors: Tree, trees: Tree, same_label: bool, needed: Callable[[slice, int, int, int], bool], score: Callable[[slice, slice], None]) -> None:
    """Pairs of nodes from the roots down, the ones that promise most first. needed(anchors, lower, upper, least id) says whether a pair can
    matter with scores in that interval; score is given pairs of leaves."""
    a, b = anchors, trees

    def interval(i: int, j: int) -> tuple[int, int]:
        middle = float(a.center[i] @ b.center[j])
        far = a.radius[i] * b.norm[j] + b.radius[j] * a.norm[i] + a.radius[i] * b.radius[j]
        slack = 1e-6 + 1e-9 * (far + a.norm[i] * b.norm[j])  # for rounding; scores are whole
        return int(np.ceil(middle - far - slack)), int(np.floor(middle + far + slack))

    todo = []
    for i in a.roots.tolist():
        for j in b.roots.tolist():
            if (a.labels[a.start[i]] == b.labels[b.start[j]]) == same_label:
                todo.append((interval(i, j), i, j))
    todo.sort(key=lambda x: x[0][1])
    while todo:
        (lower, upper), i, j = todo.pop()
        rows = slice(int(a.start[i]), int(a.end[i]))
        if not needed(rows, lower, upper, int(b.least[j])):
            continue
        split_a, split_b = a.left[i] >= 0, b.left[j] >= 0
        if not split_a and not split_b:
            score(rows, slice(int(b.start[j]), int(b.end[j])))
            continue
        # The wider side is cut, so that both shrink together.
        if split_b and (not split_a or b.radius[j] >= a.radius[i]):
            pairs = [(i, int(b.left[j])), (i, int(b.right[j]))]
        else:
            pairs = [(int(a.left[i]), j), (int(a.right[i]), j)]
        todo += sorted(((interval(*p), *p) for p in pairs), key=lambda x: x[0][1])


def find_positives(anchors: Tree, trees: Tree, best: Best) -> None:
    """The best of the same label, but for rows with the anchor's own id."""
    exact = is_exact(anchors, trees)

    def needed(rows: slice, lower: int, upper: int, least: int) -> bool:
        bound, ids = best.bounds(rows)
        return bool(((upper > bound) | ((upper == bound) & (least < ids))).any())

    def score(rows: slice, others: slice) -> None:
        s, ids = products(anchors.values[rows], trees.values[others], exact), trees.ids[others]
        bound, last = (x[:, None] for x in best.bounds(rows))
        i, j = np.nonzero(((s > bound) | ((s == bound) & (ids < last))) & (ids != anchors.ids[rows, None]))
        if len(i):
            best.add(rows.start + i, s[i, j], ids[j])

    walk(anchors, trees, True, needed, score)


def find_negatives(anchors: Tree, trees: Tree, caps: np.ndarray, lows: np.ndarray, best: Best) -> None:
    """For each anchor and each of its caps the best of other labels from lows to caps. Places are anchor times caps of an anchor plus cap."""
    exact, p = is_exact(anchors, trees), caps.shape[1]

    def bounds(rows: slice) -> tuple[np.ndarray, np.ndarray]:
        bound, ids = best.bounds(slice(rows.start * p, rows.stop * p))
        return bound.reshape(-1, p), ids.reshape(-1, p)

    def needed(rows: slice, lower: int, upper: int, least: int) -> bool:
        bound, ids = bounds(rows)
        return bool(((lower <= caps[rows]) & (upper >= lows[rows]) & ((upper > bound) | ((upper == bound) & (least < ids)))).any())

    def score(rows: slice, others: slice) -> None:
        s, ids = products(anchors.values[rows], trees.values[others], exact), trees.ids[others]
        bound, last = bounds(rows)
        found = []
        for c in range(p):
            low = np.maximum(bound[:, c], lows[rows, c])[:, None]
            i, j = np.nonzero((s <= caps[rows, c, None]) & (s >= low) & ((s > bound[:, c, None]) | (ids < last[:, c, None])))
            if len(i):
                found.append(((rows.start + i) * p + c, s[i, j], ids[j]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))

    walk(anchors, trees, False, needed, score)


# --- on Spark --------------------------------------------------------------------------------------------------------


def usable(vectors: DataFrame, relabelled: int = 7) -> DataFrame:
    """vec_id, label, v of the rows that take part; every relabelled-th id has a wrong label first."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % relabelled == 0, (label + 1) % 10).otherwise(label)
    d = vectors.where("vec_id is not null and label is not null and embedding is not null").where(~odd)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def whole_numbers(lists: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of each component, as rows of dims."""
    lists = lists.cast(pa.large_list(pa.float64()))
    ends = lists.offsets.to_numpy()
    x = np.floor(256 * lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
    if (np.abs(x) >= 1 << 31).any():
        raise ValueError("a component is too large")
    out = np.zeros((len(lists), dims), np.int32)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(lists)), size)
    out[row, np.arange(len(x)) - np.repeat(ends[:-1] - ends[0], size)] = x
    return out


PACKED = "tree long, n long, " + ", ".join(f"{f} binary" for f in Tree.FIELDS)


def packed_trees(rows: DataFrame, dims: int, most: int, leaf: int) -> DataFrame:
    """Rows (vec_id, label, v) of each task as trees, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, size = 0, [], 0

        def tree() -> pa.RecordBatch:
            nonlocal made, held, size
            ids, labels, v = (np.concatenate(c) for c in zip(*held, strict=True))
            t = Tree.build(ids, labels, v, leaf)
            key = TaskContext.get().partitionId() << 32 | made
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(ids)]), *(pa.array([x], pa.binary()) for x in t.packed())], ["tree", "n", *Tree.FIELDS])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, most - size)
                v = np.frombuffer(b"".join(part.column("v").to_pylist()), "<i4").reshape(-1, dims)
                held.append((part.column("vec_id").to_numpy(), part.column("label").to_numpy(), v))
                at, size = at + part.num_rows, size + part.num_rows
                if size >= most:
                    yield tree()
        if held:
            yield tree()

    return rows.select("vec_id", "label", "v").mapInArrow(frugal(run), PACKED)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(trees: DataFrame, dims: int, best: Callable[[], Best], search: Callable[[Tree, Best], None]) -> DataFrame:
    """place, score, vec_id: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = best()
        for batch in batches:
            for i in range(batch.num_rows):
                search(Tree.unpacked(dims, [batch.column(f)[i].as_py() for f in Tree.FIELDS]), own)
        place, rank = np.nonzero(own.scores > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(own.scores[place, rank]), pa.array(own.ids[place, rank])], ["place", "score", "vec_id"])

    return trees.select(*Tree.FIELDS).mapInArrow(frugal(run), "place long, score long, vec_id long")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, tree_rows: int = TREE_ROWS, anchor_rows: int = ANCHOR_ROWS, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id every divides; negatives have at
    least so many percent of the positive's score, and at most all of it."""
    spark = vectors.sparkSession
    d = usable(vectors)
    dims = max(1, d.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = d.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "label", "v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], RESULT)
    sample = sample.combine_chunks().to_batches()[0]
    known = Tree.build(sample.column("vec_id").to_numpy(), sample.column("label").to_numpy(), whole_numbers(sample.column("v"), dims), leaf)
    pivots = spark.sparkContext.broadcast(known.values[:: max(1, len(known.ids) // PIVOTS)])

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = whole_numbers(part.column("v"), dims)
                cell = (v @ p.T - (p**2).sum(1) / 2).argmax(1)  # the nearest pivot
                data = v.astype("<i4").tobytes()
                rows = pa.array([data[i : i + 4 * dims] for i in range(0, len(data), 4 * dims)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(cell), rows], ["vec_id", "label", "cell", "v"])

    rows = stored(d.mapInArrow(frugal(quantise), "vec_id long, label long, cell long, v binary"))
    sizes = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    tree_rows, anchor_rows = (max(16, min(n, TREE_BYTES // (4 * dims))) for n in (tree_rows, anchor_rows))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["label", "cell", F.xxhash64("vec_id")]
    tasks = max(-(-sizes[0] // tree_rows), min(least, -(-sizes[0] // 1024)))
    trees = stored(packed_trees(rows.repartitionByRange(max(1, tasks), *by), dims, tree_rows, leaf))
    own = rows.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, -(-sizes[1] // anchor_rows)), *by)
    blocks = stored(packed_trees(own.coalesce(max(1, -(-sizes[1] // anchor_rows))), dims, anchor_rows, ANCHOR_LEAF))

    out = shared_dir(spark)
    spark.createDataFrame([], RESULT).write.parquet(out)
    for (key,) in blocks.select("tree").collect():  # a number for each block
        row = blocks.where(F.col("tree") == key).select(*Tree.FIELDS).first()
        anchors = Tree.unpacked(dims, list(map(bytes, row)))
        n = len(anchors.ids)
        # Scores that the sampled rows reach are bounds to begin with.
        begin = Best(n, positives)
        find_positives(anchors, known, begin)
        given = spark.sparkContext.broadcast((list(map(bytes, row)), begin.scores[:, -1].copy()))

        def first(given=given, n=n) -> Best:
            return Best(n, positives, given.value[1])

        def search(tree: Tree, best: Best, given=given) -> None:
            find_positives(Tree.unpacked(dims, given.value[0]), tree, best)

        found = _ranked(_searched(trees, dims, first, search), positives).toArrow()
        caps, partners = np.full((n, positives), NONE, np.int64), np.full((n, positives), NO_ID, np.int64)
        place, rank = found["place"].to_numpy(), found["rank"].to_numpy() - 1
        caps[place, rank], partners[place, rank] = found["score"].to_numpy(), found["vec_id"].to_numpy()
        lows = np.where(caps > NONE, -(-percent * np.where(caps > NONE, caps, 0) // 100), -NONE)
        start = Best(n * positives, negatives)
        find_negatives(anchors, known, caps, lows, start)
        more = spark.sparkContext.broadcast((caps, lows, start.scores[:, -1].copy()))

        def first_negatives(more=more, n=n) -> Best:
            return Best(n * positives, negatives, more.value[2])

        def search_negatives(tree: Tree, best: Best, given=given, more=more) -> None:
            find_negatives(Tree.unpacked(dims, given.value[0]), tree, *more.value[:2], best)

        pairs = pa.table({"place": place * positives + rank, "anchor_id": anchors.ids[place], "positive_id": found["vec_id"], "positive_score": found["score"]})
        best = _ranked(_searched(trees, dims, first_negatives, search_negatives), negatives)
        named = best.join(F.broadcast(spark.createDataFrame(pairs)), "place")
        named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        given.unpersist()
        more.unpersist()
    return spark.read.schema(RESULT).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
QUERIES = {"op12_hard_negatives": (op12_hard_negatives, ORACLE)}
