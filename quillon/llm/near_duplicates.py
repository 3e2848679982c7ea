"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents with equal shingle sets are one class from the start, whatever their number. The classes' representatives are
hashed once per shingle into bins (one permutation); an empty bin takes the value of a bin that a universal hash of its
number and the attempt picks (optimal densification). Bands of bins name buckets. A bucket of m members gives m - 1
candidates, all to one hub, instead of m * (m - 1) / 2; each is confirmed on the full sets. A star can miss a link between
two members that are both unlike the hub: for buckets of three and more that still hold different components, candidates
across components follow from an exact prefix filter, which needs no bound on a bucket's size.

A crowded bucket and a shingle that many sets share are split into parts of PART members or so wherever they meet what is
known of them, so that no task holds all members of one. A shingle in more than COMMON prefixes makes no pairs by itself: sets meet
by it together with the next shingle that they share, which is just as exact (see across_components).

Defined results: a null or word-free text has an empty set and is linked with nothing; one or two words are one shingle.
Rows that share a doc_id are one node of the graph, each with its own set size. A null doc_id is linked with nothing; its
component is null and it is kept. Extra columns are ignored. Very long texts are shingled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Substrings, frugal, mixed, pieces, stored, table, texts, utf8
from .components import connected_components

ROWS = 5  # bins in a band
MISS = 1e-7  # chance that no band shows a pair just at the threshold
SKETCH = 1 << 20  # counters of shingle rarity, which is only about speed
FAN = 128  # members that are compared with a hub in one group
PART = 512  # members of a bucket, or sets with a shingle, that a join deals to one task
COMMON = 4096  # sets that meet by one shingle; where more have it, two must be shared
BINS_AT_ONCE = 1 << 19  # bins of signatures worked on at once
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z lower-cased, cut at ASCII white space), and where each text's words begin."""
    raw = _LOWER[raw]
    letter = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    padded = np.concatenate([[False], letter, [False]])
    start = np.flatnonzero(letter & (~padded[:-2] | edge[:-1]))
    end = np.flatnonzero(letter & (~padded[2:] | edge[1:])) + 1
    return Substrings(raw)(start, end), np.searchsorted(start, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it; and where each text begins."""
    n = len(offsets) - 1
    word, first = words_of(raw, offsets)
    n_words = np.diff(first)
    whole = n_words < size
    factors = [mixed(np.array([i + 1], U64))[0] | U64(1) for i in range(size)]
    count = np.where(whole, np.minimum(n_words, 1), n_words - size + 1)
    doc = np.repeat(np.arange(n), count)
    at = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(len(doc))
    h = np.zeros(len(doc), U64)
    for i, f in enumerate(factors):
        there = i < np.where(whole, n_words, size)[doc]
        h[there] += word[(at + i)[there]] * f
    h = mixed(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(n + 1))


def signatures(h: np.ndarray, begin: np.ndarray, bins: int) -> np.ndarray:
    """One row of bins per text: the least hash in each bin, empty bins densified. Empty texts have zeros."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    # The high part of a hash picks the bin, so sorted hashes are sorted by bin, and the first of each is its least.
    place = doc * bins + ((h >> U64(40)) * U64(bins) >> U64(24)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = place[1:] != place[:-1]
    out, full = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
    out[place[new]], full[place[new]] = h[new], True
    empty = np.flatnonzero(~full)
    empty = empty[np.diff(begin)[empty // bins] > 0]
    attempt = 0
    while len(empty):
        attempt += 1
        bin_no = empty % bins
        to = (mixed((bin_no.astype(U64) << U64(32)) + U64(attempt)) % U64(bins)).astype(np.int64)
        donor = empty - bin_no + to
        hit = full[donor]
        out[empty[hit]] = out[donor[hit]]
        empty = empty[~hit]
    return out.reshape(n, bins)


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _hashed(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b (128 bits that name the set), bands (one bucket name each; none if the set is empty)."""
    salt = mixed(np.arange(1, bands * ROWS + 1).astype(U64)) | U64(1)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, rows=max(1, BINS_AT_ONCE // (bands * ROWS))):
                h, begin = shingle_sets(*utf8(batch.column("text")), size)
                n = np.diff(begin)
                sums = [np.concatenate([[U64(0)], np.cumsum(mixed(h ^ U64(k)))]) for k in (1, 2)]
                keys = [(s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums]
                sig = signatures(h, begin, bands * ROWS) * salt
                names = mixed(sig.reshape(len(n), bands, ROWS).sum(2)).view(np.int64)
                some = n > 0
                offsets = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(names[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>")


def confirm(pool: DataFrame, candidates: DataFrame, size: int, percent: int) -> DataFrame:
    """Of candidates (hub, member), those with 100 * |intersection| >= percent * |union| on the full sets of pool(doc_id, text).

    Texts meet in groups of a hub and FAN members or so: a hub with many members heads several groups.
    """
    c = candidates.select("hub", "member", F.lit(0).alias("salt"))
    degree = stored(c.groupBy("hub").agg(F.count(F.lit(1)).alias("n")))
    c = c.drop("salt").join(degree, "hub").select("hub", F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / FAN)).alias("salt"), "member")
    roles = c.select("hub", "salt", F.col("member").alias("doc_id"), F.lit(1).alias("role")).union(c.select("hub", "salt", F.col("hub").alias("doc_id"), F.lit(0).alias("role")).distinct())
    met = roles.hint("merge").join(pool, "doc_id").select("hub", "salt", "role", "doc_id", "text").repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role", "doc_id")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub_sets = None, []
        for big in batches:
            for batch in pieces(big):
                h, begin = shingle_sets(*utf8(batch.column("text")), size)
                out = []
                for i, (hub, salt, role, doc_id) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("hub", "salt", "role", "doc_id")), strict=True)):
                    mine = h[begin[i] : begin[i + 1]]
                    if role == 0:
                        if group != (hub, salt):
                            group, hub_sets = (hub, salt), []
                        hub_sets.append(mine.copy())  # several only if rows share the hub's doc_id
                        continue
                    for other in hub_sets:
                        small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                        if 100 * len(small) < percent * len(large):
                            continue
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if both and 100 * both >= percent * (len(mine) + len(other) - both):
                            out.append((doc_id, hub))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def rarity(pool: DataFrame, size: int) -> np.ndarray:
    """How many shingles of pool(text) fall into each of SKETCH hash buckets."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for big in batches:
            for batch in pieces(big):
                total += np.bincount((shingle_sets(*utf8(batch.column("text")), size)[0] % U64(SKETCH)).astype(np.int64), minlength=SKETCH)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = pool.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.uint32)
    out[rows["bucket"].to_numpy()] = np.minimum(rows["n"].to_numpy(), 2**32 - 1)
    return out


def across_components(pool: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates (hub, member) that miss no link between different components of pool(doc_id, text, component).

    Sets as alike as percent share a shingle among the first n - ceil(percent * n / 100) + 1 of each, in any common order;
    in the order of rarity such prefixes hold what sets an edited copy apart, and few others share it (prefix and position
    filter of exact set similarity joins, Xiao et al. 2008). Such sets, of two shingles and more, share two among one more of
    the first (Wang et al. 2012): if the first that they share is one that many have, they still meet by it and their second.
    """
    sketch = pool.sparkSession.sparkContext.broadcast(rarity(pool, size))

    @frugal
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                h, begin = shingle_sets(*utf8(batch.column("text")), size)
                n = np.diff(begin)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, sketch.value[(h % U64(SKETCH)).astype(np.int64)], row))
                place = np.arange(len(h)) - begin[row]
                most = (n - -(-percent * n // 100) + 1)[row]
                first = place <= most
                row, place, h, extra = row[first], place[first], h[order][first], (place == most)[first]
                ids, parts = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "component"))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids), pa.array(parts), pa.array(n[row]), pa.array(place), pa.array(extra)], ["shingle", "doc_id", "component", "n", "place", "extra"])

    # Sets as alike as percent are of the same class of size or of two next to each other (the factor keeps rounding out of it).
    width = math.log(100 / percent) * (1 + 1e-9)
    every = stored(pool.select("doc_id", "text", "component").mapInArrow(prefixes, "shingle long, doc_id long, component long, n long, place long, extra boolean"))
    own = every.where("not extra").drop("extra")

    def sharing(rows: DataFrame) -> DataFrame:
        """shingle and m of those that different components share."""
        return rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle", "m")

    counts = stored(sharing(own))
    p = own.join(counts.where(F.col("m") <= COMMON), "shingle")
    if not (common := counts.where(F.col("m") > COMMON)).isEmpty():
        first = own.join(common.select("shingle"), "shingle")
        then = every.select("doc_id", F.col("shingle").alias("next"), F.col("place").alias("later"))
        both = stored(first.join(then, "doc_id").where("later > place").select(F.xxhash64("shingle", "next").alias("shingle"), "doc_id", "component", "n", "place"))
        p = p.unionByName(both.join(stored(sharing(both)), "shingle"))
    p = p.withColumn("parts", F.ceil(F.col("m") / PART)).drop("m").withColumn("class", F.floor(F.log("n") / width))
    # One side stays in its part of the shingle and its class, the other goes to every part and to the next class as well.
    a, b = (p.select("shingle", "class", "parts", *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "component", "n", "place")]) for x in "ab")
    a = a.withColumn("a_class", F.col("class")).withColumn("class", F.explode(F.array("class", F.col("class") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    b = b.withColumn("part", F.pmod(F.xxhash64("b_doc_id"), "parts"))
    # The first shared shingle of a linked pair has nothing before it, so what comes after it must be enough.
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    enough = rest * (100 + percent) >= percent * (F.col("a_n") + F.col("b_n"))
    once = (F.col("a_class") < F.col("class")) | (F.col("a_doc_id") < F.col("b_doc_id"))
    pairs = a.drop("parts").join(b.drop("parts"), ["shingle", "class", "part"]).where((F.col("a_component") != F.col("b_component")) & once & enough)
    return pairs.select(F.least("a_doc_id", "b_doc_id").alias("hub"), F.greatest("a_doc_id", "b_doc_id").alias("member")).distinct()


def parted(members: DataFrame) -> DataFrame:
    """members(bucket, rep, crowd) with parts, how many parts the bucket has, and part, the one a member is in."""
    d = members.withColumn("parts", F.ceil(F.col("crowd") / PART))
    return d.withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))


def to_parts(buckets: DataFrame) -> DataFrame:
    """A row of each bucket(bucket, parts, ...) for each of its parts."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    d = texts(docs)
    hashed = stored(_hashed(d, size, band_count(percent)))
    real = hashed.where("doc_id is not null and n_shingles > 0")
    # Equal sets have equal bands, so any member's will do; copies fall together before they are shuffled.
    classes = stored(real.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    # Rows that share a doc_id tie their classes together: such ids are linked to each class's representative.
    members = stored(real.select("doc_id", "key_a", "key_b").join(classes.select("key_a", "key_b", "rep"), ["key_a", "key_b"]).select("doc_id", "rep"))
    copies = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    # Counts are stored before they are joined to what was counted: only then can Spark split a hot key of the join.
    crowded = stored(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("crowd"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("bucket", "crowd"))
    shared = stored(parted(buckets.join(crowded, "bucket")))
    # A bucket's hub is the member with most company in all its buckets: in a family of edited copies that is the text they come
    # from, and the same in every band, so that a family of m gives little more than m candidates.
    company = stored(shared.groupBy("rep").agg(F.sum("crowd").alias("company")))
    named = shared.join(company, "rep")
    hubs = named.groupBy("bucket").agg(F.max(F.struct("company", -F.col("rep"))).alias("h"), F.max("parts").alias("parts")).select("bucket", "parts", (-F.col("h.col2")).alias("hub"))
    star = stored(shared.join(to_parts(hubs), ["bucket", "part"]).where("rep <> hub").select("hub", F.col("rep").alias("member")).distinct())
    # Neither side has a size bound, so these joins of texts are never broadcast joins, at any size.
    pool = stored(d.join(company.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi"))
    links = stored(confirm(pool, star, size, percent))
    labels = _labels(company, links)
    # What a star can miss: links between components in buckets of three and more. These are looked for exactly.
    open_ = shared.where("crowd > 2").join(labels.withColumnRenamed("node", "rep"), "rep")
    open_buckets = open_.groupBy("bucket").agg(F.max("parts").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket", "parts")
    unsettled = open_.drop("parts").join(to_parts(open_buckets), ["bucket", "part"]).select(F.col("rep").alias("doc_id"), "component").distinct()
    unsettled = stored(pool.join(unsettled.hint("merge"), "doc_id"))
    more = stored(confirm(unsettled.select("doc_id", "text"), across_components(unsettled, size, percent), size, percent))
    if not more.isEmpty():
        links = links.union(more)
        labels = _labels(company, links)
    # Copies hang on their representative, the least id of their class. Unless an id stands in several classes, the rounds
    # above have settled everything between representatives, and copies need not enter the graph.
    if _shared_ids(members):
        final = connected_components(copies.union(links))
    else:
        final = members.select("doc_id", F.col("rep").alias("node")).join(labels, "node", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "node").alias("component"))
    final = final.groupBy("node").agg(F.min("component").alias("component"))
    out = hashed.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    parts = connected_components(links)
    return stored(nodes.select(F.col("rep").alias("node")).distinct().join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _shared_ids(members: DataFrame) -> bool:
    """Whether any doc_id stands in two classes."""
    return not members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").isEmpty()


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def oracle_ctes(size: int, percent: int) -> str:
    """Common table expressions over documents(doc_id, text): groups(doc_id, n_shingles, component_id), by all pairs that share a shingle."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
  nd_w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  nd_s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' ')) END) AS s FROM nd_w),
  nd_e AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS g FROM nd_s),
  nd_p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM nd_e a JOIN nd_e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  nd_l AS MATERIALIZED (SELECT a, b FROM nd_p JOIN nd_s x ON x.doc_id = a JOIN nd_s y ON y.doc_id = b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
  nd_both AS MATERIALIZED (SELECT a, b FROM nd_l UNION ALL SELECT b, a FROM nd_l),
  nd_r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM nd_r r JOIN nd_both e ON e.a = r.doc_id),
  groups AS (SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id FROM nd_s s JOIN (SELECT doc_id, min(root) AS component_id FROM nd_r GROUP BY doc_id) c USING (doc_id))"""


ORACLE_SQL = f"WITH RECURSIVE {oracle_ctes(3, 85)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM groups"
QUERIES = {"op10_near_duplicates": (op10_near_duplicates, ORACLE_SQL)}
