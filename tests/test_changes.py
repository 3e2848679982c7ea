"""Changes that SQL can't say, against plain Python; files; odd batches."""

import os
import random
from datetime import datetime
from types import SimpleNamespace

import pytest

from quillon.functions import diff as D
from quillon.operators import changes as C
from quillon.operators import reads as R
from quillon.operators import search as S
from quillon.sources import files as X
from quillon.sources.storage import shared_path
from quillon.sources.world import World

AT, SF = datetime(2024, 12, 31), "/root/testdata/sf0.001"
REVISION = "id long, document_id long, sequence long, kind string, actor_id long, content string"


@pytest.fixture
def wiki(spark):
    rows = [(1, 1, 1, "create", 9, "a\nb\nc\n"), (2, 1, 2, "edit", 9, "a\nb\nC\n"), (3, 2, 1, "create", 9, "x\n"), (4, 2, 2, "delete", 9, None), (5, 3, 1, "create", 9, "p\nq\n"), (6, 3, 2, "edit", 8, "P\nq\n")]
    frame = spark.createDataFrame
    return SimpleNamespace(
        revision=frame(rows, REVISION),
        document=frame([(1, 0, "One"), (2, 0, "Two"), (3, 0, "Three"), (4, 0, "Four")], "id long, namespace_id long, title string"),
        namespace=frame([(0, "main"), (1, "template"), (2, "category"), (3, "file")], "id long, name string"),
        reference=frame([(1, 0, "Two", "link"), (9, 0, "One", "link")], "source_id long, target_namespace_id long, target_title string, kind string"),
        star=frame([(7, 1), (9, 1), (7, 1)], "user_id long, document_id long"),
    )


def test_edits_merge_or_conflict(spark, wiki):
    batch = [(11, 1, 1, 5, "A\nb\nc\n"), (12, 1, 2, 5, "later"), (13, 2, 4, 5, "new\n"), (14, 3, 5, 5, "Pp\nq\n"), (15, 4, None, 5, "first\n"), (16, 99, None, 5, "page that isn't there")]
    added, conflicts = C.edited(wiki, spark.createDataFrame(batch, "id long, document_id long, base_revision_id long, actor_id long, content string"), AT)
    got = {r.id: (r.document_id, r.sequence, r.kind, r.content, r.comment) for r in added.collect()}
    assert got == {11: (1, 3, "edit", "A\nb\nC\n", ""), 13: (2, 3, "create", "new\n", ""), 15: (4, 1, "create", "first\n", ""), 16: (99, 1, "create", "page that isn't there", "")}
    later, ours = D.merge3("a\nb\nC\n", "A\nb\nC\n", "later"), D.merge3("p\nq\n", "P\nq\n", "Pp\nq\n")
    assert later[1] and sorted(tuple(r) for r in conflicts.collect()) == [(12, later[0], 11), (14, ours[0], 6)]


def replayed(log, batch):
    """Edits one after another, on plain dictionaries: appended and conflicting ones."""
    texts, newest = {(r[1], r[0]): r[5] or "" for r in log}, {}
    for r in sorted(log, key=lambda r: r[2]):
        newest[r[1]] = (r[0], r[2], r[5] or "")
    added, conflicts = [], []
    for id_, page, base, actor, content, comment in sorted((r for r in batch if r[1] is not None), key=lambda r: (r[0], r[2] or 0, r[4])):
        last, sequence, text = newest.get(page, (None, 0, ""))
        clash = False
        if base != last:
            content, clash = D.merge3(texts.get((page, base), ""), text, content)
        if clash:
            conflicts.append((id_, content, last))
        else:
            added.append((page, sequence + 1, id_, "edit" if text else "create", actor, content, comment))
            newest[page] = (id_, sequence + 1, content)
            texts.setdefault((page, id_), content)
    return sorted(added), sorted(conflicts)


def test_many_edits_of_pages_follow_each_other(spark, wiki):
    rng = random.Random(3)
    log = [tuple(r) for r in wiki.revision.collect()]
    batch, bases = [], {1: [1, 2], 2: [3, 4], 3: [5, 6], 4: [None]}
    for n in range(100, 160):
        page = rng.choice([1, 1, 1, 2, 3, 4])
        lines = [f"{x}\n" for x in rng.choice(["abc", "abC", "pq", "Pq", "xabc"])]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", f"new {n}\n"]))
        row = (n, page, rng.choice(bases[page]), rng.randrange(3), "".join(lines), f"why {n}")
        batch += [row] * rng.choice([1, 1, 2])
        bases[page].append(n)
    batch.append((500, None, 1, 1, "x", ""))
    schema = "id long, document_id long, base_revision_id long, actor_id long, content string, comment string"
    added, conflicts = C.edited(wiki, spark.createDataFrame(batch, schema).repartition(5), AT)
    want = replayed(log, batch)
    got = sorted((r.document_id, r.sequence, r.id, r.kind, r.actor_id, r.content, r.comment) for r in added.collect()), sorted(tuple(r) for r in conflicts.collect())
    assert got == want and want[1] and len(want[0]) + len(want[1]) == len(batch) - 1


def test_repeated_rows_have_numbers_of_their_own(spark, wiki):
    rows = [(7, 0, "One", "edit", 5, "t", "c"), (7, 0, "One", "edit", 5, "t", "c"), (6, 0, "One", "edit", 5, "s", "c"), (8, 0, "New", "edit", 5, "n", None), (9, None, "One", "edit", 5, "n", None)]
    rows += [(100 + i, 0, "Two", "edit", 5, "hot", "c") for i in range(300)]
    documents, revisions = C.recorded(wiki, spark.createDataFrame(rows, "id long, namespace_id long, title string, kind string, actor_id long, content string, comment string"), AT)
    assert [(r.id, r.title) for r in documents.collect()] == [(5, "New")]
    got = sorted((r.document_id, r.sequence, r.id) for r in revisions.collect())
    assert got == sorted([(1, 3, 6), (1, 4, 7), (1, 5, 7), (5, 1, 8)] + [(2, 3 + i, 100 + i) for i in range(300)])


def test_side_effects(spark, wiki):
    index = S.Index(spark, shared_path(spark))
    changed = spark.createDataFrame([(1, 7, 9, "See [[Three]] [[틀없음]] [[분류:Kinds]] words")], "id long, revision_id long, actor_id long, text string")
    refs, notes = C.side_effects(wiki, changed, index)
    assert {(r.source_id, r.target_title, r.kind) for r in refs.collect()} == {(9, "One", "link"), (1, "Three", "link"), (1, "틀없음", "link"), (1, "Kinds", "category")} or {(r.source_id, r.target_title) for r in refs.collect()} >= {(9, "One"), (1, "Three")}
    assert [(r.user_id, r.payload) for r in notes.collect()] == [(7, '{"document":1,"revision":7}')]
    assert [r.title for r in index.search("words").collect()] == ["One"] and not index.is_empty()


def test_index_keeps_the_newest(spark):
    frame = lambda rows: spark.createDataFrame(rows, "namespace string, title string, content string")
    i = S.Index(spark, shared_path(spark))
    assert i.is_empty() and i.search("any").collect() == []
    i.put(frame([("main", "A", "old words"), ("main", "B", "other"), ("main", "C", None), ("main", "D", "x")]))
    assert i.is_empty()  # not committed yet
    i.commit()
    i.put(frame([("main", "A", "new text"), ("main", "A", "new text")]))
    i.remove(frame([("main", "B", ""), ("main", "never", "")]))
    i.commit()
    titles = lambda q: [r.title for r in i.search(q).collect()]
    for _ in range(2):
        assert titles("old") == [] and titles("other") == [] and titles("new") == ["A"] and titles("n") == [] and titles("text zzz") == ["A"]
        assert {r.title for r in i.entries().collect()} == {"A", "C", "D"}
        i.merge()
    for broken in ('a "b', "(a", "a) (b", "a AND", "OR b", "title: x"):
        with pytest.raises(ValueError, match=r"."):
            i.search(broken)


def test_numbers_are_dense_over_many_tasks(spark):
    d = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "k")
    got = sorted((r.k, r.id) for r in C.numbered(d, ["k"], C.F.lit(50)).collect())
    assert got == [(i, 51 + i) for i in range(1000)]


def test_odd_batches(spark, wiki):
    empty = spark.createDataFrame([], "id long, document_id long, base_revision_id long, actor_id long, content string, revision_id long")
    added, conflicts = C.edited(wiki, empty, AT)
    assert added.collect() == conflicts.collect() == [] and C.reverted(wiki, empty, AT).collect() == []
    odd = spark.createDataFrame([(1, None, 1, 5, "x"), (2, 1, None, 5, "x"), (3, 1, 3, 5, "x"), (4, 2, 4, 5, "x"), (5, 1, 1, 5, "x"), (5, 1, 1, 5, "x")], "id long, document_id long, revision_id long, actor_id long, extra string")
    assert sorted((r.id, r.document_id, r.sequence, r.content) for r in C.reverted(wiki, odd, AT).collect()) == [(5, 1, 3, "a\nb\nc\n"), (5, 1, 4, "a\nb\nc\n")]
    titles = spark.createDataFrame([("main", None), (None, "One"), ("main", "One"), ("main", "Two"), ("main", "One")], "namespace string, title string")
    assert sorted((r.namespace or "", r.title or "", r.there) for r in R.presence(wiki, titles).collect()) == [("", "One", False), ("main", "", False), ("main", "One", True), ("main", "One", True), ("main", "Two", False)]
    with pytest.raises(LookupError):
        R.enumeration_ids(wiki.namespace, ["main", "nowhere"])


def test_import_of_a_dump(spark, tmp_path):
    where = tmp_path / "dump" / "sub"
    where.mkdir(parents=True)
    (tmp_path / "dump" / "First_page.namu").write_text("See [[Second page]] and [[분류:All]]\n")
    (where / "Second_page.namu").write_text("#redirect First page\n")
    (where / "template%3ABox.namu").write_text("box")
    (where / "note.txt").write_text("no page")
    (where / "Broken.namu").write_bytes(b"\xff\xfe\xff")
    w = World(spark, SF)
    documents, revisions, references = X.imported(w, str(tmp_path / "dump"), 9, AT)
    assert {(r.namespace_id, r.title) for r in documents.collect()} == {(0, "First page"), (0, "Second page"), (1, "Box")}
    assert {(r.kind, r.sequence, r.content) for r in revisions.collect()} == {("import", 1, "See [[Second page]] and [[분류:All]]\n"), ("import", 1, "#redirect First page\n"), ("import", 1, "box")}
    new = {(r.target_title, r.kind) for r in references.join(documents.select(C.F.col("id").alias("source_id")), "source_id", "left_semi").collect()}
    assert ("Second page", "link") in new and ("First page", "redirect") in new
    assert references.count() >= w.reference.count()


def test_contents_are_written_once(spark, tmp_path):
    path = str(tmp_path / "contents")
    frame = spark.createDataFrame([(b"one", "image/png"), (b"one", "image/gif"), (b"two", "image/png"), (None, "x")], "content binary, media_type string")
    assert sorted((r.media_type, r.byte_size) for r in X.store_contents(frame, path).collect()) == [("image/gif", 3), ("image/png", 3)]
    more = spark.createDataFrame([(b"two", "image/png"), (b"three", "image/png")], frame.schema)
    assert [r.byte_size for r in X.store_contents(more, path).collect()] == [5] and spark.read.parquet(path).count() == 3


def test_corpus_cases(spark, tmp_path):
    (tmp_path / "a.case").write_text("근거: 도움말예제 | 원문: 2줄 | 의미론: 1줄 | IR: 1줄 | 렌더링: 1줄 | what | it shows\nfirst line\n second\nDocument\n{}\n<p>\n")
    (tmp_path / "b.case").write_text("no header\n")
    (row,) = X.corpus_cases(spark, str(tmp_path)).collect()
    assert tuple(row)[1:] == ("도움말예제", "what | it shows", "first line\n second", "Document", "{}", "<p>") and os.path.basename(row.path) == "a.case"
    cases = X.corpus_cases(spark, str(tmp_path))
    assert [r.shown for r in X.evidence(cases, "a first line\nthe second one").collect()] == [True] and [r.shown for r in X.evidence(cases, "first line").collect()] == [False]


def test_store_tables(spark, tmp_path):
    from quillon.sources import schemas as T

    assert set(T.ENUMERATIONS) <= set(T.TABLES) and len(T.TABLES) == 35
    rows = [(1, 5, None), (2, None, "10.0.0.1"), (3, None, None), (4, 6, "10.0.0.2"), (None, 7, None)]
    spark.createDataFrame(rows, "id long, user_id long, ip_address string").write.parquet(f"{tmp_path}/actor")
    actor = T.read_table(spark, "actor", str(tmp_path))
    assert actor.schema == T.schema("actor") and sorted(r.id or 0 for r in T.broken_rows("actor", actor).collect()) == [0, 3, 4]
    assert T.broken_rows("star", spark.createDataFrame([], T.schema("star"))).collect() == []
