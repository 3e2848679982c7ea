"""Streams over files that come in pieces: several files, late texts, pages that lose their links, batches that run again."""

from datetime import datetime, timedelta

import pytest

from quillon.operators import changes as C
from quillon.operators import markup as M
from quillon.operators.pages import latest
from quillon.sources.storage import shared_path
from quillon.sources.world import VIEWS, World
from quillon.streaming import changes as S
from quillon.streaming.kept import Kept

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
PAGES = "id long, at timestamp, text string"


def at(n):
    return T0 + timedelta(hours=n)


def written(spark, folder, files, schema):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_references_follow_event_time(spark, tmp_path):
    files = [
        [(1, at(1), "[[A]] [[B]]"), (2, at(1), "[[C]]"), (3, at(1), None), (None, at(1), "[[N]]")],
        [(1, at(3), "no links any more"), (2, at(2), "[[C]] [[D]] [[D]]"), (2, at(2), "[[C]] [[D]] [[D]]")],
        [(1, at(2), "[[Late]]"), (3, at(2), "[[E]]"), (2, None, "[[Never]]"), (4, None, "[[F]]")],
    ]
    kept = Kept(spark, str(tmp_path / "kept"), S.REFERENCES, ["id"], 4)
    opened = []
    for i, rows in enumerate(files):
        d = spark.createDataFrame(rows, PAGES)
        d.write.parquet(str(tmp_path / f"in{i}"))
        number = i
        S.into(spark.readStream.schema(PAGES).parquet(str(tmp_path / f"in{i}")), lambda batch, _, number=number: S.take_references(kept, batch, number))
        opened.append(set(kept.read().inputFiles()))
    got = sorted((r.id or 0, r.kind, r.target) for r in S.links_of(kept).collect())
    newest = {}
    for rows in files:
        for id_, when, text in rows:
            if id_ not in newest or (when or datetime.min) >= (newest[id_][0] or datetime.min):
                newest[id_] = (when, text or "")
    last = spark.createDataFrame([(i, t) for i, (_, t) in newest.items()], "id long, text string")
    assert got == sorted({(r.id or 0, r.kind, r.target) for r in M.scan_references(last).collect()})
    assert [x for x in got if x[0] == 1] == [] and (2, "link", "D") in got
    # What a batch replaced is read by nobody any more.
    assert not any("version=0" in f for f in opened[2] if f.split("bucket=")[1].split("/")[0] in {g.split("bucket=")[1].split("/")[0] for g in opened[2] if "version=2" in g})
    before = sorted(map(str, kept.read().collect()))
    kept.vacuum()
    assert sorted(map(str, kept.read().collect())) == before and len(kept.manifests.numbers()) == 1


def test_references_of_a_stream_of_several_files_equal_replacement(spark, tmp_path):
    folder = str(tmp_path / "pages")
    stream = written(spark, folder, [[(1, at(1), "[[A]]"), (2, at(1), "[[B]]")], [(1, at(2), "gone")], [(2, at(0), "[[Old]]"), (5, at(1), "[[분류:K]]")]], PAGES)
    kept = Kept(spark, shared_path(spark), S.REFERENCES, ["id"], 3)
    S.keep_references(stream, kept)
    assert sorted(tuple(r) for r in S.links_of(kept).collect()) == [(2, "link", "B"), (5, "category", "K")]
    assert len(kept.manifests.numbers()) == 3


def test_batches_that_run_again_change_nothing(spark, tmp_path):
    schema = "k long, at timestamp, v string"
    kept = Kept(spark, str(tmp_path), schema, ["k"], 2)
    assert kept.read().collect() == []
    frames = [spark.createDataFrame(rows, schema) for rows in ([(1, at(1), "a"), (2, at(1), "b")], [(1, at(2), "c"), (3, at(1), "d")], [])]
    for n, d in enumerate(frames):
        kept.merge(d, n)
        kept.merge(d, n)
    want = [(1, at(2), "c"), (2, at(1), "b"), (3, at(1), "d")]
    assert sorted(tuple(r) for r in kept.read().collect()) == want
    kept.merge(frames[1], 1)  # the last batch with rows, after a failure
    assert sorted(tuple(r) for r in kept.read().collect()) == want


def test_latest_equals_the_window_when_files_come_in_any_order(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    folder = str(tmp_path)
    rows = events.collect()
    for i, part in enumerate((rows[600:], rows[:300], rows[300:600], [])):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = sorted((r.document_id, r.event_id) for r in S.latest_stream(spark, folder).collect())
    assert got == sorted((r.document_id, r.id) for r in latest(World(spark, SF).revision).collect())
    # Tables of several files serve all streams.
    assert sorted(map(tuple, S.windowed_stream(spark, folder).collect())) == sorted(map(tuple, S.windowed_stream(spark, SF).collect()))
    assert sorted(map(tuple, S.references_stream(spark, folder, VIEWS["marked_text"]).collect())) == sorted(map(tuple, S.references_stream(spark, SF, VIEWS["marked_text"]).collect()))


def test_streams_without_rows(spark, tmp_path):
    for name in ("events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    star = spark.createDataFrame([], "document_id long, user_id long")
    for run in (S.windowed_stream, S.sliding_stream, S.session_stream, S.latest_stream):
        assert run(spark, str(tmp_path)).collect() == []
    assert S.notify_stream(spark, str(tmp_path), star).collect() == [] and S.references_stream(spark, str(tmp_path), VIEWS["marked_text"]).collect() == []
