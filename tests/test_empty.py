"""Queries over tables without rows give results without failing; so do operators whose keys are null."""

import pytest

from quillon.plans import access, pages, reads
from quillon.sources.world import World

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{where}/{t}.parquet")
    return where


@pytest.mark.parametrize("module", [pages, access, reads])
def test_empty_tables(spark, nothing, module):
    for name, (run, _) in module.QUERIES.items():
        assert isinstance(run(spark, nothing).collect(), list), name


def test_null_keys_and_repeated_rows(spark, nothing):
    from quillon.operators import pages as P

    w = World(spark, nothing)
    revision = [(1, 1, 1, "create", 7, "a", False), (2, 1, 2, "edit", None, None, False), (3, None, 1, "edit", 7, "x", False), (4, 2, 1, "create", 7, "same", False), (4, 2, 1, "create", 7, "same", False)]
    w._made["revision"] = spark.createDataFrame(revision, "id long, document_id long, sequence long, kind string, actor_id long, content string, hidden boolean")
    assert sorted((r.document_id or 0, r.sequence) for r in P.latest(w.revision).collect()) == [(0, 1), (1, 2), (2, 1)]
    before = sorted((r.document_id or 0, r.sequence, r.before, r.after) for r in P.previous_revisions(w).collect())
    assert before == [(0, 1, "", "x"), (1, 1, "", "a"), (1, 2, "a", ""), (2, 1, "", "same"), (2, 1, "same", "same")]
    oldest = sorted((r.document_id or 0, r.before) for r in P.previous_revisions(w, newest=1).collect())
    assert oldest == [(0, ""), (1, "a"), (2, "same")]  # the text before the oldest one seen is not lost
    batch = spark.createDataFrame([(1, 10), (1, 11), (None, 12)], "document_id long, id long")
    assert sorted((r.document_id or 0, r.id, r.sequence) for r in P.next_sequence(w, batch).collect()) == [(0, 12, 1), (1, 10, 3), (1, 11, 4)]
