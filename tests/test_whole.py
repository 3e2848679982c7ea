"""Queries do the whole job: small inputs on which a cut would show."""

import html
import re
from ipaddress import ip_address, ip_network
from datetime import datetime
from time import monotonic
from types import SimpleNamespace
from urllib.parse import quote

import pytest

from pyspark.sql import functions as F

from quillon.functions import markup as M
from quillon.functions import text as T
from quillon.operators import access as A
from quillon.operators import markup as O
from quillon.plans.access import NOW
from quillon.plans.registry import QUERIES
from quillon.sources.world import World

#: Longer than any cut, with markup at the far end only.
LONG = "plain words & more " * 300 + "\n== Far ==\n==== Farther ====\n[[/far|x]] [[분류:Far off]] [nope] @far=1@ '''b'''\n||c||\n[include(틀:Box, a=1)]" + "\nend " * 50


def test_threads_of_document_are_all_there(spark):
    w = SimpleNamespace(
        namespace=spark.createDataFrame([(0, "main"), (1, "template")], "id long, name string"),
        document=spark.createDataFrame([(5, 0, "Doc 5"), (6, 0, "Doc 6"), (7, 1, "Doc 5")], "id long, namespace_id long, title string"),
        thread=spark.createDataFrame([(i, 5 if i % 2 and i < 301 else 6 if i % 4 else 7, "normal", f"Topic {i}") for i in range(600)], "id long, document_id long, status string, topic string"),
    )
    got = A.threads_of(w, "main", "Doc 5").collect()
    assert [(r.id, r.topic, r.title) for r in got] == [(i, f"Topic {i}", "Doc 5") for i in range(299, 0, -2)]


@pytest.fixture
def long_texts(spark, tmp_path):
    d = str(tmp_path / "in")
    spark.createDataFrame([(7, "short", "xx", "s", 5), (8, LONG, "xx", "s", len(LONG))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{d}/events.parquet")
    return d


def test_markup_queries_read_whole_texts(spark, long_texts):
    marked = {r.id: r.text for r in World(spark, long_texts).marked_text.collect()}
    assert marked[8].endswith(LONG) and marked[7].endswith("short")
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name][0](spark, long_texts).where("id = 8").collect())
    s = marked[8]
    assert rows("parse_tokens") == sorted((8, *t) for t in M.token_rows(s))
    assert "plain words &amp; more" in rows("render_html")[0][1] and rows("render_html")[0][1].count("<h") >= 4 and rows("plain_text") == [(8, M.plain_text(M.parse(s)))] and rows("render_json") == [(8, M.tree_json(s))]
    assert rows("token_headings") == [(8, 4)] and len(rows("heading_outline")) == 4 and (8, 4, 4, 2) in rows("heading_level_skips")
    assert (8, "link", "Page/Sub/far") in rows("scan_refs") and (8, "/far", "Page/8/far") in rows("relative_link_targets") and (8, "/far") in rows("link_targets")
    assert rows("category_extract") == [(8, "Far off"), (8, "xx")] and (8, "far") in rows("template_variables")
    assert {(r[3], r[6]) for r in rows("diagnose")} >= {("unsupported-macro", "nope"), ("heading-level-skip", "2->4")}
    assert sorted((r.detail, r.n) for r in QUERIES["unknown_macros"][0](spark, long_texts).collect()) == [("nope", 1), ("noxx", 2)]
    assert rows("marker_residue")[0][1:] == tuple(len(re.findall(re.escape(m), s)) for m in ("[[", "]]", "{{{", "}}}", "'''", "||", "[*", "#!"))
    assert rows("expand_includes")[0][1].count("A=1") == 2 and rows("expand_includes")[0][1].endswith("end ")


def test_rows_of_a_batch_go_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(O, "STEP", 3)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "cd", None, "", "efgh", "i"])], "id long, text string")
    got = O.rows_of(d.coalesce(1), ["text"], lambda t: [(c,) for c in t], "c string").collect()
    assert [(r.id, r.c) for r in got] == [(0, "a"), (0, "b"), (1, "c"), (1, "d"), (4, "e"), (4, "f"), (4, "g"), (4, "h"), (5, "i")]


def test_texts_are_escaped_and_encoded_whole(spark, long_texts):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{long_texts}/documents.parquet").collect()}
    escaped = {r.doc_id: r.escaped for r in QUERIES["html_escape_text"][0](spark, long_texts).collect()}
    encoded = {r.doc_id: r.encoded for r in QUERIES["percent_encode_titles"][0](spark, long_texts).collect()}
    assert escaped == {k: html.escape(t, quote=False) for k, t in text.items()}
    assert encoded == {k: quote(t, safe=":/()") for k, t in text.items()}


def test_category_names_are_whole(spark, tmp_path):
    name = "long " * 100 + "name"
    spark.createDataFrame([(1, f"[[분류:{name}]]", "xx", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    assert name in [r.category for r in QUERIES["category_extract"][0](spark, f"{tmp_path}/in").collect()]


@pytest.mark.parametrize("strict", [True, False])
def test_every_actor_gets_a_decision_on_every_document(spark, strict):
    w, now = World(spark, "/root/testdata/sf0.001"), datetime.fromisoformat(NOW)
    member = {(m.name, m.actor_id) for m in w.acl_group_member.collect() if m.removed_at is None and (m.expires_at is None or m.expires_at > now)}
    rules = sorted((r for r in w.acl_rule.collect() if r.action == "edit"), key=lambda r: (r.document_id is None, r.evaluation_order, r.id))
    actors, documents = w.actor.collect(), w.document.collect()
    pairs = [(i * len(documents) + j, d.id, a.id) for i, a in enumerate(actors) for j, d in enumerate(documents)]
    odd = [(-1, None, actors[0].id), (-2, documents[0].id, None), (-3, 10**9, actors[0].id), (-4, documents[0].id, 10**9)]
    requests = spark.createDataFrame(pairs + odd, "id long, document_id long, actor_id long")
    got = {r.id: (r.allowed, r.rule_id) for r in A.decided(w, requests, "edit", NOW, strict).collect()}
    assert len(got) == len(pairs) + 4 and all(got[-i] == (False, None) for i in (1, 2, 3, 4))
    want = {}
    for i, a in enumerate(actors):
        known = {"any": True, "member": a.user_name is not None, "ip": a.user_name is None}
        inside = lambda net: a.ip is not None and ip_address(a.ip) in ip_network(net)  # noqa: B023, E731
        other = {"group": lambda v: (v, a.id) in member, "user": lambda v: v == a.user_name, "ip": inside}  # noqa: B023
        applies = [r for r in rules if (other[r.kind](r.value) if r.kind in other else known.get(r.value, not strict))]
        for j, d in enumerate(documents):
            r = next((r for r in applies if r.document_id == d.id or r.document_id is None and r.namespace_id == d.namespace_id), None)
            want[i * len(documents) + j] = (r.allowed, r.id) if r else (False, None)
    assert {k: v for k, v in got.items() if k >= 0} == want and len(set(want.values())) > 2


def test_decisions_grow_with_rules_and_actors_alone(spark):
    """Ten thousand rules that name somebody: no rows of documents times actors or names."""
    from types import SimpleNamespace

    frame = spark.createDataFrame
    rules = [(i, i % 40 if i % 4 == 0 else None, i % 3, "edit", i, "user", f"user{i % 5000}", i % 2 == 0) for i in range(10_000)] + [(20_000, None, 0, "edit", 9, "perm", "any", True), (20_001, None, None, "edit", 0, "perm", "any", True)]
    w = SimpleNamespace(
        acl_rule=frame(rules, "id long, document_id long, namespace_id long, action string, evaluation_order int, kind string, value string, allowed boolean"),
        acl_group_member=frame([], "name string, actor_id long, removed_at timestamp, expires_at timestamp"), actor=frame([(i, f"user{i}", None) for i in range(3000)] + [(9000, None, "10.0.0.1"), (9001, None, "nonsense")], "id long, user_name string, ip string"),
        document=frame([(i, i % 3) for i in range(500)], "id long, namespace_id long"),
    )
    rows = A.decisions(w, "edit", NOW).collect()
    assert len(rows) < len(rules) + 2 + 2 * 3002
    requests = [(i, i % 500, i % 3000) for i in range(2000)]
    got = {r.id: (r.allowed, r.rule_id) for r in A.decided(w, frame(requests, "id long, document_id long, actor_id long"), "edit", NOW).collect()}
    for i, d, a in requests[:300]:
        own = [(r[1] is None, r[4], r[0], r[7]) for r in rules if (r[1] == d or r[1] is None and r[2] == d % 3) and (r[6] == f"user{a}" or r[5] == "perm")]
        assert got[i] == ((min(own)[3], min(own)[2]) if own else (False, None))


@pytest.mark.parametrize("name", ["acl_decisions", "acl_decisions_compat"])
def test_queries_decide_every_document_for_every_actor(spark, name):
    w, now = World(spark, "/root/testdata/sf0.001"), datetime.fromisoformat(NOW)
    rows = QUERIES[name][0](spark, "/root/testdata/sf0.001").collect()
    of_class = {(r.document_id, r["class"]): (r.allowed, r.rule_id) for r in rows if r.document_id is not None}
    class_of = {r.actor_id: r["class"] for r in rows if r.document_id is None}
    assert len(of_class) + len(class_of) == len(rows) and len(set(class_of.values())) > 2
    member = {(m.name, m.actor_id) for m in w.acl_group_member.collect() if m.removed_at is None and (m.expires_at is None or m.expires_at > now)}
    rules = sorted((r for r in w.acl_rule.collect() if r.action == "edit"), key=lambda r: (r.document_id is None, r.evaluation_order, r.id))
    actors, documents = w.actor.collect(), w.document.collect()
    assert set(class_of) == {a.id for a in actors} and {d for d, _ in of_class} == {d.id for d in documents}
    for a in actors:
        known = {"any": True, "member": a.user_name is not None, "ip": a.user_name is None}
        inside = lambda net: a.ip is not None and ip_address(a.ip) in ip_network(net)  # noqa: B023, E731
        other = {"group": lambda v: (v, a.id) in member, "user": lambda v: v == a.user_name, "ip": inside}  # noqa: B023
        applies = [r for r in rules if (other[r.kind](r.value) if r.kind in other else known.get(r.value, name == "acl_decisions_compat"))]
        for d in documents:
            r = next((r for r in applies if r.document_id == d.id or r.document_id is None and r.namespace_id == d.namespace_id), None)
            assert of_class[d.id, class_of[a.id]] == ((r.allowed, r.id) if r else (False, None))


def test_anchors_are_encoded_in_steps_of_bytes(spark):
    """All characters, and 16 MB of them in a few seconds: looking each byte up in a list of 66 took a minute."""
    letters = "".join(chr(c) for c in [*range(1, 0x3000), *range(0x10000, 0x10100)])
    want = re.sub("%..", lambda m: m[0].lower(), quote(letters, safe=""))
    rows = spark.createDataFrame([(letters,), ("",), (None,)], "text string").select(T.percent_encode_anchor(F.col("text")).alias("a")).collect()
    assert [r.a for r in rows] == [want, "", None]
    large = spark.range(1).select(F.repeat(F.lit("an English anchor, é "), 800_000).alias("text"))
    start = monotonic()
    assert large.select(F.length(T.percent_encode_anchor(F.col("text"))).alias("n")).first().n == 800_000 * 36 and monotonic() - start < 20
