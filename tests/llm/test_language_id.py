import itertools
import zlib

import numpy as np

from quillon.llm.language_id import fit, forward_backward, loss_and_gradient, op1_language_id, predict, sample_stretches

SF = "/root/testdata/sf0.001"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths, t = np.array([3, 0, 1, 5]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(9, 3)) * 4
    posterior, pairs, log_z = forward_backward(scores, lengths, t)
    want, want_pairs, at = np.zeros((9, 3)), np.zeros((3, 3)), 0
    for i, n in enumerate(lengths):
        total = 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + j, x] for j, x in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += p
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + j, x] for j, x in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:]))) / total
            for j, x in enumerate(path):
                want[at + j, x] += p
            for a, b in zip(path, path[1:]):
                want_pairs[a, b] += p
        if n:
            assert np.isclose(log_z[i], np.log(total))
        at += n
    assert np.allclose(posterior, want) and np.allclose(pairs, want_pairs)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    weights, transitions = rng.normal(size=(12, 3)), rng.normal(size=(3, 3))
    feature, begin = rng.integers(0, 12, 20), np.array([0, 3, 4, 9, 20])
    words, lengths = np.array([0, -1, 2, 3, 3, 1, 0, -1]), np.array([5, 1, 2])
    gold = rng.integers(0, 3, 8)
    loss = lambda: loss_and_gradient(weights, transitions, words, gold, lengths, feature, begin)[0]
    _, by_weight, by_transition = loss_and_gradient(weights, transitions, words, gold, lengths, feature, begin)
    for values, gradient in ((weights, by_weight), (transitions, by_transition)):
        for i in np.ndindex(values.shape):
            kept = values[i]
            values[i] = kept + 1e-5
            up = loss()
            values[i] = kept - 1e-5
            assert abs((up - loss()) / 2e-5 - gradient[i]) < 1e-5
            values[i] = kept


def test_document_score_is_the_mean_posterior():
    model = fit([("de", "das haus steht nahe wasser".split()), ("en", "the house stands near water".split())] * 20)
    texts = ["the haus stands", "42 !!", "das wasser 7 water"]
    for text, shares in zip(texts, model.shares(texts)):
        words = text.split()
        paths = {}
        scores = model.scores(words)
        for path in itertools.product(range(2), repeat=len(words)):
            paths[path] = np.exp(sum(scores[j, x] for j, x in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
        mean = [sum(p * path.count(k) for path, p in paths.items()) / sum(paths.values()) / len(words) for k in range(2)]
        assert np.allclose(shares, mean if any(map(str.isalpha, text)) else 0)


def test_sample_is_bounded_when_ids_repeat(spark):
    rows = [(7, f"some words {i}", "xx") for i in range(500)] + [(i, "other words here", f"l{i % 40}") for i in range(400)]
    got = sample_stretches(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 5, 1)
    assert len([x for x, _ in got if x == "xx"]) <= 1 and len(got) < 41 * 15


def test_code_switched_words():
    a, b = "the house stands near green water today".split(), "das haus steht nahe grünem wasser heute".split()
    model = fit([("de", b * 4), ("en", a * 4)] * 20)
    posterior, _ = model.label([" ".join(a + b + a)])
    assert posterior.argmax(1).tolist() == [1] * 7 + [0] * 7 + [1] * 7
    assert model.transitions[0, 0] > model.transitions[0, 1]


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op1_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97


def test_odd_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    model = fit(sample_stretches(odd.withColumn("lang", F.lit("xx"))))
    rows = {r.doc_id: r for r in predict(odd, model, spans_too=True).collect()}
    assert len(rows) == 10 and all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3))
    assert rows[6].lang_pred == "xx" and rows[6].spans[0].last == 3999
    assert predict(empty, model).collect() == []
    none = fit(sample_stretches(empty.withColumn("lang", F.lit("xx"))))
    assert {r.lang_pred for r in predict(odd, none).collect()} == {"und"}
