import re
from collections import Counter

import duckdb
from odd_rows import ODD_ROWS

from quillon.llm.quality_rules import ORACLE_SQL, judge, op9_quality_rules, passing

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(text):
    """The base columns, straight from their definition."""
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), n < 50 or 100 * len(repeat) > 50 * n


HARD = ["a b c a b c", "a b c d", "a b", "x x x", "x x x x", " a b c", "a\x0bb\x0cc\rd", "#*$ %&|<> ##", "l\nl\n \n\nl", "\n\n", "w " * 60, "é ü 日本 " * 40, "a b c " + " ".join(map(str, range(80))) + " a b c"]


def test_equals_definition(spark, documents, odd):
    docs = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for d in (documents, odd, docs):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judge(d).collect())
        assert got == Counter((r.doc_id, *brute(r.text)) for r in d.collect())


def test_equals_duckdb_on_odd_rows(odd):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ODD_ROWS])
    result = c.execute(ORACLE_SQL)
    names = [d[0] for d in result.description]
    want = Counter(tuple(sorted(zip(names, r), key=str)) for r in result.fetchall())
    assert Counter(tuple(sorted({**r.asDict(), "failed": ",".join(r.failed)}.items(), key=str)) for r in judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed").collect()) == want


def test_no_python_and_no_shuffle(spark):
    plan = op9_quality_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_clean_documents_are_kept(spark, empty):
    kept = {r.doc_id for r in op9_quality_rules(spark, "/root/testdata/sf0.01").where("kept or n_words < 50").collect()}
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect()}
    assert len(good - kept) <= 0.01 * len(good)
    assert passing(empty).collect() == [] and passing(empty).dtypes == empty.dtypes
