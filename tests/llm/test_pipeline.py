import re
import zlib
from collections import Counter

import numpy as np
from test_decontamination import brute as contaminated
from test_near_duplicates import brute as groups

import corpus_pipeline
from quillon.llm._tokens import encoder, vocabulary
from quillon.llm.quality_rules import op9_quality_rules
from quillon.llm.repeats import WINDOW

SF = "/root/testdata/sf0.001"


def without_repeats(rows):
    seen, out = {}, []
    for doc_id, text in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - WINDOW + 1):
            if seen.setdefault(raw[i : i + WINDOW], (doc_id, i)) != (doc_id, i):
                gone[i : i + WINDOW] = True
        out.append((doc_id, bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")))
    return out


def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r.doc_id for r in op9_quality_rules(spark, SF).collect() if r.kept}  # has a SQL twin of its own
    rows = [x for x in rows if x[0] in good]
    first = {i for i, _, c in groups(rows, 5, 80) if i == c}
    assert len(first) < len(rows)
    rows = without_repeats([x for x in rows if x[0] in first])
    clean = [x for x in rows if not contaminated(x[1], items)[4]]
    assert len(clean) < len(rows)
    library = encoder(vocabulary("byte_bpe_50k.json")).library
    want = Counter()
    for doc_id, text in clean:
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 2048 * 2048, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Repeated rows, shared and missing ids, and empty texts after each stage and at the end."""
    long = lambda k: " ".join(f"the word{(i * k) % 997}x{k} and" for i in range(60))
    rows = [(1, long(3)), (1, long(3)), (2, long(3)), (3, None), (4, ""), (None, long(5)), (5, long(7)), (5, long(11)), (6, long(13))]
    docs = [(i, t, "xx", "s", 1, "extra") for i, t in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, seen = frame, {}
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        seen[name] = Counter((r.doc_id, r.text if "text" in r else r.piece) for r in left.collect())
    assert seen["quality_rules"] == Counter(r for r in rows if r[1])
    want = Counter([(1, long(3)), (None, long(5)), (5, long(7)), (5, long(11)), (6, long(13))])
    assert seen["near_duplicate_groups"] == seen["repeated_passages"] == seen["benchmark_decontamination"] == want
    assert seen["best_fit_packing"] == Counter((i, 0) for i, _ in want.elements())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(i for i, _ in want.elements())


def test_stages_keep_the_columns(spark, odd):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.dtypes == docs.dtypes, name
        assert out.count() <= odd.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicate_groups", "repeated_passages", "benchmark_decontamination", "best_fit_packing"]
    assert re.search("five", corpus_pipeline.near_duplicate_groups.__doc__)
