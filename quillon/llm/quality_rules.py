"""Quality rules: one table of thresholds compiled into one Spark projection.

Only DataFrame functions and no shuffle: each document is judged where it is read, whatever its source, so a hot source
or a large group of copies costs nothing extra.

Defined results: null text, empty text and text of white space only have no words; all counts are 0 and the base rule
fails. Repeated rows are judged row by row, equally. Extra columns are ignored. Very long texts are judged whole:
positions have as many bits as Spark's arrays can be long. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

#: Fixed values of the contract: white space between words, and symbols.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"

#: Frequent short words of the corpus's languages.
STOP_WORDS = tuple("the be to of and that with in is for on as der die das und ist nicht von mit den im le la les des et est que une pour du de el los las en un una por para se".split())

#: (rule, measure, least, most, per): a document is rejected if measure / per is under least or over most (per None: the
#: measure itself). The first two are the base rules of the contract.
THRESHOLDS = (
    ("too_short", "n_words", 50, None, None),
    ("repeated_words", "n_repeat_words", None, 0.50, "n_words"),
    ("short_words", "word_chars", 2.0, None, "n_words"),
    ("long_words", "word_chars", None, 12.0, "n_words"),
    ("symbols", "n_symbols", None, 0.10, "n_words"),
    ("repeated_lines", "n_dup_lines", None, 0.60, "n_lines"),
    ("capitals", "n_capitals", None, 0.30, "word_chars"),
    ("stop_words", "n_stop_words", 2, None, None),
)
N_BASE = 2
SCALE = 100  # bounds are compared in whole numbers: SCALE * measure against bound * SCALE * per
POSITION_BITS = 31


def _fails(measure: str, least, most, per: str | None) -> Column:
    base = F.col(per) if per else F.lit(1)
    value = SCALE * F.col(measure)
    tests = [value < round(least * SCALE) * base] if least is not None else []
    tests += [value > round(most * SCALE) * base] if most is not None else []
    return reduce(Column.__or__, tests)


def measures(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and every measure that THRESHOLDS names; the columns in more are carried along."""
    d = texts(docs, *more).withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", F.lit(SPACE))
    d = d.select(
        *more,
        "doc_id",
        "text",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "").alias("lines"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
    )
    # Each three-word window is a long: hash above, position below. Equal windows are neighbours once the longs are sorted.
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    at = lambda i: F.get("words", i)
    keys = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.shiftleft(F.xxhash64(at(i), at(i + 1), at(i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")))
    d = d.select(
        *more,
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.when(F.size("words") > 3, F.sort_array(keys)).alias("windows"),
    )
    same = lambda of, a, b: F.coalesce(of(a) == of(b), F.lit(False))
    beside = lambda name, of: F.filter(name, lambda x, i: same(of, x, F.get(name, i - 1)) | same(of, x, F.get(name, i + 1)))
    d = d.withColumn("windows", beside("windows", lambda x: F.shiftright(x, POSITION_BITS)))
    # The few windows left are compared as text, so that hash collisions can't count.
    spelt = F.transform("windows", lambda k: F.struct(F.concat_ws(" ", F.slice("words", k.bitwiseAND(low).cast("int") + 1, 3)).alias("w"), k.bitwiseAND(low).cast("int").alias("p")))
    d = d.withColumn("windows", F.when(F.size("windows") > 0, F.sort_array(spelt)))
    d = d.withColumn("windows", F.sort_array(F.transform(beside("windows", lambda x: x["w"]), lambda x: x["p"])))
    covered = F.aggregate(
        "windows",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + 3).alias("end")),
        lambda a: a["n"],
    )
    # The partition number keeps the optimizer from moving a filter on a measure below these projections, where every use of an
    # array would be spelt out anew, over and over; its value never matters.
    always = F.spark_partition_id() >= 0
    return d.withColumn("n_repeat_words", F.when(always, F.coalesce(covered, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))).drop("words", "windows")


def judge(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Per document its measures, base_failed, kept, and failed: the names of the rules it breaks, in the table's order. The columns in
    more are carried along; they must not be called like one of these."""
    rules = [F.when(_fails(*r[1:]), F.lit(r[0])) for r in THRESHOLDS]
    d = measures(docs, more).withColumn("failed", F.array_compact(F.array(*rules)))
    base = reduce(Column.__or__, [_fails(*r[1:]) for r in THRESHOLDS[:N_BASE]])
    return d.withColumn("base_failed", base).withColumn("kept", F.size("failed") == 0)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that break no rule, with all their columns and in their types."""
    held = {c: f"row_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in held.items()], F.lit(0).alias("doc_id"), F.col("text"))
    return judge(renamed, tuple(held.values())).where("kept").select(*[F.col(h).alias(c) for c, h in held.items()])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judge(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))


_DUCK_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_DUCK_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _duck_fails(measure: str, least, most, per: str | None) -> str:
    base = per or "1"
    tests = [f"{SCALE} * {measure} < {round(least * SCALE)} * {base}"] if least is not None else []
    tests += [f"{SCALE} * {measure} > {round(most * SCALE)} * {base}"] if most is not None else []
    return " OR ".join(tests)


#: Common table expressions that end in judged(doc_id, ..., base_failed, kept, failed), over a relation documents.
ORACLE_CTES = f"""
  d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
  tri AS (SELECT rid, i AS p, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
  rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
  cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
  l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: trim(x, {_DUCK_SPACE}) <> '') AS lines FROM d),
  m AS (SELECT d.rid, d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
      CAST(length(translate(d.text, {_DUCK_SPACE}, '')) AS BIGINT) AS word_chars,
      CAST(length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
      CAST(len(l.lines) AS BIGINT) AS n_lines, CAST(len(l.lines) - len(list_distinct(l.lines)) AS BIGINT) AS n_dup_lines,
      CAST(len(regexp_extract_all(d.text, '\\p{{Lu}}')) AS BIGINT) AS n_capitals,
      CAST(len(list_intersect(w.words, [{_DUCK_STOPS}])) AS BIGINT) AS n_stop_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN cov USING (rid)),
  judged AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN {_duck_fails(*r[1:])} THEN '{r[0]}' END" for r in THRESHOLDS)}], lambda x: x IS NOT NULL), ',') AS failed,
      {" OR ".join(f"({_duck_fails(*r[1:])})" for r in THRESHOLDS[:N_BASE])} AS base_failed FROM m)"""
ORACLE_SQL = f"WITH {ORACLE_CTES} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed = '' AS kept, failed FROM judged"

QUERIES = {"op9_quality_rules": (op9_quality_rules, ORACLE_SQL)}
