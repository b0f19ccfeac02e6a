"""Quality rules as a short-circuit cascade, in SQL expressions only.

Each rule's cost and its share of rejections are measured on a sample; rules then run in order of
rejections per cost and stop at the first that rejects. A document is kept if no rule rejects it,
so the order changes the work and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.mixture import words_of
from orbweave.llm.runtime import ready, table

#: Rows of the sample on which costs and selectivities are measured, their share of the partitions
#: that are read for it, and the largest text in it: the driver holds at most 100 MB of them.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.05
SAMPLE_BYTES = 256 << 10
#: Bytes of text that a rule sees when it is timed (rows are repeated up to there), and runs of which the fastest counts.
TIMED_BYTES = 8 << 20
TIMED_RUNS = 2
_SPACES = "\\x20\\x09-\\x0D"
_SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over the text and the base columns; null counts as not rejecting."""

    name: str
    rejects: Callable[[], Column]


def _lines_like(pattern: str) -> Column:
    return F.size(F.filter(F.split(F.col("text"), "\n"), lambda x: F.rlike(x, F.lit(pattern))))


#: After the base rule; all are in whole numbers so that any engine decides alike. The first three
#: compare columns at hand; the others scan the text or its lines, which is what the cascade saves.
RULES = (
    Rule("symbols", lambda: 2 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", lambda: (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))),
    Rule("duplicate_lines", lambda: 2 * F.col("n_dup_lines") > F.size(F.split(F.col("text"), "\n"))),
    Rule("capitals", lambda: 2 * F.regexp_count("text", F.lit("\\p{Lu}")) > F.col("word_chars")),
    Rule("letters", lambda: 2 * F.regexp_count("text", F.lit("\\p{L}")) < F.col("word_chars")),
    Rule("digits", lambda: 10 * F.regexp_count("text", F.lit("\\p{Nd}")) > 3 * F.col("word_chars")),
    Rule("words_with_letters", lambda: 10 * F.regexp_count("text", F.lit(f"\\p{{L}}[^{_SPACES}]*")) < 7 * F.col("n_words")),
    Rule("ellipsis_lines", lambda: 10 * _lines_like(f"(?:\\.\\.\\.|…)[{_SPACES}]*\\z") > 3 * F.size(F.split(F.col("text"), "\n"))),
    Rule("bullet_lines", lambda: 10 * _lines_like(f"\\A[{_SPACES}]*[-*•]") > 9 * F.size(F.split(F.col("text"), "\n"))),
)


def with_base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts; null texts count as empty.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier one), n_repeat_words (words in 3-word windows that the text has twice or more).
    Windows are compared by 64-bit hashes within their document. The columns are computed in steps of
    one row at a time; a document's word array is the largest value held.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    steps = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    triples = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    steps = steps.withColumn("_triples", triples)
    in_order = F.sort_array("_triples")
    steps = steps.withColumn("_sorted", in_order)
    steps = steps.withColumn(
        "_twice", F.array_distinct(F.filter("_sorted", lambda h, i: (i > 0) & (h == F.get("_sorted", F.greatest(i - 1, F.lit(0))))))
    )
    # Few repeated windows are looked up in their list; many are found by sorting windows with their places.
    looked_up = F.filter(
        F.transform("_triples", lambda h, i: F.when(F.array_contains("_twice", h), i).otherwise(F.lit(-1))), lambda i: i >= 0
    )
    pairs = F.sort_array(F.transform("_triples", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    steps = steps.withColumn("_pairs", F.when(F.size("_twice") > 24, pairs))
    by_sorting = F.sort_array(
        F.transform(
            F.filter(
                "_pairs",
                lambda p, k: ((k > 0) & (p["h"] == F.get("_pairs", F.greatest(k - 1, F.lit(0)))["h"]))
                | F.coalesce(p["h"] == F.get("_pairs", k + 1)["h"], F.lit(False)),
            ),
            lambda p: p["i"],
        )
    )
    steps = steps.withColumn("_at", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(F.col("_pairs").isNotNull(), by_sorting).otherwise(looked_up))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).cast("long").alias("n"), (i + 3).cast("int").alias("end")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return (
        steps.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(_SYMBOLS)).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
        .drop("_words", "_triples", "_sorted", "_twice", "_pairs", "_at", "_lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _seconds(frame: DataFrame, rejects: Column, times: int) -> float:
    """Fastest run of a condition over ``frame`` with each row ``times`` times."""
    query = frame.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_again")).agg(F.count_if(F.coalesce(rejects, F.lit(False))))
    took = []
    for _ in range(TIMED_RUNS):
        began = time.perf_counter()
        query.collect()
        took.append(time.perf_counter() - began)
    return min(took)


def plan_cascade(sample: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejections per second on the sample, best first; rules alike go by their cost.

    A rule's cost is the time of its rows, repeated up to ``TIMED_BYTES`` of text so that it shows,
    less that of as many rows under a condition that reads one base column.
    """
    sample = sample.coalesce(1).persist()
    try:
        rows, size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        counts = sample.agg(*[F.count_if(F.coalesce(r.rejects(), F.lit(False))).alias(r.name) for r in rules]).first()
        times = max(1, TIMED_BYTES // max(size, 64 * rows, 1))
        idle = _seconds(sample, F.col("n_words") < 0, times)
        found = []
        for rule in rules:
            cost = max(_seconds(sample, rule.rejects(), times) - idle, 1e-4) / (times * max(rows, 1))
            found.append(((counts[rule.name] + 1 / (rows + 1)) / max(rows, 1) / cost, rule))
    finally:
        sample.unpersist()
    return [rule for _, rule in sorted(found, key=lambda x: -x[0])]


def _sample(slim: DataFrame) -> DataFrame:
    """Some rows for the plan; partitions are read one after the other, and only until there are enough."""
    rows = slim.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).sample(SAMPLE_SHARE, 7).limit(SAMPLE_ROWS).collect()
    return with_base(slim.sparkSession.createDataFrame(rows, slim.schema)).withColumn("text", F.col("_text")).drop("_text")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, order: list[Rule] | None = None) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and ``failed_rule`` (first in cascade order) per row.

    Null and empty texts have no words and fail the base rule. Nothing is shuffled; repeated rows and
    ids are judged each by themselves, and an empty table gives an empty result. Only the id and the
    text are read. ``order`` overrides the order that a sample of ``SAMPLE_ROWS`` rows gives; the
    sample decides the order only, never a verdict.
    """
    ready(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = with_base(slim).withColumn("text", F.col("_text")).drop("_text")
    order = order or plan_cascade(_sample(slim), rules)
    failed = F.when(base_failed(), F.lit("base"))
    for rule in order:
        failed = failed.when(rule.rejects(), F.lit(rule.name))
    return base.withColumn("base_failed", base_failed()).withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull()).drop("text")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cascade's verdict for every row of ``documents``."""
    return judge(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACES}]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT doc_id, t, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(t, '{_SYMBOLS}')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_SPACES}]')) AS lines FROM d),
x AS (SELECT doc_id, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3, unnest(range(1, len(w) + 1)) AS i FROM n),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS c FROM x WHERE w3 IS NOT NULL),
z AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM y WHERE c > 1) GROUP BY doc_id),
a AS (SELECT n.doc_id, t, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM n LEFT JOIN z ON n.doc_id = z.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words
  OR 2 * n_dup_lines > len(string_split(t, chr(10))) OR 2 * len(regexp_extract_all(t, '\\p{{Lu}}')) > word_chars
  OR 2 * len(regexp_extract_all(t, '\\p{{L}}')) < word_chars OR 10 * len(regexp_extract_all(t, '\\p{{Nd}}')) > 3 * word_chars
  OR 10 * len(regexp_extract_all(t, '\\p{{L}}[^{_SPACES}]*')) < 7 * n_words
  OR 10 * len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '(?:\\.\\.\\.|…)[{_SPACES}]*\\z'))) > 3 * len(string_split(t, chr(10)))
  OR 10 * len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '\\A[{_SPACES}]*[-*•]'))) > 9 * len(string_split(t, chr(10)))) AS kept FROM b
"""

QUERIES = {"op4_quality": op4}
SQL = {"op4_quality": OP4_SQL}
