"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a row of blocks in a fixed random order, and its exact quota of block copies is
split among the output shards: the root holds all quotas, each node gives its left half a
multivariate-hypergeometric draw, and a leaf's quotas say how many blocks of each source its
shard draws. Block copies are dealt to the leaves in a second random order, without overlap, and
each shard shuffles its documents locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.runtime import cut, ready, small, table

MOST = 3
WORDS_PER_SHARD = 4_000_000
DOCS_PER_BLOCK = 256
#: Nodes at which the driver's descent of the tree ends, blocks of one prefix group, and copies of one span bucket.
TOP_NODES = 256
GROUP = 4096
SPAN = 64
SEED = "mix-1"
_SPACES = "\\x20\\x09-\\x0D"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{_SPACES}]+"))


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Words by weight for each source; at most ``most`` times its size, the excess shared by weight again."""
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    capped, rest = 0, sum(weights)
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        if most * sizes[i] * rest >= (total - capped) * weights[i]:
            for j in order[place:]:
                out[j] = float((total - capped) * weights[j]) / float(rest)
            break
        out[i] = float(most * sizes[i])
        capped += most * sizes[i]
        rest -= weights[i]
    return out


def _draw(draw: np.random.Generator, good: int, bad: int, want: int) -> int:
    """A hypergeometric draw; beyond NumPy's range its normal approximation, rounded into the feasible range."""
    low, high = max(0, want - bad), min(good, want)
    if low == high:
        return low
    if good + bad < 1_000_000_000:
        return int(draw.hypergeometric(good, bad, want))
    share = good / (good + bad)
    spread = math.sqrt(want * share * (1 - share) * (good + bad - want) / (good + bad - 1))
    return min(high, max(low, round(want * share + spread * draw.standard_normal())))


def split_node(low: int, high: int, held: np.ndarray, seed: int = 1) -> tuple[int, np.ndarray]:
    """Middle shard of a node's span and what its left half holds of each source.

    Draws depend on the seed and the span only, so reruns agree and any task can descend by itself.
    """
    middle = (low + high) // 2
    draw = np.random.Generator(np.random.PCG64([seed, low, high]))
    left, pool = np.zeros_like(held), int(held.sum())
    want = pool * (middle - low) // (high - low)
    for s, n in enumerate(held.tolist()):
        pool -= n
        left[s] = _draw(draw, n, pool, want)
        want -= int(left[s])
    return middle, left


def descend(low: int, high: int, held: np.ndarray, before: np.ndarray, stop: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Nodes of at most ``stop`` shards under a node: span, quotas, and the copies of each source dealt before them."""
    open_ = [(low, high, held, before)]
    while open_:
        low, high, held, before = open_.pop()
        if high - low <= stop:
            yield low, high, held, before
            continue
        middle, left = split_node(low, high, held)
        open_ += [(middle, high, held - left, before + left), (low, middle, left, before)]


def split_tree(quotas: np.ndarray, shards: int) -> np.ndarray:
    """Block quotas of every shard, (shards, sources); columns add up to ``quotas``."""
    held = np.asarray(quotas, dtype=np.int64)
    out = np.zeros((shards, len(held)), dtype=np.int64)
    for low, _, own, _ in descend(0, shards, held, np.zeros_like(held)):
        out[low] = own
    return out


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (s, shard, low, high) of the deal, from the packed nodes in which the driver's descent ends."""
    for batch in batches:
        for low, high, held, before in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            held, before = np.frombuffer(held, dtype=np.int64), np.frombuffer(before, dtype=np.int64)
            for shard, _, own, start in descend(low, high, held, before):
                s = np.flatnonzero(own)
                if len(s):
                    columns = [pa.array(s.astype(np.int32)), pa.array(np.full(len(s), shard)), pa.array(start[s]), pa.array(start[s] + own[s])]
                    yield pa.RecordBatch.from_arrays(columns, names=["s", "shard", "low", "high"])


def spans_of(spark: SparkSession, quotas: np.ndarray, shards: int) -> DataFrame:
    """The shards' spans of every source's deal: the driver splits the top of the tree, tasks the rest."""
    held = np.asarray(quotas, dtype=np.int64)
    top = list(descend(0, shards, held, np.zeros_like(held), max(1, -(-shards // TOP_NODES))))
    nodes = spark.createDataFrame([(a, b, h.tobytes(), x.tobytes()) for a, b, h, x in top], "low long, high long, held binary, before binary")
    return nodes.repartition(min(len(top), 64)).mapInArrow(_leaves, "s int, shard long, low long, high long")


def _random(what: Column) -> Column:
    return F.md5(F.concat(F.lit(SEED + "/"), what).cast("binary"))


def _name() -> Column:
    """What a row is drawn by: its id, or its marked key without one."""
    return F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-/"), F.col("key").cast("string")))


def _row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """What tells rows apart whatever is null in them: a hash of id, source, size and text."""
    return F.xxhash64(doc_id.cast("long"), source.cast("string"), F.size(words_of(text)), text.cast("string"))


def _before(frame: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """``frame`` with ``before``, the sum of ``value`` over earlier rows of its ``s`` in the order of ``part`` and ``order``.

    Two levels: sums of the parts, then rows inside their part, so no task holds all rows of an ``s``.
    """
    parts = frame.groupBy("s", "part").agg(F.sum(value).alias("sum"))
    over = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s", "part", F.coalesce(F.sum("sum").over(over), F.lit(0)).alias("start"))
    inside = Window.partitionBy("s", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.join(parts, ["s", "part"]).withColumn("before", F.col("start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("start")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    words_per_shard: int = WORDS_PER_SHARD,
    docs_per_block: int = DOCS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """The plan per source and the mixed stream.

    First frame: ``source``, ``source_size``, ``target``. Second frame, one row per copy of a document
    that the mix takes and one row with ``copy`` null for a document that it does not take: ``id``,
    ``source``, ``size``, ``key`` (``_row_key``), ``row`` (the input row's number), ``copy`` (from 0),
    ``words`` (of this copy, its first ones), ``shard``, ``block`` and ``place`` (random order inside the shard).

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ... Sizes are words; null texts have
    none. Whole passes over a source come first; what is left of its quota goes down its
    permutation, and the last document is cut to its first words, so a source's words equal its
    rounded target. Ties in the permutation (repeated ids) are ordered by id, size, key, then row, so
    rows that repeat are taken each by itself; a row without an id is drawn by its key. Sources of
    size 0 get target 0. Empty input, two empty frames. Only the columns named are read.

    The driver holds one row per source and the tree's top ``TOP_NODES`` nodes; the rest of the tree,
    the shards' spans, blocks and documents stay distributed. Copies find their shard's span by source
    and bucket of ``SPAN`` places, so the work is linear in copies and spans. Only the block in which a
    source's quota ends is put in order by document.
    """
    spark = docs.sparkSession
    ready(spark)
    slim = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(source_col).cast("string").alias("source"),
            F.size(words_of(F.col(text_col))).cast("long").alias("size"),
            _row_key(F.col(id_col), F.col(source_col), F.col(text_col)).alias("key"),
        )
        .withColumn("draw", _random(_name()))
        .withColumn("row", F.monotonically_increasing_id())
    )
    found = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [1 + i % 3 for i in range(len(found))]
    wanted = targets([r["size"] for r in found], weights)
    rows = []
    for i, (r, w, t) in enumerate(zip(found, weights, wanted, strict=True)):
        whole = int(np.floor(t + 0.5))
        passes, left = divmod(whole, r["size"]) if r["size"] else (0, 0)
        rows.append((i, r["source"], r["size"], float(t), passes, left, max(1, -(-r["n"] // docs_per_block))))
    plan = spark.createDataFrame(rows, "s int, source string, source_size long, target double, passes long, rest long, blocks long")

    block = F.shiftright(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * F.col("blocks"), 32)
    keyed = slim.join(small(plan, len(rows)), slim["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumn("block", block)
    sums = keyed.groupBy("s", "block").agg(F.sum("size").alias("block_size"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = cut(
        _before(sums.withColumn("part", F.floor(F.col("block") / GROUP)), "block_size", [F.col("block")])
        .drop("part")
        .withColumn("copies", F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0))
    )

    quota = {r["s"]: (r["copies"], r["n"]) for r in blocks.groupBy("s").agg(F.sum("copies").cast("long").alias("copies"), F.count(F.lit(1)).alias("n")).collect()}
    quotas = np.array([quota.get(i, (0, 0))[0] for i in range(len(rows))], dtype=np.int64)
    shards = max(1, -(-sum(r["size"] for r in found) // words_per_shard)) if found else 1
    spans = spans_of(spark, quotas, shards).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / SPAN), F.floor((F.col("high") - 1) / SPAN))))

    copies = blocks.where("copies > 0").select(
        "s", "block", "passes", "rest", F.col("before").alias("words_before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    )
    parts = spark.createDataFrame([(i, max(1, int(q) // GROUP)) for i, q in enumerate(quotas.tolist())], "s int, parts long")
    order = _random(F.concat_ws("/", "block", "copy"))
    copies = copies.join(small(parts, len(rows)), "s").withColumn("order", order).withColumn("one", F.lit(1).cast("long"))
    copies = copies.withColumn("part", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("parts"), 32))
    dealt = (
        _before(copies, "one", [F.col("order"), F.col("block"), F.col("copy")])
        .withColumnRenamed("before", "deal")
        .withColumn("bucket", F.floor(F.col("deal") / SPAN))
        .join(spans, ["s", "bucket"])
        .where("deal >= low and deal < high")
        .select("s", "block", "shard", "copy")
    )
    # The block where a quota ends: its documents in order, the last one cut. One block per source.
    at_end = blocks.where("rest > 0 and before < rest and before + block_size >= rest").select("s", "block", "before", F.col("rest").alias("quota"))
    inside = Window.partitionBy("s", "block").orderBy("draw", "id", "size", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    ended = (
        keyed.select("id", "size", "key", "row", "draw", "s", "block")
        .join(small(at_end, len(rows)), ["s", "block"])
        .withColumn("cut_words", F.greatest(F.lit(0), F.least("size", F.col("quota") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))).cast("long"))
        .select("row", "cut_words")
    )
    taken = (
        keyed.select("id", "source", "size", "key", "row", "s", "block", "passes")
        .join(dealt, ["s", "block"], "left")
        .join(small(ended, len(rows) * 8 * docs_per_block), "row", "left")
        .withColumn("words", F.when((F.col("copy") < F.col("passes")) | F.col("cut_words").isNull(), F.col("size")).otherwise(F.col("cut_words")))
        .withColumn("taken", F.col("copy").isNotNull() & (F.col("words") > 0))
    )
    stream = taken.where("taken or copy is null or copy = 0").select(
        "id",
        "source",
        "size",
        "key",
        "row",
        F.when(F.col("taken"), F.col("copy")).alias("copy"),
        F.when(F.col("taken"), F.col("words")).otherwise(F.lit(0)).cast("long").alias("words"),
        F.when(F.col("taken"), F.col("shard")).alias("shard"),
        F.col("block"),
        _random(F.concat_ws("/", "shard", _name(), "copy")).alias("place"),
    )
    return plan.select("source", "source_size", "target"), stream


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it is."""
    return F.array_join(F.slice(F.split(text, f"(?<=[^{_SPACES}])(?=[{_SPACES}])"), 1, n), "")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", words_per_shard: int = WORDS_PER_SHARD
) -> DataFrame:
    """The documents of the mix with all their columns: a row per copy.

    Rows are put in shards, each in its random order. Every row has its own copies, whatever its id,
    also without one; rows that repeat id, source and text have theirs each. The one document of
    a source in which its quota ends is cut at the end of a word, and ``length_col``, where there is
    one, becomes its new length; a source whose target is below its size leaves documents out.
    """
    _, stream = mix(docs, id_col, text_col, source_col, words_per_shard)
    stream = cut(stream)
    copies = stream.where("copy is not null").select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("words").alias("_words"), "shard", "place")
    twins = cut(stream.groupBy("key").agg(F.count_distinct("row").alias("n")).where("n > 1").select(F.col("key").alias("_key")))
    n = twins.count()
    keyed = docs.withColumn("_key", _row_key(docs[id_col], docs[source_col], docs[text_col]))
    if n:  # rows that repeat: one of them carries the copies of all
        keyed = keyed.join(small(twins, n), "_key", "left_anti").unionByName(keyed.join(small(twins, n), "_key", "left_semi").dropDuplicates(["_key"]))
    cut_here = F.col("_words") < F.col("_size")
    whole = keyed.join(copies, "_key").withColumn("_cut", F.when(cut_here, first_words(F.col(text_col), F.col("_words").cast("int"))))
    kinds = dict(docs.dtypes)
    columns = [
        F.coalesce("_cut", text_col).alias(c) if c == text_col else F.when(cut_here, F.char_length("_cut").cast(kinds[c])).otherwise(F.col(c)).alias(c) if c == length_col else F.col(c)
        for c in docs.columns
    ]
    return whole.repartition("shard").sortWithinPartitions("shard", "place").select(*columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of ``documents`` takes of each document, with its source's size and target.

    ``taken`` adds up the words of the copies that the shards drew from their quotas: a block copy that no
    leaf of the tree deals out is not counted.
    """
    plan, stream = mix(table(spark, sf_dir, "documents"))
    taken = stream.groupBy("row", "id", "source", "size").agg(F.sum("words").cast("long").alias("taken"))
    return taken.join(small(plan, plan.count()), taken["source"].eqNullSafe(plan["source"])).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[{_SPACES}]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum({MOST} * source_size) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
  row_number() OVER (ORDER BY {MOST} * source_size / w, source NULLS LAST) AS place FROM s),
c AS (SELECT * FROM o WHERE {MOST} * source_size * rest >= (total - capped) * w ORDER BY place LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.place < c.place THEN CAST({MOST} * o.source_size AS DOUBLE)
  ELSE CAST((c.total - c.capped) * o.w AS DOUBLE) / CAST(c.rest AS DOUBLE) END AS target FROM o, c),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS whole FROM t),
r AS (SELECT d.doc_id, d.size, q.source_size, q.target, CASE WHEN q.source_size = 0 THEN 0 ELSE whole // q.source_size END AS passes,
  CASE WHEN q.source_size = 0 THEN 0 ELSE whole % q.source_size END AS rest,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}/' || CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""

QUERIES = {"op3_mixture": op3}
SQL = {"op3_mixture": OP3_SQL}
