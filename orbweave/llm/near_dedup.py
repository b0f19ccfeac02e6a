"""Near-duplicate documents: chosen-path set similarity join over minwise tokens.

Documents are sets of word shingles. Each set gets a sketch of minwise hashes ("tokens"). Every
tree of the join starts by branching documents on one token position; nodes that hold more than
``node_limit`` documents branch again on further positions drawn from the node's path, and nodes
within the limit compare their sketches exhaustively. Independent trees repeat until a pair at
the threshold is missed with the target probability. What the trees find are candidate clusters;
inside them links are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.graph import components
from orbweave.llm.runtime import cut, ready, small, table, tidy
from orbweave.llm.sortedgroups import whole_groups

TOKENS = 64
#: Shares of equal tokens below which a pair is not a candidate lie this many deviations under the threshold.
DEVIATIONS = 5.0
MISS = 1e-6
NODE_LIMIT = 4096
BRANCHES = 4
DEPTH = 6
#: Shingles that one task of the exact stage holds at most, but for a single larger pair of documents.
CHUNK_SHINGLES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(77))
_MULTIPLY = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, TOKENS, dtype=np.uint64)


def trees_for(threshold: float, miss: float = MISS) -> int:
    """Trees needed: a pair at the threshold shares a root branch with that probability in each."""
    return max(2, math.ceil(math.log(miss) / math.log(1 - threshold)))


def _sketches(width: int, id_type: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in wb.blocks(batch):
                block = wb.Block(texts, lower=True)
                shingle, first = wb.shingles(block, width)
                n = len(texts)
                size = np.zeros(n, dtype=np.int64)
                sums = np.zeros((2, n), dtype=np.uint64)
                for i in range(n):
                    own = shingle[first[i] : first[i + 1]]
                    if len(own):
                        own = np.sort(own)
                        keep = np.empty(len(own), dtype=bool)
                        keep[0] = True
                        np.not_equal(own[1:], own[:-1], out=keep[1:])
                        own = own[keep]
                        size[i] = len(own)
                        sums[0, i] = own.sum(dtype=np.uint64)
                        sums[1, i] = wb.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                tokens = np.zeros((n, TOKENS), dtype=np.uint32)
                full = np.flatnonzero(np.diff(first) > 0)
                if len(full):
                    begin = first[full]
                    for k in range(TOKENS):
                        h = shingle * _MULTIPLY[k]
                        h += _ADD[k]
                        h >>= np.uint64(32)
                        tokens[full, k] = np.minimum.reduceat(h, begin)
                raw = tokens.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, n).cast(pa.int64()),
                        pa.array(size),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([raw[i * 4 * TOKENS : (i + 1) * 4 * TOKENS] if size[i] else b"" for i in range(n)], type=pa.binary()),
                    ],
                    names=["id", "n", "s1", "s2", "sketch"],
                )

    return tidy(run)


def _forest(labels: np.ndarray, i: int, near: np.ndarray) -> None:
    """Join the labels of row i and of the rows near it."""
    found = labels[near]
    least = min(int(labels[i]), int(found.min()))
    if (found != least).any() or labels[i] != least:
        labels[np.isin(labels, np.append(found, labels[i]))] = least


def _node_links(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_groups(batches, ["key"]):
            ids = batch.column("id").to_numpy()
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(len(ids), TOKENS)
            left, right = [], []
            sizes = np.diff(at)
            few = np.flatnonzero((sizes > 1) & (sizes <= 8))
            for s in np.unique(sizes[few]):
                begin = at[:-1][few[sizes[few] == s]]
                for i in range(int(s)):
                    for j in range(i + 1, int(s)):
                        a, b = begin + i, begin + j
                        for part in range(0, len(a), 20_000):
                            x, y = a[part : part + 20_000], b[part : part + 20_000]
                            hit = (tokens[x] == tokens[y]).sum(axis=1) >= need
                            left.append(ids[x[hit]])
                            right.append(ids[y[hit]])
            for g in np.flatnonzero(sizes > 8):
                own = tokens[at[g] : at[g + 1]]
                labels = np.arange(len(own))
                step = max(1, 8_000_000 // (len(own) * TOKENS))
                for i in range(0, len(own), step):
                    equal = np.zeros((min(step, len(own) - i), len(own)), dtype=np.int16)
                    for k in range(TOKENS):
                        equal += own[i : i + step, k, None] == own[None, :, k]
                    for r in range(len(equal)):
                        near = np.flatnonzero(equal[r, i + r :] >= need) + i + r
                        if len(near) > 1:
                            _forest(labels, i + r, near)
                root = ids[at[g] : at[g + 1]]
                moved = labels != np.arange(len(own))
                left.append(root[moved])
                right.append(root[labels[moved]])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return tidy(run)


def exact_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Labels of single-linkage groups at ``100 * intersection >= percent * union``, confirmed on full sets.

    A document that has been compared with all others is done; the rest goes on only while its
    documents lie in more than one group, and the smallest of these groups goes first.
    """
    n = len(sets)
    labels = np.arange(n)
    if n < 2:
        return labels
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    first = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    weight = np.bincount(token)
    typical = np.add.reduceat(weight[token], first[:-1]) / size
    live = np.arange(n)
    lone: int | None = int(np.argmax(typical))
    while True:
        groups, count = np.unique(labels[live], return_counts=True)
        if len(groups) < 2:
            return labels
        if lone is None:
            inside = live[labels[live] == groups[np.argmin(count)]]
            lone = int(inside[0])
        flags = np.zeros(len(weight), dtype=bool)
        flags[token[first[lone] : first[lone + 1]]] = True
        others = live[live != lone]
        fit = (size[others] * 100 >= percent * size[lone]) & (size[lone] * 100 >= percent * size[others])
        others = others[fit]
        if len(others):
            reps = size[others]
            at = np.repeat(first[others], reps) + wb.ramp(reps)
            begin = np.cumsum(reps) - reps
            both = np.add.reduceat(flags[token[at]].astype(np.int64), begin)
            near = others[both * 100 >= percent * (reps + size[lone] - both)]
            if len(near):
                _forest(labels, lone, near)
        live = live[live != lone]
        lone = None


def _exact(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_groups(batches, ["cluster", "part", "other"]):
            ids = batch.column("id").to_numpy()
            sets: list[np.ndarray] = []
            for _, texts in wb.blocks(batch):
                shingle, first = wb.shingles(wb.Block(texts, lower=True), width)
                sets += [np.unique(shingle[first[i] : first[i + 1]]) for i in range(len(texts))]
            out = np.empty(len(ids), dtype=np.int64)
            for a, b in zip(at[:-1], at[1:], strict=True):
                labels, own = exact_labels(sets[a:b], percent), ids[a:b]
                for root in np.unique(labels):
                    out[a:b][labels == root] = own[labels == root].min()
            moved = out != ids
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(out[moved])], names=["a", "b"])

    return tidy(run)


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    width: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    node_limit: int = NODE_LIMIT,
    chunk_shingles: int = CHUNK_SHINGLES,
    miss: float = MISS,
) -> DataFrame:
    """Groups of documents whose shingle sets reach ``100 * intersection >= percent * union``.

    Returns ``id``, ``n_shingles``, ``component`` (smallest id reachable by links), ``kept``; one row
    per input row. A-Z is lower-cased and words are ``[^\\x20\\x09-\\x0D]+``. Texts with fewer words
    than ``width`` are one shingle; null, empty and wordless texts have none, link with nothing and
    are kept. Equal sets are one group at once. Rows that repeat an id are one document of the
    graph. A null id takes part in no link and has no component. Other columns are not read. Empty input, empty result.

    Only sketches (256 bytes a document) are written between the scans. A tree's hot nodes branch
    again, so a token shared by a third of the documents costs a few more levels; documents that
    stay together through all levels are compared in blocks of ``node_limit``. The exact stage puts
    a candidate cluster in one task up to ``chunk_shingles`` and beyond that compares its chunks
    pairwise in tasks of their own.
    """
    spark = docs.sparkSession
    ready(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = cut(source.mapInArrow(_sketches(width, "long"), "id long, n long, s1 long, s2 long, sketch binary"))
    sets = cut(
        sketches.where("n > 0 and id is not null")
        .groupBy("s1", "s2", "n")
        .agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    share = percent / 100
    need = math.floor(TOKENS * share - DEVIATIONS * math.sqrt(TOKENS * share * (1 - share)))
    edges = _tree_edges(sets, trees_for(share, miss), max(need, 1), node_limit)
    clusters = components(edges)
    roots = clusters.select(F.col("component").alias("node"), "component").distinct()
    members = cut(
        clusters.union(roots).join(sets.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("id"), F.col("component").alias("cluster"), "n")
    )
    n_members = members.count()
    if n_members:
        links = _confirmed(source, members, n_members, width, percent, chunk_shingles)
    else:
        links = spark.createDataFrame([], "node long, component long")
    return (
        sketches.select("id", "n", "s1", "s2")
        .join(sets.select("s1", "s2", "n", "rep"), ["s1", "s2", "n"], "left")
        .join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
    )


def _token(column: str, position):
    return F.substring(column, position * 4 + 1, 4) if isinstance(position, int) else F.expr(f"substring({column}, {position} * 4 + 1, 4)")


def _tree_edges(sets: DataFrame, trees: int, need: int, node_limit: int) -> DataFrame:
    """Links (a, b) between documents whose sketches agree, a spanning forest for each large node."""
    found: DataFrame | None = None
    start = F.array(*[F.xxhash64(F.lit(t), _token("sketch", t % TOKENS)) for t in range(trees)])
    nodes = sets.select("rep", F.explode(start).alias("key"))
    for depth in range(DEPTH + 1):
        sizes = cut(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
        heavy = sizes.where(F.col("c") > node_limit)
        n_heavy, in_heavy = heavy.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
        leaf = sizes if depth == DEPTH else sizes.where(F.col("c") <= node_limit)
        here = nodes.join(leaf, "key")
        if depth == DEPTH and n_heavy:  # inseparable documents: every two blocks of the node meet once
            parts = F.ceil(F.col("c") / (node_limit / 2)).cast("int")
            own = F.pmod(F.xxhash64("rep"), F.when(F.col("c") > node_limit, parts).otherwise(1)).cast("int")
            here = (
                here.withColumn("own", own)
                .withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("c") > node_limit, parts - 1).otherwise(0))))
                .select("rep", F.xxhash64("key", F.least("own", "o"), F.greatest("own", "o")).alias("key"))
            )
        rows = here.select("key", F.col("rep").alias("id")).join(sets.select(F.col("rep").alias("id"), "sketch"), "id")
        linked = cut(
            rows.repartition("key").sortWithinPartitions("key").mapInArrow(_node_links(need), "a long, b long").distinct()
        )
        found = linked if found is None else found.union(linked)
        if not n_heavy or depth == DEPTH:
            break
        spread = F.array(*[F.pmod(F.xxhash64("key", F.lit(b)), F.lit(TOKENS)).cast("int") for b in range(BRANCHES)])
        nodes = cut(nodes.join(small(heavy.select("key"), n_heavy), "key"))
        # From here on only the sketches of documents in heavy nodes move.
        sets = cut(sets.join(small(nodes.select("rep").distinct(), in_heavy), "rep", "left_semi"))
        nodes = cut(
            nodes.join(sets.select("rep", "sketch"), "rep")
            .select("rep", "key", "sketch", F.explode(spread).alias("p"))
            .select("rep", F.xxhash64("key", "p", _token("sketch", "p")).alias("key"))
        )
    return found


def _confirmed(source: DataFrame, members: DataFrame, n_members: int, width: int, percent: int, chunk: int) -> DataFrame:
    """(node, component) of the links that hold on full sets, inside the candidate clusters."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("parts"))
    split = cut(sizes.where("parts > 1"))
    n_split = split.count()
    placed = members.select("id", "cluster")
    if n_split:
        placed = (
            placed.join(small(split, n_split), "cluster", "left")
            .withColumn("parts", F.coalesce("parts", F.lit(1)))
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("id", "cluster", F.least("own", "o").alias("part"), F.greatest("own", "o").alias("other"))
        )
    else:
        placed = placed.select("id", "cluster", F.lit(0).alias("part"), F.lit(0).alias("other"))
    keys = ["cluster", "part", "other"]
    links = (
        source.join(small(placed, n_members if not n_split else n_members * 64), "id")
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_exact(width, percent), "a long, b long")
    )
    links = cut(links)
    return components(links) if n_split else links.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of the smallest id; all columns stay.

    A document is an id with a text: different texts under one id are judged each by itself, and of
    rows that repeat both one stays. Rows with a null id, null and wordless texts stay, all of them.
    Documents are told apart by a 64-bit hash of id and text.
    """
    i, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    some = i.isNotNull() & (F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) != "")
    keyed = docs.withColumn("_key", F.when(some, F.xxhash64(i, text)))
    found = cut(near_duplicates(keyed, percent, id_col="_key", text_col=text_col).select("id", "component"))
    moved = cut(found.where("id <> component").select(F.col("id").alias("_key"), "component").distinct())
    n = moved.count()
    left = keyed
    if n:
        roots = moved.select(F.col("component").alias("_key"), "component").distinct()
        members = cut(moved.union(roots))
        ids = keyed.select("_key", F.col(id_col).cast("long").alias("_id")).join(small(members, 2 * n), "_key")
        stays = ids.groupBy("component").agg(F.min_by("_key", F.struct("_id", "_key")).alias("_stays"))
        gone = members.join(small(stays, n), "component").where("_key <> _stays").select("_key")
        left = keyed.join(small(gone, n), "_key", "left_anti")
    repeated = found.where("id is not null").groupBy("id").count().where("count > 1")
    if repeated.limit(1).count():
        left = left.where("_key is null").union(left.where("_key is not null").dropDuplicates(["_key"]))
    return left.select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` at a Jaccard similarity of 0.85 over 5-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


QUERIES = {"op6_near_dedup": op6}
SQL: dict[str, str] = {}
