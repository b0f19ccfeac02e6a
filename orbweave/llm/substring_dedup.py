"""Substring deduplication with difference-cover anchors.

Only windows at positions in a difference cover modulo a period are hashed. For any two positions
there is a shift below the period that moves both into the cover, so two equal runs of ``window``
words always share an aligned anchor of ``window - period + 1`` words. Documents with a shared
anchor are extended around it: the fingerprints of all ``window``-word runs that hold the anchor
decide, per run, whether it starts in a document with a smaller id.

Entries travel as packed arrays, one row for each block of text and bucket. A block settles what
it can by itself first (an anchor or run that two of its documents share leaves one entry), so
one passage in a third of all documents costs a bucket one entry a block, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.runtime import ready, table, tidy, tidy_group
from orbweave.llm.sortedgroups import whole_groups

#: A perfect difference set modulo 31: every remainder is the difference of two members.
PERFECT_31 = (1, 5, 11, 24, 25, 27)
#: Bytes of text that one group of documents holds at most, but for hash skew and a single longer text.
GROUP_BYTES = 64 << 20
#: Rows that hold a document id several times with different texts are told apart by the upper bits of a position.
_VARIANT = 40

_ENTRY = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("key", pa.binary()), ("more", pa.binary()), ("doc", pa.binary()), ("pos", pa.binary())])
_ENTRY_DDL = "bucket int, kind tinyint, key binary, more binary, doc binary, pos binary"


def difference_cover(period: int) -> np.ndarray:
    """Members of a set whose differences give every remainder modulo ``period``."""
    if period == 31:
        cover = np.array(PERFECT_31)
    else:
        root = int(np.ceil(np.sqrt(period)))
        cover = np.unique(np.concatenate((np.arange(root), np.arange(0, period, root), [period - 1]))) % period
        cover = np.unique(cover)
    found = np.zeros(period, dtype=bool)
    found[(cover[:, None] - cover[None, :]) % period] = True
    assert found.all()
    return cover


def period_for(window: int) -> int:
    """About three fifths of the window; the rest, and one word, is the anchor's width."""
    return max(1, min(window, round(window * 31 / 50)))


def _order(key: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and the offsets of the groups."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    turn = np.empty(len(k), dtype=bool)
    turn[:1] = True
    np.not_equal(k[1:], k[:-1], out=turn[1:])
    if more is not None:
        m = more[order]
        if ((m[1:] != m[:-1]) & ~turn[1:]).any():
            order = np.lexsort((more, key))
            k, m = key[order], more[order]
            turn[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    return order, np.flatnonzero(turn)


def _spans(b: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """First offsets and spans of the runs of equal buckets."""
    if not len(b):
        return np.zeros(0, dtype=np.int64), []
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    return first, list(zip(first.tolist(), [*first[1:].tolist(), len(b)], strict=True))


def _spread(doc: np.ndarray, buckets: int) -> np.ndarray:
    """What ``pmod(xxhash64(doc), buckets)`` gives in SQL."""
    return np.mod(wb.xxhash64_long(doc).view(np.int64), buckets).astype(np.int32)


def _by_doc(doc: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Decided entries, packed for the buckets of their documents."""
    b = _spread(doc, buckets)
    order = np.lexsort((pos, doc, b))
    b, doc, pos = b[order], doc[order], pos[order]
    first, spans = _spans(b)
    n = len(first)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(b[first]),
            pa.array(np.ones(n, dtype=np.int8)),
            pa.array([None] * n, type=pa.binary()),
            pa.array([None] * n, type=pa.binary()),
            pa.array([doc[s:e].tobytes() for s, e in spans], type=pa.binary()),
            pa.array([pos[s:e].tobytes() for s, e in spans], type=pa.binary()),
        ],
        schema=_ENTRY,
    )


def _by_key(key: np.ndarray, more: np.ndarray | None, doc: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Open entries, packed for the buckets of their keys."""
    b = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    b, key, doc, pos = b[order], key[order], doc[order], pos[order]
    more = more[order] if more is not None else None
    first, spans = _spans(b)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(b[first]),
            pa.array(np.zeros(len(first), dtype=np.int8)),
            pa.array([key[s:e].tobytes() for s, e in spans], type=pa.binary()),
            pa.array([more[s:e].tobytes() if more is not None else None for s, e in spans], type=pa.binary()),
            pa.array([doc[s:e].tobytes() for s, e in spans], type=pa.binary()),
            pa.array([pos[s:e].tobytes() for s, e in spans], type=pa.binary()),
        ],
        schema=_ENTRY,
    )


def _settle_shared(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose key two documents of the block have (all decided), and those to send on."""
    order, first = _order(key, None)
    d = doc[order]
    low, high = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    shared = (low != high)[group]
    on = ~shared
    on[first] = True
    return order[shared], order[on]


def _settle_later(key: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a document that is not its key's smallest (all decided), and the others."""
    order, first = _order(key, more)
    d = doc[order]
    low = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(key))))
    return order[d > low], order[d == low]


def _anchors(window: int, period: int, buckets: int):
    width = window - period + 1
    at_cover = np.zeros(period, dtype=bool)
    at_cover[difference_cover(period)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            for at, texts in wb.blocks(batch, limit=4 << 20):
                block = wb.Block(texts)
                n = np.where(known[at : at + len(texts)] & (block.n_words >= window), block.n_words, 0)
                row = np.repeat(np.arange(len(texts)), block.n_words)
                pos = wb.ramp(block.n_words)
                on = np.flatnonzero(at_cover[pos % period] & (pos + width <= n[row]))
                if not len(on):
                    continue
                key = wb.windows(block.hashes, width, 5)[on]
                doc, pos = ids[at + row[on]], pos[on]
                done, open_ = _settle_shared(key, doc, pos)
                yield _by_doc(doc[done], pos[done], buckets)
                yield _by_key(key[open_], None, doc[open_], pos[open_], buckets)

    return tidy(run)


def _unpack(batch: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=dtype)


def _decide(settle, with_more: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in whole_groups(batches, ["bucket", "kind"]):
            kinds = batch.column("kind").to_numpy()
            if kinds.any():
                yield batch.filter(pa.array(kinds == 1)).cast(_ENTRY)
            batch = batch.filter(pa.array(kinds == 0))
            if not batch.num_rows:
                continue
            spans = batch.column("bucket").to_numpy()
            for b in np.unique(spans):
                own = batch.filter(pa.array(spans == b))
                key, doc, pos = _unpack(own, "key", np.uint64), _unpack(own, "doc", np.int64), _unpack(own, "pos", np.int64)
                done = (settle(key, _unpack(own, "more", np.uint32), doc, pos) if with_more else settle(key, doc, pos))[0]
                if len(done):
                    yield _by_doc(doc[done], pos[done], buckets)

    return tidy(run)


def _marks(right: pa.Table) -> dict[int, np.ndarray]:
    """Positions by document."""
    if not right.num_rows:
        return {}
    doc = np.frombuffer(b"".join(right.column("doc").to_pylist()), dtype=np.int64)
    pos = np.frombuffer(b"".join(right.column("pos").to_pylist()), dtype=np.int64)
    order = np.argsort(doc, kind="stable")
    doc, pos = doc[order], pos[order]
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    return dict(zip(doc[first].tolist(), np.split(pos, first[1:]), strict=True))


def _variants(ids: list, texts: pa.ChunkedArray) -> dict[int, int]:
    """Row -> rank of its text among the texts of its id, for ids that repeat."""
    seen: dict = {}
    for i, x in enumerate(ids):
        seen.setdefault(x, []).append(i)
    out = {}
    for x, rows in seen.items():
        if x is not None and len(rows) > 1:
            own = [(texts[i].as_py() or "").encode() for i in rows]
            rank = {t: k for k, t in enumerate(sorted(set(own)))}
            out |= {i: rank[t] for i, t in zip(rows, own, strict=True)}
    return out


def _runs(window: int, period: int, buckets: int):
    reach = period  # an anchor lies 0..period-1 words after the start of a run that holds it

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        marks, out = _marks(right), []
        ids = left.column("id").to_pylist()
        hit = [i for i, x in enumerate(ids) if x in marks]
        variant = _variants(ids, left.column("text"))
        if hit:
            chosen = left.take(pa.array(hit)).combine_chunks()
            for batch in chosen.to_batches():
                for at, texts in wb.blocks(batch, limit=4 << 20):
                    block = wb.Block(texts)
                    starts, docs, places = [], [], []
                    for j in range(len(texts)):
                        row, last = hit[at + j], int(block.n_words[j]) - window
                        if last < 0:
                            continue
                        p = marks[ids[row]]
                        step = np.zeros(last + 2, dtype=np.int32)
                        np.add.at(step, np.clip(p - reach + 1, 0, last + 1), 1)
                        np.add.at(step, np.clip(p + 1, 0, last + 1), -1)
                        s = np.flatnonzero(np.cumsum(step[:-1]) > 0)
                        starts.append(s + block.first[j])
                        docs.append(np.full(len(s), ids[row], dtype=np.int64))
                        places.append(s + (variant.get(row, 0) << _VARIANT))
                    if not starts:
                        continue
                    at_, doc, pos = np.concatenate(starts), np.concatenate(docs), np.concatenate(places)
                    if not len(at_):
                        continue
                    k = wb.windows(block.hashes, window, 7)[at_]
                    m = (wb.windows(block.hashes, window, 11)[at_] >> np.uint64(32)).astype(np.uint32)
                    done, open_ = _settle_later(k, m, doc, pos)
                    out += [_by_doc(doc[done], pos[done], buckets), _by_key(k[open_], m[open_], doc[open_], pos[open_], buckets)]
        return pa.Table.from_batches(out, schema=_ENTRY)

    return tidy_group(run)


def _cut_out(window: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        marks = _marks(right)
        ids = left.column("id").to_pylist()
        texts = left.column("text")
        variant = _variants(ids, texts)
        n_words, n_removed, digest, kept = [], [], [], []
        rest = left.column("rest") if "rest" in left.column_names else None
        for i, x in enumerate(ids):
            text = texts[i].as_py()
            words = (text or "").encode().split()
            n, gone = len(words), 0
            p = marks.get(x)
            if p is not None:
                k = variant.get(i, 0)
                p = p[(p >> _VARIANT) == k] & ((1 << _VARIANT) - 1)
            if p is not None and len(p):
                step = np.zeros(n + 1, dtype=np.int32)
                np.add.at(step, p, 1)
                np.add.at(step, p + window, -1)
                covered = np.cumsum(step[:-1]) > 0
                gone = int(covered.sum())
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            left_over = b" ".join(words)
            n_words.append(n)
            n_removed.append(gone)
            digest.append(hashlib.sha256(left_over).hexdigest())
            kept.append(left_over.decode() if gone else None)
        columns = [left.column("id"), pa.array(n_words, type=pa.int64()), pa.array(n_removed, type=pa.int64()), pa.array(digest, type=pa.string()), pa.array(kept, type=pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]
        if rest is not None:
            columns, names = [*columns, texts, rest], [*names, "text", "rest"]
        return pa.table(columns, names=names)

    return tidy_group(run)


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Words of every document that no run of ``window`` words shares with a document of a smaller id.

    Returns ``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``: the kept words
    joined by one space, null if nothing was removed. One row per input row. Null texts count as
    no words; they and texts shorter than the window are never cut. Rows of one id never cut each
    other, and rows with a null id neither cut nor are cut. Other columns are not read, unless ``carry``
    adds the text and, as the struct ``rest``, the whole row. Runs are judged on the input. Equality is that of 96-bit fingerprints of the word sequence.

    The text is shuffled once by document bucket (both later scans of it reuse the exchange);
    anchors, about a fifth of the words, move as packed entries. The number of buckets follows from the
    measured bytes, so a group's texts and entries stay near ``GROUP_BYTES`` at every size.
    """
    spark = docs.sparkSession
    ready(spark)
    period = period_for(window)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // GROUP_BYTES))
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*others).alias("rest")] if carry else []))
    by_bucket = lambda frame: frame.repartition("bucket").sortWithinPartitions("bucket", "kind")
    anchors = source.mapInArrow(_anchors(window, period, buckets), _ENTRY_DDL)
    shared = by_bucket(anchors).mapInArrow(_decide(_settle_shared, False, buckets), _ENTRY_DDL).select("bucket", "doc", "pos")
    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), *rows.columns)
    held = placed.groupBy("bucket")
    runs = held.cogroup(shared.groupBy("bucket")).applyInArrow(_runs(window, period, buckets), _ENTRY_DDL)
    later = by_bucket(runs).mapInArrow(_decide(_settle_later, True, buckets), _ENTRY_DDL).select("bucket", "doc", "pos")
    carried = ", text string, rest " + dict(rows.dtypes)["rest"] if carry else ""
    return held.cogroup(later.groupBy("bucket")).applyInArrow(
        _cut_out(window), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + carried
    )


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated runs cut out of the texts; rows that lose all their words go.

    A cut text is its kept words joined by one space, and ``length_col``, where there is one, its
    new length; other texts and columns stay as they are.
    """
    found = remove_repeats(docs, window, id_col, text_col, carry=True).where("n_removed < n_words or n_removed = 0")
    text = F.coalesce("kept_text", "text")
    size = F.when(F.col("kept_text").isNull(), F.col(f"rest.{length_col}")).otherwise(F.char_length("kept_text")) if length_col in docs.columns else None
    kinds = dict(docs.dtypes)
    return found.select(
        *[text.alias(c) if c == text_col else size.cast(kinds[c]).alias(c) if c == length_col else F.col(f"rest.{c}").alias(c) for c in docs.columns]
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without the words of 50-word runs that a smaller doc_id has too."""
    found = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_substring_dedup": op2}
SQL: dict[str, str] = {}
