"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every partition packs its own pieces best-fit decreasing and passes bins that are full, or nearly
so, straight on. The underfull bins meet in ever fewer partitions, where they are the items of the
next best-fit round, until a round over all that is left gains nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.runtime import cut, ready, table, tidy
from orbweave.llm.wordtokens import WordTokens

CAPACITY = 4096
#: Free tokens up to which a bin is nearly full.
SLACK = 2
#: Bins and bytes of pieces that one best-fit call takes; more are packed in turns.
TURN_BINS = 200_000
TURN_BYTES = 64 << 20
BINS_PER_TASK = 4000
FAN_IN = 8
_BINS = "used int, items binary"

_loaded: dict[tuple, WordTokens] = {}


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, bins
            bins += 1
        out[i] = b
        if r - n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    return out


def _bins(items: list[np.ndarray], capacity: int) -> pa.RecordBatch:
    """Items are (n, 6) arrays of id, piece, start, length, crc and whether the id is valid that stay together."""
    lengths = np.array([int(x[:, 3].sum()) for x in items], dtype=np.int64)
    place = best_fit(lengths, capacity)
    used = np.bincount(place, weights=lengths).astype(np.int32) if len(items) else np.zeros(0, dtype=np.int32)
    held: list[list[bytes]] = [[] for _ in range(len(used))]
    for i in np.argsort(place, kind="stable").tolist():
        held[place[i]].append(items[i].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array([b"".join(x) for x in held], type=pa.binary())], names=["used", "items"])


def _tokens(path: str, end: int) -> WordTokens:
    """The worker's tokenizer; its cache outlives a task."""
    if (path, end) not in _loaded:
        _loaded[path, end] = WordTokens(path, end)
    return _loaded[path, end]


def _tokenised(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path, end)
        items: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in wb.blocks(batch, limit=1 << 20):
                flat, first = tokens.ids(texts)
                flat = flat.astype("<u4", copy=False)
                for i in range(len(texts)):
                    name = ids[at + i]
                    own = flat[first[i] : first[i + 1]]
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        items.append(np.array([[name or 0, p, s, len(part), zlib.crc32(part.tobytes()), name is not None]], dtype=np.int64))
                if len(items) >= TURN_BINS:
                    yield _bins(items, capacity)
                    items = []
        if items:
            yield _bins(items, capacity)

    return tidy(run)


def _merged(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for raw in batch.column("items").to_pylist():
                items.append(np.frombuffer(raw, dtype=np.int64).reshape(-1, 6))
                size += len(raw)
                if len(items) >= TURN_BINS or size >= TURN_BYTES:
                    yield _bins(items, capacity)
                    items, size = [], 0
        if items:
            yield _bins(items, capacity)

    return tidy(run)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            items = [np.frombuffer(raw, dtype=np.int64).reshape(-1, 6) for raw in part.column("items").to_pylist()]
            if not items:
                continue
            every = np.concatenate(items)
            offset = np.concatenate([np.cumsum(x[:, 3]) - x[:, 3] for x in items])
            sequence = np.repeat(part.column("sequence_id").to_numpy(), [len(x) for x in items])
            columns = [pa.array(every[:, 0], mask=every[:, 5] == 0), pa.array(every[:, 1].astype(np.int32)), *(pa.array(np.ascontiguousarray(every[:, k])) for k in (2, 3, 4)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = 1,
    slack: int = SLACK,
    least_gain: float = 0.0,
) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens.

    Returns ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    A document is its ids followed by ``end_id``; only longer ones than ``capacity`` are cut. Null and
    empty texts are the end id alone. Rows that repeat are packed each by themselves; a null id
    stays null. Empty input, empty result. Other columns are not read.

    A best-fit call holds bounded numbers of bins and bytes whatever the input, and only the packed
    numbers of pieces (48 bytes each) move, never ids or texts. A bin that has no room for the
    smallest open one leaves the rounds. Rounds use ever fewer tasks, down to one for every
    ``TURN_BINS`` open bins, and end when one at that width saves no bin; ``least_gain`` ends them
    at a share of the open bins instead.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    level = cut(source.mapInArrow(_tokenised(tokenizer_path, end_id, capacity), _BINS))
    used, tasks, before = F.col("used"), None, None
    done = level.limit(0)
    while True:
        # The smallest bin can join another one only if that has room for it.
        least = level.agg(F.min("used")).first()[0]
        full = used > min(capacity - (least or 0), capacity - slack - 1)
        done, open_ = done.union(level.where(full)), level.where(~full)
        n = open_.count()
        fewest = max(1, -(-n // TURN_BINS))
        if n < 2 or (tasks is not None and tasks <= fewest and n >= (1 - least_gain) * before):
            break
        wide = max(fewest, -(-n // BINS_PER_TASK))
        tasks, before = wide if tasks is None else max(fewest, min(wide, tasks // FAN_IN)), n
        level = cut(open_.repartition(tasks).mapInArrow(_merged(capacity), _BINS))
    return (
        done.union(open_)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .mapInArrow(_laid_out, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file()).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_packing": op8}
SQL: dict[str, str] = {}
