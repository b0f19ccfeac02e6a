"""Binary files of token ids: one zstandard frame a document, one dictionary for all.

Short documents share little with themselves, so a dictionary trained on serialised id arrays of a
sample stands in for the history that a frame lacks. Every document is a frame by itself; a file
ends with an index of frame offsets, so one document is read with two seeks. A file:

    8 bytes   magic ``OWTOKEN1``
    4 bytes   width of an id in bytes (2 or 4, unsigned little-endian)
    32 bytes  SHA-256 of the dictionary (of nothing where there is none)
    frames    in ascending order of document id, nulls first
    index     arrays over the documents: id (int64), id is valid (uint8), ids before it in the file
              (uint64), its ids (uint64), frame offset (uint64, one more than documents)
    16 bytes  offset of the index, number of documents (uint64)
    8 bytes   magic

A table ``manifest`` beside the files names those that count, in order. A task writes under a name
of its own attempt and the manifest is committed by Spark, so a lost or repeated task leaves
at most a file that nobody reads.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.packing import tokenizer_file
from orbweave.llm.runtime import ready, table, tidy
from orbweave.llm.sharedfiles import discard, new_folder, opened, written
from orbweave.llm.wordtokens import WordTokens

MAGIC = b"OWTOKEN1"
END_ID = 2
#: The dictionary is trained on at most so many documents of at most so many characters each.
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 8192
DICTIONARY_BYTES = 64 << 10
#: Fewer samples train no dictionary; frames then stand by themselves.
LEAST_SAMPLES = 16
#: Bytes of frames that a file should hold.
FILE_BYTES = 128 << 20
READ_BYTES = 8 << 20
_TAIL, _HEAD = "<QQ8s", "<8sI32s"
_MANIFEST = "shard int, file string, n_docs long, n_ids long, bytes long, first_id long, last_id long, nulls long"

_loaded: dict[tuple, WordTokens] = {}


def _tokens(path: str, end: int) -> WordTokens:
    """The worker's tokenizer; its cache outlives a task."""
    if (path, end) not in _loaded:
        _loaded.clear()
        _loaded[path, end] = WordTokens(path, end)
    return _loaded[path, end]


def id_width(tokenizer_path: str, end: int) -> int:
    """Bytes that hold every id of the tokenizer and the end id."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end + 1) <= 1 << 16 else 4


def _serialised(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with their ids and the offsets of the rows in them."""
    tokens = _tokens(path, end)
    for batch in batches:
        for at, texts in wb.blocks(batch, limit=1 << 20):
            flat, first = tokens.ids(texts)
            yield batch, at, flat.astype(f"<u{width}", copy=False), first


def _sampled(path: str, end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, flat, first in _serialised(batches, path, end, width):
            yield pa.RecordBatch.from_arrays([pa.array([flat[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], type=pa.binary())], names=["ids"])

    return tidy(run)


def train_dictionary(docs: DataFrame, tokenizer_path: str, end: int = END_ID, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary from the id arrays of at most ``sample`` documents of at most ``SAMPLE_CHARS`` characters.

    The sample is drawn by a hash of the id, so it is the same in every run. Empty with fewer than
    ``LEAST_SAMPLES`` such documents. It only changes sizes, never what is read back.
    """
    n = max(1, docs.count())
    key = F.xxhash64(F.col(id_col))
    text = F.col(text_col).cast("string")
    share = min(1.0, 4 * sample / n)
    low = docs.where((F.abs(key % 1_000_003) <= int(share * 1_000_003)) & (F.length(text) <= SAMPLE_CHARS)).select(key.alias("k"), text.alias("text"))
    few = low.orderBy("k", "text").limit(sample).select("text")
    found = sorted(r[0] for r in few.mapInArrow(_sampled(tokenizer_path, end, id_width(tokenizer_path, end)), "ids binary").collect())
    if len(found) < LEAST_SAMPLES:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(x) for x in found]).as_bytes()
    except zstandard.ZstdError:  # too little in the samples to train on
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=False, write_dict_id=False, write_content_size=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _frames(path: str, end: int, width: int, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = _compressor(dictionary).compress
        for batch, at, flat, first in _serialised(batches, path, end, width):
            frames = [flat[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(frames)),
                    pa.array([zlib.crc32(x) for x in frames], type=pa.int64()),
                    pa.array(np.diff(first)),
                    pa.array([packed(x) for x in frames], type=pa.binary()),
                ],
                names=["id", "crc", "n_ids", "frame"],
            )

    return tidy(run)


def _writer(folder: str, width: int, sha: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (b for b in batches if b.num_rows)
        if (batch := next(held, None)) is None:
            return
        shard = TaskContext.get().partitionId()
        files, place = opened(folder)
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
        ids, valid, counts, sizes = [], [], [], []
        with files.open_output_stream(f"{place}/{name}") as out:
            out.write(struct.pack(_HEAD, MAGIC, width, sha))
            while batch is not None:
                out.write(b"".join(frames := batch.column("frame").to_pylist()))
                sizes.append(np.fromiter(map(len, frames), dtype=np.uint64, count=len(frames)))
                ids.append(batch.column("id").fill_null(0).to_numpy())
                valid.append(batch.column("id").is_valid().to_numpy(zero_copy_only=False))
                counts.append(batch.column("n_ids").to_numpy())
                batch = next(held, None)
            doc, known, n, size = (np.concatenate(x) for x in (ids, valid, counts, sizes))
            offset = np.concatenate(([0], np.cumsum(size))).astype("<u8") + np.uint64(struct.calcsize(_HEAD))
            for x in (doc.astype("<i8"), known.astype("u1"), (np.cumsum(n) - n).astype("<u8"), n.astype("<u8"), offset):
                out.write(x.tobytes())
            out.write(struct.pack(_TAIL, int(offset[-1]), len(doc), MAGIC))
        own = doc[known]
        first, last = (int(own[0]), int(own[-1])) if len(own) else (None, None)
        row = {"shard": shard, "file": name, "n_docs": len(doc), "n_ids": int(n.sum()), "bytes": int(offset[-1]), "first_id": first, "last_id": last, "nulls": int((~known).sum())}
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    return tidy(run)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of all documents under ``folder`` (a shared path or URI) and return the manifest.

    A document is the ids of its whole text, null as empty, followed by ``end_id``. Documents go in
    ascending order of id, nulls first; those of one id in the order of their ids' checksums, so only
    rows that hold the same ids are interchangeable. Rows that repeat are written each. Columns
    other than the two named are not read. Empty input writes no file and an empty manifest.

    Texts are tokenised once and leave their task as compressed frames; only those are sorted. Files
    are cut by their bytes, so a key that many rows share is spread by the checksum too.
    """
    ready(docs.sparkSession)
    width = id_width(tokenizer_path, end_id)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(source, tokenizer_path, end_id, "id", "text")
    files, place = opened(folder)
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/dictionary.zdict") as out:
        out.write(dictionary)
    frames = written(source.mapInArrow(_frames(tokenizer_path, end_id, width, dictionary), "id long, crc long, n_ids long, frame binary"), "frames")
    size = frames.agg(F.sum(F.length("frame"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    ordered = frames.repartitionByRange(tasks, "id", "crc").sortWithinPartitions("id", "crc")
    ordered.mapInArrow(_writer(folder, width, hashlib.sha256(dictionary).digest()), _MANIFEST).write.parquet(f"{folder}/manifest")
    discard(frames)
    return manifest(docs.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row a file that counts."""
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


class TokenFile:
    """One file, its index and its frames."""

    def __init__(self, folder: str, name: str, dictionaries: dict[str, bytes]):
        files, place = opened(folder)
        if folder not in dictionaries:
            with files.open_input_stream(f"{place}/dictionary.zdict") as f:
                dictionaries[folder] = f.read()
        dictionary = dictionaries[folder]
        self.file = files.open_input_file(f"{place}/{name}")
        magic, self.width, sha = struct.unpack(_HEAD, self.file.read_at(struct.calcsize(_HEAD), 0))
        end = self.file.size() - struct.calcsize(_TAIL)
        at, n, again = struct.unpack(_TAIL, self.file.read_at(struct.calcsize(_TAIL), end))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{name} is not a whole file of token ids")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        raw = self.file.read_at(end - at, at)
        take = lambda kind, k, skip: np.frombuffer(raw, dtype=kind, count=k, offset=skip)
        self.ids, self.valid = take("<i8", n, 0), take("u1", n, 8 * n).astype(bool)
        self.start, self.n_ids, self.offset = take("<u8", n, 9 * n).astype(np.int64), take("<u8", n, 17 * n).astype(np.int64), take("<u8", n + 1, 25 * n).astype(np.int64)
        self.unpacked = _decompressor(dictionary).decompress

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, by its frame alone."""
        raw = self.file.read_at(int(self.offset[k + 1] - self.offset[k]), int(self.offset[k]))
        return np.frombuffer(self.unpacked(raw), dtype=f"<u{self.width}")

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, as runs of (first, id arrays); reads ``READ_BYTES`` at a time, or one larger frame."""
        k, n = 0, len(self.ids)
        while k < n:
            to = max(k + 1, int(np.searchsorted(self.offset, self.offset[k] + READ_BYTES, side="right")) - 1)
            base = int(self.offset[k])
            raw = self.file.read_at(int(self.offset[to]) - base, base)
            bounds = (self.offset[k : to + 1] - base).tolist()
            yield k, [np.frombuffer(self.unpacked(raw[s:e]), dtype=f"<u{self.width}") for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            k = to


def _reader(folder: str, chosen: frozenset[int] | None, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(folder, name, dictionaries)
                if chosen is None:
                    parts = file.documents()
                else:
                    parts = ((int(k), [file.document(int(k))]) for k in np.flatnonzero(file.valid & np.isin(file.ids, list(chosen))))
                for at, found in parts:
                    rows = slice(at, at + len(found))
                    wide = [x.astype("<u4") for x in found]
                    columns = [
                        pa.array(file.ids[rows], mask=~file.valid[rows]),
                        pa.array(file.start[rows] + base),
                        pa.array(np.fromiter(map(len, wide), dtype=np.int64, count=len(wide))),
                        pa.array([zlib.crc32(x.tobytes()) for x in wide], type=pa.int64()),
                    ]
                    names = ["id", "start", "n_tokens", "ids_crc32"]
                    if ids_too:
                        columns, names = [*columns, pa.array([x.astype(np.int64) for x in wide], type=pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return tidy(run)


def read_tokens(spark: SparkSession, folder: str, ids: Iterable[int] | None = None, with_ids: bool = False) -> DataFrame:
    """``id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``, from the files.

    ``ids`` names some documents: only files whose span holds one are opened, and of them only the
    index and the frames named. The manifest, one row a file, is what the driver holds. A file of
    another dictionary, or one that is not whole, is an error.
    """
    ready(spark)
    kind = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    files = sorted(manifest(spark, folder).collect(), key=lambda r: r["shard"])
    chosen = None if ids is None else frozenset(int(i) for i in ids)
    named = np.array(sorted(chosen or ()), dtype=np.int64)
    rows, base = [], 0
    for f in files:
        if chosen is None or (f["first_id"] is not None and np.searchsorted(named, f["last_id"], side="right") > np.searchsorted(named, f["first_id"])):
            rows.append((f["file"], base))
        base += f["n_ids"]
    tasks = spark.createDataFrame(rows, "file string, base long").repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "file")
    return tasks.mapInArrow(_reader(folder, chosen, with_ids), kind)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` written as files of token ids and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(docs, "ids")
    write_tokens(docs, folder, tokenizer_file())
    return read_tokens(spark, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"op12_token_files": op12}
SQL: dict[str, str] = {}
