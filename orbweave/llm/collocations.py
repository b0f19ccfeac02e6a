"""Phrases whose words stand together more often than their parts would have it, by language.

Three readings of the texts. The first counts all phrases into very many buckets by a hash; a bucket
that stays below the least count holds no frequent phrase, so what lies in a fuller bucket, with all
its parts, is a safe superset of the frequent phrases. The second lists these candidates. The third
counts them exactly: a minimal perfect hash over the candidates gives each a slot, the stored key
tells strangers off, a task counts slots in one NumPy array, and arrays are summed in a tree. The
counts of the parts, at which a phrase can be cut, are read by their slots.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.perfecthash import SHARD_BITS, PerfectHash, build_shard
from orbweave.llm.runtime import ready, table, tidy
from orbweave.llm.sharedfiles import discard, written

#: Leading bits of a key: those of a bucket, and those that tell the bits of the filter (32 MB).
BUCKET_BITS, FILTER_BITS = 35, 28
#: Keys that a task counts or tells apart at once.
BUFFER_KEYS = 3_000_000
#: Candidates that one reading counts; a volume of them is sent to all tasks (about 9 bytes each).
VOLUME_KEYS = 8_000_000
#: Slots of a block of counts, and blocks or tasks that one task of the tree adds up.
BLOCK_SLOTS, FAN_IN = 1 << 16, 16
_VOLUME_SHIFT = 40

_IS_SPLIT = np.zeros(256, dtype=bool)
_IS_SPLIT[list(b".,;:!?\n\x0b\x0c\r")] = True
_IS_GAP = _IS_SPLIT.copy()
_IS_GAP[list(b" \t")] = True
_FAMILIES = (wb.BYTE_VALUES, np.random.Generator(np.random.PCG64(77001)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_PLACES = np.random.Generator(np.random.PCG64(77002)).integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def salts(langs: list[str]) -> np.ndarray:
    """Two 64-bit values a language, which keep its phrases apart from those of others."""
    of = {v: np.frombuffer(hashlib.blake2b(v.encode(), digest_size=16).digest(), dtype="<u8") for v in set(langs)}
    return np.array([of[v] for v in langs], dtype=np.uint64).reshape(-1, 2)


class Words:
    """The words of some texts: where they stand, their piece, their text, and hashes of both families."""

    def __init__(self, texts: list[bytes], salt: np.ndarray, families: int = 2):
        self.data = b"\n".join(texts).lower().replace(b"\t", b" ")
        a = np.frombuffer(self.data, dtype=np.uint8)
        starts, ends, hashes, pieces, at, split = [], [], [[] for _ in range(families)], [], 0, 0
        while at < len(a):
            to = min(len(a), at + wb.SLICE)
            while to < len(a) and not _IS_GAP[a[to]]:  # the slice ends where a word ends
                gap = np.flatnonzero(_IS_GAP[a[to : to + 4096]])
                to += int(gap[0]) if len(gap) else min(4096, len(a) - to)
            part = a[at:to]
            gap = np.ones(len(part) + 2, dtype=np.int8)
            gap[1:-1] = _IS_GAP[part]
            turn = np.diff(gap)
            s, e = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
            up, down = wb.powers(len(part) + 1)
            for out, values in zip(hashes, _FAMILIES):
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(values[part] * up[: len(part)], out=sums[1:])
                out.append(wb.mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
            passed = np.cumsum(_IS_SPLIT[part], dtype=np.int64)
            starts.append(s + at)
            ends.append(e + at)
            pieces.append(split + passed[s])
            split += int(passed[-1])
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        self.start, self.end, self.piece = (join(x, np.int64) for x in (starts, ends, pieces))
        self.hashes = [join(x, np.uint64) for x in hashes]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        begin = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, begin)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.salt = salt

    def whole(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words within a piece."""
        last = len(self.start) - n + 1
        return np.flatnonzero(self.piece[: max(last, 0)] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, dtype=np.int64)

    def keys(self, at: np.ndarray, n: int, family: int) -> np.ndarray:
        """Keys of the runs of ``n`` words that begin at ``at``."""
        h, c = self.hashes[family], _PLACES[family]
        out = self.salt[self.text[at], family] + np.uint64(n)
        for k in range(n):
            out = out + h[at + k] * c[k]
        return wb.mix(out)

    def phrases(self, at: np.ndarray, n: int) -> list[bytes]:
        """Text of the runs of ``n`` words that begin at ``at``, joined by one blank."""
        last = at + n - 1
        begin, end = self.start[at], self.end[last]
        length = sum((self.end[at + k] - self.start[at + k] for k in range(n)), np.full(len(at), n - 1))
        out = [self.data[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
        for k in np.flatnonzero(end - begin != length).tolist():  # more than one blank somewhere
            out[k] = b" ".join(w for w in out[k].split(b" ") if w)
        return out


def total_keys(salt: np.ndarray) -> np.ndarray:
    """Keys of the phrase of no words, which stands at every word of a language: its count is the language's."""
    return wb.mix(salt.copy())


def _texts(batches: Iterator[pa.RecordBatch], families: int = 2) -> Iterator[tuple[Words, list[str]]]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for at, texts in wb.blocks(batch):
            own = langs[at : at + len(texts)]
            yield Words(texts, salts(own), families), own


def _coded(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as 16-bit steps; a longer way takes steps that count nothing."""
    steps = np.diff(keys, prepend=keys[:1] * 0)
    extra = (steps // 65535).astype(np.int64)
    if not extra.any():
        return steps.astype("<u2").tobytes(), counts.tobytes()
    at = np.cumsum(extra + 1) - 1
    out, n = np.full(int(at[-1]) + 1, 65535, dtype="<u2"), np.zeros(int(at[-1]) + 1, dtype=np.uint8)
    out[at], n[at] = steps % 65535, counts
    return out.tobytes(), n.tobytes()


def _bucket_counts(part_bits: int, most_words: int, least: int, buffer: int):
    """Counts of buckets, up to ``least``, of each task, cut into parts by their leading bits."""

    def emitted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, least).astype(np.uint8)
        low = BUCKET_BITS - part_bits
        bounds = np.searchsorted(bucket, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(low))
        for at in range(0, 1 << part_bits, 256):
            rows = [(p, *_coded(bucket[s:e] & np.uint64((1 << low) - 1), n[s:e])) for p in range(at, min(at + 256, 1 << part_bits)) if (s := bounds[p]) < (e := bounds[p + 1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "steps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, _ in _texts(batches, 1):
            for n in range(1, most_words + 1):
                held.append(words.keys(words.whole(n), n, 0) >> np.uint64(64 - BUCKET_BITS))
                size += len(held[-1])
            if size >= buffer:
                yield from emitted(held)
                held, size = [], 0
        if size:
            yield from emitted(held)

    return tidy(run)


def _full_buckets(part_bits: int, least: int, filter_bits: int):
    """The bits of the filter that a part covers."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(np.frombuffer(x, dtype="<u2"), dtype=np.uint64) for x in rows.column("steps").to_pylist()])
        n = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in rows.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        full = keys[first][np.add.reduceat(n[order].astype(np.int64), first) >= least]
        bits = np.zeros(1 << (filter_bits - part_bits), dtype=bool)
        bits[full >> np.uint64(BUCKET_BITS - filter_bits)] = True
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], type=pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], type=pa.binary())})

    return run


def _part_bits(docs: DataFrame, filter_bits: int) -> int:
    """Bits that cut keys into some times as many parts as there are tasks."""
    tasks = max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(filter_bits - 3, max(8, (4 * tasks - 1).bit_length()))


def candidate_filter(docs: DataFrame, most_words: int, least: int, filter_bits: int = FILTER_BITS, buffer: int = BUFFER_KEYS) -> np.ndarray:
    """Bits over the leading bits of keys; unset where no phrase stands ``least`` times. Its size is fixed."""
    part_bits = _part_bits(docs, filter_bits)
    counted = docs.mapInArrow(_bucket_counts(part_bits, most_words, min(least, 255), buffer), "part int, steps binary, counts binary")
    full = counted.groupBy("part").applyInArrow(_full_buckets(part_bits, min(least, 255), filter_bits), "part int, bits binary")
    out = np.zeros(1 << (filter_bits - 3), dtype=np.uint8)
    wide = len(out) >> part_bits
    for r in full.toLocalIterator():
        out[r["part"] * wide : (r["part"] + 1) * wide] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _passing(words: Words, bits: np.ndarray, filter_bits: int, most_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first words, keys) of the phrases of which the filter lets all parts and the whole pass."""
    before = np.ones(len(words.start) + 1, dtype=bool)
    for n in range(1, most_words + 1):
        at = words.whole(n)
        if n > 1:
            at = at[before[at] & before[at + 1]]
        key = words.keys(at, n, 0)
        cell = (key >> np.uint64(64 - filter_bits)).astype(np.int64)
        ok = (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        at, key = at[ok], key[ok]
        before = np.zeros(len(words.start) + 1, dtype=bool)
        before[at] = True
        yield n, at, key


def _listed(bits, part_bits: int, filter_bits: int, most_words: int, buffer: int):
    """The candidates of a task, each once in a buffer, sorted and packed by language and by the leading bits of their keys."""

    def packed(found: dict[tuple[str, int], list[bytes]]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        names = list(found)
        for at in range(0, len(names), 512):
            part = names[at : at + 512]
            blobs = [press(b"\n".join(sorted(found[k]))) for k in part]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part]), pa.array([k[1] for k in part], type=pa.int32()), pa.array(blobs, type=pa.binary())], names=["lang", "part", "phrases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bytes]] = {}
        seen = [np.zeros(0, dtype=np.uint64) for _ in range(most_words + 1)]
        for words, langs in _texts(batches, 1):
            for k in np.flatnonzero(np.diff(words.first)).tolist():
                found.setdefault((langs[k], 0), [b""])  # the phrase of no words
            for n, at, key in _passing(words, bits.value, filter_bits, most_words):
                one, where = np.unique(key, return_index=True)
                new = ~np.isin(one, seen[n], assume_unique=True)
                seen[n] = np.concatenate((seen[n], one[new]))
                first = at[where[new]]
                part = (one[new] >> np.uint64(64 - part_bits)).astype(np.int64).tolist()
                for t, p, phrase in zip(words.text[first].tolist(), part, words.phrases(first, n), strict=True):
                    found.setdefault((langs[t], p), []).append(phrase)
            if sum(map(len, seen)) > buffer:
                yield from packed(found)
                found, seen = {}, [x[:0] for x in seen]
        yield from packed(found)

    return tidy(run)


_CANDIDATE = "lang string, n_words int, phrase string, k1 long, k2 long"


def _distinct(rows: pa.Table) -> pa.Table:
    """Each candidate of a language and part once, with its keys."""
    unpacked = zstandard.ZstdDecompressor().decompress
    phrases = sorted(set().union(*[unpacked(x.as_py()).split(b"\n") for x in rows.column("phrases")]))
    lang = rows.column("lang")[0].as_py()
    words = Words(phrases, np.repeat(salts([lang]), len(phrases), axis=0))
    count = np.diff(words.first)
    keys = total_keys(words.salt)
    for n in range(1, int(count.max(initial=0)) + 1):
        own = np.flatnonzero(count == n)
        for f in (0, 1):
            keys[own, f] = words.keys(words.first[own], n, f)
    text = pa.array(phrases, type=pa.binary()).cast(pa.string())
    columns = [pa.array([lang] * len(phrases), type=pa.string()), pa.array(count.astype(np.int32)), text, *(pa.array(np.ascontiguousarray(keys[:, f]).view(np.int64)) for f in (0, 1))]
    return pa.table(columns, names=["lang", "n_words", "phrase", "k1", "k2"])


def _volume(volumes: int) -> Column:
    return F.pmod(F.shiftrightunsigned("k2", 24), F.lit(volumes))


def _built(rows: pa.Table) -> pa.Table:
    k1, k2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("k1", "k2"))
    sizes, bits, keys = build_shard(k1, k2)
    return pa.table({"volume": rows.column("volume").slice(0, 1), "shard": rows.column("shard").slice(0, 1), "sizes": pa.array([sizes.tobytes()], type=pa.binary()), "bits": pa.array([bits.tobytes()], type=pa.binary()), "keys": pa.array([keys.tobytes()], type=pa.binary())})


def _looked_up(held, volume: int):
    """The rows with the slot of their key; those of no slot go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("k1", "k2"))
            slot = held.value.slots(k1, k2)
            keep = pa.array(slot >= 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot | volume << _VOLUME_SHIFT)], names=[*batch.schema.names, "slot"]).filter(keep)

    return run


def _slot_counts(bits, held, filter_bits: int, most_words: int, buffer: int):
    """Counts of all slots of a task as blocks of its array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = held.value
        counts = np.zeros(len(table_), dtype=np.int64)
        found, size = [], 0
        limit = max(buffer, len(table_) // 2)
        for words, _ in _texts(batches):
            n_words = np.diff(words.first)
            key = total_keys(words.salt)
            slot = table_.slots(key[:, 0], key[:, 1])
            counts += np.bincount(slot[slot >= 0], weights=n_words[slot >= 0], minlength=len(counts)).astype(np.int64)[: len(counts)] if (slot >= 0).any() else 0
            for n, at, key in _passing(words, bits.value, filter_bits, most_words):
                slot = table_.slots(key, words.keys(at, n, 1))
                found.append(slot[slot >= 0])
                size += len(found[-1])
            if size >= limit:
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
                found, size = [], 0
        if size:
            counts += np.bincount(np.concatenate(found), minlength=len(counts))
        part = TaskContext.get().partitionId()
        packed = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(counts), BLOCK_SLOTS):
            block = counts[at : at + BLOCK_SLOTS]
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK_SLOTS]), pa.array([part], type=pa.int64()), pa.array([packed(block.tobytes())], type=pa.binary())], names=["block", "part", "counts"])

    return tidy(run)


def _added(rows: pa.Table) -> np.ndarray:
    unpacked = zstandard.ZstdDecompressor().decompress
    return functools.reduce(np.add, (np.frombuffer(unpacked(x.as_py()), dtype=np.int64) for x in rows.column("counts")))


def _branch(rows: pa.Table) -> pa.Table:
    """One array for those of some tasks."""
    packed = zstandard.ZstdCompressor(level=1).compress(_added(rows).tobytes())
    return pa.table({"block": rows.column("block").slice(0, 1), "part": rows.column("part").slice(0, 1), "counts": pa.array([packed], type=pa.binary())})


def _root(volume: int):
    def run(rows: pa.Table) -> pa.Table:
        counts = _added(rows)
        slot = np.flatnonzero(counts)
        at = rows.column("block")[0].as_py() * BLOCK_SLOTS
        return pa.table({"slot": (slot + at) | volume << _VOLUME_SHIFT, "a": counts[slot]})

    return run


def tree_sum(blocks: DataFrame, tasks: int, volume: int) -> DataFrame:
    """``slot`` and ``a`` from the arrays of all tasks, ``FAN_IN`` at a time."""
    while tasks > FAN_IN:
        blocks, tasks = blocks.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInArrow(_branch, "block long, part long, counts binary"), -(-tasks // FAN_IN)
    return blocks.groupBy("block").applyInArrow(_root(volume), "slot long, a long")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each phrase its proper parts: those that begin or end it, and those of two words or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, whole, a, count = (batch.column(k).to_pylist() for k in (0, 2, 3, 4))
        words = Words(wb.text_bytes(batch.column(1)), salts(langs))
        first = words.first[:-1]
        out: list[list[np.ndarray]] = []
        whole, a, count = (np.array(x, dtype=np.int64) for x in (whole, a, count))
        for n in range(2, int(count.max()) + 1):
            own = np.flatnonzero(count == n)
            for i in range(n):
                for j in range(i + 1, n + 1):
                    if j - i < n and (i == 0 or j == n or j - i > 1) and len(own):
                        at = first[own] + i
                        out.append([whole[own], a[own], *(np.full(len(own), v) for v in (n, i, j)), *(words.keys(at, j - i, f).view(np.int64) for f in (0, 1))])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["whole", "a", "n", "i", "j", "k1", "k2"])


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact for counts below 10^16."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    top, base = F.lit(1_000_000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)"), (left * right).cast("decimal(33,0)")
    return F.call_function("div", top, base)


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = 10,
    most_words: int = 3,
    top: int = 2000,
    inside_percent: int = 50,
    filter_bits: int = FILTER_BITS,
    volume_keys: int = VOLUME_KEYS,
    buffer_keys: int = BUFFER_KEYS,
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into pieces and those at blanks
    and tabs into words. A candidate is a phrase of 2 to ``most_words`` words within a piece that
    stands at least ``least`` times in its language (null: ``und``); ``a`` is that count, ``n`` all words
    of the language, ``l`` and ``r`` the counts of the two parts of its lowest-scoring cut, ties to the
    shorter first part. A candidate that lies inside a longer one of at least ``inside_percent`` of
    its count goes. Order: score, then count, both descending, then the phrase by its bytes.

    Null and empty texts have no words; rows that repeat count each; other columns are not read;
    empty input gives an empty result. Languages may share a name with ``und`` and are then one.

    Keys are 128-bit. The filter and one volume of candidates are sent to all tasks; both have
    fixed sizes, and more candidates take more readings, never a cut. A phrase that is everywhere
    reaches the sums as one number a task, so no key is hot.
    """
    ready(docs.sparkSession)
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    bits = context.broadcast(candidate_filter(source, most_words, least, filter_bits, buffer_keys))
    listed = source.mapInArrow(_listed(bits, _part_bits(source, filter_bits), filter_bits, most_words, buffer_keys), "lang string, part int, phrases binary")
    candidates = written(listed.groupBy("lang", "part").applyInArrow(_distinct, _CANDIDATE), "candidates")
    volumes = max(1, -(-candidates.count() // volume_keys))
    keyed = candidates.select(_volume(volumes).alias("volume"), F.shiftrightunsigned("k1", 64 - SHARD_BITS).alias("shard"), "k1", "k2")
    shards = written(keyed.groupBy("volume", "shard").applyInArrow(_built, "volume long, shard long, sizes binary, bits binary, keys binary"), "slots")
    tables = []
    for v in range(volumes):
        rows = shards.where(F.col("volume") == v).collect()
        tables.append(context.broadcast(PerfectHash([(r["shard"], *(np.frombuffer(r[c], dtype=t) for c, t in (("sizes", np.int64), ("bits", np.uint8), ("keys", np.uint64)))) for r in rows])))

    def with_slots(rows: DataFrame) -> DataFrame:
        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", slot long"
        own = [rows.where(_volume(volumes) == v).mapInArrow(_looked_up(t, v), kinds) for v, t in enumerate(tables)]
        return functools.reduce(DataFrame.unionByName, own)

    tasks = source.rdd.getNumPartitions()
    counted = [tree_sum(source.mapInArrow(_slot_counts(bits, t, filter_bits, most_words, buffer_keys), "block long, part long, counts binary"), tasks, v) for v, t in enumerate(tables)]
    counts = functools.reduce(DataFrame.unionByName, counted)
    found = with_slots(candidates).join(counts, "slot").where((F.col("a") >= least) | (F.col("n_words") == 0))
    found = written(found.select("slot", "lang", "n_words", "phrase", "a"), "phrases")

    phrases = found.where("n_words > 1")
    asked = phrases.select("lang", "phrase", "slot", "a", "n_words").mapInArrow(_parts, "whole long, a long, n long, i long, j long, k1 long, k2 long")
    discard(candidates)
    parts = written(with_slots(asked).join(found.select("slot", F.col("a").alias("own")), "slot"), "parts")
    sides = parts.where("i = 0 or j = n").groupBy("whole", F.when(F.col("i") == 0, F.col("j")).otherwise(F.col("i")).alias("k"))
    cuts = sides.agg(F.max("a").alias("a"), F.max(F.when(F.col("i") == 0, F.col("own"))).alias("l"), F.max(F.when(F.col("j") == F.col("n"), F.col("own"))).alias("r"))
    scored = cuts.select("whole", F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("whole").agg(F.min("cut").alias("cut"))
    inside = parts.where("j - i > 1").groupBy("slot").agg(F.max("a").alias("longer"))
    kept = phrases.join(inside, "slot", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    ranked = kept.join(lowest, kept["slot"] == lowest["whole"]).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = ranked.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = found.where("n_words = 0").select("lang", F.col("a").alias("n"))
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of ``documents``."""
    return mine(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, w[i : i] AS g FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded)
  UNION ALL SELECT lang, w[i : i + 1] FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM worded)
  UNION ALL SELECT lang, w[i : i + 2] FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM worded)
), f AS (
  SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 10
), cuts AS (
  SELECT lang, g, a, k, g[1 : k] AS x, g[k + 1 : len(g)] AS y FROM (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1)
), scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.a AS l, y.a AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.x JOIN f y ON y.lang = c.lang AND y.g = c.y
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), longer AS (
  SELECT lang, g, max(a) AS a FROM (SELECT lang, g[1 : 2] AS g, a FROM f WHERE len(g) = 3 UNION ALL SELECT lang, g[2 : 3], a FROM f WHERE len(g) = 3) GROUP BY lang, g
), kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.g = s.g WHERE o.a IS NULL OR 100 * o.a < 50 * s.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

QUERIES = {"op11_collocations": op11}
SQL = {"op11_collocations": OP11_SQL}
