"""Which ids of two tokenizers stand for the same bytes, and how often over a corpus.

Both tokenizers cut the bytes of blank + text. Where both end a token, a group ends; all tokens of
a group are linked. A merge of the two runs of token ends with one pointer each finds the groups.
Neither tokenizer joins a blank to a sign before it, so a text falls into chunks (a blank and what
follows up to the next such blank) that are cut alike wherever they stand: a worker merges each
distinct chunk once and puts documents together from them. Fresh chunks are cut in one go, one after
the other, and told apart by their bytes.

The counting is Spark's: pairs are grouped over documents, and counts and the highest count of
each id are joined back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.packing import tokenizer_file
from orbweave.llm.runtime import ready, release, table
from orbweave.llm.sharedfiles import written
from orbweave.llm.wordblocks import ramp

#: Chunks, and bytes of them, that a worker holds at once; it starts anew beyond.
CACHED_CHUNKS = 300_000
CACHED_BYTES = 32 << 20
#: Links of a group up to which each is written; beyond, distinct ids are counted first.
LONG_GROUP = 4096
_MARK = "▁".encode()
_SIGNS = frozenset(range(0x21, 0x7F))
#: Texts of a batch are taken in runs of so many bytes.
RUN_BYTES = 1 << 20
#: The most frequent pairs, whose counts every task gets; all others are joined by a shuffle.
HOT_PAIRS = 1 << 17

#: A blank after which it is not certain that the sign before it is no white space.
_ODD = re.compile(rb"\A |(?:[\x00-\x20\x7f]|[\x80-\xbf](?<!\xc3[\x80-\xbf])) ")
_ODD_END = re.compile(rb"(?:[\x00-\x20\x7f]|[\x80-\xbf](?<!\xc3[\x80-\xbf]))\Z")

_ALIGNED = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def chunks(text: bytes) -> list[bytes]:
    """Parts of a text that join by one blank to it; no tokenizer carries a token from one to the next."""
    parts = text.split(b" ")
    if not _ODD.search(text):
        return parts
    out: list[bytes] = []
    held = [parts[0]]
    for part in parts[1:]:
        if held[-1] and not _ODD_END.search(held[-1]):
            out.append(b" ".join(held))
            held = []
        held.append(part)
    out.append(b" ".join(held))
    return out


def byte_level_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Offsets where tokens of both sides end: a merge of two ascending runs of ends."""
    both = np.concatenate((ends_a, ends_b))
    both.sort(kind="stable")  # two runs: timsort merges them
    return both[:-1][both[1:] == both[:-1]]


class _Codes(dict):
    """chunk -> code; chunks not seen before queue up to be cut."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.held = 0

    def __missing__(self, chunk: bytes) -> int:
        code = self[chunk] = len(self)
        self.fresh.append(chunk)
        self.held += len(chunk)
        return code


class Aligner:
    """Chunks to codes; of code c the numbers of tokens, groups and links, the groups as text and the linked pairs."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_level_alphabet()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if joined := [p for p in pieces if re.search("[^▁]▁", p)]:
            raise ValueError(f"chunks need a vocabulary whose pieces hold no blank after a sign: {joined[:3]}")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        # Ids as text with what may follow them: "," or "|" after A's, "," or ";" after B's.
        self.shown = [f"{i}{mark}".encode() for side, marks in ((self.bytes_a, ",|"), (pieces, ",;")) for mark in marks for i in range(len(side))]
        n_a, n_b = len(self.bytes_a), len(pieces)
        self.shown_at = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])
        self.shown_length = np.array([len(x) for x in self.shown], dtype=np.int64)
        self.reset()

    def reset(self) -> None:
        self.codes = _Codes()
        self.figures = np.zeros((0, 5), dtype=np.int64)
        self.text: list[bytes] = []
        self.names: dict[int, int] = {}
        self.name = np.zeros(0, dtype=np.int64)
        self.begin = np.zeros(1, dtype=np.int64)
        self.pair = np.zeros(0, dtype=np.int64)
        self.often = np.zeros(0, dtype=np.int64)

    def _together(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides of chunks that may follow each other; None if the pieces do not join to them."""
        whole = b" " + b" ".join(part)
        text = whole.decode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        b = np.array(self.b.encode(text[1:]), dtype=np.int64)
        same = all(b"".join(map(side.__getitem__, ids.tolist())) == whole for side, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        ends = np.cumsum([1 + len(c) for c in part])
        return (a, b) if same and all(np.isin(ends, np.cumsum(n[ids])).all() for n, ids in ((self.length_a, a), (self.length_b, b))) else None

    def _alone(self, chunk: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        whole, text = b" " + chunk, chunk.decode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text) if text else [self.blank]
        if b"".join(self.bytes_a[i] for i in a) != whole or b"".join(self.bytes_b[i] for i in b) != whole:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def _merge(self, part: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Figures, texts, numbers of links, linked pairs and how often each stands, of chunks one after the other."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = group_ends(ends_a, ends_b)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        each_a, each_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        before_a, before_b = np.concatenate(([0], np.cumsum(each_a))), np.concatenate(([0], np.cumsum(each_b)))
        # Text: of each group A's ids, then B's.
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        shown = np.empty(len(a) + len(b), dtype=np.int64)
        shown[np.arange(len(a)) + before_b[group_a]] = a + self.shown_at[last_a.astype(np.int64)]
        shown[np.arange(len(b)) + before_a[group_b + 1]] = b + self.shown_at[2 + last_b.astype(np.int64)]
        text = b"".join(map(self.shown.__getitem__, shown.tolist()))
        # Chunks end where groups end.
        chunk_end = np.cumsum([1 + len(c) for c in part])
        groups = np.concatenate(([0], np.searchsorted(ends, chunk_end) + 1))
        n_a, n_b = before_a[groups], before_b[groups]
        at = np.concatenate(([0], np.cumsum(self.shown_length[shown])))[n_a + n_b].tolist()
        texts = [text[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
        each = each_a * each_b
        links = np.concatenate(([0], np.cumsum(each)))[groups]
        figures = np.stack([np.diff(n_a), np.diff(n_b), np.diff(groups), np.diff(links), np.zeros(len(part), dtype=np.int64)], axis=1)
        # Pairs: every A id with every B id of its group; long groups by their distinct ids.
        plain = each <= LONG_GROUP
        own = plain[group_a]
        times = each_b[group_a[own]]
        pair = np.repeat(a[own] << 32, times) | b[np.repeat(before_b[group_a[own]], times) + ramp(times)]
        often = np.ones(len(pair), dtype=np.int64)
        count = np.concatenate(([0], np.cumsum(np.where(plain, each, 0))))[groups]
        held = np.diff(count)
        if not plain.all():
            parts, marks, chunk = [(pair, often)], [np.repeat(np.arange(len(part)), held)], np.searchsorted(groups, np.arange(len(ends)), side="right") - 1
            for g in np.flatnonzero(~plain).tolist():
                ids_a, k_a = np.unique(a[before_a[g] : before_a[g + 1]], return_counts=True)
                ids_b, k_b = np.unique(b[before_b[g] : before_b[g + 1]], return_counts=True)
                parts.append(((ids_a[:, None] << 32 | ids_b[None, :]).ravel(), (k_a[:, None] * k_b[None, :]).ravel()))
                marks.append(np.full(len(ids_a) * len(ids_b), chunk[g]))
            mark = np.concatenate(marks)
            order = np.argsort(mark, kind="stable")
            pair, often = (np.concatenate(x)[order] for x in zip(*parts, strict=True))
            held = np.bincount(mark, minlength=len(part))
        return figures, texts, held, pair, often

    def learn(self) -> None:
        """Cut and merge the fresh chunks."""
        fresh, self.codes.fresh = self.codes.fresh, []
        for at in range(0, len(fresh), 8192):
            part = fresh[at : at + 8192]
            apart = [not c or (c[-1] not in _SIGNS and _ODD_END.search(c) is not None) or _MARK in c for c in part]
            order, a, b, bad = [k for k, odd in enumerate(apart) if not odd], [], [], []
            if order:
                if (both := self._together([part[k] for k in order])) is None:
                    order, apart = [], [True] * len(part)
                else:
                    a.append(both[0])
                    b.append(both[1])
            for k in (k for k, odd in enumerate(apart) if odd):
                if (both := self._alone(part[k])) is None:
                    bad.append(k)
                else:
                    order.append(k)
                    a.append(both[0])
                    b.append(both[1])
            figures, texts, held, pair, often = np.zeros((0, 5), dtype=np.int64), [], np.zeros(0, dtype=np.int64), self.pair[:0], self.often[:0]
            if order:
                figures, texts, held, pair, often = self._merge([part[k] for k in order], np.concatenate(a), np.concatenate(b))
            # Back to the order of the codes; what could not be cut counts as such.
            place = np.argsort(np.array(order + bad, dtype=np.int64))
            figures = np.concatenate((figures, np.array([[0, 0, 0, 0, 1]] * len(bad), dtype=np.int64).reshape(-1, 5)))[place]
            texts += [b""] * len(bad)
            held = np.concatenate((held, np.zeros(len(bad), dtype=np.int64)))
            begin = np.concatenate(([0], np.cumsum(held)))[place]
            held = held[place]
            take = np.repeat(begin, held) + ramp(held)
            self.text += [texts[k] for k in place.tolist()]
            names, back = np.unique(pair[take], return_inverse=True)
            known = np.array([self.names.setdefault(p, len(self.names)) for p in names.tolist()], dtype=np.int64)
            self.figures = np.concatenate((self.figures, figures))
            self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(held)))
            self.pair = np.concatenate((self.pair, known[back] if len(known) else self.pair[:0]))
            self.often = np.concatenate((self.often, often[take]))
        more = islice(self.names, len(self.name), None)
        self.name = np.concatenate((self.name, np.fromiter(more, dtype=np.int64, count=len(self.names) - len(self.name))))

    def documents(self, texts: list[bytes]) -> dict[str, object]:
        """Figures, digests and linked pairs (with their numbers) of some texts."""
        if len(self.codes) > CACHED_CHUNKS or self.codes.held > CACHED_BYTES:
            self.reset()
        every = [list(map(self.codes.__getitem__, chunks(t))) if t else [] for t in texts]
        self.learn()
        count = np.fromiter(map(len, every), dtype=np.int64, count=len(texts))
        code = np.fromiter(chain.from_iterable(every), dtype=np.int64, count=int(count.sum()))
        doc = np.repeat(np.arange(len(texts)), count)
        sums = np.zeros((len(texts), 5), dtype=np.int64)
        for k in range(5):
            sums[:, k] = np.bincount(doc, weights=self.figures[code, k], minlength=len(texts)).astype(np.int64)
        bad = sums[:, 4] > 0
        sums[bad] = 0
        shas = [hashlib.sha256(b"".join([self.text[c] for c in own])[:-1]).hexdigest() if own and not odd else "" for own, odd in zip(every, bad.tolist(), strict=True)]
        keep = ~bad[doc]
        width = max(1, len(self.codes))
        one, times = np.unique(doc[keep] * width + code[keep], return_counts=True)
        d, c = np.divmod(one, width)
        links = self.begin[c + 1] - self.begin[c]
        at = np.repeat(self.begin[c], links) + ramp(links)
        known = max(1, len(self.name))
        key = np.repeat(d, links) * known + self.pair[at]
        one, back = np.unique(key, return_inverse=True)
        n = np.bincount(back, weights=self.often[at] * np.repeat(times, links), minlength=len(one)).astype(np.int64)
        d, p = np.divmod(one, known)
        p = self.name[p]
        bounds = np.searchsorted(d, np.arange(len(texts) + 1)).tolist()
        spans = list(zip(bounds[:-1], bounds[1:], strict=True))
        return {"n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3], "groups_sha256": shas, "pairs": [p[s:e] for s, e in spans], "times": [n[s:e] for s, e in spans]}


_aligners: dict[tuple[str, str], Aligner] = {}


def _merged(path_a: str, path_b: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path_a, path_b) not in _aligners:
            _aligners.clear()
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner, row = _aligners[path_a, path_b], TaskContext.get().partitionId() << 40
        for frame in frames:
            ids, held, size, begin = pd.array(frame["id"].to_numpy(), dtype="Int64"), [], 0, 0
            ids[frame["no_id"].to_numpy()] = pd.NA
            texts = [t.encode() if isinstance(t, str) else b"" for t in frame["text"]]
            for k, t in enumerate(texts + [None]):
                if t is None or (held and size + len(t) > RUN_BYTES):
                    if held:
                        found = {"row": np.arange(row, row + len(held)), "id": ids[begin:k]} | aligner.documents(held)
                        yield pd.DataFrame(found)
                        row += len(held)
                    held, size, begin = [], 0, k
                if t is not None:
                    held.append(t)
                    size += len(t)
        release()

    return run


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: tokens of both sides, groups, links, the digest of the groups and the linked pairs (A's id << 32 | B's id) with their numbers.

    A is a byte-level BPE file of ``tokenizers`` applied to blank + text, B a SentencePiece model that
    adds the blank. Null and empty texts, and texts whose pieces do not join to blank + text on
    either side, have no tokens: zeros, no pairs, digest ''. Rows stand by themselves, also those that
    repeat; ``row`` tells them apart. Other columns are not read; empty input, empty result.
    """
    ready(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A null would make pandas turn the ids of a batch to floats, so nulls travel beside them.
    shown = source.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "text")
    return shown.mapInPandas(_merged(path_a, path_b), _ALIGNED)


def lexicon(rows: DataFrame) -> DataFrame:
    """Every linked pair of ids: ``pair``, ``a``, ``b``, ``n_docs`` that hold it, and whether that is the highest of its A id and of its B id.

    The highest counts have one row an id, so both are bounded by the vocabularies.
    """
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")).select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_docs"), "pairs")
    top = lambda side: F.broadcast(counts.groupBy(side).agg(F.max("n_docs").alias(f"top_{side}")))
    return counts.join(top("a"), "a").join(top("b"), "b").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("top_a")).alias("best_a"), (F.col("n_docs") == F.col("top_b")).alias("best_b"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The rows of ``aligned`` without their pairs but with ``n_best``, ``n_best_b`` and ``count_sum``, and the ``lexicon``.

    ``count_sum`` adds up the counts of a row's links; ``n_best`` and ``n_best_b`` are those links whose
    count is the highest of their A id, of their B id, ties included. Counts are of rows, so a row
    that repeats counts again. The ``hot_pairs`` most frequent pairs are sent to the rows, all
    others meet them in a shuffle: no pair, however frequent, gathers its rows in one task.
    """
    rows = written(aligned(docs, path_a, path_b, id_col, text_col), "aligned")
    pairs = written(lexicon(rows), "lexicon")
    slim = pairs.select("pair", "n_docs", "best_a", "best_b")
    least = slim.orderBy(F.desc("n_docs"), "pair").limit(hot_pairs)
    hot = F.broadcast(least)
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    figures = lambda f: f.groupBy("row").agg(
        F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"),
        F.sum(F.when(F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"),
    )
    rest = links.join(hot.select("pair"), "pair", "left_anti").join(slim.join(hot.select("pair"), "pair", "left_anti"), "pair")
    near = links.join(hot, "pair")
    both = figures(near).unionByName(figures(rest)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("count_sum", "n_best", "n_best_b")))
    out = rows.drop("pairs", "times").join(both, "row", "left").na.fill(0, ["count_sum", "n_best", "n_best_b"])
    return out.drop("row"), pairs


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` by byte_bpe_50k (A) and piece_bpe_32k (B)."""
    docs = table(spark, sf_dir, "documents")
    found, _ = align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op13_alignment": op13}
SQL: dict[str, str] = {}
