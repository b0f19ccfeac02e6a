"""Token counts of whole texts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; dynamic programming over
match ends carries the best score and its number of pieces, nothing else. Ties go as in unigram
tokenizers that walk start positions upward and replace a path only by a strictly better one: the
piece with the smaller start wins, and the unknown character, considered last, loses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.packing import tokenizer_file
from orbweave.llm.runtime import ready, table, tidy

#: How far an unknown character scores under the worst piece, and the word mark.
UNKNOWN_PENALTY = 10.0
MARK = "▁"
CACHED_WORDS = 300_000

_counters: dict[str, WordCounts] = {}


class WordCounts(dict):
    """word bytes -> number of pieces of the marked word; a bounded cache."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def count(self, text: str) -> int:
        """Pieces of the best segmentation; unknown characters fall back to their bytes."""
        n = len(text)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(text):
            found[end + 1].append(match)
        for end in range(1, n + 1):
            top, k, single = None, 0, False
            for length, score in sorted(found[end], reverse=True):
                total = score + best[end - length]
                if top is None or total > top:
                    top, k = total, pieces[end - length] + 1
                single = single or length == 1
            if not single:
                total = self.unknown + best[end - 1]
                if top is None or total > top:
                    top, k = total, pieces[end - 1] + len(text[end - 1].encode())
            best[end], pieces[end] = top, k
        return pieces[n]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        text = word.decode()
        n = self[word] = self.count(text if text.startswith(MARK) else MARK + text)
        return n


def _counted(vocabulary: list[tuple[str, float]], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _counters:
            _counters.clear()
            _counters[key] = WordCounts(vocabulary)
        pieces = _counters[key].__getitem__
        for batch in batches:
            for at, texts in wb.blocks(batch, limit=1 << 20):
                words = [t.split() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(np.fromiter(map(len, words), dtype=np.int64, count=len(words))),
                        pa.array(np.fromiter((sum(map(pieces, w)) for w in words), dtype=np.int64, count=len(words))),
                    ],
                    names=["id", "n_words", "n_tokens"],
                )

    return tidy(run)


def vocabulary_of(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model, to be used as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def _digest(vocabulary: list[tuple[str, float]]) -> str:
    """Tells vocabularies apart by all their pieces and scores."""
    h = hashlib.sha256()
    for piece, score in vocabulary:
        h.update(f"{len(piece)}:{piece}{score!r};".encode())
    return h.hexdigest()


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words`` and ``n_tokens`` of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, each segmented with the word mark before it (one that starts with the mark gets no second). Null and empty
    texts have none. Rows stand by themselves, so repeats give repeats and nothing is shuffled; an
    empty table gives an empty result. The vocabulary travels with the function; its size is fixed.
    """
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_counted(vocabulary, _digest(vocabulary)), f"id {kind}, n_words long, n_tokens long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram pieces of every row of ``documents``."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_of(tokenizer_file("piece_bpe_32k.model"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_token_counts": op5}
SQL: dict[str, str] = {}
