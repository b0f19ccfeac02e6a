"""Language identification by a linear-chain conditional random field over words.

A word is a run of ASCII letters and non-ASCII bytes. Its emission scores come from hashed byte
trigrams with word boundaries, prefixes and suffixes, and from a lexicon of each language's
frequent words; transitions between neighbouring labels are learned with them. Forward-backward
over a whole text labels every word, also where languages switch; the language with the largest
mean posterior is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import wordblocks as wb
from orbweave.llm.runtime import ready, small, table, tidy

UNDETERMINED = "und"
#: Bounds of the labelled sample the model is fitted on, for each language: documents, and words of
#: these (whole texts each). A language whose every text is longer gives its shortest sampled one.
SAMPLE_DOCS = 300
SAMPLE_WORDS = 80_000
#: Frequent words of each language in the lexicon.
LEXICON = 400
#: Hashed features, and passes of the optimiser over the sample.
BITS = 16
PASSES = 50
CHUNK = 64

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ANY_LETTER = regex.compile(r"\p{L}")
_KINDS = {"trigram": 1, "prefix2": 2, "prefix3": 3, "suffix2": 4, "suffix3": 5}


def _slot(kind: str, *parts: np.ndarray) -> np.ndarray:
    """Feature number of byte tuples."""
    h = np.full(len(parts[0]), _KINDS[kind] * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    return (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


class Words:
    """The words of some texts: features by word and the number of words of each text."""

    def __init__(self, texts: list[bytes]):
        a = np.frombuffer(b" ".join([*texts, b" "]), dtype=np.uint8)
        letter = _LETTER[a]
        low = _LOWER[a]
        accent = np.zeros(len(a), dtype=bool)  # capitals of the Latin-1 range follow 0xC3
        accent[1:] = (a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)
        low = np.where(letter, low + np.uint8(32) * accent, np.uint8(0))
        turn = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        length = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.count = np.diff(np.searchsorted(self.start, np.concatenate(([0], np.cumsum(length)))))
        pad = np.concatenate(([0, 0, 0], low, [0, 0, 0])).astype(np.uint32)
        at = np.flatnonzero(letter) + 3
        self.trigrams = _slot("trigram", pad[at - 1], pad[at], pad[at + 1])
        self.first = np.cumsum(self.end - self.start) - (self.end - self.start)
        s, e, n = self.start + 3, self.end + 3, self.end - self.start
        third = np.where(n > 2, pad[e - 3], 0).astype(np.uint32)
        second = np.where(n > 1, pad[e - 2], 0).astype(np.uint32)
        self.affixes = np.stack(
            [
                _slot("prefix2", pad[s], pad[s + 1]),
                _slot("prefix3", pad[s], pad[s + 1], np.where(n > 1, pad[s + 2], 0).astype(np.uint32)),
                _slot("suffix2", second, pad[e - 1]),
                _slot("suffix3", third, second, pad[e - 1]),
            ],
            axis=1,
        ) if len(s) else np.zeros((0, 4), dtype=np.uint32)
        up, down = wb.powers(len(a) + 1)
        sums = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(wb.BYTE_VALUES[low] * letter * up[: len(a)], out=sums[1:])
        self.hash = wb.mix((sums[self.end] - sums[self.start]) * down[self.start])


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2^BITS + lexicon + 1, labels): hashed features, lexicon entries, then zeros
    transitions: np.ndarray  # (labels, labels)
    lexicon: np.ndarray  # sorted word hashes

    def lexicon_rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, hashes)
        at = np.minimum(at, max(len(self.lexicon) - 1, 0))
        found = self.lexicon[at] == hashes if len(self.lexicon) else np.zeros(len(hashes), dtype=bool)
        return np.where(found, (1 << BITS) + at, len(self.weights) - 1)

    def emissions(self, words: Words) -> np.ndarray:
        w = self.weights
        out = np.empty((len(words.start), len(self.labels)))
        for k in range(len(self.labels)):
            column = np.ascontiguousarray(w[:, k])
            out[:, k] = np.add.reduceat(column[words.trigrams], words.first) / np.sqrt(words.end - words.start)
            for j in range(4):
                out[:, k] += column[words.affixes[:, j]]
            out[:, k] += column[self.lexicon_rows(words.hash)]
        return out


def _steps(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of the sequences, longest first: first word, length, and for each its number before sorting."""
    chunks = -(-count // CHUNK)
    which = wb.ramp(chunks)
    begin = np.repeat(np.cumsum(count) - count, chunks) + which * CHUNK
    size = np.minimum(CHUNK, np.repeat(count, chunks) - which * CHUNK)
    order = np.argsort(-size, kind="stable")
    return begin[order], size[order], order


def posteriors(emission: np.ndarray, transitions: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word by forward-backward, exact over each whole sequence.

    The second array holds the normalised forward messages.

    Sequences are cut into chunks only to work on many at once: transfer matrices carry the messages
    from chunk to chunk, and each chunk is then filled in from both of its ends.
    """
    n, labels = emission.shape
    if not n:
        return np.zeros((0, labels)), np.zeros((0, labels))
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-12
    a = np.exp(transitions - transitions.max())
    begin, size, order = _steps(count)
    alive = [int(np.searchsorted(-size, -t, side="left")) for t in range(CHUNK + 1)]  # chunks longer than t
    m = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for t in range(CHUNK):
        k = alive[t]
        if not k:
            break
        m[:k] = (m[:k].reshape(-1, labels) @ a).reshape(k, labels, labels) * e[begin[:k] + t][:, None, :]
        if t % 8 == 7:
            m[:k] /= m[:k].max(axis=(1, 2), keepdims=True)
    m /= m.max(axis=(1, 2), keepdims=True)
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    chunks = -(-count // CHUNK)
    first = np.cumsum(chunks) - chunks
    ahead, after = np.empty((len(order), labels)), np.empty((len(order), labels))
    busy = np.argsort(-chunks, kind="stable")
    deep = chunks[busy]
    f = np.full((len(count), labels), 1.0 / labels)
    for c in range(int(chunks.max(initial=0))):
        own = busy[: int(np.searchsorted(-deep, -c, side="left"))]
        at = back[first[own] + c]
        ahead[at] = f[own]
        f[own] = np.matmul(f[own][:, None, :], m[at])[:, 0, :]
        f[own] /= f[own].sum(axis=1, keepdims=True)
    g = np.ones((len(count), labels))
    for c in range(int(chunks.max(initial=0))):
        own = busy[: int(np.searchsorted(-deep, -c, side="left"))]
        at = back[first[own] + chunks[own] - 1 - c]
        after[at] = g[own]
        g[own] = np.matmul(m[at], g[own][:, :, None])[:, :, 0]
        g[own] /= g[own].sum(axis=1, keepdims=True)
    out = np.empty((n, labels))
    f = ahead
    for t in range(CHUNK):
        k = alive[t]
        if not k:
            break
        f[:k] = (f[:k] @ a) * e[begin[:k] + t]
        f[:k] /= f[:k].sum(axis=1, keepdims=True)
        out[begin[:k] + t] = f[:k]
    forward = out.copy()
    g = after
    for t in range(CHUNK - 1, -1, -1):
        k = alive[t]
        if not k:
            continue
        at = begin[:k] + t
        out[at] *= g[:k]
        g[:k] = (e[at] * g[:k]) @ a.T
        g[:k] /= g[:k].sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True), forward


def fit(texts: list[bytes], langs: list[str], passes: int = PASSES) -> Model:
    """Fit on whole labelled texts; sequences splice two texts at random places, so switches are seen too.

    Every word of every text is in one sequence: a pair of texts is cut once each and interleaved.
    """
    labels = sorted(set(langs))
    y_of = {x: i for i, x in enumerate(labels)}
    rng = np.random.Generator(np.random.PCG64(5))
    words = Words(texts)
    begin = np.cumsum(words.count) - words.count
    doc_label = np.array([y_of[x] for x in langs])
    of_word = np.repeat(doc_label, words.count)
    # Lexicon: each language's words by how far their count there exceeds that elsewhere.
    unique, inverse = np.unique(words.hash, return_inverse=True)
    by_label = np.zeros((len(unique), len(labels)))
    np.add.at(by_label, (inverse, of_word), 1)
    chosen = set()
    for k in range(len(labels)):
        gain = by_label[:, k] - (by_label.sum(axis=1) - by_label[:, k])
        top = np.argsort(-gain, kind="stable")[:LEXICON]
        chosen |= set(unique[top[by_label[top, k] > 1]].tolist())
    lexicon = np.array(sorted(chosen), dtype=np.uint64)
    model = Model(labels, np.zeros(((1 << BITS) + len(lexicon) + 1, len(labels))), np.zeros((len(labels), len(labels))), lexicon)
    pieces, lengths = [], []
    docs = rng.permutation([i for i in range(len(texts)) if words.count[i]]).tolist()
    for i, j in zip(docs[::2], [*docs[1::2], None][: len(docs[::2])], strict=True):
        parts = []
        for x in (i, j):
            if x is not None:
                s, n = int(rng.integers(words.count[x] + 1)), int(words.count[x])
                parts.append((np.arange(begin[x], begin[x] + s), np.arange(begin[x] + s, begin[x] + n)))
        own = [p[k] for k in (0, 1) for p in parts]
        pieces += own
        lengths.append(sum(map(len, own)))
    if not pieces:
        return model
    at, count = np.concatenate(pieces), np.array(lengths)
    truth = of_word[at]
    # Distinct words carry the features; a sequence refers to them.
    kept, place = np.unique(inverse[at], return_inverse=True)
    example = np.empty(len(unique), dtype=np.int64)
    example[inverse] = np.arange(len(inverse))
    example = example[kept]
    reps = (words.end - words.start)[example]
    tri = words.trigrams[np.repeat(words.first[example], reps) + wb.ramp(reps)]
    owner = np.concatenate((np.repeat(np.arange(len(kept)), reps), np.tile(np.arange(len(kept)), 5)))
    slot = np.concatenate((tri, *(words.affixes[example, j] for j in range(4)), model.lexicon_rows(words.hash[example]))).astype(np.int64)
    value = np.concatenate((np.repeat(1 / np.sqrt(reps), reps), np.ones(5 * len(kept))))
    value[slot == len(model.weights) - 1] = 0
    last = np.zeros(len(at), dtype=bool)
    last[np.cumsum(count) - 1] = True
    seen = np.zeros_like(model.transitions)
    np.add.at(seen, (truth[:-1][~last[:-1]], truth[1:][~last[:-1]]), 1)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(seen), np.zeros_like(seen)]
    for step in range(1, passes + 1):
        emission = np.stack([np.bincount(owner, value * model.weights[slot, k], len(kept)) for k in range(len(labels))], axis=1)[place]
        p, forward = posteriors(emission, model.transitions, count)
        wrong = p.copy()
        wrong[np.arange(len(truth)), truth] -= 1
        own = np.stack([np.bincount(place, wrong[:, k], len(kept)) for k in range(len(labels))], axis=1)
        grad = np.stack([np.bincount(slot, value * own[owner, k], len(model.weights)) for k in range(len(labels))], axis=1) / len(at) + 1e-7 * model.weights
        # Pair marginals: the forward message, the transition, and what the next posterior says of its label.
        a = np.exp(model.transitions)
        before = forward[:-1][~last[:-1]]
        pairs = a * (before.T @ (p[1:][~last[:-1]] / (before @ a)))
        flow = (pairs - seen) / len(at) + 1e-4 * model.transitions
        for parameter, g, m1, m2, rate in ((model.weights, grad, moments[0], moments[1], 0.15), (model.transitions, flow, moments[2], moments[3], 0.1)):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            parameter -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    model.weights[-1] = 0
    return model


def label_texts(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its mean posterior and the number of words of each text."""
    words = Words(texts)
    sums = np.zeros((len(texts), len(model.labels)))
    if len(words.start):
        p, _ = posteriors(model.emissions(words), model.transitions, words.count)
        some = np.flatnonzero(words.count)
        sums[some] = np.add.reduceat(p, (np.cumsum(words.count) - words.count)[some], axis=0)
    mean = sums / np.maximum(words.count, 1)[:, None]
    best = mean.argmax(axis=1)
    score = mean[np.arange(len(texts)), best]
    names = [model.labels[b] for b in best]
    for i, t in enumerate(texts):
        if not words.count[i] or not _ANY_LETTER.search(t.decode()):
            names[i], score[i] = UNDETERMINED, 0.0
    return names, np.clip(score, 0.0, 1.0), words.count


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in wb.blocks(batch, limit=1 << 20):
                names, score, count = label_texts(model, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(names), pa.array(score), pa.array(count)], names=["id", "lang_pred", "score", "n_words"]
                )

    return tidy(run)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS
) -> Model:
    """A model of the labelled rows that are not held out, fitted on a bounded sample of each language.

    Every non-null label is learned, however rare: up to ``sample_docs`` distinct texts of it, in
    order of their hashes, as long as they have ``sample_words`` words together; the first counts
    anyway. Texts are used whole. Without labelled rows the model has the single label ``und``. The
    driver holds the sample, whose size grows with the number of labels only.
    """
    text = F.col(text_col).cast("string")
    usable = docs.where(~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & text.rlike("\\p{L}")).select(
        F.col(lang_col).cast("string").alias("l"), text.alias("t"), F.xxhash64(text).alias("h")
    )
    sizes = {r["l"]: r["n"] for r in usable.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model([UNDETERMINED], np.zeros(((1 << BITS) + 1, 1)), np.zeros((1, 1)), np.zeros(0, dtype=np.uint64))
    # About twice the sample's texts of every language, copies folded before they move.
    every = usable.sparkSession.createDataFrame([(k, max(1, n // (2 * sample_docs))) for k, n in sizes.items()], "l string, every long")
    some = usable.join(small(every, len(sizes)), "l").where(F.pmod("h", "every") == 0).groupBy("l", "h").agg(F.min("t").alias("t"))
    some = some.withColumn("n", F.size(F.split("t", "[\\x20\\x09-\\x0D]+")))
    order = Window.partitionBy("l").orderBy(F.col("n") > sample_words, F.when(F.col("n") > sample_words, F.col("n")), "h")
    rows = (
        some.withColumn("rank", F.row_number().over(order))
        .withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("rank") == 1) | ((F.col("rank") <= sample_docs) & (F.col("total") <= sample_words)))
        .select("l", "h", "t")
        .collect()
    )
    rows.sort(key=lambda r: (r["l"], r["h"]))
    return fit([r["t"].encode() for r in rows], [r["l"] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score`` and ``n_words`` of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0. Each row stands by itself:
    repeats give repeats, an empty table an empty result, no other column is read, nothing is
    shuffled. The model's size is fixed by its feature slots and labels, not by the data.
    """
    ready(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_predicted(model), f"id {kind}, lang_pred string, score double, n_words long")


def _keeping(model: Model, text_col: str, lang_col: str, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_lang = batch.schema.get_field_index(lang_col)
            for at, texts in wb.blocks(batch, text=text_col, limit=1 << 20):
                names, score, _ = label_texts(model, texts)
                part = batch.slice(at, len(texts))
                lang = pa.array([a if a is not None else b for a, b in zip(part.column(at_lang).to_pylist(), names, strict=True)], type=pa.string())
                columns = [lang if k == at_lang else c for k, c in enumerate(part.columns)]
                stay = pa.array(np.array([n != UNDETERMINED for n in names]) & (score >= least))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(stay)

    return tidy(run)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language: not ``und``, and a mean posterior of at least ``least``.

    All columns stay as they are, but a null language becomes the predicted one. Null and empty texts go.
    """
    ready(docs.sparkSession)
    return docs.mapInArrow(_keeping(model, text_col, lang_col, least), docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every row of ``documents``; rows of remainder 2 are held out of the fit."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language": op1}
SQL: dict[str, str] = {}
