"""Token ids of whole texts through a bounded cache of words.

For a tokenizer whose normaliser and pre-tokeniser never join characters across white space, the
ids of a text are those of its words in order. Words are cut at ASCII white space only; whatever
else a tokenizer takes for white space stays inside a word and is its own business.
"""

from __future__ import annotations

import os
import re

import numpy as np

from orbweave.llm.wordblocks import ramp

#: Words held at once; the cache starts anew beyond.
CACHED_WORDS = 450_000

#: Words of a-z and lower-case Latin-1 letters: no normaliser changes them and no pattern splits them.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Signs that part from a letter before them; not the apostrophe, nor those that special tokens end in.
_STOPS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'
#: How a vocabulary marks the last piece of a word.
_END_MARK = "</w>"


class WordTokens(dict):
    """word bytes -> code; ids of code c are the ``length[c]`` ones of ``flat`` from ``begin[c]`` on. Code 0 is ``end``.

    For byte-level BPE that lower-cases, splits letters from other signs and normalises to NFC. Words
    are looked up in lower case, stops after a letter by themselves, and plain words skip the normaliser.
    """

    def __init__(self, path: str, end: int, splitter: str = "<|endoftext|>"):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.splitter, self.split_id, self.end = splitter, self.tokenizer.token_to_id(splitter), end
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(1 + max(vocabulary.values()), dtype=bool)
        self.ends_word[[i for entry, i in vocabulary.items() if entry.endswith(_END_MARK)]] = True
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[bytes | tuple[int, int]] = []
        self.begin, self.length = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
        self.flat = np.array([self.end], dtype=np.uint32)

    def __missing__(self, word: bytes) -> int:
        parts = None
        if word[-1] in _STOPS and (stem := word.rstrip(_STOPS)) and 97 <= stem[-1] <= 122:
            parts = self[stem], self[word[len(stem) :]]
        code = len(self) + 1
        self[word] = code
        self.fresh.append(parts or word)
        return code

    def _encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of each; a word's last id is marked as such."""
        texts = [b" ".join(words[at : at + 2048]).decode() for at in range(0, len(words), 2048)]
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
        return flat, np.diff(np.flatnonzero(self.ends_word[flat]), prepend=-1)

    def _encode_any(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mark = self.splitter.encode()
        out: list[np.ndarray] = []
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            if any(mark in w for w in part):
                out += [np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, dtype=np.uint32) for w in part]
                continue
            text = (b" " + mark + b" ").join(part).decode()
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(ids == self.split_id)
            starts, ends = np.append(0, cuts + 1), np.append(cuts, len(ids))
            out += [ids[s:e] for s, e in zip(starts, ends, strict=True)]
        flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)
        return flat, np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    def _learn(self) -> None:
        """Append the ids of the fresh words; a word with a stop is those of its parts, which are known before it."""
        fresh, self.fresh = self.fresh, []
        plain, other, joined = [], [], []
        for k, w in enumerate(fresh):
            (joined if type(w) is tuple else plain if _PLAIN.fullmatch(w) else other).append(k)
        begin, length = np.zeros(len(fresh), dtype=np.int64), np.zeros(len(fresh), dtype=np.int64)
        parts, at = [self.flat], len(self.flat)
        for own, encode in ((plain, self._encode_plain), (other, self._encode_any)):
            flat, n = encode([fresh[k] for k in own])
            begin[own], length[own] = at + np.cumsum(n) - n, n
            parts.append(flat)
            at += len(flat)
        self.flat = np.concatenate(parts)
        self.begin, self.length = np.concatenate((self.begin, begin)), np.concatenate((self.length, length))
        if joined:
            pairs = np.array([fresh[k] for k in joined], dtype=np.int64)
            code = len(self.begin) - len(fresh) + np.array(joined, dtype=np.int64)
            each = self.length[pairs]
            added = self.flat[np.repeat(self.begin[pairs].ravel(), each.ravel()) + ramp(each.ravel())]
            n = each.sum(axis=1)
            self.begin[code], self.length[code] = at + np.cumsum(n) - n, n
            self.flat = np.concatenate((self.flat, added))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and the offsets of the texts."""
        if len(self) > CACHED_WORDS:
            self.reset()
        codes: list[int] = []
        count = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            words = (t if b"<|" in t else t.lower()).split()  # special tokens are told by their case
            codes += map(self.__getitem__, words)
            codes.append(0)
            count[i] = len(words) + 1
        if self.fresh:
            self._learn()
        code = np.array(codes, dtype=np.int64)
        lengths = self.length[code]
        out = self.flat[np.repeat(self.begin[code], lengths) + ramp(lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        return out, sums[np.concatenate(([0], np.cumsum(count)))]
