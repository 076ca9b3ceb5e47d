"""Ids of public tokenizers for whole columns of texts, as one flat array and offsets.

Two short cuts give the ids of the tokenizers library at a fraction of its time, and a test holds them against it:
a byte-level vocabulary is run by tiktoken on the merges of the same file, and where white space separates and is dropped,
each different word is encoded once and its ids are looked up. Texts that hold the string of an added token, which the
library gives that token's id, go to it whole.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain

import numpy as np

#: Different words that a worker keeps; a word's text, ids and entry take about 200 bytes.
WORDS_KEPT = 500_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where it prints, else the next code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Library:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)


def _added(path: str) -> list[str]:
    """Strings of the file's added tokens; they are found in the text as it stands."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["normalized"] for t in tokens):
        raise ValueError(f"{path} has added tokens that are found in the normalised text")
    return [t["content"] for t in tokens]


class ByteLevel:
    """A byte-level vocabulary with the usual pattern."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t) and t != "<|endoftext|>"}
        self.core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.library, self.added = path, None, _added(path)

    def one(self, text: str) -> np.ndarray:
        if any(x in text for x in self.added):
            self.library = self.library or _Library(self.path)
            return self.library(text)
        try:
            return self.core.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the pattern engine gives up (it panics) on very long runs of one kind of character
            if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                raise
            self.library = self.library or _Library(self.path)
            return self.library(text)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.one(t) for t in texts]
        off = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) for x in each], out=off[1:])
        return (np.concatenate(each) if each else np.zeros(0, np.uint32)).astype(np.uint32, copy=False), off


class _Words(dict):
    """Numbers of words; a new word gets the next one and is noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k


class WordLevel:
    """A vocabulary whose pre-tokenizer splits at white space and drops it, so that a text's ids are its words' ids in a row.

    New words of Latin letters, digits and signs go through tiktoken as pieces with a mark behind them, which stands for the
    vocabulary's word end and merges into the last byte before anything else; other words go to the library.
    """

    STOPS = frozenset(".,;:!?")
    END, MARK, BEYOND_LATIN = "</w>", "\0", "\u0250"
    #: The file's own splitting pattern.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.library, self.added = _Library(path), _added(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        alphabet, ranks = _byte_alphabet(), {}
        for t, i in vocab.items():
            body, end = (t[: -len(self.END)], self.MARK.encode()) if t.endswith(self.END) and t != self.END else (t, b"")
            if all(c in alphabet for c in body) and not t.startswith("<|"):
                ranks[bytes(alphabet[c] for c in body) + end] = i
        self.core = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(b"\0")]] = True
        self.pieces = regex.compile(self.PIECES)
        self._clear()

    def _clear(self) -> None:
        self.at = _Words()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has."""
        text = self.MARK.join(words)
        low = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split(self.MARK)
        pieces, counts = [], np.ones(len(low), np.int64)
        for k, w in enumerate(low):
            if w.isalpha():
                pieces.append(w)
            elif w[-1] in self.STOPS and w[:-1].isalpha():
                pieces += (w[:-1], w[-1])
                counts[k] = 2
            else:
                pieces += (own := self.pieces.findall(w))
                counts[k] = len(own)
        ids = self.core.encode_to_numpy(self.MARK.join(pieces) + self.MARK, disallowed_special=())
        piece_ends = np.flatnonzero(self.ends[ids]) + 1
        return ids, np.diff(np.concatenate([[0], piece_ends[np.cumsum(counts) - 1]]))

    def _learn(self) -> None:
        """Ids of the words that were noted."""
        words, self.at.new = self.at.new, []
        first = len(self.at) - len(words)
        text = self.MARK.join(words)
        if max(text) < self.BEYOND_LATIN and text.count(self.MARK) == len(words) - 1 and max(map(len, words)) < 1000:
            plain = np.ones(len(words), bool)
        else:
            plain = np.fromiter((max(w) < self.BEYOND_LATIN and self.MARK not in w and len(w) < 1000 for w in words), bool, len(words))
        latin, n = np.flatnonzero(plain), np.zeros(len(words), np.int64)
        parts = []
        if len(latin):
            ids, n[latin] = self._latin(words if plain.all() else [words[k] for k in latin.tolist()])
            parts.append((latin, ids))
        if len(rest := np.flatnonzero(~plain)):
            each = [x.ids for x in self.library.tok.encode_batch_fast([words[k] for k in rest.tolist()], add_special_tokens=False)]
            n[rest] = np.fromiter(map(len, each), np.int64, len(each))
            parts.append((rest, np.fromiter((x for y in each for x in y), np.uint32)))
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.size[first : len(self.at)] = n
        for own, ids in parts:
            ends = self.used + np.cumsum(n[own])
            self.start[first + own] = ends - n[own]
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """str.split also splits at four control characters that are no white space to the library; texts with them, or with an added token, go to it whole."""
        ids, counts = [], np.zeros(len(texts) + 1, np.int64)
        i = 0
        while i < len(texts):
            lists, chars = [], 0
            j = i
            while j < len(texts) and (chars < 2_000_000 or j == i):
                t = texts[j]
                odd = any(c in t for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self.added))
                lists.append(None if odd else t.split())
                chars += len(t)
                j += 1
            if len(self.at) > WORDS_KEPT:
                self._clear()
            total = sum(len(x) for x in lists if x)
            at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(x for x in lists if x)), np.int64, total)
            if self.at.new:
                self._learn()
            size = self.size[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            flat = self.flat[np.repeat(self.start[at] - ends + size, size) + np.arange(total)]
            word_end = np.cumsum([len(x) if x else 0 for x in lists])
            id_end = np.concatenate([[0], ends])[word_end]
            if any(x is None for x in lists):
                cut = np.concatenate([[0], id_end])
                for k, x in enumerate(lists):
                    own = self.library(texts[i + k]) if x is None else flat[cut[k] : cut[k + 1]]
                    ids.append(own)
                    counts[i + k + 1] = len(own)
            else:
                ids.append(flat)
                counts[i + 1 : j + 1] = np.diff(np.concatenate([[0], id_end]))
            i = j
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(counts)


_HELD: dict[tuple[str, str], ByteLevel | WordLevel] = {}


def encoder(kind: type, path: str):
    """The process's own encoder; a worker that runs several tasks loads its file once."""
    key = (kind.__name__, path)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = kind(path)
    return _HELD[key]
