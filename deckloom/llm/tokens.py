"""Whole-text encoding through a per-worker cache of distinct words.

Both tokenizers split a text at white space before any merge, so the ids of a text are those of its words in a row.
Every distinct word goes through the tokenizers library once per worker; a text is then assembled by look-ups.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np

from deckloom.llm.common import PIECE_BYTES, pieces

#: About as many bytes are cached per worker at most. A full cache keeps what was met again since it was last full.
CACHE_BYTES = 160 << 20
#: What an entry takes in memory besides its word.
ENTRY_BYTES = 190
#: New words that are encoded in one line, and told apart by the places of their tokens: the call costs less for each, up to about here.
LINE_WORDS = 256
#: Closing punctuation; the tokenizer always splits a word between an ASCII letter and these.
_TAIL = b".,;:!?*$%&#"

_WORKER: dict = {}


def library_tokenizer(path: str):
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORKER[path] = Tokenizer.from_file(path)
    return _WORKER[path]


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space and case (``word_bpe_49k``).

    The cache maps a word to a slot; a slot is a range of the array ``flat``. What the library encodes is a word's
    lower-cased stem and its closing punctuation, so forms such as ``Word,`` and ``word.`` share the work.
    """

    def __init__(self, path: str):
        self.tokenizer = library_tokenizer(path)
        self.slot: dict[bytes, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int32)
        self.met = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.slots = self.filled = self.held = 0
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        #: Tokens that end a word of letters; none if the tokenizer doesn't mark them.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.last[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True

    def _shrink(self) -> None:
        """Keep the words that most slices of text had, in half the room at most."""
        times = self.met[: self.slots]
        order = np.sort(times)[::-1]
        least = max(2, int(order[min(len(order) - 1, CACHE_BYTES // (2 * ENTRY_BYTES))]) + 1)
        kept = np.flatnonzero(times >= least)
        number = np.full(self.slots, -1)
        number[kept] = np.arange(len(kept))
        ids, length = self._gather(kept), self.length[kept]
        self.slot = {w: n for w, s in self.slot.items() if (n := int(number[s])) >= 0}
        self.held = len(self.slot) * ENTRY_BYTES + sum(map(len, self.slot))
        self.slots = self.filled = 0
        self.met[:] = 0
        self._append(ids, length)

    def _append(self, ids: np.ndarray, length: np.ndarray) -> range:
        """New slots for runs of ids of the given lengths."""
        n, first = self.slots, self.filled
        while n + len(length) > len(self.start):
            self.start, self.length, self.met = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.met))
        while first + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.length[n : n + len(length)] = length
        self.start[n : n + len(length)] = first + np.cumsum(length) - length
        self.flat[first : first + len(ids)] = ids
        self.slots, self.filled = n + len(length), first + len(ids)
        return range(n, self.slots)

    def _learn(self, fresh: set[bytes]) -> None:
        stems, tailed, heads, tails, plain = {}, [], [], [], set()
        for word in fresh:
            stem = word.rstrip(_TAIL)
            if b"<|" in word:  # the strings of special tokens stay as they are
                plain.add(word)
            elif len(stem) < len(word) and stem[-1:].isalpha():
                tailed.append(word)
                heads.append(stem.lower())
                tails.append(word[len(stem) :])
            else:
                stems[word] = word.lower()
        plain.update(stems.values(), heads, tails)
        slot = self.slot
        letters, others, marked = [], [], []
        for word in plain.difference(slot):
            (letters if _of_letters(word) else marked if b"<|" in word else others).append(word)
        unknown = letters + others + marked
        if unknown:
            runs = [self._of_letters(letters), self._encoded(others, LINE_WORDS), self._encoded(marked, 1)]
            slot.update(zip(unknown, self._append(*map(np.concatenate, zip(*runs, strict=True))), strict=True))
        before = len(slot) - len(unknown)
        slot.update(zip(stems, map(slot.__getitem__, stems.values()), strict=True))
        if tailed:
            pair = np.fromiter(map(slot.__getitem__, chain.from_iterable(zip(heads, tails, strict=True))), np.int64, 2 * len(tailed))
            ids, length = self._gather(pair), self.length[pair].reshape(-1, 2).sum(1)
            slot.update(zip(tailed, self._append(ids, length), strict=True))
        self.held += (len(slot) - before) * ENTRY_BYTES + sum(map(len, fresh)) + sum(map(len, unknown))

    def _encoded(self, words: list[bytes], at_once: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row and their number for each. Most of the time for a short text goes into the call, so many words
        are encoded as one line; words with the mark of special tokens go one by one."""
        ids, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        lines = [[w.decode() for w in words[k : k + at_once]] for k in range(0, len(words), at_once)]
        for line, got in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            end = np.cumsum(np.fromiter(map(len, line), np.int64) + 1)
            at = np.fromiter((a for a, _ in got.offsets), np.int64)
            ids.append(np.array(got.ids, np.uint32))
            length.append(np.bincount(np.searchsorted(end, at, side="right"), minlength=len(line)))
        return np.concatenate(ids), np.concatenate(length)

    def _of_letters(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: the tokenizer never splits these, so a word ends where a token is marked as the last
        of one, and the places of tokens aren't asked for."""
        lines = [b" ".join(words[k : k + LINE_WORDS]).decode() for k in range(0, len(words), LINE_WORDS)]
        got = self.tokenizer.encode_batch(lines, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(x.ids, np.uint32) for x in got)])
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(words) or (len(ends) and ends[-1] + 1 != len(ids)):  # a tokenizer of another kind
            return self._encoded(words, LINE_WORDS)
        return ids, np.diff(ends, prepend=-1)

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        length = self.length[slots]
        ends = np.cumsum(length, dtype=np.int64)
        return self.flat[np.repeat(self.start[slots] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text as uint32, in order. About a megabyte of text is looked up at a time, cut at white space."""
        words: list[list[bytes]] = []
        ends: list[bool] = []
        parts: list[np.ndarray] = []
        held = 0

        def done() -> Iterator[np.ndarray]:
            for ids, end in zip(self._look_up(words), ends, strict=True):
                parts.append(ids)
                if end:
                    yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                    parts.clear()
            words.clear()
            ends.clear()

        for text in texts:
            cut = list(pieces(text))
            for k, piece in enumerate(cut):
                words.append(piece.split())
                ends.append(k + 1 == len(cut))
                held += len(piece)
                if held >= PIECE_BYTES:
                    yield from done()
                    held = 0
        yield from done()

    def _look_up(self, words: list[list[bytes]]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self._shrink()
        flat = list(chain.from_iterable(words))
        slots = np.fromiter(map(self.slot.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(slots < 0).tolist()
        if new:
            self._learn({flat[i] for i in new})
            slots[new] = [self.slot[flat[i]] for i in new]
        self.met[: self.slots] += np.bincount(slots, minlength=self.slots) > 0
        ids = self._gather(slots)
        word_ends = np.cumsum([0, *map(len, words)])
        id_ends = np.concatenate([[0], np.cumsum(self.length[slots], dtype=np.int64)])[word_ends].tolist()
        return [ids[a:b] for a, b in zip(id_ends, id_ends[1:], strict=False)]


def _of_letters(word: bytes) -> bool:
    """If a word holds nothing but letters of ASCII and Latin-1, which no rule of Unicode takes apart."""
    return word.isalpha() or not word.isascii() and (text := word.decode()).isalpha() and max(text) <= "\xff"


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; tasks that follow in the same worker find its cache filled."""
    key = ("words", path)
    if key not in _WORKER:
        _WORKER[key] = WordEncoder(path)
    return _WORKER[key]


#: A chunk is a run of ASCII white space with the word after it, or white space at the end of the text.
CHUNK = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: Other characters that some rule treats as white space: a text that has one is encoded whole by the library.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class ChunkLengths(dict):
    """Token counts of chunks under a byte-level tokenizer: a ready table first, then a bounded worker cache.

    A chunk is white space with the word after it. The tokenizer's pattern never joins a word to white space that
    follows, so chunks can be counted one by one. ``MIXED`` marks a chunk for which this isn't certain.
    """

    MIXED = 1 << 40

    def __init__(self, path: str, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.tokenizer = library_tokenizer(path)
        self.rare: dict[bytes, int] = {}
        self.held = 0

    def __missing__(self, chunk: bytes) -> int:
        n = self.rare.get(chunk)
        if n is None:
            if self.held > CACHE_BYTES:
                self.rare.clear()
                self.held = 0
            self.held += ENTRY_BYTES + len(chunk)
            n = self.rare[chunk] = self.measure(chunk)
        return n

    def measure(self, chunk: bytes) -> int:
        text = chunk.decode()
        if OTHER_SPACE.search(text):
            return self.MIXED
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: bytes) -> int:
        n = 0
        for piece in pieces(text):
            n += sum(map(self.__getitem__, CHUNK.findall(piece)))
        if n >= self.MIXED:
            n = len(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        return n


def chunk_lengths(path: str, name: str, frequent: Callable[[], dict[bytes, int]]) -> ChunkLengths:
    """The worker's counts for a file and the table of this name; tasks that follow in the same worker find its cache filled.

    A worker keeps one table and one cache, so another name takes the place of the last.
    """
    key = ("chunks", path)
    if key not in _WORKER or _WORKER[key][0] != name:
        _WORKER[key] = name, ChunkLengths(path, frequent())
    return _WORKER[key][1]
