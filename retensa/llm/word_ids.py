"""Ids of texts through the tokenizers library, each distinct run of a block encoded once.

Tokenizers like the 49k word vocabulary lower-case, drop white space and cut words into runs of
letters, runs of marks and single digits, which they encode apart.  A block of texts is cut
that way in numpy, Arrow numbers its distinct runs, only runs that are not in the bounded
cache go to the library, and the texts' ids are gathered through offsets.

A word with any other character (apostrophes, other scripts, special tokens) goes to the
library as it stands.  Whether all this holds is probed when a file is loaded; a tokenizer
that fails the probe encodes whole texts instead.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
SPACE, LETTER, MARK, DIGIT, ODD, LEAD, TAIL = range(7)

KIND = np.full(256, ODD, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = SPACE
KIND[33:127] = MARK
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[ord("'")] = ODD                   # opens suffixes such as 's
KIND[0x80:0xC0] = TAIL                 # of U+00C0 to U+00FF, all letters but two
KIND[[0x97, 0xB7]] = ODD
KIND[0xC3] = LEAD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PROBE = ("The QUICK Ünïcode-ÀÞßÿ word's x×y÷z don't 12,345.6 a1b2 ###***$%&|<>() é q r "
         "<|endoftext|>x a<|startoftext|> ΑΣ Ǆ 中文 \x1c\x00 i̇ İ ... -- "
         "http://a.b/c?d=e&f=_g_ 'tis 'LL x''s \U0001f600 ﬁ\nĳ\r\n\tlast  ")


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable Latin-1 as it is, others from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden) if b > 32}


class WordIds:
    """Encodes blocks of texts; keeps at most about ``cached`` runs between blocks."""

    def __init__(self, file: str, cached: int = 300_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(file)
        vocabulary = self.tokenizer.get_vocab()
        largest = max(vocabulary.values(), default=0)
        self.kind = np.dtype("<u2" if largest < 1 << 16 else "<u4")
        self.closes = np.zeros(largest + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.runs_only = Tokenizer(self.tokenizer.model)      # the same merges, on runs
        self.runs_only.pre_tokenizer = CharDelimiterSplit(" ")
        self.spelling = _byte_characters()
        self.cached = cached
        self._forget()
        self.by_runs = True
        self.by_runs = self._probe()
        self._forget()

    def _probe(self) -> bool:
        texts = [PROBE, PROBE.upper(), PROBE.lower(), ""]
        ids, ends = self.encode([t.encode() for t in texts])
        return all(ids[a:b].tolist() == self.tokenizer.encode(t, add_special_tokens=False).ids
                   for t, a, b in zip(texts, ends[:-1], ends[1:]))

    # the cache: run or word -> number; ids of number i are flat[start[i]:start[i] + size[i]]

    def _forget(self) -> None:
        self.runs: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, self.kind)

    def _shrink(self) -> None:
        """Keep the half of the cache that was used most."""
        if len(self.size) <= self.cached:
            return
        keep = np.zeros(len(self.used), bool)
        keep[np.argsort(-self.used, kind="stable")[:self.cached // 2]] = True
        keep &= self.size <= 64
        number = (np.cumsum(keep) - 1).tolist()
        flags = keep.tolist()
        for name in ("runs", "words"):
            known = getattr(self, name)
            setattr(self, name, {k: number[i] for k, i in known.items() if flags[i]})
        self.flat = self.flat[ranges(self.start[keep], self.size[keep])]
        self.size, self.used = self.size[keep], self.used[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def _add(self, known: dict[bytes, int], keys: list[bytes], ids: np.ndarray,
             sizes: np.ndarray) -> None:
        known.update(zip(keys, range(len(self.size), len(self.size) + len(keys))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.used = np.concatenate((self.used, np.zeros(len(keys), np.int64)))
        self.flat = np.concatenate((self.flat, ids.astype(self.kind)))

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words],
                                                 add_special_tokens=False)
        ids = [e.ids for e in found]
        return (np.array([i for own in ids for i in own], np.int64),
                np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn_words(self, words: list[bytes]) -> None:
        self._add(self.words, words, *self._alone(words))

    def _learn_runs(self, runs: list[bytes]) -> None:
        """Runs go to the merges in lines; every run ends with an id that closes a word."""
        lines = [b" ".join(runs[i:i + 512]) for i in range(0, len(runs), 512)]
        spelled = [x.decode() if x.isascii() else x.decode("latin-1").translate(self.spelling)
                   for x in lines]
        ids = [e.ids for e in self.runs_only.encode_batch_fast(spelled, add_special_tokens=False)]
        flat = np.array([i for own in ids for i in own], np.int64)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) == len(runs) and (not len(ends) or ends[-1] == len(flat)):
            self._add(self.runs, runs, flat, np.diff(ends, prepend=0))
        else:
            self._add(self.runs, runs, *self._alone(runs))

    def _numbers(self, known: dict[bytes, int], learn, array: pa.Array) -> np.ndarray:
        coded = array.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        new = [k for k in keys if k not in known]
        if new:
            learn(new)
        number = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        codes = coded.indices.to_numpy()
        self.used[number] += np.bincount(codes, minlength=len(keys))
        return number[codes]

    def _block(self, joined: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block, and how many of them stand before each place in ``begins``."""
        data = np.frombuffer(joined, np.uint8)
        kind = KIND[data]
        lower = LOWER[data]
        tail = np.flatnonzero((kind[:-1] == LEAD) & (kind[1:] == TAIL)) + 1
        kind[tail] = kind[tail - 1] = LETTER
        kind[kind > ODD] = ODD
        lower[tail[data[tail] < 0x9F]] += 32
        odd = np.flatnonzero(kind == ODD)
        if b"<|" in joined:
            odd = np.concatenate((odd, np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))))
        if len(odd):
            space = kind == SPACE
            word = np.cumsum(space)
            whole = np.zeros(int(word[-1]) + 1, bool)
            whole[word[odd]] = True
            kind[whole[word] & ~space] = ODD
        edge = np.concatenate(([0], np.flatnonzero(
            (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1, [len(data)]))
        at, size = edge[:-1], np.diff(edge)
        what = kind[at]
        at, size, what = (x[what != SPACE] for x in (at, size, what))
        number = np.zeros(len(at), np.int64)
        plain = what != ODD
        for chosen, source, known, learn in (
                (plain, lower[(kind != SPACE) & (kind != ODD)], self.runs, self._learn_runs),
                (~plain, data[kind == ODD], self.words, self._learn_words)):
            n = int(chosen.sum())
            if n:
                offsets = np.concatenate(([0], np.cumsum(size[chosen]))).astype(np.int32)
                array = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer(offsets), pa.py_buffer(source.tobytes())])
                number[chosen] = self._numbers(known, learn, array)
        sizes = self.size[number]
        before = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[ranges(self.start[number], sizes)]
        return ids, before[np.searchsorted(at, begins)]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's ids begin (one more than texts)."""
        if not self.by_runs:
            ids, sizes = self._alone(texts)
            return ids.astype(self.kind), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        found, counts = [], np.zeros(len(texts), np.int64)
        for begin, parts in _blocks(texts):
            self._shrink()
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            ends = np.cumsum(sizes + 1)
            ids, before = self._block(b"\n".join(parts) + b"\n", np.concatenate(([0], ends)))
            found.append(ids)
            counts[begin:begin + len(parts)] += np.diff(before)
        return (np.concatenate(found) if found else np.zeros(0, self.kind),
                np.concatenate(([0], np.cumsum(counts))))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start[i] .. start[i] + size[i] - 1`` of all i, one after the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of bounded size; a longer text comes in several
    blocks of its own, cut at white space, where no id reaches across."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > BLOCK_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        if len(text) > BLOCK_BYTES:
            at = 0
            while len(text) - at > BLOCK_BYTES:
                cut = max(text.rfind(b, at, at + BLOCK_BYTES) for b in (b" ", b"\n", b"\t"))
                if cut <= at:
                    found = [p for b in (b" ", b"\n", b"\t") if (p := text.find(b, at + 1)) > 0]
                    cut = min(found, default=len(text))
                yield i, [text[at:cut]]
                at = cut
            yield i, [text[at:]]
            begin = i + 1
        else:
            size += len(text) + 1
    if begin < len(texts):
        yield begin, texts[begin:]


@cache
def word_ids(file: str) -> WordIds:
    """One encoder per worker process."""
    return WordIds(file)
