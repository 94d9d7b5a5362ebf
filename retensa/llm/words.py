"""Vectorised word hashing for blocks of texts (numpy, inside Arrow tasks).

A block of texts is handled as one byte array.  Every word gets a 64-bit hash
from one prefix sum: with odd ``B``, ``sum(T[byte_i] * B**i)`` over the word,
times ``B**-start``, does not depend on where the word stands.  The hash is then
mixed, so runs of words can be combined by a second polynomial.

Block size is bounded, so memory does not follow the Arrow batch; only a single
text longer than a block makes a block of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 19
ALL = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply-and-shift finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i < n, kept and extended on demand."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * BLOCK_BYTES)
        step = np.full(size, BASE, np.uint64)
        step[0] = 1
        back = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _powers, _inverse = np.multiply.accumulate(step), np.multiply.accumulate(back)
    return _powers, _inverse


class WordClass:
    """Which bytes belong to words, and the value each byte hashes as.

    ``separators``: the byte values between words.  Line feeds must be among
    them: texts of a block are joined by one.  ``fold_case`` lower-cases A-Z.
    """

    def __init__(self, separators: bytes, fold_case: bool):
        if 0x0A not in separators:
            raise ValueError("a line feed must separate words")
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        source = np.arange(256)
        if fold_case:
            source[65:91] += 32
        self.value = np.where(self.is_word, BYTE_VALUE[source], np.uint64(0))


BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: words ``[^\x20\x09-\x0D]+``, as they stand or lower-cased
BLANK_CASED = WordClass(BLANKS, False)
BLANK_FOLDED = WordClass(BLANKS, True)
#: words of digits, letters and everything outside ASCII, lower-cased
ALNUM_FOLDED = WordClass(bytes(b for b in range(128) if not chr(b).isalnum()), True)


class Block:
    """Words of some texts: ``hashes``, byte ``starts`` / ``ends`` in ``data``, and
    ``first[i]:first[i + 1]`` the words of text i; text i begins at ``begin[i]``."""

    def __init__(self, texts: list[bytes], kind: WordClass):
        self.joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        inside = kind.is_word[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.begin)
        powers, inverse = _power_tables(len(self.data))
        sums = kind.value[self.data]
        sums *= powers[:len(sums)]
        np.cumsum(sums, out=sums)
        before = np.where(self.starts > 0, sums[self.starts - 1], np.uint64(0))
        self.hashes = mix((sums[self.ends - 1] - before) * inverse[self.starts])

    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word index) of every run of ``size`` words inside one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * STEP + self.hashes[j:j + n]
        ok = np.ones(n, bool)
        for j in range(1, size):          # runs that begin in the last words of a text
            late = self.first[1:-1] - j
            ok[late[(late >= 0) & (late < n)]] = False
        at = np.flatnonzero(ok)
        return mix(h[at] + np.uint64(size)), at


def blocks(texts: list[bytes], kind: WordClass,
           limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(from, to, Block) over consecutive texts of at most ``limit`` bytes, or one text."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) + 1 > limit:
            yield begin, i, Block(texts[begin:i], kind)
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts), Block(texts[begin:], kind)


def utf8_values(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa
    binary = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) \
        else column.cast(pa.large_binary())
    return [v or b"" for v in binary.to_pylist()]
