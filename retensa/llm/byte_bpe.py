"""Byte-level BPE: encoding with a segment tree of pair ranks, and decoding.

A piece's byte positions are the leaves of a segment tree; a live leaf holds the rank
of the pair that begins there, and every inner node the least rank below it, so the
root's way down by the leftmost child that holds the least rank finds the next merge.  A
merge removes one position and renews the ranks of at most two live neighbours: a
logarithmic number of nodes each.

Defined cases: a null text is empty; an empty text has no ids; repeated rows are encoded
alike; any row identity is carried, null included.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches
from .words import utf8_values

NO_RANK = 1 << 60


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the leftmost pair of least rank."""
    if piece in ranks:
        return [ranks[piece]]
    rank_of = ranks.get
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    tree = [NO_RANK] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank_of(piece[i:i + 2], NO_RANK)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after = list(range(1, n + 1))        # where the token that begins here ends
    before = list(range(-1, n - 1))      # where the token to the left begins

    while tree[1] != NO_RANK:
        node, least = 1, tree[1]
        while node < size:
            node += node
            if tree[node] != least:
                node += 1
        at = node - size
        gone = after[at]
        end = after[gone]
        after[at] = end
        tree[size + gone] = NO_RANK
        if end < n:
            before[end] = at
            tree[node] = rank_of(piece[at:after[end]], NO_RANK)
        else:
            tree[node] = NO_RANK
        left = before[at]
        if left >= 0:
            tree[size + left] = rank_of(piece[left:end], NO_RANK)
        for place in (gone, at, left) if left >= 0 else (gone, at):
            node = (size + place) >> 1
            while node:
                low, other = tree[2 * node], tree[2 * node + 1]
                if other < low:
                    low = other
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:after[at]]])
        at = after[at]
    return ids


#: ``\s`` spelled out, as the property means it in every engine
WHITE = r"\t-\r\x20\x85\xa0  -     　"


#: a blank beside white space, or at an end of the text
ODD_BLANK = regex.compile(f"(?:^|[{WHITE}]) | (?:$|[{WHITE}])")

#: marks that are neither letters, digits nor white space, and begin no contraction
MARKS = ".,;:!?#*$%&|<>()"


class Recent(dict):
    """A dictionary of two generations: at ``limit`` entries the older one is let go."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def put(self, key, value):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Codec:
    """Ranks, splitting pattern and bounded caches of encoded pieces and words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int):
        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(
            r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.token = {i: t for t, i in ranks.items()}
        self.digits = {i: str(i) for i in self.token}
        self.pieces, self.words = Recent(cached), Recent(cached)

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.older.get(text)
        if ids is None:
            ids = tuple(merge_piece(text.encode(), self.ranks))
        return self.pieces.put(text, ids) if len(text) <= 64 else ids

    def run(self, text: str) -> tuple[int, ...]:
        """Ids of a text, match by match of the pattern."""
        known, piece = self.pieces.get, self.piece
        return tuple([i for p in self.split.findall(text) for i in known(p) or piece(p)])

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of a blank and the word behind it."""
        ids = self.words.older.get(text)
        if ids is None:
            stem = text.rstrip(MARKS)
            if not stem.isalpha():
                ids = self.run(" " + text)
            else:      # letters, then marks: one match with the blank, one without
                known, piece = self.pieces.get, self.piece
                lead, tail = " " + stem, text[len(stem):]
                ids = known(lead) or piece(lead)
                if tail:
                    ids += known(tail) or piece(tail)
        return self.words.put(text, ids) if len(text) <= 64 else ids

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """Ids of a text in consecutive parts.

        A blank between two characters that are not white space always begins a match:
        a match holds white space only at its front, or nothing else.  So a text whose
        blanks all stand like that is encoded word by word.
        """
        if not text:
            return []
        if ODD_BLANK.search(text):
            return [self.run(text)]
        first, *rest = text.split(" ")
        known, word = self.words.get, self.word
        return [self.run(first)] + [known(w) or word(w) for w in rest]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def forget(self) -> None:
        self.pieces.forget()
        self.words.forget()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@cache
def codec(ranks_file: str, cached: int = 300_000) -> Codec:
    """One codec per worker process."""
    import public_tokenizers

    ranks = {}
    with open(ranks_file, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return Codec(ranks, public_tokenizers.PATTERN, cached)


def encode_documents(docs: DataFrame, ranks_file: str, cached: int = 80_000) -> DataFrame:
    """All columns of ``docs`` but the text, then ids (array) and decoded (binary).

    As one stage among others it keeps few words, and none between tasks.
    """
    place = docs.columns.index("text")
    others = [f for f in docs.schema.fields if f.name not in ("text", "ids", "decoded")]

    def run(batch):
        c = codec(ranks_file, cached)
        ids = [c.encode(v.decode()) for v in utf8_values(batch.column(place))]
        return pa.RecordBatch.from_arrays(
            [batch.column(f.name) for f in others]
            + [pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.binary())],
            names=[f.name for f in others] + ["ids", "decoded"])

    return map_batches(docs, run, T.StructType([
        *others, T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.BinaryType())]), lambda: codec(ranks_file, cached).forget())


def encode_digests(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: ids are encoded, then decoded."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        c = codec(ranks_file)
        n, ids_sha, back_sha = [], [], []
        for value in utf8_values(batch.column(1)):
            ids = c.encode(value.decode())
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(
                ",".join(map(c.digits.__getitem__, ids)).encode()).hexdigest())
            back_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run,
                       f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
