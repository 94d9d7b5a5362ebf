"""Best-fit packing of token ids into sequences of a fixed capacity.

Texts are encoded, an end id is appended, and what is longer than the capacity is cut into
pieces.  Pieces of one length can stand for each other, so best-fit decreasing runs over the
**lengths**: at most ``capacity`` of them, however many documents there are.  Bins of equal
content are one run; a segment tree over remaining capacities finds the tightest open bin in
logarithmic time.  A run takes as many equal pieces as fit before the next one is looked at,
which is what best fit does with them one by one: a bin that was the tightest and still
has room is again the tightest.  Each piece then finds its place by its rank among all pieces
of its length, which is a local rank plus the counts of the tasks before.

Defined cases: a null or empty text has the end id alone; a null doc_id is an id like any other;
repeated rows are packed as often as they come; a text of any length is cut as it is encoded;
no rows give no sequences.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, ship_file, ship_package, shipped, stored
from .word_ids import ranges, word_ids
from .words import utf8_values

SLICE_BYTES = 1 << 24


class RoomTree:
    """Segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, room: int, value: bool) -> None:
        i = room + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            value = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == value:
                break
            self.any[i] = value

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` that an open bin has."""
        i = size + self.leaves
        if self.any[i]:
            return size
        while i > 1:                      # up until a right sibling holds something
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        if i <= 1:
            return None
        while i < self.leaves:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


class Plan:
    """Where pieces go, by length and rank; ``sequences`` is the number of bins."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.tree = RoomTree(capacity)
        self.open: dict[int, list[tuple[int, int]]] = {}     # room -> runs (first bin, bins)
        self.capacity, self.sequences, self.rows = capacity, 0, []
        for size in sorted(counts, reverse=True):
            if not 0 < size <= capacity:
                raise ValueError(f"a piece of {size} does not fit into {capacity}")
            self._place(size, counts[size])
        columns = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        self.size, self.rank, self.first, self.each, self.used = columns.T
        self.at = np.searchsorted(self.size, np.arange(capacity + 2))
        del self.tree, self.open, self.rows

    def _add(self, room: int, first: int, bins: int) -> None:
        if bins and room:
            self.open.setdefault(room, []).append((first, bins))
            self.tree.set(room, True)

    def _take(self, room: int) -> tuple[int, int]:
        runs = self.open[room]
        run = runs.pop()
        if not runs:
            self.tree.set(room, False)
        return run

    def _place(self, size: int, left: int) -> None:
        rank = 0
        while left:
            room = self.tree.tightest(size)
            if room is None:
                room, first = self.capacity, self.sequences
                bins = -(-left // (room // size))
                self.sequences += bins
            else:
                first, bins = self._take(room)
            each = room // size
            full = min(bins, left // each)
            self.rows.append((size, rank, first, each, self.capacity - room))
            taken = full * each
            self._add(room - each * size, first, full)
            if full < bins and taken < left:       # the last bin gets fewer than fit
                self._add(room - (left - taken) * size, first + full, 1)
                taken, full = left, full + 1
            self._add(room, first + full, bins - full)
            rank, left = rank + taken, left - taken

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces; a binary search among the rows of their length."""
        low, high = self.at[size], self.at[size + 1]
        while True:
            middle = (low + high) // 2
            go = high - low > 1
            if not go.any():
                break
            right = self.rank[middle] <= rank
            low = np.where(go & right, middle, low)
            high = np.where(go & ~right, middle, high)
        ahead = rank - self.rank[low]
        return (self.first[low] + ahead // self.each[low],
                self.used[low] + ahead % self.each[low] * size)


def local_ranks(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Rank of each entry among equal ones, after ``seen`` (counts by size, brought up to date)."""
    order = np.argsort(sizes, kind="stable")
    ranked = sizes[order]
    first = np.searchsorted(ranked, ranked)
    rank = np.empty(len(sizes), np.int64)
    rank[order] = seen[ranked] + np.arange(len(sizes)) - first
    np.add.at(seen, sizes, 1)
    return rank


def write_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids (raw little-endian), ids_crc32, part and rank."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = ship_file(spark, tokenizer_file)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        encode, seen = word_ids(shipped(vocabulary)), np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            found, ends = encode.encode(utf8_values(batch.column(1)))
            sizes = np.diff(ends) + 1
            whole = np.full(int(sizes.sum()), end_id, encode.kind)
            begin = np.cumsum(sizes) - sizes
            whole[ranges(begin, sizes - 1)] = found
            pieces = -(-sizes // capacity)
            document = np.repeat(np.arange(len(sizes)), pieces)
            number = ranges(np.zeros(len(sizes), np.int64), pieces)
            start = number * capacity
            length = np.minimum(capacity, sizes[document] - start)
            at = begin[document] + start
            rank = local_ranks(length, seen)
            wide = whole.astype("<u4")
            sums = np.array([zlib.crc32(wide[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())],
                            np.int64)
            step = max(1, SLICE_BYTES // (capacity * whole.itemsize))
            for a in range(0, len(at), step):
                own = slice(a, a + step)
                offsets = np.concatenate(([0], np.cumsum(length[own]))) * whole.itemsize
                data = whole[at[a]:at[a] + int(length[own].sum())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(document[own])), pa.array(number[own].astype(np.int32)),
                     pa.array(start[own]), pa.array(length[own]),
                     pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
                         None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())]),
                     pa.array(sums[own]), pa.array(np.full(len(offsets) - 1, part, np.int32)),
                     pa.array(rank[own])],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "part", "rank"])

    return stored(docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary, ids_crc32 long, "
             "part int, rank long"), "pieces")


@dataclass
class Packed:
    """Pieces with their ids as they were written, and a narrow row per piece of its place:
    doc_id, piece, start, length, ids_crc32, part, rank (which name the piece), sequence_id
    and offset.  ``n_sequences`` sequences are numbered from 0 without gaps."""

    pieces: DataFrame
    places: DataFrame
    n_sequences: int

    def sequences(self) -> DataFrame:
        """sequence_id, length, ids (raw) and documents (offset, doc_id, piece) in order."""
        name = ["part", "length", "rank"]
        whole = self.places.join(self.pieces.select(*name, "ids"), name)
        inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
        return whole.groupBy("sequence_id").agg(
            F.sum("length").alias("length"), inside.alias("inside")).select(
            "sequence_id", "length",
            F.aggregate("inside", F.lit(b""), lambda ids, p: F.concat(ids, p.ids)).alias("ids"),
            F.transform("inside", lambda p: F.struct(p.offset, p.doc_id, p.piece)).alias("documents"))


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 2048) -> Packed:
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    pieces = write_pieces(docs, tokenizer_file, end_id, capacity)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n"))          # one row a length
    plan = Plan({r["length"]: r["n"] for r in totals.collect()}, capacity)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in fields)
    ranked = pieces.join(bases, ["part", "length"]).select(
        *fields, (F.col("rank") + F.col("base")).alias("among"))

    def place(batch):
        sequence, offset = plan.find(*(batch.column(c).to_numpy() for c in ("length", "among")))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in fields), pa.array(sequence), pa.array(offset)],
            names=[*fields, "sequence_id", "offset"])

    places = map_batches(ranked, place, f"{kinds}, sequence_id long, offset long")
    return Packed(pieces, places, plan.sequences)
