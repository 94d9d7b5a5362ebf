"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group, which one shard takes whole.  Groups of one size can stand for
each other, so best-fit-decreasing runs over the **sizes** and how many groups have each:
the driver holds distinct sizes, not groups (k of them need k * k / 2 bytes of text at least, so
they are at most the square root of twice the input).  Largest first, each group enters the shard of least remaining
capacity that still holds it, found in a balanced search tree over remaining capacities; the
next one of its size enters the same shard as long as it fits, for that is now the tightest.
A group then finds its shard by its rank among the groups of its size.  The capacity is the least,
by bisection, with which the wanted number of shards is enough.  A group above the even
share gets a shard of its own, and the rest is spread over the other shards.

Defined cases: a null text has no bytes and is one group with the empty text; repeated
rows stay together as equal texts; a null doc_id is numbered like any other; without
documents nothing is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CHUNKS = 1024
HOT_SHARE = 4096


class FreeSpace:
    """AVL tree of (remaining capacity, bin): insert, and take the least at or above a size."""

    def __init__(self):
        self.top = None                    # node: [key, left, right, height]

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _settle(self, node):
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) < 2:
            return node
        near, far = (1, 2) if lean > 1 else (2, 1)
        child = node[near]
        if self._height(child[far]) > self._height(child[near]):
            node[near] = self._turn(child, far, near)
        return self._turn(node, near, far)

    def _turn(self, node, up: int, down: int):
        """Lift the child on side ``up`` above ``node``."""
        child = node[up]
        node[up], child[down] = child[down], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def insert(self, key: tuple[int, int]) -> None:
        def put(node):
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._settle(node)
        self.top = put(self.top)

    def _remove(self, node, key):
        if key != node[0]:
            side = 1 if key < node[0] else 2
            node[side] = self._remove(node[side], key)
        elif node[1] and node[2]:
            least = node[2]
            while least[1]:
                least = least[1]
            node[0] = least[0]
            node[2] = self._remove(node[2], least[0])
        else:
            return node[1] or node[2]
        return self._settle(node)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (remaining, bin) that holds ``size``."""
        best, node = None, self.top
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.top = self._remove(self.top, best)
        return best


Run = tuple[int, int, int]              # size, rank of its first group, groups


def best_fit(runs: list[Run], capacity: int, limit: int) -> list[tuple[int, int, int, int]] | None:
    """(size, first rank, groups, bin) for runs sorted from the largest size, opening a bin where
    none holds a group; None above ``limit`` bins or for a size above ``capacity``."""
    free, used, out = FreeSpace(), 0, []
    for size, rank, count in runs:
        while count:
            found = free.take(size)
            if found is None:
                if used == limit or size > capacity:
                    return None
                found = (capacity, used)
                used += 1
            room, at = found
            n = min(count, room // size)
            out.append((size, rank, n, at))
            free.insert((room - n * size, at))
            rank, count = rank + n, count - n
    return out


def pack(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, groups, shard) of groups counted by size, near equal in total."""
    left = [(size, 0, counts[size]) for size in sorted(counts, reverse=True)]
    out, rest, total = [], 0, sum(size * n for size, n in counts.items())
    while left and rest < shards - 1 and left[0][0] * (shards - rest) > total:
        size, rank, n = left[0]            # larger than an even share of what is left
        out.append((size, rank, 1, rest))
        total -= size
        rest += 1
        left[0:1] = [(size, rank + 1, n - 1)] if n > 1 else []
    if not left:
        return out
    bins = shards - rest
    low = high = max(left[0][0], -(-total // bins))
    found = best_fit(left, low, bins)      # many small groups fill the bins evenly at once
    while found is None:
        low, high = high + 1, high + max(1, 2 * (high - low + 1))
        found = best_fit(left, high, bins)
    while low < high:
        middle = (low + high) // 2
        fits = best_fit(left, middle, bins)
        if fits is None:
            low = middle + 1
        else:
            high, found = middle, fits
    return out + [(size, rank, n, rest + b) for size, rank, n, b in found]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _size() -> Column:
    return (F.octet_length(_text()) + 1).cast("long")


def _digest() -> Column:
    return F.unhex(F.md5(_text()))


def _chunk(*columns: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(chunks)).cast("int")


def _numbered(rows: DataFrame, group: str, order: list[str], chunks: int) -> DataFrame:
    """``rows`` (with a column chunk) with a gapless ``number`` from 0 within ``group``: its place
    within (group, chunk), after the rows of the chunks before.  No task sorts a whole group."""
    counts = rows.groupBy(group, "chunk").agg(F.count("*").alias("n"))
    before = counts.select(group, "chunk", F.coalesce(F.sum("n").over(
        Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(group, "chunk").orderBy(*order))
    return rows.withColumn("inside", inside).join(before, [group, "chunk"]).withColumn(
        "number", F.col("before") + F.col("inside") - 1).drop("before", "inside", "chunk")


def _homes(sizes: DataFrame, shards: int, chunks: int) -> tuple[DataFrame, int]:
    """_md5, copies and shard of every group of ``sizes`` (_md5, size of all rows), and the rows."""
    groups = stored(sizes.groupBy("_md5").agg(
        F.sum("size").alias("group_size"), F.count("*").alias("copies")).withColumn(
        "chunk", _chunk("_md5", chunks=chunks)), "sharding-groups")
    counts = groups.groupBy("group_size").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")).collect()
    placed = pack({r["group_size"]: r["n"] for r in counts}, shards)
    runs = sizes.sparkSession.createDataFrame(
        placed, "group_size long, first long, groups long, shard int")
    ranked = _numbered(groups, "group_size", ["_md5"], chunks)
    ahead = F.col("number") - F.col("first")
    homes = ranked.join(runs, "group_size").where((ahead >= 0) & (ahead < F.col("groups"))).select(
        "_md5", "copies", "shard")
    return stored(homes, "sharding-homes"), sum(r["rows"] for r in counts)


def _located(rows: DataFrame, sizes: DataFrame, shards: int, chunks: int) -> DataFrame:
    """``rows`` with the shard of their text.  Texts that are at least 1/4,096 of all rows (so
    at most 4,096 of them) are sent to all tasks; a shuffle would gather each in one."""
    homes, total = _homes(sizes, shards, chunks)
    hot = F.col("copies") >= max(2, -(-total // HOT_SHARE))
    common, rare = (homes.where(c).select("_md5", "shard") for c in (hot, ~hot))
    return rows.join(F.broadcast(common), "_md5").unionByName(
        rows.join(F.broadcast(common.select("_md5")), "_md5", "left_anti").join(rare, "_md5"))


def assign_shards(docs: DataFrame, shards: int = 16, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``."""
    if shards < 1 or chunks < 1:
        raise ValueError("shards and chunks must be positive")
    rows = stored(docs.select("doc_id", _digest().alias("_md5"), _size().alias("size"),
                              F.crc32(_text().cast("binary")).alias("text_crc32")), "sharding-rows")
    located = _located(rows, rows.select("_md5", "size"), shards, chunks).withColumn(
        "chunk", _chunk("doc_id", "size", "text_crc32", chunks=chunks))
    return _numbered(located, "shard", ["doc_id", "_md5"], chunks).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("number").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: int = 16, chunks: int = CHUNKS) -> None:
    """Write ``docs``, all columns, as Parquet with one subfolder ``shard=N`` for each shard."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _digest().alias("_md5"))
    sizes = docs.select(_digest().alias("_md5"), _size().alias("size"))
    _located(rows, sizes, shards, chunks).drop("_md5").write.partitionBy("shard").parquet(folder)
