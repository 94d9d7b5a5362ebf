"""N-gram Jaccard self-join with PartEnum signatures.

Shingle hashes are the feature domain.  Sets whose sizes allow a similarity of 3/4 lie
in one size band (powers of two; a set at the upper edge also joins the next band).  A
band cuts the domain into partitions, two sets that differ in few features agree on
whole partitions, and each signature is the hash of a set's features in one of them:

* below 64 shingles every feature is a partition of its own, so sets that are similar
  share at least ``n - n // 3`` signatures: exact;
* above, a band of sizes ``2**q`` has ``2**q`` partitions, of which the first ``parts``
  are enumerated, single ones only.  A pair at a similarity of exactly 3/4 shares
  ``LEAST_SHARED`` or more of them but for a probability below 5e-7 (most where the sizes
  are 3/4 of ``2**q`` and ``2**q``), a more similar one far more surely.

A set that shares fewer signatures with others than any partner must share drops out.  A
signature of more than ``hot`` sets, such as a license line's, is left out for sets that
must share a rarer one with any partner.  The least set of a signature leads it; sets with
a common leader form a cluster, so two similar sets always meet in one.  Inside a cluster
all pairs are compared exactly by one matrix product per pair of blocks; a block holds a
bounded number of sets and features, so no task holds an unbounded group, and only
spanning links leave a task.

Sets go by a 64-bit name: two of n different sets share one with odds of n*n / 2**65.

Defined cases: null or wordless texts have no set, no links and their own id as
component; equal sets are one set, named by the least doc_id; a null doc_id takes part but
never names a component (null where a component has no other id); repeated rows are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, membership, same, ship_package, stored
from .components import components
from .words import BLANK_FOLDED, blocks, mix, utf8_values

SHINGLE = 5
EXACT_BELOW_BITS = 6
PARTS = 48
LEAST_SHARED = 5
HOT = 64
BLOCK_SETS = 1024
BLOCK_FEATURES = 1 << 19
COLUMNS = 1 << 10
DENSE_FROM = 24


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    out = []
    for lo, hi, block in blocks(texts, BLANK_FOLDED):
        h, at = block.windows(SHINGLE)
        cut = np.searchsorted(at, block.first)
        for i in range(hi - lo):
            words = int(block.first[i + 1] - block.first[i])
            if 0 < words < SHINGLE:
                one = np.array([words], np.uint64)
                for w in block.hashes[block.first[i]:block.first[i + 1]]:
                    one = mix(one * np.uint64(31) + w)
                out.append(one)
                continue
            own = np.sort(h[cut[i]:cut[i + 1]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def signatures(features: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """Signatures of a set for its own size band, and for the next one where it reaches there."""
    n = len(features)
    if n < 3:                       # similar means equal
        return [np.empty(0, np.uint64)] * 2
    band = n.bit_length() - 1
    out = []
    for q in (band, band + 1):
        if q > band and 4 * n < 3 * (1 << q):
            out.append(np.empty(0, np.uint64))
        elif q < EXACT_BELOW_BITS:
            out.append(mix(features + np.uint64(q)))
        else:
            shift = np.uint64(64 - q)
            few = features[:np.searchsorted(features, np.uint64(parts) << shift)] \
                if parts < (1 << q) else features
            part = few >> shift
            if not len(few):
                out.append(np.empty(0, np.uint64))
                continue
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            sums = np.add.reduceat(mix(few), first)
            out.append(mix(sums ^ mix(part[first] * np.uint64(64) + np.uint64(q))))
    return out


def _set_name(features: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    pair = np.array([mix(features).sum(dtype=np.uint64), mix(features ^ mix(features)).sum(
        dtype=np.uint64)], np.uint64)
    hi, lo = mix(pair + np.uint64(len(features))).view(np.int64).tolist()
    return hi, lo


def describe(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """doc_id, digest (of the text), node and low (the set's name), n_shingles, and the
    signatures of both bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        sets = shingle_sets(utf8_values(batch.column(2)))
        names = [_set_name(s) if len(s) else (None, None) for s in sets]
        both = [signatures(s, parts) for s in sets]
        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a for a, _ in names], pa.int64()),
             pa.array([b for _, b in names], pa.int64()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([b[0].view(np.int64) for b in both], longs),
             pa.array([b[1].view(np.int64) for b in both], longs)],
            names=["doc_id", "digest", "node", "low", "n_shingles", "own", "next"])

    return map_batches(
        docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), run,
        f"doc_id {kind}, digest long, node long, low long, n_shingles long, own array<long>, "
        "next array<long>")


def clusters(sets: DataFrame, hot: int = HOT) -> DataFrame:
    """(leader, node): every set under the leaders of its signatures."""
    signed = sets.select("node", "n_shingles", F.explode(F.array(
        F.struct(F.lit(0).alias("band"), F.col("own").alias("sigs")),
        F.struct(F.lit(1).alias("band"), F.col("next").alias("sigs")))).alias("s")).select(
        "node", "n_shingles", "s.band", F.size("s.sigs").alias("n_sigs"),
        F.explode("s.sigs").alias("sig"))
    groups = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")) \
        .where("size > 1")
    # signatures that any similar partner must share, at least
    exact = F.col("n_shingles") < F.lit(1 << EXACT_BELOW_BITS) / (F.col("band") + 1)
    sure = F.when(exact, F.col("n_sigs") - F.floor(F.col("n_shingles") / 3)).otherwise(
        F.when(F.col("n_sigs") >= PARTS // 2, LEAST_SHARED).otherwise(1))
    members = stored(signed.join(groups, "sig").select(
        "node", "band", sure.alias("sure"), (F.col("size") > hot).alias("hot"), "leader"),
        "signature-members")
    tally = members.groupBy("node", "band", "sure").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("hot").alias("n_hot")).where(
        F.col("n") >= F.col("sure")).select(
        "node", "band", (F.col("n_hot") >= F.col("sure")).alias("bound"))
    return members.join(tally, ["node", "band"]).where(~F.col("hot") | F.col("bound")).select(
        "leader", "node").distinct()


def _rare_pairs(owner: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """How many of the given features (each of fewer than ``DENSE_FROM`` sets) two sets share."""
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros(n * n, np.int32)
    for step in range(1, DENSE_FROM):
        pair = np.flatnonzero(column[step:] == column[:-step])
        if not len(pair):
            break
        total += np.bincount(owner[pair] * n + owner[pair + step], minlength=n * n).astype(np.int32)
    total = total.reshape(n, n)
    return total + total.T


def _links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None,
           percent: int) -> list[tuple[int, int]]:
    """Every set that similar pairs lead to, linked with the first of them: of the pairs
    within ``left``, or between ``left`` and ``right``."""
    rows = left + (right or [])
    names = [a for a, _ in rows]
    sizes = np.array([len(s) for _, s in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    features, place, n = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True,
                                   return_counts=True)
    column = np.cumsum(n > 1) - 1
    shared = n[place] > 1
    owner, column = owner[shared], column[place[shared]]
    often = n[place[shared]]
    cut = len(left) if right is not None else len(rows)
    first, second = slice(0, cut), slice(cut if right is not None else 0, len(rows))
    common = _rare_pairs(owner[often < DENSE_FROM], column[often < DENSE_FROM], len(rows))
    common = common[first, second].astype(np.float32)
    dense, column = np.unique(column[often >= DENSE_FROM], return_inverse=True)
    owner = owner[often >= DENSE_FROM]
    for lo in range(0, len(dense), COLUMNS):
        table = np.zeros((len(rows), min(COLUMNS, len(dense) - lo)), np.float32)
        here = (column >= lo) & (column < lo + COLUMNS)
        table[owner[here], column[here] - lo] = 1
        common += table[first] @ table[second].T
    near = np.zeros((len(rows), len(rows)), bool)
    for lo in range(first.start, first.stop, 256):
        both = common[lo:lo + 256].astype(np.int64)
        union = sizes[lo:min(lo + 256, first.stop), None] + sizes[second][None, :] - both
        near[lo:lo + len(both), second] = 100 * both >= percent * union
    near |= near.T
    out = []
    seen = np.zeros(len(rows), bool)
    for start in range(len(rows)):
        if seen[start]:
            continue
        seen[start] = True
        edge = np.array([start])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & ~seen)
            seen[edge] = True
            out += [(names[start], names[x]) for x in edge.tolist()]
    return out


def verified_links(docs: DataFrame, sets: DataFrame, grouped: DataFrame, percent: int = 75,
                   filter_bits: int = 1 << 23) -> DataFrame:
    """Spanning links (a, b) of the pairs inside each cluster that are similar."""
    ship_package(docs.sparkSession)
    size = grouped.join(sets.select("node", "n_shingles"), "node").groupBy("leader").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n_shingles").alias("features")).where("sets > 1")
    size = size.select("leader", F.greatest(
        F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("features") / BLOCK_FEATURES)).alias("n"))
    members = stored(grouped.join(size, "leader").join(sets.select("node", "digest"), "node"),
                     "cluster-members")
    wanted = membership(members.select("digest").distinct(), "digest", filter_bits)

    def features(batch):
        digests = batch.column(0).to_numpy().view(np.uint64)
        rows = np.flatnonzero(wanted(digests))
        if not len(rows):
            return None
        found = [s for s in shingle_sets(utf8_values(batch.column(1).take(pa.array(rows)))) if len(s)]
        return pa.RecordBatch.from_arrays(
            [pa.array([_set_name(s)[0] for s in found], pa.int64()),
             pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "features"])

    content = map_batches(docs.where(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("digest"), "text"), features, "node long, features binary")
    block = F.pmod(F.xxhash64("node"), F.col("n"))
    dealt = members.select("leader", "node", "n", block.alias("block")).join(
        content.dropDuplicates(["node"]), "node").withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "leader", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
        "block", "node", "features")
    dealt = dealt.repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y")

    def compare(batches):
        key, left, right = None, [], []

        def close():
            if key is None:
                return
            links = _links(left, None if key[1] == key[2] else right, percent) \
                if len(left) + len(right) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in links], pa.int64()),
                     pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for c, x, y, own, node, data in zip(*columns):
                if (c, x, y) != key:
                    yield from close()
                    key, left, right = (c, x, y), [], []
                (left if own == x else right).append((node, np.frombuffer(data, np.uint64)))
        yield from close()

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, parts: int = PARTS,
                    hot: int = HOT) -> DataFrame:
    """doc_id, digest, n_shingles and component_id for every row of ``docs``.

    ``percent``: the least similarity, of 75 or more.
    """
    if percent < 75:
        raise ValueError("size bands hold from a similarity of 75 percent")
    rows = stored(describe(docs, parts), "shingle-signatures")
    sets = stored(rows.where("n_shingles > 0").groupBy("node", "low").agg(
        F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"),
        F.first("n_shingles").alias("n_shingles"), F.first("own").alias("own"),
        F.first("next").alias("next")), "shingle-sets")
    grouped = stored(clusters(sets, hot), "clusters")
    found = components(verified_links(docs, sets, grouped, percent))
    label = sets.select("node", "low", "doc_id").join(found, "node", "left").withColumn(
        "label", F.coalesce("component", "node"))
    named = label.join(label.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label") \
        .select("node", "low", "component_id")
    return rows.select("doc_id", "digest", "node", "low", "n_shingles").join(
        named, ["node", "low"], "left").select(
        "doc_id", "digest", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(
            F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, of which each component keeps the least doc_id.

    Rows without words stay.  Rows that share the kept doc_id and its text stay together.
    """
    gone = near_duplicates(docs, **params).where(
        (F.col("n_shingles") > 0) & ~same(F.col("doc_id"), F.col("component_id"))).select(
        F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct()
    return docs.join(gone, same(docs["doc_id"], F.col("_gone_id"))
                     & (F.xxhash64(docs["text"]) == F.col("_gone_digest")), "left_anti")
