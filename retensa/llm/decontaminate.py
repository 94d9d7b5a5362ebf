"""Benchmark decontamination by a prefix-filtered set join.

Every item becomes windows of ``window`` words (a shorter item is one window).  A window
is a set of short shingles; as an occurrence must hold all of them, one necessary
shingle is enough as the join prefix, and the rarest in the documents is taken.
Documents emit only the places of prefix shingles (found by a bit table of fixed
size), with the words around.  Length and position bounds drop places where the window
would not fit, and the words themselves are compared last, so matches are exact.

Defined cases: null or empty texts have no words; items without words have no windows;
a null ``item_id`` marks words but is not listed; repeated rows are judged alike and kept
apart; empty tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, membership, same, stored
from .words import ALNUM_FOLDED, Block, blocks, utf8_values

WINDOW = 13
SHINGLE = 3


def _words(block: Block, lo: int, hi: int) -> str:
    """Words lo..hi of a block, lower-cased, with a blank between."""
    folded = block.joined
    return b" ".join([folded[block.starts[i]:block.ends[i]] for i in range(lo, hi)]).lower().decode()


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """Distinct (item_id, words, size, shingles): the windows of every item.

    ``shingles`` are the hashes of the window's runs of ``shingle`` words, in order; a
    window of fewer words has one, of its own size.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def cut(batch):
        ids, items, texts = batch.column(0), [], utf8_values(batch.column(1))
        words, sizes, hashes = [], [], []
        for lo, hi, block in blocks(texts, ALNUM_FOLDED):
            runs: dict[int, np.ndarray] = {}
            for i in range(hi - lo):
                first, last = int(block.first[i]), int(block.first[i + 1])
                size = min(window, last - first)
                if not size:
                    continue
                k = min(shingle, size)
                if k not in runs:
                    h, at = block.windows(k)
                    runs[k] = np.zeros(len(block.hashes), np.int64)
                    runs[k][at] = h.view(np.int64)
                for begin in range(first, last - size + 1):
                    items.append(lo + i)
                    words.append(_words(block, begin, begin + size))
                    sizes.append(size)
                    hashes.append(runs[k][begin:begin + size - k + 1])
        if not items:
            return None
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(items)), pa.array(words), pa.array(sizes, pa.int32()),
             pa.array(hashes, pa.list_(pa.int64()))],
            names=["item_id", "words", "size", "shingles"])

    return map_batches(benchmark.select("item_id", "text"), cut,
                       f"item_id {kind}, words string, size int, shingles array<long>").distinct()


def shingle_counts(docs: DataFrame, sizes: list[int], wanted) -> DataFrame:
    """How often the shingles that pass ``wanted`` stand in the documents: (shingle, n)."""
    def count(batch):
        found = []
        for _, _, block in blocks(utf8_values(batch.column(0)), ALNUM_FOLDED):
            for k in sizes:
                h, _ = block.windows(k)
                found.append(h[wanted(h)])
        shingle, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n)],
                                          names=["shingle", "n"])

    return map_batches(docs.select("text"), count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n"))


def _places(docs: DataFrame, sizes: list[int], window: int, wanted) -> DataFrame:
    """Per document: n_words and the places of wanted shingles with the words around."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("left", pa.int32()),
                       ("around", pa.string())])

    def find(batch):
        n_words, places = [], [[] for _ in range(batch.num_rows)]
        for lo, hi, block in blocks(utf8_values(batch.column(2)), ALNUM_FOLDED):
            n_words.extend(block.counts().tolist())
            for k in sizes:
                h, at = block.windows(k)
                hit = np.flatnonzero(wanted(h))
                text = np.searchsorted(block.first, at[hit], side="right") - 1
                for j, i in zip(hit.tolist(), text.tolist()):
                    word, first, last = int(at[j]), int(block.first[i]), int(block.first[i + 1])
                    begin = max(first, word - window + 1)
                    around = _words(block, begin, min(last, word + window))
                    places[lo + i].append({"shingle": int(h[j].view(np.int64)), "at": word - first,
                                           "left": word - begin, "around": around})
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
             pa.array(places, pa.list_(place))], names=["doc_id", "digest", "n_words", "places"])

    return map_batches(
        docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), find,
        f"doc_id {kind}, digest long, n_words long, "
        "places array<struct<shingle: long, at: long, left: int, around: string>>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       shingle: int = SHINGLE, filter_bits: int = 1 << 23) -> DataFrame:
    """doc_id, digest, n_words, n_hit, n_items, items (sorted as strings), spans (word ranges)
    and contaminated for every row of ``docs``."""
    windows = stored(item_windows(benchmark, window, shingle), "item-windows")
    # at most ``shingle`` values
    sizes = sorted(r[0] for r in windows.select(
        F.least("size", F.lit(shingle)).alias("k")).distinct().collect())
    distinct = windows.select("words", "size", "shingles").distinct()
    each = distinct.select("words", "size", F.posexplode("shingles").alias("offset", "shingle"))
    if sizes:
        counts = shingle_counts(docs, sizes, membership(each, "shingle", filter_bits))
    else:
        counts = docs.sparkSession.createDataFrame([], "shingle long, n long")
    # a shingle that no document holds rules its windows out; the rarest is the prefix
    rarest = each.join(counts, "shingle", "left").groupBy("words", "size").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("least"))
    prefix = stored(rarest.where("least.n > 0").select(
        "words", "size", "least.shingle", "least.offset"), "prefix-shingles")
    rows = stored(_places(docs, sizes, window, membership(prefix, "shingle", filter_bits))
                  .withColumn("row", F.monotonically_increasing_id()), "prefix-places")

    at = rows.select("row", "n_words", F.explode("places").alias("p")).select(
        "row", "n_words", "p.shingle", "p.at", "p.left", "p.around")
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    piece = F.array_join(F.slice(F.split("around", " "), F.col("left") - F.col("offset") + 1,
                                 F.col("size")), " ")
    matched = at.join(prefix, "shingle").where(fits).where(piece == F.col("words")).select(
        "row", start.alias("start"), (start + F.col("size")).alias("end"), "words")
    matched = stored(matched, "window-matches")

    spans = matched.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    items = matched.select("row", "words").distinct().join(
        windows.select("words", "item_id").distinct(), "words").groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0).cast("long"), s.end - F.greatest(s.start, a.upto))).alias("n"),
            F.greatest(a.upto, s.end).alias("upto")),
        lambda a: a.n)
    none = F.array().cast("array<string>")
    return (rows.select("row", "doc_id", "digest", "n_words").join(spans, "row", "left")
            .join(items, "row", "left")
            .select("doc_id", "digest", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("items", none).alias("items"), "spans")
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated."""
    bad = find_contamination(docs, benchmark, **params).where("contaminated").select(
        F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    return docs.join(bad, (F.xxhash64(docs["text"]) == F.col("_bad_digest"))
                     & same(docs["doc_id"], F.col("_bad_id")), "left_anti")
