r"""Phrase collocations by multikey quicksort of suffix pointers.

Texts are cut into pieces (at marks and line ends) and pieces into words; every word's suffix
is itself and the words after it in its piece, up to ``max_words``.  A word goes by a 64-bit
name of (lang, word).  Suffixes are routed by their leading words to buckets of bounded
size; in a bucket, three-way multikey quicksort orders suffix pointers word by word.  A
partition of equal leading words is a phrase and its size the phrase's count, so partitions
below ``min_count`` are abandoned at once, with all that they would be divided into.

Before routing, counts of single words leave out what cannot be in any phrase, and equal suffixes of a block
are one weighted pointer.  Suffixes that begin with **hot** words (each at least 1/4,096 of all
words, so at most 4,096 of them) are routed by one word more, as often as their words go on
being hot; the counts of the few phrases that this divides are added up afterwards.

Defined cases: a null text is empty and has no words, a null lang is ``und``; a text of any
length is cut between its pieces; repeated rows count as often as they come; equal scores
and counts are settled by the phrase's UTF-8 bytes; no rows give no phrases.  Should two
words share a name, which is checked, all is done again with other names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, membership, ship_package, stored
from .words import WordClass, blocks, mix, utf8_values

SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
WORDS = WordClass(b"\x20\x09" + SEPARATORS, fold_case=True)
IS_CUT = np.zeros(256, bool)
IS_CUT[list(SEPARATORS)] = True
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLOCK_BYTES = 1 << 21
HOT_SHARE = 4096
SALTS = 64


def multikey_quicksort(names: np.ndarray, weight: np.ndarray, least: list[int]
                       ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, pointers, counts) of the equal partitions of suffixes ``names`` (rows; 0: end).

    All open partitions are divided by their own pivots at the same time: less, equal and
    greater in the word at the partition's depth.  The equal part of depth d is a phrase of
    d + 1 words, of which one pointer is given, and goes on one word deeper.  A part whose
    weight is below ``least[d]`` is abandoned.
    """
    depth_end = names.shape[1]
    item = np.arange(len(names))
    start = np.zeros(1, np.int64)
    depth = np.zeros(1, np.int64)
    while len(item):
        size = np.diff(np.append(start, len(item)))
        part = np.repeat(np.arange(len(start)), size)
        key = names[item, depth[part]]
        three = np.sort(np.stack([key[start], key[start + size // 2], key[start + size - 1]]), axis=0)
        pivot = three[1][part]
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        to = 3 * part + side
        count = np.bincount(to, minlength=3 * len(start))
        heavy = np.bincount(to, weights=weight[item], minlength=3 * len(start)).astype(np.int64)
        # a stable move: where the part begins, and how many before this one go to it
        begin = np.cumsum(count) - count
        place = np.empty(len(item), np.int64)
        for s in range(3):
            mine = side == s
            before = np.cumsum(mine)
            base = before[start] - mine[start]
            place[mine] = (begin[to] + before - 1 - base[part])[mine]
        moved = np.empty_like(item)
        moved[place] = item
        level = np.repeat(depth, 3)
        equal = np.tile([False, True, False], len(start))
        go = (count > 0) & (heavy >= np.array(least)[level])
        first = moved[np.minimum(begin, len(item) - 1)]
        go &= ~(equal & (names[first, level] == 0))
        for d in range(depth_end):
            phrase = go & equal & (level == d)
            if phrase.any():
                yield d + 1, first[phrase], heavy[phrase]
        level = level + equal
        go &= level < depth_end
        item = moved[np.repeat(go, count)]
        start = (np.cumsum(count * go) - count * go)[go]
        depth = level[go]


def merged(names: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes as one, with the sum of their weights."""
    order = np.lexsort(names.T[::-1])
    names, weight = names[order], weight[order]
    if not len(names):
        return names, weight
    first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1))))
    return names[first], np.add.reduceat(weight, first)


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about a block's size, cut where pieces end."""
    at = 0
    while len(text) - at > BLOCK_BYTES:
        end = max(text.rfind(s, at, at + BLOCK_BYTES) for s in map(bytes, zip(SEPARATORS)))
        if end <= at:
            ends = [p for s in map(bytes, zip(SEPARATORS)) if (p := text.find(s, at + 1)) > 0]
            end = min(ends, default=len(text))
        yield text[at:end]
        at = end
    yield text[at:]


def named_blocks(batch: pa.RecordBatch, seed: int):
    """(block, names of its words, lang of each word as a number, langs) of a (lang, text) batch."""
    langs: dict[str, int] = {}
    texts, own = [], []
    for lang, text in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1))):
        for part in _cut(text):
            texts.append(part)
            own.append(langs.setdefault(lang, len(langs)))
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=bytes([seed])
                                                    ).digest(), "little") for x in langs], np.uint64)
    own = np.array(own)
    for a, b, block in blocks(texts, WORDS, BLOCK_BYTES):
        if len(block.hashes):
            lang = np.repeat(own[a:b], block.counts())
            names = mix(block.hashes ^ salt[lang])
            names[names == 0] = 1
            yield block, names, lang, list(langs)


def count_words(rows: DataFrame, seed: int) -> DataFrame:
    """name, lang, word and f of every distinct word."""
    def run(batch):
        out = []
        for block, names, lang, langs in named_blocks(batch, seed):
            found, at, n = np.unique(names, return_index=True, return_counts=True)
            text = block.joined.translate(_LOWER)
            words = [text[a:b] for a, b in zip(block.starts[at].tolist(), block.ends[at].tolist())]
            out.append(pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array([langs[i] for i in lang[at]], pa.string()),
                 pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)],
                names=["name", "lang", "word", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    parts = map_batches(rows, run, "name long, lang string, word string, n long")
    return stored(parts.groupBy("name", "lang", "word").agg(F.sum("n").alias("f")), "words")


def vocabulary(rows: DataFrame) -> tuple[DataFrame, int]:
    """Counts of all words under names that no two of them share, and the names' seed."""
    for seed in range(8):
        words = count_words(rows, seed)
        if words.groupBy("name").count().where("count > 1").isEmpty():
            return words, seed
    raise ArithmeticError("no names without collisions found")


def _suffixes(block, names: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of two words or more, up to the piece's end or the first word not known."""
    piece = np.cumsum(IS_CUT[block.data])[block.starts]
    out = np.zeros((len(names), depth), np.uint64)
    go = known.copy()
    out[go, 0] = names[go]
    for j in range(1, depth):
        on = np.zeros(len(names), bool)
        on[:-j] = known[j:] & (piece[j:] == piece[:-j])
        go &= on
        out[:-j, j] = np.where(go[:-j], names[j:], 0)
    return out[out[:, 1] != 0] if depth > 1 else out[:0]


def _lead(names: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """By how many leading words a suffix is routed: two, and one more for each hot word that
    follows two hot ones; never more than there are."""
    lead = np.full(len(names), 2)
    go = np.ones(len(names), bool)
    for j in range(names.shape[1] - 1):
        go &= np.isin(names[:, j], hot)
        if j:
            lead[go] = j + 2
    return lead


def count_phrases(rows: DataFrame, words: DataFrame, seed: int, max_words: int, min_count: int,
                  bucket_words: int) -> tuple[DataFrame, list[int]]:
    """names (array) and f of every phrase of 2 to ``max_words`` words found ``min_count``
    times or more, and the names of hot words."""
    ship_package(rows.sparkSession)
    total = words.agg(F.sum("f")).first()[0] or 0
    frequent = words.where(F.col("f") >= min_count)
    is_known = membership(frequent, "name")            # fixed size, no false negatives
    share = -(-total // HOT_SHARE)
    hot_names = [r["name"] for r in frequent.where(F.col("f") >= share).select("name").collect()]
    hot = np.array(hot_names, np.int64).view(np.uint64)
    buckets = max(1, -(-total // bucket_words))
    tasks = min(buckets, 20_000)

    def route(batches):
        for batch in batches:
            for block, names, _, _ in named_blocks(batch, seed) if batch.num_rows else ():
                found = _suffixes(block, names, is_known(names), max_words)
                found, n = merged(found, np.ones(len(found), np.int64))
                if not len(found):
                    continue
                lead = _lead(found, hot)
                h = np.zeros(len(found), np.uint64)
                for j in range(max_words):
                    h = np.where(j < lead, mix(h + found[:, j]), h)
                to = (h % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                at, edge = np.unique(to[order], return_index=True)
                pieces = np.split(order, edge[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array([found[p].T.tobytes() for p in pieces], pa.binary()),
                     pa.array([n[p].astype("<u4").tobytes() for p in pieces], pa.binary())],
                    names=["bucket", "names", "weights"])

    def sort(batches):
        open_bucket, names, weights = None, [], []

        def done():
            found, n = np.concatenate(names), np.concatenate(weights)
            lead = _lead(found, hot)
            for words_routed in np.unique(lead).tolist():
                mine = lead == words_routed
                # phrases shorter than the routing words are divided over buckets
                least = [min_count] * max_words if words_routed == 2 else [
                    1 if d < words_routed - 1 else min_count for d in range(max_words)]
                own, weight = found[mine], n[mine]
                for length, at, count in multikey_quicksort(own, weight, least):
                    if length > 1:
                        flat = own[at, :length].reshape(-1).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.ListArray.from_arrays(
                                pa.array(np.arange(0, len(flat) + 1, length, dtype=np.int32)),
                                pa.array(flat)), pa.array(count)], names=["names", "n"])

        for batch in batches:
            for bucket, own, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != open_bucket and names:
                    yield from done()
                    names, weights = [], []
                open_bucket = bucket
                names.append(np.frombuffer(own, np.uint64).reshape(max_words, -1).T)
                weights.append(np.frombuffer(n, "<u4").astype(np.int64))
                if sum(map(len, weights[1:])) > 2 * max(bucket_words, len(weights[0])):
                    both = merged(np.concatenate(names), np.concatenate(weights))
                    names, weights = [both[0]], [both[1]]
        if names:
            yield from done()

    routed = rows.mapInArrow(route, "bucket long, names binary, weights binary")
    dealt = routed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")
                                   ).sortWithinPartitions("bucket")
    parts = dealt.mapInArrow(sort, "names array<long>, n long")
    phrases = parts.groupBy("names").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    return stored(phrases, "phrases"), hot_names


def _look_up(df: DataFrame, key: str, counts: DataFrame, hot: list[int], by: str) -> DataFrame:
    """Join of ``df`` to the counts of the phrase in ``key``.  Many rows may ask for a phrase of hot
    words only, so its count is there ``SALTS`` times and the rows are spread by ``by``."""
    def all_hot(names: Column) -> Column:
        return F.forall(names, lambda x: x.isin(hot)) if hot else F.lit(False)

    salt = F.when(all_hot(F.col(key)), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0))
    salts = F.when(all_hot(F.col("names")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0)))
    table = counts.withColumn("salt", F.explode(salts)).withColumnRenamed("names", key)
    return df.withColumn("salt", salt.cast("int")).join(table, [key, "salt"]).drop("salt")


def score_phrases(phrases: DataFrame, words: DataFrame, hot: list[int]) -> DataFrame:
    """names, lang, a, l, r and score of every phrase, at its lowest-scoring cut."""
    single = words.select(F.array("name").alias("names"), "f", "lang")
    counts = single.unionByName(phrases.withColumn("lang", F.lit(None).cast("string")))
    cuts = phrases.select("names", F.col("f").alias("a"), F.explode(
        F.sequence(F.lit(1), F.size("names") - 1)).alias("k")).select(
        "names", "a", "k", F.slice("names", F.lit(1), F.col("k")).alias("left"),
        F.slice("names", F.col("k") + 1, F.size("names")).alias("right"))
    both = _look_up(cuts, "left", counts.withColumnRenamed("f", "l"), hot, "right")
    both = _look_up(both, "right", counts.drop("lang").withColumnRenamed("f", "r"), hot, "left")
    a, l, r = (F.col(c).cast("decimal(15,0)") for c in "alr")
    both = both.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * a * a).withColumn(
        "under", l * r).withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return both.groupBy("names", "a").agg(best.alias("cut"), F.max("lang").alias("lang")).select(
        "names", "lang", "a", "cut.l", "cut.r", "cut.score")


def without_parts(scored: DataFrame, share: int) -> DataFrame:
    """Phrases that no longer one holds contiguously with ``100 * count >= share * a``."""
    size = F.size("names")
    inside = scored.where(size > 2).select("a", "names", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1),
            lambda at: F.slice("names", at, n))))).alias("part"))
    most = inside.groupBy(F.col("part").alias("names")).agg(F.max("a").alias("longer"))
    return scored.join(most, "names", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def mine(docs: DataFrame, max_words: int = 3, min_count: int = 10, top: int = 2000,
         part_share: int = 50, bucket_words: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's ``top`` phrases."""
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more and are found at least once")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    words, seed = vocabulary(rows)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases, hot = count_phrases(rows, words, seed, max_words, min_count, bucket_words)
    frequent = words.where(F.col("f") >= min_count)
    kept = stored(without_parts(score_phrases(phrases, frequent, hot), part_share), "scored-phrases")
    # the words are looked up for phrases that can be among the first, ties included
    order = [F.desc("score"), F.desc("a")]
    first = kept.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("at") <= top).drop("at")
    spelled = first.select("names", F.posexplode("names").alias("place", "name")).join(
        frequent.select("name", "word"), "name").groupBy("names").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w.word), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return first.join(spelled, "names").withColumn("rank", rank.cast("long")).where(
        F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
