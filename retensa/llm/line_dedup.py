r"""Substring dedup by line or paragraph hashing.

Texts are cut into lines (at ``\n``), paragraphs (at lines without words) or sentences (at
``\n`` and at the blank or tab after ``.``, ``!`` or ``?``).  Every unit of a word or more is
normalised (A-Z lower-cased, runs of white space as one blank, none at the ends) and hashed.
Of equal units over all documents the one of least (doc_id, place) is the earliest; the
others are repeats.  A **run** of repeats, with nothing between them but units without words,
is taken out when its words are ``min_words`` or more: a repeated passage goes whether it is
one long line or many short ones, and a short line that many documents happen to share
stays.  The original offsets of what was taken out (code points, end exclusive) are kept in
the result.  Lines and paragraphs cannot see a passage inside a line of other words;
sentences see what it holds of whole ones.

Defined cases: a null text is empty and has no units; a null doc_id ranks last; rows that
share a doc_id rank alike, so both keep what neither has from a lesser one; a unit that is
repeated within a text is a repeat from its second place on; ids may be of any type that
has an order; very long texts are one row like any other.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, same, stored
from .words import utf8_values

MIN_WORDS = 25
LAST = (1 << 63) - 1
HOT_SHARE = 4096
_SENTENCE = re.compile(rb"\n|(?<=[.!?])[ \t]")
_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def units_of(text: bytes, unit: str) -> list[bytes]:
    """The text in units; one separator, a line feed or (between sentences) a blank or tab,
    stands between two of them."""
    if unit == "sentence":
        return _SENTENCE.split(text)
    lines = text.split(b"\n")
    if unit == "line":
        return lines
    out, open_ = [], []
    for line in lines:
        if line.split():
            open_.append(line)
            continue
        if open_:
            out.append(b"\n".join(open_))
            open_ = []
        out.append(line)
    return out + [b"\n".join(open_)] if open_ else out


def normalised(unit: bytes) -> tuple[bytes | None, int]:
    """(digest, words) of a unit; no digest without words."""
    words = unit.translate(_FOLD).split()
    return (hashlib.md5(b" ".join(words)).digest() if words else None), len(words)


def rank_of(docs: DataFrame) -> Column:
    """Ids in their order, null last; whole numbers as one long, which aggregates faster."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    return F.struct(F.col("doc_id").isNull(), F.col("doc_id"))


def repeated_units(docs: DataFrame, unit: str) -> DataFrame:
    """doc_id, digest (of the text) and gone: the unit digests that a lesser document has.

    Units that are at least 1/4,096 of all (so at most 4,096 of them) are sent to all tasks
    instead of being joined by a shuffle, in which each would be one large group.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch):
        found = [sorted({d for u in units_of(t, unit) if (d := normalised(u)[0])})
                 for t in utf8_values(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))],
            names=["doc_id", "digest", "units"])

    rows = stored(map_batches(docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), cut,
                              f"doc_id {kind}, digest long, units array<binary>"), "units")
    each = rows.select("doc_id", "digest", rank_of(rows).alias("rank"), F.explode("units").alias("unit"))
    first = stored(each.groupBy("unit").agg(
        F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n")).where(
        "last > first").select("unit", "first", "n"), "first-units")
    total = rows.agg(F.sum(F.size("units"))).first()[0] or 0
    hot = F.col("n") >= max(2, -(-total // HOT_SHARE))
    common, rare = (first.where(c).select("unit", "first") for c in (hot, ~hot))
    by_task = each.join(F.broadcast(common), "unit")
    by_key = each.join(F.broadcast(common.select("unit")), "unit", "left_anti").join(rare, "unit")
    return by_task.unionByName(by_key).where("rank > first").groupBy("doc_id", "digest").agg(
        F.collect_set("unit").alias("gone"))


def taken_out(digests: list[bytes | None], words: list[int], lost: set[bytes],
              min_words: int) -> set[int]:
    """Numbers of the units in runs of repeats with ``min_words`` words or more."""
    out, run, size, seen = set(), [], 0, set()
    for i, digest in enumerate(digests):
        if digest is None:
            continue
        if digest in lost or digest in seen:
            run.append(i)
            size += words[i]
            continue
        seen.add(digest)
        if size >= min_words:
            out.update(run)
        run, size = [], 0
    return out | set(run) if size >= min_words else out


def remove_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what is kept of it), n_units, n_removed and removed (start, end of every
    unit taken out) for every row of ``docs``.  A unit that is kept keeps the separator before
    it, unless it is the first."""
    if unit not in ("line", "paragraph", "sentence"):
        raise ValueError("unit must be line, paragraph or sentence")
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = repeated_units(docs, unit).select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "gone")
    base = docs.select("doc_id", "text")
    marked = base.join(gone, same(base["doc_id"], gone["_id"])
                       & (F.xxhash64(base["text"]) == gone["_digest"]), "left").select(
        "doc_id", "text", "gone")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def take_out(batch):
        texts, counts, removed = [], [], []
        for text, lost in zip(utf8_values(batch.column(1)), batch.column(2).to_pylist()):
            parts = units_of(text, unit) if text else []
            known = [normalised(u) for u in parts]
            out = taken_out(*(list(x) for x in zip(*known)), set(lost or ()), min_words) if parts else ()
            kept, spans, at, byte = [], [], 0, 0
            for i, u in enumerate(parts):
                size = len(u) if u.isascii() else len(u.decode())
                if i in out:
                    spans.append({"start": at, "end": at + size})
                else:
                    kept.append(text[byte - 1:byte] + u if kept else u)
                at += size + 1
                byte += len(u) + 1
            texts.append(b"".join(kept).decode())
            counts.append(len(parts))
            removed.append(spans)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
             pa.array([len(s) for s in removed], pa.int64()), pa.array(removed, pa.list_(span))],
            names=["doc_id", "text", "n_units", "n_removed", "removed"])

    return map_batches(marked, take_out, f"doc_id {kind}, text string, n_units long, "
                                         "n_removed long, removed array<struct<start: long, end: long>>")


def repeat_digests(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_units, n_removed, removed (start:end, comma-joined) and the kept text."""
    spans = F.transform("removed", lambda s: F.concat_ws(":", s.start.cast("string"),
                                                         s.end.cast("string")))
    return remove_repeats(docs, **params).select(
        "doc_id", "n_units", "n_removed", F.array_join(spans, ",").alias("removed"),
        "text")
