"""Token-id files with a minimal perfect hash index for keyed access.

``write_token_files`` encodes every text, appends the end id and writes raw ids in
ascending ``doc_id`` order, one file per range of ids.  ``build_index`` puts every
document's key into one of many minimal perfect hash shards, whose slots hold a
fingerprint, the file and the byte offset; ``read_documents`` finds any set of keys with
one probe each and reads their ranges.

A key is (doc_id, repeat): repeat counts the rows of one doc_id from 0, so repeated
rows keep entries of their own.  Null ids sort first and are keys like any other.  A null
text is empty and has the end id alone.  Without documents there are no files.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, shared_folder, ship_file, ship_package, shipped, stored
from .files import Folder, attempt_name
from .perfect_hash import PerfectHash
from .word_ids import word_ids
from .words import utf8_values

MAGIC = b"RTIDS1\0\0"
HEADER = "<8sII"


@dataclass
class TokenFiles:
    """A written data set: its folder, and a row per document of where its ids lie."""

    folder: str
    documents: DataFrame      # doc_id, repeat, file, offset, n_tokens, start
    item_bytes: int


def write_token_files(docs: DataFrame, tokenizer_file: str, end_id: int,
                      folder: str | None = None) -> TokenFiles:
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = ship_file(spark, tokenizer_file)
    folder = folder or shared_folder(spark, "token-ids")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", "text").repartitionByRange(
        "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches):
        from pyspark import TaskContext
        encode, out, name = word_ids(shipped(vocabulary)), None, ""
        end = np.array([end_id], encode.kind).tobytes()
        place = ids_before = run = 0
        last: object = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = attempt_name("ids", ".bin")
                out = Folder(folder).create(name)
                out.write(struct.pack(HEADER, MAGIC, encode.kind.itemsize, end_id))
                place = struct.calcsize(HEADER)
            ids, ends = encode.encode(utf8_values(batch.column(1)))
            ends = ends.tolist()
            out.write(b"".join([ids[a:b].tobytes() + end for a, b in zip(ends[:-1], ends[1:])]))
            ids = np.diff(ends) + 1
            repeats = []
            for key in batch.column(0).to_pylist():
                run = run + 1 if key == last else 0
                last = key
                repeats.append(run)
            n = ids * encode.kind.itemsize
            offset = place + np.concatenate(([0], np.cumsum(n)[:-1]))
            start = ids_before + np.concatenate(([0], np.cumsum(ids)[:-1]))
            place, ids_before = int(offset[-1] + n[-1]), int(start[-1] + ids[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(repeats, pa.int64()),
                 pa.array(np.full(len(n), TaskContext.get().partitionId(), np.int32)),
                 pa.array([name] * len(n)), pa.array(offset), pa.array(ids), pa.array(start)],
                names=["doc_id", "repeat", "part", "file", "offset", "n_tokens", "start"])
        if out is not None:
            out.close()

    placed = stored(ranged.mapInArrow(
        write, f"doc_id {kind}, repeat long, part int, file string, offset long, n_tokens long, "
               "start long"), "token-places")
    # one row per file (their number is the partition count): ids before it, and how often its
    # first key stands at the end of the files before it
    order = F.struct("start", "offset")
    parts = placed.groupBy("part").agg(
        F.sum("n_tokens").alias("ids"), F.min_by("doc_id", order).alias("first"),
        F.max_by("doc_id", order).alias("last"), F.max_by("repeat", order).alias("again"))
    before, carry, last, rows = 0, 0, (), []
    for r in parts.orderBy("part").collect():
        own = carry if (r["first"],) == last else 0
        rows.append((r["part"], before, r["first"], own))
        before += r["ids"]
        carry = r["again"] + 1 + (own if r["first"] == r["last"] else 0)
        last = (r["last"],)
    bases = spark.createDataFrame(rows, f"part int, base long, first {kind}, carried long")
    documents = placed.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("repeat") + F.when(F.col("doc_id").eqNullSafe(F.col("first")),
                                            F.col("carried")).otherwise(0)).alias("repeat"),
        "file", "offset", "n_tokens", (F.col("start") + F.col("base")).alias("start"))
    return TokenFiles(folder, documents, word_ids(tokenizer_file).kind.itemsize)


def _key_hashes(doc_id: Column, repeat: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), doc_id, doc_id.isNull(), repeat).alias("h1"),
            F.xxhash64(repeat, doc_id.isNull(), doc_id, F.lit(2)).alias("h2")]


@dataclass
class Index:
    folder: str
    shards: DataFrame         # shard, index_file
    n_shards: int


def build_index(files: TokenFiles, keys_per_shard: int = 250_000) -> Index:
    """One perfect hash per shard of at most about ``keys_per_shard`` keys."""
    n_shards = max(1, -(-files.documents.count() // keys_per_shard))
    keys = files.documents.select(*_key_hashes(F.col("doc_id"), F.col("repeat")), "file", "offset",
                                  "n_tokens", "start")
    keys = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards)))
    folder = files.folder

    def build(group):
        h1, h2 = (group[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        table = PerfectHash.build(h1, h2)
        slot = table.slots(h1, h2)
        names, code = np.unique(group["file"].to_numpy().astype(str), return_inverse=True)
        columns = {"names": names}
        for name, values in (("which", code), *((c, group[c].to_numpy())
                                               for c in ("offset", "n_tokens", "start"))):
            columns[name] = np.empty(len(slot), np.int64)
            columns[name][slot] = values
        file = attempt_name(f"index-{group['shard'].iloc[0]}", ".npz")
        with Folder(folder).create(file) as out:
            out.write(table.dump(**columns))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "index_file": [file]})

    return Index(folder, stored(keys.groupBy("shard").applyInPandas(
        build, "shard long, index_file string"), "token-index"), n_shards)


def find(index: Index, keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (doc_id, repeat) that the index holds, with file, offset, n_tokens, start."""
    kind = keys.schema["doc_id"].dataType.simpleString()
    asked = keys.select("doc_id", "repeat", *_key_hashes(F.col("doc_id"), F.col("repeat")))
    asked = asked.withColumn("shard", F.pmod(F.col("h1"), F.lit(index.n_shards))).join(
        index.shards, "shard")
    # an index file is read once per run of its shard's keys
    asked = asked.repartition("shard", F.pmod("h2", F.lit(4))).sortWithinPartitions("shard")
    folder = index.folder
    fields = ["file", "offset", "n_tokens", "start"]

    def probe(batches):
        store, name, table, columns = Folder(folder), None, None, None
        for batch in batches:
            files = batch.column("index_file").to_pylist()
            edge = 0
            while edge < len(files):
                end = edge
                while end < len(files) and files[end] == files[edge]:
                    end += 1
                if files[edge] != name:
                    name = files[edge]
                    table, columns = PerfectHash.load(store.whole(name))
                part = batch.slice(edge, end - edge)
                h1, h2 = (part.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
                slot = table.slots(h1, h2)
                ok = np.flatnonzero(slot >= 0)
                slot = slot[ok]
                got = [pa.array(columns["names"][columns["which"][slot]].tolist(), pa.string())]
                got += [pa.array(columns[c][slot]) for c in fields[1:]]
                part = part.take(pa.array(ok))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("repeat"), *got],
                    names=["doc_id", "repeat", *fields])
                edge = end

    return asked.select("doc_id", "repeat", "h1", "h2", "index_file").mapInArrow(
        probe, f"doc_id {kind}, repeat long, file string, offset long, n_tokens long, start long")


def read_documents(folder: str, found: DataFrame, item_bytes: int,
                   tasks: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of found keys, from the files' bytes.
    ``tasks``: how many read, if their number is not left to Spark."""
    kind = found.schema["doc_id"].dataType.simpleString()
    ordered = found.repartitionByRange(*([tasks] if tasks else []), "file", "offset") \
        .sortWithinPartitions("file", "offset")
    item = np.dtype(f"<u{item_bytes}")

    def run(batch):
        store = Folder(folder)
        sums = []
        for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens"))):
            ids = np.frombuffer(store.read(name, at, n * item_bytes), item)
            if len(ids) != n:
                raise ValueError(f"{name} ends before {at} + {n} ids")
            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
        store.close()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"),
             pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(ordered, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
