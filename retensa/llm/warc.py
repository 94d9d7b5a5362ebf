"""WARC archives with a two-level capture index.

``write_archives`` writes one compressed record per row; of records with equal payloads
that with the least id is a response, the others revisit it.  ``build_index`` sorts
the captures by (reversed-host URL key, id) into shards of compressed blocks, and keeps a
sparse directory with the first key of every block.  ``look_up`` finds keys by binary
search in the shard bounds, in the directory and in one block read by its range;
``read_captures`` reads the records' own ranges back.

Defined cases: a null payload is empty; a null URL has an empty key; rows that carry the
response's id and payload are responses too, so repeated rows stay; null ids sort last
and are a response only where no row of the payload has an id; ids are whole numbers (others
raise TypeError); without pages nothing is written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, same, shared_folder, ship_package, stored
from .files import Folder, attempt_name, read_tasks

BLOCK_LINES = 512
DATE = "2020-01-01T00:00:00Z"
#: the least length in bytes of a payload that may be revisited
REVISIT_FROM = 0


def url_key(url: Column) -> Column:
    """Host parts in reverse, then the path: ``com,example,www)/path``; in lower case.

    Scheme, user, port and fragment do not count; what is no URL stands as it is.
    """
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)(?::[0-9]*)?([^#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, pattern, 1))
    path = F.lower(F.regexp_extract(text, pattern, 2))
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    whole = F.concat(reversed_host, F.lit(")"), F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit("/"), path)))
    return F.regexp_replace(F.when(host == "", F.lower(text)).otherwise(whole), r"[\x00-\x20]", "+")


def id_key(page_id: Column) -> Column:
    """Text that sorts like the id; null last."""
    wide = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"),
                  20, "0")
    return F.coalesce(wide, F.lit("~"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html); returns the captures:
    key, file, offset, length."""
    spark = pages.sparkSession
    if not isinstance(pages.schema["page_id"].dataType, T.IntegralType):
        raise TypeError("page_id must be a whole number")
    ship_package(spark)
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"),
                        F.unhex(F.sha2(payload, 256)).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select("sha", "response")
    # only payloads that occur again are told about their response
    rows = rows.join(first, "sha", "left").withColumn(
        "refers_to", F.when(F.col("response").isNotNull() & ~same(F.col("page_id"), F.col("response"))
                            & (F.octet_length("payload") >= REVISIT_FROM), F.col("response")))
    rows = rows.select(F.concat_ws(" ", url_key(F.col("url")), id_key(F.col("page_id"))).alias("key"),
                       "page_id", "url", "payload", "refers_to")

    def record(page_id, url, body: bytes, refers_to) -> bytes:
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
               f"Content-Length: {len(body)}\r\n\r\n".encode()
        block = http + (body if refers_to is None else b"")
        head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
                f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
                f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
                f"WARC-Payload-Digest: sha1:{digest}"]
        if refers_to is not None:
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def write(batches):
        out, name, place = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = attempt_name("pages", ".warc.gz")
                out = Folder(folder).create(name)
            offsets, lengths = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 5)]
            for page_id, url, body, refers_to in zip(*columns):
                pack = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = pack.compress(record(page_id, url, body, refers_to)) + pack.flush()
                out.write(data)
                offsets.append(place)
                lengths.append(len(data))
                place += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([name] * len(offsets)), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64())], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(write, "key string, file string, offset long, length long"),
                  "captures")


@dataclass
class CaptureIndex:
    folder: str
    bounds: list[str]         # first key of every shard
    shards: list[str]         # file of every shard


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorted shards of compressed blocks, each shard ending in its directory.

    One row per shard reaches the driver; their number is the partition count.
    """
    ship_package(captures.sparkSession)
    ordered = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions(
        "key", "file", "offset")

    def write(batches):
        out, name, place, lines, directory = None, "", 0, [], []

        def close_block():
            nonlocal place, lines
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{place}\t{len(data)}")
            place += len(data)
            lines = []

        for batch in batches:
            if batch.num_rows and out is None:
                name = attempt_name("captures", ".idx")
                out = Folder(folder).create(name)
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                lines.append("\t".join(map(str, row)))
                if len(lines) == block_lines:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        data = zlib.compress("\n".join(directory).encode(), 6)
        out.write(data + place.to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([directory[0].split("\t", 1)[0]]), pa.array([name]),
             pa.array([place + len(data) + 8])], names=["first", "shard", "bytes"])

    made = stored(ordered.mapInArrow(write, "first string, shard string, bytes long"),
                  "capture-shards").collect()
    made.sort(key=lambda r: (r["first"].encode(), r["shard"]))
    return CaptureIndex(folder, [r["first"] for r in made],
                        [f"{r['shard']}\t{r['bytes']}" for r in made])


def look_up(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """Captures (key, file, offset, length) of every key; ``keys`` has one distinct column, key."""
    folder, bounds, shards = index.folder, [b.encode() for b in index.bounds], index.shards

    def route(batch):
        found = [bisect_right(bounds, k.encode()) - 1 for k in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())],
                                          names=["key", "shard"])

    # captures of one key may go over the edge of shards: every shard that begins with it counts
    routed = map_batches(keys, route, "key string, shard int").where("shard >= 0")
    ordered = routed.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")

    def search(batches):
        store = Folder(folder)
        opened: dict = {"shard": None, "block": None}

        def directory(shard: int):
            if opened["shard"] != shard:
                name, size = shards[shard].split("\t")
                end = int(size) - 8
                place = int.from_bytes(store.read(name, end, 8), "little")
                lines = zlib.decompress(store.read(name, place, end - place)).decode().split("\n")
                entries = [x.rsplit("\t", 2) for x in lines]
                opened.update(shard=shard, name=name, block=None,
                              firsts=[e[0].encode() for e in entries],
                              ranges=[(int(e[1]), int(e[2])) for e in entries])

        def block(shard: int, number: int):
            directory(shard)
            if opened["block"] != number:
                data = store.read(opened["name"], *opened["ranges"][number])
                lines = zlib.decompress(data).decode().split("\n")
                opened.update(block=number, lines=lines,
                              keys=[x.split("\t", 1)[0].encode() for x in lines])
            return opened["keys"], opened["lines"]

        def captures(shard: int, key: bytes):
            while shard >= 0:
                directory(shard)
                number = bisect_right(opened["firsts"], key) - 1
                while number >= 0:
                    keys, lines = block(shard, number)
                    at = bisect_right(keys, key) - 1
                    while at >= 0 and keys[at] == key:
                        yield lines[at].split("\t")
                        at -= 1
                    if at >= 0:            # a smaller key: nothing further left
                        return
                    number -= 1
                shard -= 1

        for batch in batches:
            rows = []
            for key, shard in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend(captures(shard, key.encode()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]),
                     pa.array([int(r[2]) for r in rows]), pa.array([int(r[3]) for r in rows])],
                    names=["key", "file", "offset", "length"])
        store.close()

    return ordered.mapInArrow(search, "key string, file string, offset long, length long")


def parse_record(data: bytes) -> dict:
    """Headers of a record, its payload, and the payload's length and digest.

    A response's digest is taken from its payload and must be the one it states; a
    revisit states both of the full payload.
    """
    raw = zlib.decompress(data, 31)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, body = block.split(b"\r\n\r\n", 1)
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if (digest, len(body)) != (stated, size):
            raise ValueError(f"{fields['WARC-Record-ID']} holds another payload than it states")

    def page(name: str) -> int | None:
        number = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(number[1]) if number else None

    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload": body,
            "payload_bytes": size, "payload_digest": stated, "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To")}


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(folder: str, captures: DataFrame, payloads: bool = False,
                  tasks: int | None = None) -> DataFrame:
    """Records of captures, read by range in the order of files; with their payloads if asked.
    ``tasks``: how many read, if their number is not left to Spark."""
    ordered = captures.select("file", "offset", "length").repartitionByRange(
        *([tasks] if tasks else []), "file", "offset").sortWithinPartitions("file", "offset")
    names = [f.split()[0] for f in RESULT.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batch):
        store, rows = Folder(folder), []
        for at in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = parse_record(store.read(*at))
            rows.append([found[n] for n in names])
        store.close()
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return map_batches(ordered, run, RESULT + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages``, index the captures, look every page's key up and read its record."""
    folder = shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    index = build_index(captures, folder)
    keys = pages.select(F.concat_ws(" ", url_key(F.col("url")), id_key(F.col("page_id"))).alias(
        "key")).distinct()
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    return read_captures(folder, look_up(index, keys), tasks=read_tasks(*size))
