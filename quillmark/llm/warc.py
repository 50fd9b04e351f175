"""A deterministic sharded WARC writer, and its reader.

Pages are cut into ranges of their id by exact counts over all pages, so shards are the same on every run. A task
sorts its shards' pages by id, writes gzip members one a record, and starts a new file whenever the compressed size
reaches ``roll_bytes``. Headers and digests are made anew from the payload. Files are written under a temporary name
of the attempt and moved to their final, deterministic name when complete; rows for the manifest name them with size
and checksum, and the manifest is committed the same way after all tasks have ended. Files that no manifest names
count as not written, so lost executors and repeated attempts leave nothing half-done.

Of records with equal payloads the one with the smallest id is the response, the others are revisits.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, quoted, stash

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
FILES = "file string, bytes bigint, sha1 string, records bigint"


def filesystem(folder: str):
    """The file system and path of a folder's URI: local, HDFS or an object store, as pyarrow finds it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, copy: int) -> str:
    """The same page always gets the same id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def header_text(value: str) -> str:
    """A value that stays on its header line: controls, blanks at the ends and percent signs are percent-encoded."""
    odd = "[\\x00-\\x20\\x7f-\\x9f\\u2028\\u2029]"
    if not re.search(odd, value):
        return value
    return re.sub(odd + "|%", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_response: bool, copy: int, date: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    http = HTTP % len(payload)
    block = http + payload if is_response else http
    head = {
        "WARC-Type": "response" if is_response else "revisit",
        "WARC-Record-ID": record_id(page_id, digest, copy),
        "WARC-Date": date,
        "WARC-Target-URI": header_text(url) if url else f"urn:page:{page_id}",
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Length": str(len(block)),
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if not is_response:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest, 0), "X-Refers-To-Page-ID": "" if refers_to is None else str(refers_to)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member without name or time, so equal records are equal bytes."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Roll:
    """Files of one shard, rolled by compressed size."""

    def __init__(self, folder: str, shard: int, roll_bytes: int, attempt: str, date: str):
        self.fs, self.path = filesystem(folder)
        self.shard, self.roll_bytes, self.attempt, self.date = shard, roll_bytes, attempt, date
        self.number, self.out, self.done = 0, None, []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.path}/_temporary/{self.name}.{self.attempt}"
            self.out, self.size, self.sha1, self.records = self.fs.open_output_stream(self.temp, compression=None), 0, hashlib.sha1(), 0
            info = f"software: quillmark\r\nformat: WARC File Format 1.1\r\nX-Shard: {self.shard}\r\n".encode()
            head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(self.name, '', 0)}\r\nWARC-Date: {self.date}\r\nWARC-Filename: {self.name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
            self.put(member(head.encode() + info + b"\r\n\r\n", 6))
        self.put(data)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.path}/{self.name}")
            self.done.append((self.name, self.size, self.sha1.hexdigest(), self.records))
            self.out, self.number = None, self.number + 1


def cut_points(pages: DataFrame, id_col: str, size_col: str, shard_bytes: int, bins: int = 1 << 16) -> list[int]:
    """Smallest ids of all shards but the first, from exact sums over all pages.

    Ids are binned between their bounds; all bins that alone are over the size are binned again, in one job a level. A
    level has at most ``bins`` sums, or two for each bin that is over the size, of which there are fewer than shards.
    """
    bounds = pages.agg(F.min(id_col).alias("low"), F.max(id_col).alias("high")).first()
    ranges, leaves = [] if bounds.low is None else [(bounds.low, bounds.high)], []
    while ranges:
        each = max(2, bins // len(ranges))
        lows, highs = [a for a, _ in ranges], [b for _, b in ranges]
        widths = [max(1, -(-(b - a + 1) // each)) for a, b in ranges]
        sums = pages.select(bin_start(F.col(id_col), lows, highs, widths).alias("start"), size_col).where(F.col("start").isNotNull())
        ranges = []
        for r in sums.groupBy("start").agg(F.sum(size_col).alias("bytes")).orderBy("start").collect():
            k = bisect.bisect_right(lows, r.start) - 1
            end = min(highs[k], r.start + widths[k] - 1)
            if r.bytes > shard_bytes and end > r.start:
                ranges.append((r.start, end))
            else:
                leaves.append((r.start, r.bytes))
    cuts, held = [], 0
    for start, size in sorted(leaves):
        if held and held + size > shard_bytes:
            cuts.append(start)
            held = 0
        held += size
    return cuts


def bin_start(page_id: Column, lows: list[int], highs: list[int], widths: list[int]) -> Column:
    """The first id of an id's bin; null outside of the ranges."""
    low, high, width = np.array(lows, np.int64), np.array(highs, np.int64), np.array(widths, np.uint64)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = batch.fill_null(0).to_numpy()
            k = np.maximum(np.searchsorted(low, ids, side="right") - 1, 0)
            outside = batch.is_null().to_numpy(zero_copy_only=False) | (ids < low[k]) | (ids > high[k])
            # unsigned, since the distance of two ids may be over the signed numbers
            past = (ids.view(np.uint64) - low[k].view(np.uint64)) // width[k] * width[k]
            yield pa.array((low[k].view(np.uint64) + past).view(np.int64), mask=outside)

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "bigint")(page_id)


def shard_of(page_id: Column, cuts: list[int]) -> Column:
    """The number of cut points at or below an id; a null id goes to the last shard."""
    points = np.array(cuts, np.int64)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            place = np.searchsorted(points, batch.fill_null(0).to_numpy(), side="right")
            yield pa.array(np.where(batch.is_null().to_numpy(zero_copy_only=False), len(points), place).astype(np.int32))

    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(find, "int")(page_id)


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = 32 << 20, most_shards: int = 8192, roll_bytes: int | None = None, level: int = 6, date: str = "2020-01-01T00:00:00Z") -> str:
    """Writes one record per row of ``pages`` into a new folder and returns the folder.

    A null payload is empty. Payloads of at least ``min_revisit_bytes`` that equal that of a row with a smaller id are
    revisits of the smallest; rows equal in id and payload count as copies of which the first is the response. Rows
    with a null id follow all others. Null URLs are written as ``urn:page:`` and the id. Other columns are not read.
    An empty table gives a manifest without files. ``shard_bytes`` are payload bytes, more where there would be over
    ``most_shards`` shards; each shard is one task's sorted run. A file ends when its compressed size reaches
    ``roll_bytes``, unless given a sixteenth of the payload bytes of a shard: 2 MiB at first, under a gigabyte for 100 TB
    of pages, so a shard has a few files at every size. A record is never split. Ids must be integers.
    """
    spark = pages.sparkSession
    if not isinstance(pages.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer")
    folder = folder or new_path(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)
    payload = F.coalesce(F.col(quoted(payload_col)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), payload.alias("payload"))
    slim = stash(rows.select("id", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1")), "warc-digests")
    # copies are summed up by digest before the shuffle; only digests that occur twice are looked up again
    firsts = slim.where(F.col("bytes") >= min_revisit_bytes).groupBy("sha1", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    total = slim.agg(F.sum("bytes").alias("n")).first().n or 0
    shard_bytes = max(shard_bytes, -(-total // most_shards))
    roll_bytes = roll_bytes or max(1, shard_bytes // 16)
    cuts = cut_points(slim, "id", "bytes", shard_bytes)
    firsts = stash(firsts.select(F.col("sha1").alias("f_sha1"), "first", F.lit(True).alias("again")), "warc-firsts")
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    joined = keyed.join(firsts, keyed.sha1 == firsts.f_sha1, "left").drop("f_sha1")
    ranged = joined.withColumn("shard", shard_of(F.col("id"), cuts)).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "sha1", "url")
    dedup = min_revisit_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, roll, files, last, copy = uuid.uuid4().hex, None, [], None, 0
        for batch in batches:
            for row in zip(*[batch.column(k) for k in ("id", "url", "payload", "sha1", "again", "first", "shard")]):
                page, url, body, sha1, again, first, part = (x.as_py() for x in row)
                if roll is None or roll.shard != part:
                    if roll is not None:
                        roll.close()
                        files += roll.done
                    roll = Roll(folder, part, roll_bytes, attempt, date)
                copy = copy + 1 if (page, sha1) == last else 0
                last = (page, sha1)
                response = len(body) < dedup or not again or (page == first and copy == 0)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                roll.write(member(record(page, url, body, digest, first, response, copy, date), level))
        if roll is not None:
            roll.close()
            files += roll.done
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["file", "bytes", "sha1", "records"])

    ranged = ranged.select("id", "url", "payload", "sha1", F.coalesce("again", F.lit(False)).alias("again"), "first", "shard")
    files = sorted(ranged.mapInArrow(write, FILES).collect())
    commit_manifest(folder, [f.asDict() for f in files])
    return folder


def commit_manifest(folder: str, files: list[dict]) -> None:
    """Writes the manifest under a temporary name and moves it into place."""
    fs, path = filesystem(folder)
    temp = f"{path}/_temporary/manifest.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(json.dumps({"files": files}, sort_keys=True).encode())
    fs.move(temp, f"{path}/manifest.json")


def read_manifest(folder: str) -> list[dict]:
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/manifest.json", compression=None) as f:
        return json.loads(f.read())["files"]


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped archive, one member at a time."""
    rest = b""
    while True:
        press, data = zlib.decompressobj(31), []
        while not press.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if data:
                    raise ValueError("the archive ends within a record")
                return
            data.append(press.decompress(rest))
            rest = press.unused_data
        whole = b"".join(data)
        head, _, body = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield headers, body[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that the manifest's files hold: page_id, url, record_type, refers_to, payload_digest, payload_bytes
    and payload (null for revisits).

    Blocks and payloads are checked against the headers' digests. Only files that the manifest names are read.
    """
    files = read_manifest(folder)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        number = lambda x: int(x) if x else None
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for h, block in records_of(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if f"sha1:{base32_sha1(block)}" != h["WARC-Block-Digest"] or payload is not None and base32_sha1(payload) != digest:
                            raise ValueError(f"{name}: a digest does not fit its record")
                        rows.append({"page_id": number(h["X-Page-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": number(h.get("X-Refers-To-Page-ID")), "payload_digest": digest, "payload_bytes": int(h["X-Payload-Length"]), "payload": payload})
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_struct_array(pa.array(rows, pa.struct(list(kinds.items()))))
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_struct_array(pa.array(rows, pa.struct(list(kinds.items()))))

    names = spark.range(0, len(files), 1, max(1, len(files))).select(F.get(F.array(*[F.lit(f["file"]) for f in files]), F.col("id").cast("int")).alias("file")) if files else spark.createDataFrame([], "file string")
    return names.mapInArrow(read, schema)
