"""Sharding along a Hilbert curve.

Metadata dimensions are quantised to ``bits`` bits each, in the order of their values and by quantiles; a row's cell is
its place on the Hilbert curve through the grid. Rows are ordered by cell, then by a hash, then by the id, and the order
is cut into runs of equal count. Neighbouring cells lie in one shard and a coordinate is a range of values, so the least
and the greatest value of a shard are near each other, and a filter on any of the dimensions meets few shards.

Ranks need no global sort: rows are counted by cell, of which the grid has a fixed number, and by bucket, a part of a
cell of about ``rows_per_bucket`` rows; rows are numbered within their bucket only. A cell with a third of all rows has
as many buckets as its count asks for.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted


def hilbert_index(coordinates: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (one a row) with ``bits`` bits a coordinate.

    Each level of bits, from the top, is a Gray-coded step: lower bits are exchanged or inverted according to
    the upper ones, after which the interleaved bits are Gray-decoded.
    """
    x = coordinates.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            up = (x[d] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(up, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[dims - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[d] >> level) & 1)
    return place


def ordered_code(value: Column, kind: T.DataType, low) -> Column:
    """A number that grows with the value: numbers are themselves, of texts the seven bytes after ``low``, the bytes that
    all of them begin with."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    rest = F.substring(F.encode(value.cast("string"), "UTF-8"), len(low) + 1, 7)
    return F.conv(F.rpad(F.hex(rest), 14, "0"), 16, 10).cast("double")


def quantiles(docs: DataFrame, dims: tuple[str, ...], bits: int) -> dict[str, tuple[bytes, list[float]]]:
    """For each dimension what its texts begin with, and the codes at which the next coordinate begins.

    Two passes over the dimensions alone; the driver gets two values and at most 2^bits numbers of each. Quantiles are
    approximate: they shape the grid, and have no part in what a law promises.
    """
    kinds = {c: docs.schema[c].dataType for c in dims}
    texts = [c for c in dims if not isinstance(kinds[c], T.NumericType)]
    ends = docs.agg(*[f(F.col(quoted(c)).cast("string")).alias(f"{n}{k}") for k, c in enumerate(texts) for n, f in (("low", F.min), ("high", F.max))]).first() if texts else None
    begin = {c: os.path.commonprefix([(ends[f"low{k}"] or "").encode(), (ends[f"high{k}"] or "").encode()]) for k, c in enumerate(texts)}
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    if not dims:
        return {}
    found = docs.agg(*[F.percentile_approx(ordered_code(F.col(quoted(c)), kinds[c], begin.get(c, b"")), shares, 10_000).alias(f"q{k}") for k, c in enumerate(dims)]).first()
    return {c: (begin.get(c, b""), sorted(set(found[f"q{k}"] or []))) for k, c in enumerate(dims)}


def coordinate(value: Column, kind: T.DataType, low: bytes, cuts: list[float]) -> Column:
    """How many of ``cuts`` are at most the value's code; 0 for null."""
    code = ordered_code(value, kind, low)
    return F.coalesce(F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= code)), F.lit(0))


def curve(columns: list[Column], bits: int) -> Column:
    def place(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(hilbert_index(np.stack([c.to_numpy(zero_copy_only=False) for c in batch], axis=1), bits), pa.int64())

    place.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(place, "bigint")(*columns)


DIMS = ("source", "lang", "n_chars")


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = DIMS, bits: int = 5, rows_per_bucket: int = 2048) -> DataFrame:
    """Every row of ``docs``, without its text, with size, text_crc32, cell, shard and slot; shards' counts differ by
    one at most, the earlier ones being larger; slots count from 0 without gaps in each.

    size is the UTF-8 bytes of the text (null: none) plus 1. Null metadata has the first coordinate, a missing
    dimension none; a null id sorts first. Rows with equal id are ordered by checksum and size, and rows equal in
    all of these are interchangeable. Columns named like a result give way. Fewer rows than shards leave shards
    empty; an empty table gives no rows. Only ids and metadata are shuffled; the driver holds the cells' counts, at most
    2^(bits * dims) rows whatever the corpus. Rows are spread by id and checksum; only rows equal in both stay together.
    """
    spark = docs.sparkSession
    text, i = F.col(quoted(text_col)).cast("binary"), F.col(quoted(id_col))
    dims = tuple(c for c in dims if c in docs.columns)
    cuts = quantiles(docs, dims, bits)
    split = [c for c in dims if cuts[c][1]]  # a dimension with one value or none has no part in the curve
    coordinates = [coordinate(F.col(quoted(c)), docs.schema[c].dataType, *cuts[c]).alias(f"d{k}") for k, c in enumerate(split)]
    crc = F.crc32(F.coalesce(text, F.lit(b"")))
    own = F.struct(*[F.col(quoted(c)) for c in docs.columns if c != text_col])
    slim = docs.select(own.alias("row"), i.alias("id"), (F.coalesce(F.length(text), F.lit(0)) + 1).cast("long").alias("size"), crc.alias("crc"), *coordinates)
    names = [F.col(f"d{k}") for k in range(len(split))]
    cell = curve(names, bits) if len(names) > 1 else names[0].cast("long") if names else F.lit(0).cast("long")
    placed = slim.select("row", "id", "size", "crc", cell.alias("cell"))
    counts = sorted((r.cell, r.n) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    cells = spark.createDataFrame([(c, b, max(1, -(-n // rows_per_bucket))) for (c, n), b in zip(counts, before)], "cell bigint, start bigint, parts bigint")
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), "crc"), F.col("parts"))
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("part", part).drop("parts")
    buckets = dealt.groupBy("cell", "part", "start").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("cell", "part", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset"))
    order = Window.partitionBy("cell", "part").orderBy(F.col("id").asc_nulls_first(), "crc", "size")
    ranked = dealt.drop("start").join(offsets, ["cell", "part"]).withColumn("rank", F.col("offset") + F.row_number().over(order) - 1)
    # the first total % shards runs have one row more
    rank, few, more = F.col("rank"), total // shards, total % shards
    long_rows = more * (few + 1)
    shard = F.when(rank < long_rows, F.floor(rank / (few + 1))).otherwise(more + F.floor((rank - long_rows) / max(few, 1))).cast("int")
    slot = F.when(shard < more, rank - shard * (few + 1)).otherwise(rank - long_rows - (shard - more) * few).cast("long")
    found = {"size": F.col("size"), "text_crc32": F.col("crc"), "cell": F.col("cell"), "shard": shard, "slot": slot}
    kept = [F.col("row." + quoted(c)) for c in docs.columns if c != text_col and c.lower() not in found]
    return ranked.select(*kept, *[v.alias(k) for k, v in found.items()])


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", **options) -> DataFrame:
    """Writes ``docs`` as Parquet under ``path``, one folder a shard, rows by slot, and returns what pruning needs:
    the least and greatest value of each dimension by shard.

    Ids must be unique and not null, since rows are joined with their shards by id.
    """
    text_col, dims = options.get("text_col", "text"), options.get("dims", DIMS)
    plan = assign_shards(docs, shards, id_col, **options).select(F.col(quoted(id_col)), "shard", "slot")
    whole = docs.join(plan, id_col).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot")
    whole.write.mode("overwrite").partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    bounds = [f(F.col(quoted(c))).alias(f"{f.__name__}_{c}") for c in dims if c in docs.columns for f in (F.min, F.max)]
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(F.col(quoted(text_col)))).alias("bytes"), *bounds)
