"""What several operators share: table access, Arrow batches, files in shared folders."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = (1 << 64) - 1
BITS = 1 << 24


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by a URI or by a plain absolute path."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def attempt_name(stem: str, ending: str) -> str:
    """A file name no other attempt of the same task can use.

    Only the names that a successful attempt returns are read later, so what a lost executor or a
    second attempt leaves behind is never seen.
    """
    return f"{stem}-{uuid.uuid4().hex}{ending}"


def joined_path(folder: str, name: str) -> str:
    return posixpath.join(folder, name)


def record_batches(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 4 << 20, most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, cut by the size of their texts and binaries."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size >= most_bytes or len(held) >= most_rows:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(v, t.type) for v, t in zip(columns, schema, strict=True)], schema=schema)


def perhaps_in(ids: DataFrame) -> Column:
    """A test on ``doc_id`` that passes all of ``ids`` (one bigint column) and few others.

    The ids set bits in a bitmap of a fixed 2 MB, so what the driver and the tasks hold does not grow. With
    very many ids more others pass; the join behind it drops them.
    """
    place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(BITS))
    found = (
        ids.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    per_bucket = 8 * len(found[0].bits) if found else 1
    bits = {r.bucket: np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little") for r in found}

    def run(buckets: pa.Array, positions: pa.Array) -> pa.Array:
        b, p = buckets.to_numpy(zero_copy_only=False), positions.to_numpy(zero_copy_only=False)
        passes = np.zeros(len(b), dtype=bool)
        for bucket in np.unique(b):
            if bucket in bits:
                own = b == bucket
                passes[own] = bits[bucket][p[own] % per_bucket] > 0
        return pa.array(passes)

    own = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    return F.arrow_udf(run, "boolean")(F.bitmap_bucket_number(own), F.bitmap_bit_position(own))


def flagged(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with the test of ``perhaps_in`` as a column, by a broadcast join of the bitmap and without Python workers."""
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(BITS))
    marks = ids.select(place(ids.columns[0]).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_bucket"))
    bits = F.broadcast(marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")))
    held = F.conv(F.hex(F.substring("_bits", (F.col("_position") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(held.bitwiseAND(F.pow(F.lit(2), F.col("_position") % 8).cast("int")) > 0, F.lit(False))
    keyed = rows.withColumns({"_bucket": F.bitmap_bucket_number(place("doc_id")), "_position": F.bitmap_bit_position(place("doc_id"))})
    return keyed.join(bits, "_bucket", "left").select(*rows.columns, test.alias(name))
