"""Digests of vectors, and of texts in an order, by tasks that hold one block at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes of texts that are joined in one row before they meet in order.
BLOCK = 1 << 16


@F.arrow_udf(StringType())
def vector_sha256(v: pa.Array) -> pa.Array:
    """SHA-256 of each vector's little-endian float32 bytes; null for a null vector."""
    values, ends = v.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes(), np.append(0, np.cumsum(v.value_lengths().fill_null(0).to_numpy()))
    return pa.array([hashlib.sha256(values[4 * a : 4 * b]).hexdigest() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], v.is_valid().to_pylist())])


def _blocks(between: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            nonlocal at, held, size
            body, at, held, size = between.join(held), at + 1, [], 0
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "at": pa.array([at], pa.int64()), "body": pa.array([body], pa.binary())})

        for batch in batches:
            for body in batch.column(0).to_pylist():
                held.append(body)
                size += len(body)
                if size >= BLOCK:
                    yield row()
        if held:
            yield row()

    return run


def _chain(start: bytes, between: bytes, end: bytes, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, sink = hashlib.sha256(), 0, None
        if path:
            store, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            store.create_dir(root.rpartition("/")[0], recursive=True)
            sink = store.open_output_stream(root, compression=None)

        def add(body: bytes) -> None:
            nonlocal size
            digest.update(body)
            size += len(body)
            if sink:
                sink.write(body)

        add(start)
        first = True
        for batch in batches:
            for body in batch.column("body").to_pylist():
                add(body if first else between + body)
                first = False
        add(end)
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pydict({"sha256": [digest.hexdigest()], "bytes": pa.array([size], pa.int64())})

    return run


def ordered_document(df: DataFrame, text: Column, order: list[str], start: str = "", between: str = ",", end: str = "", path: str | None = None) -> tuple[str, int]:
    """(SHA-256, bytes) of ``start``, all texts (or binary values) by ``order`` (unique) joined with ``between``, and ``end``; also written to ``path``.

    SHA-256 is a chain and a document is one file, so one task must pass over all bytes; ranges join the texts in order to blocks
    of 64 KB before, and that task streams the blocks, holding one digest's state. Texts mustn't be null.
    """
    ranged = df.select(text.cast("binary").alias("body"), *order).repartitionByRange(*order).sortWithinPartitions(*order).select("body")
    blocks = ranged.mapInArrow(_blocks(between.encode()), "part long, at long, body binary")
    one = blocks.repartitionByRange(1, "part", "at").sortWithinPartitions("part", "at")
    found = one.mapInArrow(_chain(start.encode(), between.encode(), end.encode(), path), "sha256 string, bytes long").first()
    if found is None:  # no texts may give no task
        empty = df.sparkSession.range(1).select(F.lit(b"").alias("body")).coalesce(1).mapInArrow(lambda batches: _chain((start + end).encode(), b"", b"", path)(b.slice(0, 0) for b in batches), "sha256 string, bytes long")
        found = empty.first()
    return found.sha256, found.bytes


@F.arrow_udf(BinaryType())
def vector_bytes(v: pa.Array) -> pa.Array:
    """Each vector's little-endian float32 bytes; null for a null vector."""
    values, ends = v.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes(), np.append(0, np.cumsum(v.value_lengths().fill_null(0).to_numpy()))
    return pa.array([values[4 * a : 4 * b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], v.is_valid().to_pylist())], pa.binary())
