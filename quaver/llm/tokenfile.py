"""Token ids in Arrow files of fixed-size lists.

A file holds record batches of two columns, ``ids`` and ``mask``, each a fixed-size list with one value
for each place of a sequence. All sequences are equally long, so sequence k of a memory-mapped file is a
slice of one buffer: no offsets, no decoding, no copy. Documents follow each other without gaps; only the
end of a file is padded, where the mask is false. A second file lists the documents with their first
token and count. Files are written under the name of the attempt; the manifest names those of the
attempts that succeeded, so a task that is run again can't mix its output with another's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import Scratch

MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"


def file_schema(length: int, dtype: str) -> pa.Schema:
    kind = pa.uint16() if np.dtype(dtype).itemsize == 2 else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(pa.field("item", kind, nullable=False), length)), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


class _Writer:
    """Appends id bytes to a file and writes a batch whenever enough sequences are full."""

    def __init__(self, sink, length: int, dtype: str, sequences: int = 512):
        self.schema, self.length, self.sequences = file_schema(length, dtype), length, sequences
        self.size = np.dtype(dtype).itemsize
        self.kind = self.schema.field("ids").type.value_type
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.bytes = 0

    def add(self, body: bytes) -> None:
        self.held.append(body)
        self.bytes += len(body)
        unit = self.length * self.size * self.sequences
        if self.bytes >= unit:
            data = b"".join(self.held)
            for i in range(0, len(data) - unit + 1, unit):
                self._batch(data[i : i + unit], self.length * self.sequences)
            rest = data[len(data) // unit * unit :]
            self.held, self.bytes = [rest], len(rest)

    def _batch(self, data: bytes, tokens: int) -> None:
        rows = len(data) // (self.length * self.size)
        ids = pa.Array.from_buffers(self.kind, rows * self.length, [None, pa.py_buffer(data)])
        mask = pa.array(np.arange(rows * self.length) < tokens)
        lists = [pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((ids, mask), self.schema)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        data = b"".join(self.held)
        if data:
            unit = self.length * self.size
            padded = data + bytes(-len(data) % unit)
            self._batch(padded, len(data) // self.size)
        self.file.close()


def _write(base: str, tokenizer_path: str, end_id: int, length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quaver.llm.tokens import encoder, is_spaced

        coder = encoder(tokenizer_path, dtype, is_spaced(tokenizer_path))
        end = np.array([end_id], dtype).tobytes()
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, root = pafs.FileSystem.from_uri(name if "://" in name or name.startswith("file:") else f"file://{name}")
        writer = index = None
        docs = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store.create_dir(root.rpartition("/")[0], recursive=True)
                sink, index_sink = store.open_output_stream(f"{root}.arrow"), store.open_output_stream(f"{root}.docs.arrow")
                writer = _Writer(sink, length, dtype)
                index_schema = pa.schema([("doc_id", batch.column("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, index_schema)
            starts, counts = [], []
            for body in coder.encode(batch.column("text").to_pylist()):
                writer.add(body)
                writer.add(end)
                n = len(body) // writer.size + 1
                starts.append(tokens)
                counts.append(n)
                tokens += n
            docs += batch.num_rows
            index.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema))
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([task.partitionId()], pa.int32()),
                    "path": [f"{name}.arrow"],
                    "index_path": [f"{name}.docs.arrow"],
                    "n_docs": pa.array([docs], pa.int64()),
                    "n_tokens": pa.array([tokens], pa.int64()),
                }
            )

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", base: str | None = None) -> DataFrame:
    """Write all documents' ids in ascending id order; returns the manifest (part, path, index_path, n_docs, n_tokens).

    ``base`` is a folder that all executors see (the session's shared folder by default). A null text is
    empty; every document ends with ``end_id``; null ids come first; rows of equal id follow each other in
    input order; no rows give no files.
    """
    from quaver.llm.tokens import vocabulary_size

    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    dtype = "<u2" if max(vocabulary_size(tokenizer_path), end_id + 1) <= 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("seq"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "doc_id", "seq").sortWithinPartitions("doc_id", "seq").select("doc_id", "text")
    written = ranged.mapInArrow(_write(base or scratch.path("files"), tokenizer_path, end_id, length, dtype), MANIFEST)
    return scratch.table(written, "manifest")


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of a file of sequences; a local file is mapped, not read."""
    store, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if isinstance(store, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(name))
    return pa.ipc.open_file(store.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of sequence ``k``."""
    rows = reader.get_batch(0).num_rows
    batch = reader.get_batch(k // rows)
    length = batch.schema.field("ids").type.list_size
    ids = batch.column("ids").values.to_numpy()
    at = k % rows * length
    return ids[at : at + length], np.asarray(batch.column("mask").values.slice(at, length))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for files in batches:
        for row in files.to_pylist():
            reader, index = open_sequences(row["path"]), open_sequences(row["index_path"])
            batch_at, held, reach, low = -1, None, 0, 0
            for k in range(index.num_record_batches):
                docs = index.get_batch(k)
                crcs = []
                for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                    crc, at, stop = 0, start, start + n
                    while at < stop:
                        while at >= reach:
                            batch_at += 1
                            held = reader.get_batch(batch_at).column("ids").values.to_numpy()
                            low, reach = reach, reach + len(held)
                        upto = min(stop, reach)
                        crc = zlib.crc32(held[at - low : upto - low].astype("<u4"), crc)
                        at = upto
                    crcs.append(crc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": docs.column("doc_id"),
                        "start": pa.array(docs.column("start").to_numpy() + row["base"], pa.int64()),
                        "n_tokens": docs.column("n_tokens"),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )


def read_documents(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Read files back: (doc_id, start among the ids of all documents, n_tokens, ids_crc32)."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(parts, "part").mapInArrow(_read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
