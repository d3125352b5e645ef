"""Data sources of binary files: matrices of float32 rows and layered graphs as int32 arrays.

``spark.read.format("float32_matrix")`` plans ranges of bytes of the files below a path, in the order of their names, and numbers
rows on across ranges and files. ``format("layered_graph")`` does the same for graph files: a header, the first layer
of every node, the first link of every layer, and the links. Both writers write a file for each task under the name
of the attempt; the commit proves that the ranges follow each other without a gap and publishes all files with one
list; an aborted write leaves nothing. A file whose length or header is not what it must be is refused when
the read is planned, broken offsets when a range is read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# The header of a graph file. Magic, version, nodes, dimensions, links of a node, candidates of the build,
# seed, entry, highest level, padding; then the lengths of the three arrays.
HEADER = struct.Struct("<8s9I3Q")
MAGIC = b"MDACSR01"

#: Bytes that one task reads, and rows of one batch.
RANGE_BYTES, BATCH_ROWS = 64 << 20, 8192
LIST = "_files.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of one file, of those that a folder's list names, or of all in it, in the order of their names."""
    store, root = _open(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"Nothing at {path}")
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    if store.get_file_info(f"{root}/{LIST}").type == pafs.FileType.File:
        with store.open_input_stream(f"{root}/{LIST}") as f:
            listed = [(f"{root}/{x['name']}", x["bytes"]) for x in json.loads(f.read())["files"]]
        found = {i.path: i.size for i in store.get_file_info([p for p, _ in listed])} if listed else {}
        if any(found[p] != size for p, size in listed):
            raise ValueError(f"Files at {path} differ from their list")
        return listed
    return sorted((i.path, i.size) for i in store.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.endswith(ending))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values))


@dataclass
class Range(InputPartition):
    path: str
    base: int
    first: int
    last: int


# ---------------------------------------------------------------- matrices


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dimensions = options["path"], int(options["dimensions"])
        self.rows = max(1, int(options.get("rangeBytes", RANGE_BYTES)) // (4 * self.dimensions))

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for path, size in _files(self.path, ".f32"):
            if size % (4 * self.dimensions):
                raise ValueError(f"{path} has {size} bytes, which are no rows of {self.dimensions} floats")
            n = size // (4 * self.dimensions)
            out += [Range(path, base, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
            base += n
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges, no rows
            return
        store, _ = _open(self.path)
        width = 4 * self.dimensions
        with store.open_input_file(part.path) as f:
            for a in range(part.first, part.last, BATCH_ROWS):
                n = min(BATCH_ROWS, part.last - a)
                m = np.frombuffer(f.read_at(n * width, a * width), "<f4")
                if len(m) != n * self.dimensions:
                    raise ValueError(f"{part.path} ends early")
                rows = pa.array(np.arange(part.base + a, part.base + a + n))
                yield pa.RecordBatch.from_arrays([rows, _lists(m, np.arange(n + 1) * self.dimensions)], names=["row", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    count: int
    bytes: int
    sha256: str


class _Writer(DataSourceArrowWriter):
    """Files of consecutive rows, published together."""

    ending = ""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.path, self.overwrite = options, options["path"], overwrite
        self.attempt = uuid.uuid4().hex

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        """The bytes of a file; sets ``first`` and ``count``, the rows that it holds."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = _open(self.path)
        task = TaskContext.get()
        name = f"part-{self.attempt}-{task.partitionId():06d}-{task.taskAttemptId()}{self.ending}"
        self.first, self.count, size, digest = None, 0, 0, hashlib.sha256()
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for body in self.encode(iterator):
                out.write(body)
                digest.update(body)
                size += len(body)
        if self.first is None:
            store.delete_file(f"{root}/{name}")
            return Written(name, 0, 0, 0, "")
        return Written(name, self.first, self.count, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.count), key=lambda m: m.first)
        at = 0
        for m in parts:
            if m.first != at:
                self.abort(messages)
                raise ValueError(f"Row {min(at, m.first)} is missing or repeated")
            at += m.count
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        before = store.get_file_info(f"{root}/{LIST}").type == pafs.FileType.File
        if before and not self.overwrite:
            self.abort(messages)
            raise ValueError("There are files already")
        body = json.dumps({"rows": at, "files": [{"name": m.name, "first": m.first, "rows": m.count, "bytes": m.bytes, "sha256": m.sha256} for m in parts]})
        staged = f"{root}/{LIST}.{self.attempt}"
        with store.open_output_stream(staged) as out:
            out.write(body.encode())
        store.move(staged, f"{root}/{LIST}")  # readers see the old files or the new ones

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for i in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"part-{self.attempt}-"):
                store.delete_file(i.path)


class MatrixWriter(_Writer):
    ending = ".f32"

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        dimensions = int(self.options["dimensions"])
        for batch in batches:
            rows, lists = batch.column("row").to_numpy(), batch.column("embedding")
            if not len(rows):
                continue
            if self.first is None:
                self.first = int(rows[0])
            if (rows != np.arange(self.first + self.count, self.first + self.count + len(rows))).any():
                raise ValueError("Rows don't follow each other")
            values = lists.flatten()
            if lists.null_count or values.null_count or (np.diff(lists.offsets.to_numpy()) != dimensions).any():
                raise ValueError(f"A vector hasn't {dimensions} components")
            self.count += len(rows)
            yield values.to_numpy().astype("<f4").tobytes()


class MatrixSource(DataSource):
    """Options: path, dimensions; for reading rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "float32_matrix"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


# ---------------------------------------------------------------- graphs


def graph_header(path: str) -> dict[str, int]:
    """The checked header of a graph file."""
    store, root = _open(path)
    return _header(store, root, store.get_file_info(root).size)


def _header(store: pafs.FileSystem, path: str, size: int) -> dict[str, int]:
    with store.open_input_file(path) as f:
        data = f.read_at(HEADER.size, 0)
    if len(data) < HEADER.size:
        raise ValueError(f"{path} has no header")
    magic, version, *values, pad, nodes, layers, links = HEADER.unpack(data)
    head = dict(zip(("count", "dimensions", "m", "construction", "seed", "entry", "max_level"), values)) | {"layers": layers - 1, "links": links}
    if magic != MAGIC or version != 1 or pad or nodes != head["count"] + 1 or layers < 1 or size != HEADER.size + 4 * (nodes + layers + links):
        raise ValueError(f"{path} has an unknown header")
    return head


class GraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.nodes = options["path"], int(options.get("rangeNodes", 1 << 18))

    def partitions(self) -> list[Range]:
        store, _ = _open(self.path)
        out, base, shared = [], 0, None
        for path, size in _files(self.path, ".csr"):
            head = _header(store, path, size)
            own = {k: head[k] for k in ("dimensions", "m", "construction", "seed", "entry", "max_level")}
            if shared not in (None, own):
                raise ValueError(f"{path} is of another graph")
            shared, n = own, head["count"]
            out += [Range(path, base, a, min(n, a + self.nodes)) for a in range(0, n, self.nodes)]
            base += n
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no ranges, no rows
            return
        store, _ = _open(self.path)
        head = _header(store, part.path, store.get_file_info(part.path).size)
        with store.open_input_file(part.path) as f:

            def ints(section: int, first: int, n: int) -> np.ndarray:
                return np.frombuffer(f.read_at(4 * n, HEADER.size + 4 * (section + first)), "<i4").astype(np.int64)

            layer_section, link_section = head["count"] + 1, head["count"] + 2 + head["layers"]
            for a in range(part.first, part.last, BATCH_ROWS):
                n = min(BATCH_ROWS, part.last - a)
                node = ints(0, a, n + 1)
                depth = np.diff(node)
                if (a == 0 and node[0]) or (depth < 1).any() or (depth > head["max_level"] + 1).any() or node[-1] > head["layers"] or (a + n == head["count"] and node[-1] != head["layers"]):
                    raise ValueError(f"Broken layers of nodes in {part.path}")
                layer = ints(layer_section, int(node[0]), int(node[-1] - node[0]) + 1)
                if (node[0] == 0 and layer[0]) or (np.diff(layer) < 0).any() or layer[-1] > head["links"] or (node[-1] == head["layers"] and layer[-1] != head["links"]):
                    raise ValueError(f"Broken links of layers in {part.path}")
                links = ints(link_section, int(layer[0]), int(layer[-1] - layer[0]))
                src = np.repeat(np.arange(part.base + a, part.base + a + n), depth)
                level = np.arange(len(src)) - np.repeat(node[:-1] - node[0], depth)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(level.astype(np.int32)), _lists(links, layer - layer[0])], names=["src", "level", "neighbors"])


class GraphWriter(_Writer):
    ending = ".csr"

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        o = self.options
        src, level, sizes, links = [], [], [], []
        for batch in batches:
            lists = batch.column("neighbors")
            if lists.null_count or lists.flatten().null_count:
                raise ValueError("Null links")
            src.append(batch.column("src").to_numpy())
            level.append(batch.column("level").to_numpy())
            sizes.append(np.diff(lists.offsets.to_numpy()))
            links.append(lists.flatten().to_numpy())
        src, level = np.concatenate([np.zeros(0, np.int64), *src]), np.concatenate([np.zeros(0, np.int64), *level])
        if not len(src):
            return
        starts = np.flatnonzero(level == 0)
        depth = np.diff(np.append(starts, len(level)))
        self.first, self.count = int(src[0]), len(starts)
        if len(starts) == 0 or starts[0] or (src != np.repeat(np.arange(self.first, self.first + self.count), depth)).any() or (level != np.arange(len(level)) - np.repeat(starts, depth)).any():
            raise ValueError("Layers don't follow each other")
        offsets = np.append(0, np.cumsum(np.concatenate(sizes).astype(np.int64)))
        flat = np.concatenate(links)
        if max(offsets[-1], len(src), flat.max(initial=0)) >= 1 << 31:
            raise ValueError("Too many links for 32 bits")
        # fixed order: node table, layer table, links
        yield HEADER.pack(MAGIC, 1, self.count, *(int(o[k]) for k in ("dimensions", "m", "construction", "seed", "entry", "maxLevel")), 0, self.count + 1, len(offsets), len(flat))
        for array in (np.append(starts, len(level)), offsets, flat):
            yield array.astype("<i4").tobytes()


class GraphSource(DataSource):
    """A row (src, level, neighbors) for each layer of each node, layers without links too.

    Options: path; for reading rangeNodes; for writing dimensions, m, construction, seed, entry, maxLevel.
    """

    @classmethod
    def name(cls) -> str:
        return "layered_graph"

    def schema(self) -> str:
        return "src long, level int, neighbors array<long>"

    def reader(self, schema) -> GraphReader:
        return GraphReader(self.options)

    def writer(self, schema, overwrite: bool) -> GraphWriter:
        return GraphWriter(self.options, overwrite)


# ---------------------------------------------------------------- whole tables


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(GraphSource)


def write_matrix(vectors: DataFrame, path: str, dimensions: int, mode: str = "append") -> None:
    """Write (row, embedding), rows 0 to n - 1, as files of float32 rows in row order."""
    register(vectors.sparkSession)
    ranged = vectors.select("row", "embedding").repartitionByRange("row").sortWithinPartitions("row")
    ranged.write.format("float32_matrix").option("dimensions", dimensions).mode(mode).save(path)


def read_matrix(spark: SparkSession, path: str, dimensions: int, **options) -> DataFrame:
    register(spark)
    return spark.read.format("float32_matrix").options(dimensions=dimensions, **options).load(path)


def packed_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, level, neighbors) of every layer from 0 to a node's highest; ``nodes`` (row) may have nodes without links."""
    own = edges.groupBy("src", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("neighbors"))  # a layer's links are bounded by the build
    top = nodes.select(F.col("row").alias("src")).join(edges.groupBy("src").agg(F.max("level").alias("top")), "src", "left")
    every = top.select("src", F.explode(F.sequence(F.lit(0), F.coalesce("top", F.lit(0)))).alias("level"))
    return every.join(own, ["src", "level"], "left").select("src", F.col("level").cast("int").alias("level"), F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def write_graph(layers: DataFrame, path: str, header: dict[str, int], mode: str = "append", files: int | None = None) -> None:
    """Write (src, level, neighbors), nodes 0 to n - 1, as graph files of ranges of nodes; ``files`` = 1 gives one file.

    ``header``: dimensions, m, construction, seed, entry, max_level. A task holds the layers of its range.
    """
    register(layers.sparkSession)
    ranged = layers.repartitionByRange(files, "src") if files else layers.repartitionByRange("src")
    options = {"maxLevel" if k == "max_level" else k: v for k, v in header.items()}
    ranged.sortWithinPartitions("src", "level").write.format("layered_graph").options(**options).mode(mode).save(path)


def read_graph(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("layered_graph").options(**options).load(path)


def dense_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``row``, its place from 0 by ascending ``key`` (unique), counted by range."""
    from pyspark.sql import Window

    from quaver.scratch import scratch_table

    parts = scratch_table(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = parts.groupBy("__part").agg(F.count("*").alias("n"))
    # one row for each range
    before = totals.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parts.withColumn("__own", inside).join(F.broadcast(before), "__part").withColumn("row", F.col("__before") + F.col("__own")).drop("__part", "__own", "__before")


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of listed files whose bytes aren't those that were written; each is hashed by a task."""
    store, root = _open(path)
    with store.open_input_stream(f"{root}/{LIST}") as f:
        listed = json.loads(f.read())["files"]
    files = spark.createDataFrame([(x["name"], x["bytes"], x["sha256"]) for x in listed], "name string, bytes long, sha256 string")

    def run(batches):
        for b in batches:
            for name, size, want in zip(*(b.column(c).to_pylist() for c in ("name", "bytes", "sha256"))):
                own, _ = _open(path)
                with own.open_input_stream(f"{root}/{name}", compression=None) as f:
                    digest = hashlib.sha256()
                    while body := f.read(1 << 20):
                        digest.update(body)
                if digest.hexdigest() != want:
                    yield pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})

    return files.repartition("name").mapInArrow(run, "name string, bytes long, sha256 string")
