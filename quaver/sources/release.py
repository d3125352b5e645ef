"""Releases: immutable sets of tables with pinned digests, and the binary forms of vectors and graphs."""

from __future__ import annotations

import bz2
import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

from quaver.functions.text import audio_route
from quaver.operators.lookup import row_parts, trigrams, with_folds

#: Rows of a file of a release; a file is hashed whole by one task.
FILE_ROWS = 1_000_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def asset_pins(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    name = F.substring_index("path", "/", -1)
    return files.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), name).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_release(tables: dict[str, DataFrame], path: str, release_id: str) -> str:
    """Stage the tables, prove them, publish with one rename; returns the manifest's digest.

    Tables are written below ``path``.staging and compared with what was asked for (``same_rows``). An existing release
    is never changed.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ValueError("A release is immutable")
    staging = f"{path}.staging"
    pins: list[dict] = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{staging}/{name}")
        if not same_rows(df, spark.read.parquet(f"{staging}/{name}")):
            raise ValueError(f"{name} differs after it was written")
        pins += [r.asDict() for r in asset_pins(spark, f"{staging}/{name}").orderBy("path").collect()]  # one row for each file
    manifest = json.dumps({"schemaVersion": 1, "id": release_id, "assets": sorted(pins, key=lambda p: p["path"])}, sort_keys=True, separators=(",", ":"))
    out = fs.create(_fs(spark, f"{staging}/release.json")[1], True)
    out.write(bytearray(manifest.encode()))
    out.close()
    if not fs.rename(_fs(spark, staging)[1], target):
        raise ValueError("The release could not be published")
    return hashlib.sha256(manifest.encode()).hexdigest()


def open_release(spark: SparkSession, path: str, expected_sha256: str) -> dict[str, DataFrame]:
    """The tables of a release whose manifest has the expected digest and whose files match their pins."""
    body = spark.read.text(f"{path}/release.json", wholetext=True).first()[0]
    if hashlib.sha256(body.encode()).hexdigest() != expected_sha256:
        raise ValueError("The manifest is not the expected one")
    manifest = json.loads(body)
    if set(manifest) != {"schemaVersion", "id", "assets"} or manifest["schemaVersion"] != 1:
        raise ValueError("Unknown manifest")
    want = spark.createDataFrame([(a["path"], a["bytes"], a["sha256"]) for a in manifest["assets"]], "path string, bytes long, sha256 string")
    have = None
    names = sorted({a["path"].split("/")[0] for a in manifest["assets"]})
    for name in names:
        pins = asset_pins(spark, f"{path}/{name}")
        have = pins if have is None else have.unionByName(pins)
    if not same_rows(want, have):
        raise ValueError("Files differ from their pins")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often: by their count and sums of 128 bits of hashes of whole rows, so no task holds rows."""
    if a.schema.simpleString() != b.schema.simpleString():
        return False

    def digest(df: DataFrame):
        row = df.select(F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(df.columns)))).alias("row"))
        sums = (F.sum(F.xxhash64(F.lit(salt), "row").cast("decimal(20,0)")).alias(f"h{salt}") for salt in (1, 2))
        return row.agg(F.count("*").alias("n"), *sums).first()

    return digest(a) == digest(b)


def rows_by_position(tracks: DataFrame, rows: list[int]) -> DataFrame:
    """The listed rows in list order, repeats kept; the list is the caller's and is broadcast."""
    spark = tracks.sparkSession
    wanted = spark.createDataFrame(list(enumerate(rows)), "pos int, row long")
    return tracks.join(F.broadcast(wanted), "row").orderBy("pos")


def positions(layout: DataFrame, rows: list[int]) -> DataFrame:
    wanted = layout.sparkSession.createDataFrame([(r,) for r in sorted(set(rows))], "row long")
    return layout.join(F.broadcast(wanted), "row").orderBy("row")


def verified_blobs(evidence: DataFrame) -> DataFrame:
    """Blobs whose bytes and hash are those of their pins; others are left out by the caller's check."""
    return evidence.withColumn("ok", (F.length("data") == F.col("bytes")) & (F.sha2("data", 256) == F.col("sha256")))


def merged_evidence(evidence: DataFrame) -> DataFrame:
    """One row for each path; a path with two pins fails."""
    one = evidence.groupBy("path").agg(F.countDistinct("bytes", "sha256").alias("pins"), F.min("bytes").alias("bytes"), F.min("sha256").alias("sha256"))
    return one.select("path", "bytes", F.when(F.col("pins") == 1, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("Conflicting pins: "), "path"))).alias("sha256"))


def delivery(tracks: DataFrame, served: DataFrame) -> DataFrame:
    """(row, route, available)."""
    return tracks.join(served.select("row", F.lit(True).alias("available")), "row", "left").select("row", audio_route(F.col("id")).alias("route"), F.coalesce("available", F.lit(False)).alias("available"))


def availability_bits(rows: DataFrame) -> DataFrame:
    """(bucket, bits): a bit for each row, 32,768 rows to a bitmap; encoded by the JVM's bitmap aggregate."""
    own = rows.filter("available")
    return own.groupBy(F.bitmap_bucket_number(F.col("row")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("row"))).alias("bits"))


def packed(column: Column) -> Column:
    """A vector as base64 of little-endian floats."""
    return _pack(column)


@F.arrow_udf(StringType())
def _pack(v: pa.Array) -> pa.Array:
    import base64

    return pa.array([None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode() for x in v.to_pylist()])


@F.arrow_udf(ArrayType(FloatType()))
def unpacked(v: pa.Array) -> pa.Array:
    """The vector of base64 little-endian floats."""
    import base64

    return pa.array([None if x is None else np.frombuffer(base64.b64decode(x), "<f4").tolist() for x in v.to_pylist()], pa.list_(pa.float32()))


def decode_matrix(files: DataFrame, dimensions: int) -> DataFrame:
    """(row, embedding) from binary files of float32 rows (content); rows count on within a file."""

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                m = np.frombuffer(content, "<f4").reshape(-1, dimensions)
                for a in range(0, len(m), 8192):
                    part = m[a : a + 8192]
                    yield pa.RecordBatch.from_pydict({"row": pa.array(range(a, a + len(part)), pa.int64()), "embedding": pa.array(part.tolist(), pa.list_(pa.float32()))})

    return files.select("content").mapInArrow(run, "row long, embedding array<float>")


def write_catalog(tracks: DataFrame, path: str, release_id: str) -> str:
    """A release of ``tracks`` with folded names, stored once, and ``grams``, their trigram index; returns its digest.

    Rows are dealt to tasks by count first, as a small file of many rows would be one task's, with all of its grams.
    """
    folded = with_folds(tracks.repartition(row_parts(tracks), "row"))
    return write_release({"tracks": folded, "grams": trigrams(folded)}, path, release_id)


#: Of a ZIP member's local header: its fixed part, its signature, the method bzip2, and the flags it may have.
_LOCAL, _SIGNATURE, _BZIP2, _FLAGS = struct.Struct("<4s5H3I2H"), b"PK\x03\x04", 12, 0x0808


def _member(data: bytes | None, want: dict) -> tuple[bytes | None, str | None]:
    """(content, None) of one member's bytes, or (None, the first rule that they break)."""
    if data is None or len(data) != want["range_bytes"] or len(data) < _LOCAL.size or not data.startswith(_SIGNATURE):
        return None, "range"
    _, _, flags, method, _, _, crc, packed_size, size, name_size, extra_size = _LOCAL.unpack_from(data)
    body = _LOCAL.size + name_size + extra_size
    stop = body + want["compressed_bytes"]
    name = data[_LOCAL.size : _LOCAL.size + name_size]
    if flags & ~_FLAGS or method != _BZIP2 or body > 512 or stop > len(data) or name != want["filename"].encode():
        return None, "header"
    if not flags & 8 and (crc, packed_size, size) != (want["crc32"], want["compressed_bytes"], want["bytes"]):
        return None, "header sizes"
    reader = bz2.BZ2Decompressor()
    try:
        content = reader.decompress(data[body:stop], max_length=want["bytes"] + 1)  # never more than one byte too many
    except (OSError, ValueError):
        return None, "compression"
    if not reader.eof or reader.unused_data or len(content) != want["bytes"] or zlib.crc32(content) != want["crc32"] or hashlib.sha256(content).hexdigest() != want["sha256"]:
        return None, "content"
    return content, None


def decode_members(members: DataFrame) -> DataFrame:
    """(id, content, problem) of ZIP members with bzip2 content, each checked against its entry.

    ``members`` (id, data, filename, bytes, compressed_bytes, range_bytes, crc32, sha256). A member that breaks a rule
    has null content; a null in an entry breaks its rule. One member at a time is held decoded.
    """
    columns = ["id", "data", "filename", "bytes", "compressed_bytes", "range_bytes", "crc32", "sha256"]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                want = {c: b.column(c)[i].as_py() for c in columns}
                lacking = any(want[c] is None for c in columns[2:])
                content, problem = (None, "entry") if lacking else _member(want["data"], want)
                yield pa.RecordBatch.from_pydict({"id": pa.array([want["id"]], pa.string()), "content": pa.array([content], pa.binary()), "problem": pa.array([problem], pa.string())})

    typed = members.select(F.col("id").cast("string"), "data", "filename", *(F.col(c).cast("long") for c in columns[3:7]), "sha256")
    return typed.mapInArrow(run, "id string, content binary, problem string")


def hydrate(members: DataFrame, path: str, budget: int) -> DataFrame:
    """All members decoded below ``path``, or none: one problem, or more range bytes than ``budget``, and nothing is published."""
    spark = members.sparkSession
    asked = members.agg(F.coalesce(F.sum("range_bytes"), F.lit(0)).alias("n")).first()["n"]
    if asked > budget:
        raise ValueError(f"{asked} bytes are over the budget")
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ValueError("A release is immutable")
    staging = f"{path}.staging"
    decode_members(members).write.mode("overwrite").parquet(staging)
    failed = spark.read.parquet(staging).filter("problem is not null")
    bad = failed.orderBy("id").select("id", "problem").first()
    if bad:
        fs.delete(_fs(spark, staging)[1], True)
        raise ValueError(f"Member {bad['id']}: {bad['problem']}")
    if not fs.rename(_fs(spark, staging)[1], target):
        raise ValueError("The members could not be published")
    return spark.read.parquet(path).select("id", "content")


# The fields of a source record that count as notices.
NOTICE_FIELDS = ("track_copyright_c", "track_copyright_p", "track_composer", "track_lyricist", "track_publisher", "track_information")


def merged_notices(supplied: Column, record: Column, album: Column) -> Column:
    """The map ``supplied`` with the record's notice fields (a map) and the album's information, where they say anything."""
    own = F.map_filter(record, lambda k, v: k.isin(*NOTICE_FIELDS) & v.isNotNull() & (v != ""))
    more = F.when(album.isNotNull() & (album != ""), F.create_map(F.lit("albumInformation"), album))
    none = F.create_map().cast("map<string,string>")
    added = F.map_concat(F.coalesce(own, none), F.coalesce(more, none))
    kept = F.map_filter(F.coalesce(supplied, none), lambda k, v: ~F.map_contains_key(added, k))
    return F.map_concat(kept, added)
