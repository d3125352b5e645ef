"""A content-addressed archive of web records.

Two tables make an archive. ``payloads`` holds the bytes of every distinct payload once, as a Zstandard frame, under
its SHA-256; merging copies checks that they agree in length and in a second hash. ``records`` holds the exact header bytes of each record
(WARC headers, blank line, HTTP headers, blank line), its digest, and whether the payload belongs to the record's own
block. A join on the digest gives every record back, and the payload's digest is computed anew on reading.

Pages become records of WARC 1.1: of those with equal payloads the first is a response and later ones revisit
it; payloads too small to be worth it are always responses. Archives go to and from files of gzip members.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quaver.llm.common import Scratch, small

#: Rows of shared payloads' first records that are broadcast: about 120 bytes each, 12 MB.
BROADCAST_ROWS = 100_000
END = b"\r\n\r\n"


@dataclass
class Archive:
    """records (headers, digest, own, and what tells them apart) and payloads (digest, frame)."""

    records: DataFrame
    payloads: DataFrame


# ---------------------------------------------------------------- storing and restoring


@F.arrow_udf(BinaryType())
def compressed(v: pa.Array) -> pa.Array:
    """Each value as a Zstandard frame."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=3)
    return pa.array([None if x is None else coder.compress(x) for x in v.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def decompressed(v: pa.Array) -> pa.Array:
    import zstandard

    coder = zstandard.ZstdDecompressor()
    return pa.array([None if x is None else coder.decompress(x) for x in v.to_pylist()], pa.binary())


def store_payloads(payloads: DataFrame) -> DataFrame:
    """(digest, frame): each distinct value of the binary column ``payload`` once; unequal bytes under one digest are an error."""
    facts = payloads.select(F.sha2("payload", 256).alias("digest"), compressed("payload").alias("frame"), F.length("payload").alias("n"), F.xxhash64("payload").alias("h"))
    once = facts.groupBy("digest").agg(F.first("frame").alias("frame"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "h") for f in (F.min, F.max)))
    return once.select("digest", F.when(F.expr("min_n = max_n and min_h = max_h"), F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("Two payloads under digest "), "digest"))).alias("frame"))


def store(records: DataFrame, scratch: Scratch) -> Archive:
    """An archive of records as ``read_files`` gives them; their other columns are kept.

    A record of its own payload has that payload's digest. Another (a revisit) has the digest of the records whose headers claim the
    same digest, of whatever kind; if there are none, the digest that it claims if that is a SHA-256, else none.
    """
    digest = F.when(F.col("own"), F.sha2("payload", 256))
    kept = scratch.table(records.withColumn("digest", digest).drop("payload"), "kept")
    names = scratch.table(kept.filter("own and claimed is not null").groupBy("claimed").agg(F.min("digest").alias("named")), "names")
    claimed = F.when(F.col("claimed").startswith("sha256:"), F.substring("claimed", 8, 64))
    found = kept.join(small(names, BROADCAST_ROWS), "claimed", "left").withColumn("digest", F.coalesce("digest", "named", claimed)).select(*kept.columns)
    return Archive(scratch.table(found, "records"), scratch.table(store_payloads(records.filter("own").select("payload")), "payloads"))


def restore(archive: Archive) -> DataFrame:
    """The records with their payloads; the payload of one that isn't ``own`` is that it refers to.

    Copies of one payload may be any share of the records: both sides are written tables, so the join's exchanges are
    plain and a hot digest is split. A payload that doesn't have its digest any more is an error; one
    that the archive lacks is null.
    """
    met = archive.records.join(archive.payloads, "digest", "left").withColumn("payload", decompressed("frame")).drop("frame")
    good = F.when(F.col("payload").isNull() | (F.sha2("payload", 256) == F.col("digest")), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("Damaged payload "), "digest")))
    return met.withColumn("payload", good)


# ---------------------------------------------------------------- pages


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _escaped(uri: Column) -> Column:
    """Spaces and control characters as %20: they would end a header line."""
    return F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20")


def record_headers(kind: Column, page_id: Column, url: Column, date: str, digest: Column, refers_to: Column, refers_url: Column, n: Column) -> Column:
    """The exact bytes of a record's headers."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = kind == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n.cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(n)
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", urn(page_id)),
        _field("WARC-Target-URI", _escaped(url)),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(_field("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _field("WARC-Refers-To", urn(refers_to)), _field("WARC-Refers-To-Target-URI", _escaped(refers_url)))).otherwise(""),
        _field("Content-Type", F.lit("application/http;msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit("\r\n"),
        http,
    ).cast("binary")


def archive_pages(pages: DataFrame, scratch: Scratch, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Archive a record for every page.

    Of pages with equal payloads of ``least`` bytes or more, the one with the smallest id (null last; then by url, null
    first, then by place in the input) is a response and the others are revisits of it. Null html is empty. Repeated rows are records
    of their own. A null url has no header. Other columns are ignored; no pages give an archive without records.
    """
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    ids = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    # written, so that a row's place can't change if it has to be computed again
    facts = scratch.table(ids.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("n"), F.monotonically_increasing_id().alias("seq")), "facts")
    first = facts.filter(F.col("n") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("odd"), "page_id", "url", "seq")).alias("first"), F.count("*").alias("copies"))
    first = scratch.table(first.filter("copies > 1").select("digest", "first"), "first")
    of = facts.join(small(first, BROADCAST_ROWS), "digest", "left").withColumn("kind", F.expr("if(first.seq <> seq, 'revisit', 'response')"))
    headers = record_headers(F.col("kind"), F.col("page_id"), F.col("url"), date, F.col("digest"), F.col("first.page_id"), F.col("first.url"), F.col("n"))
    records = of.select("seq", headers.alias("headers"), "digest", (F.col("kind") == "response").alias("own"))
    return Archive(scratch.table(records, "records"), scratch.table(store_payloads(ids.select("payload")), "payloads"))


def page_records(archive: Archive) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to), from the restored records alone."""
    text = F.decode("headers", "utf-8")
    field = lambda name, body="([^\r]*)": F.regexp_extract(text, f"\n{name}: {body}\r", 1)
    number = lambda name: F.nullif(field(name, "<urn:page:(-?[0-9]*)>"), F.lit("")).cast("long")
    return restore(archive).select(
        number("WARC-Record-ID").alias("page_id"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        "payload",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


# ---------------------------------------------------------------- files


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _write(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, sink, n = TaskContext.get(), None, 0
        name = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        for batch in batches:
            for headers, own, payload in zip(*(batch.column(c).to_pylist() for c in ("headers", "own", "payload"))):
                if sink is None:
                    store_, root = _open(name)
                    store_.create_dir(root.rpartition("/")[0], recursive=True)
                    sink = store_.open_output_stream(root, compression=None)  # the name must not compress it again
                sink.write(gzip.compress(headers + (payload if own and payload else b"") + END, mtime=0))
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([n], pa.int64())})

    return run


def write_files(archive: Archive, base: str) -> DataFrame:
    """Write the archive's records as files of one gzip member each, below ``base``; the plan's rows are (path, n_records).

    A file has the name of the attempt that wrote it: only files that the rows name belong to the result.
    """
    return restore(archive).select("headers", "own", "payload").mapInArrow(_write(base), "path string, n_records long")


def _records(stream: io.BufferedReader) -> Iterator[tuple[bytes, bytes]]:
    """(headers with their blank line, block) of each record."""
    while True:
        lines = [stream.readline()]
        if not lines[0]:
            return
        while lines[-1] not in (b"\r\n", b""):
            lines.append(stream.readline())
        head = b"".join(lines)
        length = next((int(x.partition(b":")[2]) for x in lines if x.lower().startswith(b"content-length:")), None)
        if length is None:
            raise ValueError("A record without a length")
        block, end = stream.read(length), stream.read(4)
        if len(block) < length or end != END:
            raise ValueError(f"A record of {length} bytes is cut short")
        yield head, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store_, root = _open(path)
            held, size = [], 0
            with store_.open_input_stream(root, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
                for k, (head, block) in enumerate(_records(stream)):
                    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(b":") for x in head.split(b"\r\n"))}
                    cut = block.find(END) + len(END) if fields.get(b"content-type", b"").startswith(b"application/http") and END in block else 0
                    claimed = fields.get(b"warc-payload-digest")
                    own = fields.get(b"warc-type") != b"revisit"
                    held.append((path, k, head + block[:cut], block[cut:] if own else None, claimed and claimed.decode(), own))
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(held)
                        held, size = [], 0
            if held:
                yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"path": pa.string(), "at": pa.int64(), "headers": pa.binary(), "payload": pa.binary(), "claimed": pa.string(), "own": pa.bool_()}
    return pa.RecordBatch.from_pydict({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows))})


def read_files(files: DataFrame) -> DataFrame:
    """(path, at, headers, payload, claimed, own) of the records in files (path), plain or of gzip members.

    ``claimed`` is the payload's digest as the headers have it; a record that isn't ``own`` (a revisit) has no payload. The task that
    reads a file holds one record, or 8 MB of them. A file that is cut short is an error.
    """
    return files.select("path").distinct().repartition("path").mapInArrow(_read, "path string, at long, headers binary, payload binary, claimed string, own boolean")


def query(spark, sf_dir: str) -> DataFrame:
    archive = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), Scratch(spark, "warc"))
    return page_records(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, n >= 100 AND row_number() OVER w > 1 AS again, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS FIRST))
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM r
"""
