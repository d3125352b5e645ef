"""Benchmark decontamination by Wu-Manber multi-pattern search.

Benchmark texts become windows of words, written as bytes with a space around every word. Windows of
like length share a table: block shift tables skip positions where no window can end, the hash of the
last block selects a bucket of windows, and direct comparison confirms an occurrence. Documents are
searched in Arrow batches; all positions of a batch that are still open advance together in numpy, one
skip at a time, so the tables are the only state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import FOLD, Scratch, free_names, text_bytes

#: Bytes of a word: not [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = True
WORD_BYTE[0x61:0x7B] = True
WORD_BYTE[0x80:] = True


def normalised(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array in which every word has one space before it and each text ends with a space.

    Also the offset of each text in it, one longer. A text without words is one space.
    """
    sizes = end - start
    n = len(start)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(base[-1]) + 1, 0x20, np.uint8)
    if n and len(raw):
        if (end[:-1] == start[1:]).all():
            body = FOLD[raw[int(start[0]) : int(end[-1])]]
            body = np.where(WORD_BYTE[body], body, np.uint8(0x20))
            where = np.ones(len(out), bool)
            where[base] = False
            out[where] = body
        else:
            for i in range(n):
                piece = FOLD[raw[int(start[i]) : int(end[i])]]
                out[base[i] + 1 : base[i] + 1 + len(piece)] = np.where(WORD_BYTE[piece], piece, np.uint8(0x20))
    keep = np.ones(len(out), bool)
    space = out == 0x20
    keep[1:] = ~(space[1:] & space[:-1])
    # a text's first space always stays, so that texts without words keep their place
    keep[base[:-1]] = True
    keep[-1] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    # each text ends with the space that begins the next
    first = at[base[:-1]]
    return out[keep], np.append(first, int(keep.sum()) - 1)


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    flat, _ = normalised(data, np.array([0]), np.array([len(data)]))
    return flat.tobytes().split()


def windows_of(items: list[tuple[str, str]], size: int) -> dict[bytes, list[int]]:
    """Window bytes (`` w1 w2 ... ``) to the positions of their items."""
    found: dict[bytes, list[int]] = {}
    for k, (_, text) in enumerate(items):
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(b" " + b" ".join(w[i : i + size]) + b" ", [])
            owners = found[b" " + b" ".join(w[i : i + size]) + b" "]
            if not owners or owners[-1] != k:
                owners.append(k)
    return found


class Table:
    """The Wu-Manber tables of patterns of at least ``m`` bytes."""

    BITS = 18

    def __init__(self, patterns: list[bytes], owners: list[list[int]]):
        self.patterns, self.owners = patterns, owners
        self.m = min(map(len, patterns))
        self.block = max(1, min(8, self.m // 2))
        blocks = self.m - self.block + 1
        rows = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << self.BITS, blocks, np.uint16 if blocks < 65536 else np.uint32)
        for j in range(blocks):  # later blocks lie nearer to the end and shift less
            h = self.hash_rows(rows[:, j : j + self.block])
            self.shift[h] = np.minimum(self.shift[h], blocks - 1 - j)
        last = self.hash_rows(rows[:, blocks - 1 :])
        order = np.argsort(last, kind="stable")
        self.bucket = order
        self.keys, self.starts = np.unique(last[order], return_index=True)
        self.starts = np.append(self.starts, len(order))

    def hash_rows(self, rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(0x100000001B3) + rows[:, k]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def hash_at(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for k in range(self.block):
            h = h * np.uint64(0x100000001B3) + flat[at + k]
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, flat: np.ndarray, lane: int = 256) -> Iterator[tuple[int, int]]:
        """(position, pattern) of every occurrence in ``flat``, by lanes that skip side by side."""
        n = len(flat) - self.m + 1
        if n <= 0:
            return
        at = np.arange(0, n, lane)
        stop = np.minimum(at + lane, n)
        tail = self.m - self.block
        hits = []
        while len(at):
            step = self.shift[self.hash_at(flat, at + tail)].astype(np.int64)
            hit = at[step == 0]
            if len(hit):
                hits.append(hit)
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not hits:
            return
        text = flat.tobytes()
        all_hits = np.concatenate(hits)
        all_hits = all_hits[flat[all_hits] == 0x20]  # windows begin between words
        slots = np.searchsorted(self.keys, self.hash_at(flat, all_hits + tail))
        for p, b in zip(all_hits.tolist(), slots.tolist()):
            for q in self.bucket[self.starts[b] : self.starts[b + 1]].tolist():
                if text.startswith(self.patterns[q], p):
                    yield p, q


def tables_of(items: list[tuple[str, str]], size: int) -> list[Table]:
    """A table for each power of two of the windows' bytes, so that a short window doesn't shorten the shifts of long ones."""
    classes: dict[int, list[bytes]] = {}
    windows = windows_of(items, size)
    for w in windows:
        classes.setdefault(len(w).bit_length(), []).append(w)
    return [Table(sorted(c), [windows[w] for w in sorted(c)]) for _, c in sorted(classes.items())]


def search_batch(texts, tables: list[Table], block: int = 4 << 20):
    """(words, spans, items) per text of an Arrow array: spans are merged word ranges, items are positions."""
    raw, start, end = text_bytes(texts)
    n = len(start)
    words = np.zeros(n, np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    i = 0
    while i < n:  # in blocks of bytes, for bounded memory
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        flat, first = normalised(raw, start[i:j], end[i:j])
        space = flat == 0x20
        before_word = space[:-1] & ~space[1:]
        begins = np.concatenate([[0], np.cumsum(before_word), [0]])  # words that begin before a position
        begins[-1] = begins[-2]
        words[i:j] = np.diff(begins[first])
        for table in tables:
            for p, q in table.search(flat):
                d = int(np.searchsorted(first, p, side="right")) - 1
                if p + len(table.patterns[q]) - 1 > first[d + 1]:
                    continue  # runs into the next text
                w = int(begins[p] - begins[first[d]])
                spans[i + d].append((w, w + table.patterns[q].count(b" ") - 1))
                items[i + d].update(table.owners[q])
        i = j
    return words, spans, items


def merged_size(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_bytes``, by a hash of the item."""
    known = benchmark.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    total = known.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // block_bytes))
    return [known.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [known]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = 8 << 20
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted), spans.

    The benchmark is collected in blocks of about ``block_bytes`` of text (one item is never split). Each block
    is searched in a pass of its own, which is written before the next block is collected, so what the driver and
    the executors hold is bounded whatever the benchmark's size.
    Null texts have no words; items with a null id or no words are ignored; items that share an id count as
    one. Repeated documents are judged one by one if the benchmark is one block; with more blocks rows of equal
    doc_id and text are told apart by their places, which are written once. Spans are merged word ranges [start, end).
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
    spark = docs.sparkSession
    doc_type = docs.schema[id_col].dataType.simpleString()
    schema = schema.replace("doc_id long", f"doc_id {doc_type}", 1)
    blocks = _benchmark_blocks(benchmark, item_col, text_col, block_bytes)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def tables(block: DataFrame):
        items = sorted((r["item"], r["body"]) for r in block.collect())
        return spark.sparkContext.broadcast((tables_of(items, size), [i for i, _ in items]))

    if len(blocks) == 1:
        return source.mapInArrow(_searcher(tables(blocks[0]), False), schema)
    scratch = Scratch(spark, "contamination")
    placed = scratch.table(source.withColumn("place", F.monotonically_increasing_id()), "placed")
    passes = []
    for k, block in enumerate(blocks):
        shared = tables(block)
        passes.append(scratch.table(placed.mapInArrow(_searcher(shared, True), schema + ", place long"), f"pass-{k}"))
        shared.destroy()
    scratch.drop("placed")
    return _combine(passes)


def _searcher(shared, with_place: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, names = shared.value
        for batch in batches:
            words, spans, items = search_batch(batch.column("text"), tables)
            found = [sorted({names[k] for k in x}) for x in items]
            flat = [merge(s) for s in spans]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(words, pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in s) for s in flat], pa.int64()),
                "n_items": pa.array([len(x) for x in found], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                "contaminated": pa.array([bool(s) for s in flat], pa.bool_()),
                "items": pa.array(found, pa.list_(pa.string())),
                "spans": pa.array([[{"start": a, "end": b} for a, b in s] for s in flat], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
            if with_place:
                columns["place"] = batch.column("place")
            yield pa.RecordBatch.from_pydict(columns)

    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _combine(passes: list[DataFrame]) -> DataFrame:
    """The union of what the passes over benchmark blocks have found in each document."""
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    # one row of each pass per document: groups are as small as the number of blocks
    grouped = every.groupBy("place").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
    )
    union = F.expr(
        "aggregate(s, cast(array() as array<struct<start:long,end:long>>), (a, x) -> "
        "if(size(a) > 0 and x.start <= element_at(a, -1).end, "
        "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))), concat(a, array(x))))"
    )
    return grouped.withColumn("spans", union).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "items",
        "spans",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.0, size: int = 10) -> DataFrame:
    """The rows of ``docs`` of whose words no more than ``share`` are in benchmark windows, with all their columns."""
    (at,) = free_names(docs, "place")
    # written once, so that a place names the same row in both passes
    marked = Scratch(docs.sparkSession, "marked").table(docs.withColumn(at, F.monotonically_increasing_id()), "marked")
    hits = find_contamination(marked, benchmark, size, id_col=at).filter(F.col("n_hit") > share * F.col("n_words"))
    return marked.join(hits.select(F.col("doc_id").alias(at)), at, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + 9], ' ') AS g FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM w, ks, unnest(range(1, len(w) + 1)) t(i) WHERE i + k - 1 <= len(w)),
h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM h), unnest(range(i, i + k)) t(p) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
