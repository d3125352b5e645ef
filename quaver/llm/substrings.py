"""Removal of word windows that start earlier in the corpus, with FM-indexes.

1. Every window's key is the least hash of its short word grams. Neighbouring windows with the same key form
   a segment. Equal windows have equal keys, so a window can only repeat where its key does.
2. Keys are counted over all documents. Segments whose key occurs once, and don't repeat themselves, are done.
3. Of equal segments the first stays and all windows of the others are repeats.
4. The different segments of a key are dealt to shards by key, so equal windows meet. Each shard builds a
   compressed FM-index (wavelet matrix over the Burrows-Wheeler transform) of its segments in corpus order
   and streams them through backward search; a window is a repeat if the least position in its interval
   is smaller than its own.
5. A key with very many different segments must not fill one shard. Its windows are combined by hash before
   any shuffle, down to the earliest start of each; all other starts are repeats, so a passage that a
   third of all documents share is one row of each task.

Keys and positions are shuffled, and words of segments that need a search; texts are shuffled twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm import common
from quaver.llm.common import Scratch, gram_hashes, mix, small, word_blocks

#: Words of a gram.
GRAM = 6


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over x[i : i + width]; the result has len(x) - width + 1 values."""
    h, acc = 1, x
    while 2 * h <= width:
        acc = op(acc[: len(acc) - h], acc[h:])
        h *= 2
    rest = width - h
    return op(acc[: len(acc) - rest], acc[rest:]) if rest else acc


def _range_hash(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = common._power_table(len(words) + 1)
    acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * p[: len(words)], dtype=np.uint64)])
    return mix((acc[b] - acc[a]) * q[a] + (b - a).astype(np.uint64))


def segments_of(words: np.ndarray, first: np.ndarray, size: int):
    """(text, start word in it, windows, key, content hash, self-repeating) of the segments of a block."""
    empty = np.zeros(0, np.int64)
    n_windows = np.maximum(np.diff(first) - size + 1, 0)
    if not n_windows.any():
        return empty, empty, empty, empty, empty, empty.astype(bool)
    grams, _ = gram_hashes(words, first, GRAM)
    width = size - GRAM + 1
    key = np.zeros(len(words), np.uint64)
    least = _sliding(grams, width, np.minimum)
    key[: len(least)] = least
    text = np.repeat(np.arange(len(n_windows)), n_windows)
    local = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = first[:-1][text] + local
    k = key[at]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(text)))
    # grams that are the least of a window, next to an equal one: the segments around them may repeat themselves
    top = np.zeros(len(words), np.uint64)
    top[at] = k
    padded = np.concatenate([np.zeros(width - 1, np.uint64), top])
    minimal = np.flatnonzero(grams == _sliding(padded, width, np.maximum))
    close = (grams[minimal[1:]] == grams[minimal[:-1]]) & (np.diff(minimal) <= width)
    mark = np.zeros(len(words) + 2 * width + 2, np.int64)
    np.add.at(mark, np.maximum(minimal[:-1][close] - width, 0), 1)
    np.add.at(mark, minimal[1:][close] + width, -1)
    marked = np.concatenate([[0], np.cumsum(np.cumsum(mark) > 0)])
    own = marked[at[begin] + count] - marked[at[begin]] > 0
    content = _range_hash(words, at[begin], at[begin] + count + size - 1)
    return text[begin], local[begin], count, k[begin].view(np.int64), content.view(np.int64), own & (count > 1)


def _segment(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, first, _ in word_blocks(batch.column("text")):
                text, start, count, key, content, own = segments_of(words, first, size)
                rows = pa.array(text + i)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(key),
                        "content": pa.array(content),
                        "doc_id": batch.column("doc_id").take(rows),
                        "place": batch.column("place").take(rows),
                        "start": pa.array(start.astype(np.int32)),
                        "windows": pa.array(count.astype(np.int32)),
                        "own": pa.array(own),
                    }
                )

    return run


def _listed(batch: pa.RecordBatch):
    """The listed segments of each block of a batch: (row, first word in the block, words, key, start, hashes of words)."""
    lists = batch.column("segments")
    offsets, listed = lists.offsets.to_numpy(), lists.values
    start, windows, key = (listed.field(f).to_numpy(zero_copy_only=False) for f in ("start", "windows", "key"))
    for i, j, words, first, _ in word_blocks(batch.column("text")):
        own = slice(offsets[i], offsets[j])
        doc = np.repeat(np.arange(i, j), np.diff(offsets[i : j + 1]))
        if len(doc):
            from_ = start[own].astype(np.int64)
            yield doc, first[doc - i] + from_, windows[own].astype(np.int64), key[own].view(np.uint64), from_, words


def _deal(size: int, shards: int):
    """Words of the listed segments, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, windows, key, from_, words in _listed(batch):
                n = windows + size - 1
                ends = np.cumsum(n)
                flat = words[np.arange(ends[-1]) + np.repeat(at - ends + n, n)]
                of = pa.array(doc)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array((key % np.uint64(shards)).astype(np.int32)),
                        "doc_id": batch.column("doc_id").take(of),
                        "place": batch.column("place").take(of),
                        "start": pa.array(from_.astype(np.int32)),
                        "words": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64))),
                    }
                )

    return run


def _windows(size: int):
    """Two hashes and the start of every window of the listed segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, windows, _, from_, words in _listed(batch):
                step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                begin = np.repeat(at, windows) + step
                of = pa.array(np.repeat(doc, windows))
                yield pa.RecordBatch.from_pydict(
                    {
                        "h1": pa.array(_range_hash(words, begin, begin + size).view(np.int64)),
                        "h2": pa.array(_range_hash(mix(words ^ np.uint64(0x5851F42D4C957F2D)), begin, begin + size).view(np.int64)),
                        "doc_id": batch.column("doc_id").take(of),
                        "place": batch.column("place").take(of),
                        "start": pa.array((np.repeat(from_, windows) + step).astype(np.int32)),
                    }
                )

    return run


def _search(size: int):
    """All segments of a partition in one index; they come in corpus order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quaver.llm.fm_index import FMIndex, repeated_windows

        parts, places, starts = [], [], []
        for batch in batches:
            lists = batch.column("words")
            parts.append((lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())))
            places.append(batch.column("place").to_numpy())
            starts.append(batch.column("start").to_numpy())
        if not parts:
            return
        flat, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        place, start = np.concatenate(places), np.concatenate(starts).astype(np.int64)
        if not len(sizes):
            return
        symbols = np.unique(flat, return_inverse=True)[1] + 1
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        seq = np.zeros(len(flat) + len(sizes), np.int64)  # 0 ends every segment
        seq[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        index = FMIndex(seq, 1 << (size.bit_length() - 1))
        at = np.sort(repeated_windows(index, seq, begin, sizes - size + 1, size))
        of = np.searchsorted(begin, at, side="right") - 1
        # neighbouring windows as one row
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(of) != 0)
        head = np.flatnonzero(new)
        yield pa.RecordBatch.from_pydict(
            {
                "place": pa.array(place[of[head]], pa.int64()),
                "start": pa.array((start[of[head]] + at[head] - begin[of[head]]).astype(np.int32), pa.int32()),
                "windows": pa.array(np.diff(np.append(head, len(at))).astype(np.int32), pa.int32()),
            }
        )

    return run


def _joined(raw: np.ndarray, w_start: np.ndarray, w_end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text joined by one space: Arrow offsets and bytes. ``first`` is each text's first word, one longer."""
    count = np.diff(first)
    if not len(w_start):
        return np.zeros(len(count) + 1, np.int32), np.zeros(0, np.uint8)
    base = int(w_start[0])
    part = raw[base : int(w_end[-1]) + 1].copy()
    begins, ends = np.zeros(len(part) + 1, np.int8), np.zeros(len(part) + 1, np.int8)
    begins[w_start - base] = 1
    ends[w_end - base] = 1
    inside = np.cumsum(begins - ends, dtype=np.int8)[: len(part)].astype(bool)
    # the byte behind every word but a text's last separates it from the next
    last = np.zeros(len(w_start), bool)
    last[first[1:][count > 0] - 1] = True
    gap = w_end[~last] - base
    part[gap] = 0x20
    inside[gap] = True
    sizes = np.concatenate([[0], np.cumsum(w_end - w_start)])
    bytes_of = sizes[first[1:]] - sizes[first[:-1]] + np.maximum(count - 1, 0)
    return np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int32), part[inside]


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("repeats")
            for i, j, _, first, (raw, w_start, w_end) in word_blocks(batch.column("text"), hashed=False):
                counts = np.diff(first)
                keep = np.ones(len(w_start), bool)
                spans: list[list[dict]] = [[] for _ in range(i, j)]
                for d in np.flatnonzero(np.asarray(listed.slice(i, j - i).is_valid())).tolist():
                    merged: list[list[int]] = []
                    for g in sorted((g["start"], g["start"] + g["windows"] + size - 1) for g in listed[i + d].as_py()):
                        keep[first[d] + g[0] : first[d] + g[1]] = False
                        if merged and g[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], g[1])
                        else:
                            merged.append(list(g))
                    spans[d] = [{"start": x, "end": y} for x, y in merged]
                before = np.concatenate([[0], np.cumsum(keep)])
                left = before[first[1:]] - before[first[:-1]]
                offsets, data = _joined(raw, w_start[keep], w_end[keep], np.concatenate([[0], np.cumsum(left)]))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "n_words": pa.array(counts.astype(np.int64)),
                        "n_removed": pa.array((counts - left).astype(np.int64)),
                        "kept": pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(data)]),
                        "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    }
                )

    return run


def dedup_substrings(docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 250_000, hot_segments: int = 4_000) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (words left, joined by one space), removed (word ranges).

    A word goes if it is in a window of ``size`` words of one document whose words also start earlier: at a
    smaller doc_id, or earlier in the same document. Windows are judged on the input. Null ids come first;
    rows of equal id are ordered by their place in the input. Null texts have no words; texts of fewer words
    have no windows. The windows of a key with more than
    ``hot_segments`` different segments are combined by hash. Rows are written once with their places.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    source = scratch.table(source, "source")
    segments = scratch.table(source.mapInArrow(_segment(size), f"key long, content long, doc_id {kind}, place long, start int, windows int, own boolean"), "segments")
    keys = scratch.table(segments.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("o")).filter("c > 1 or o").select("key"), "keys")
    cand = scratch.table(segments.join(small(keys, 200_000), "key"), "candidates")
    scratch.drop("segments")

    here = F.struct("doc_id", "place", "start")
    distinct = cand.groupBy("key", "content").agg(F.min(here).alias("f"), F.count("*").alias("c"), F.max("windows").alias("windows"), F.max("own").alias("own"))
    distinct = distinct.select("key", "content", F.col("f.place").alias("place"), F.col("f.start").alias("start"), "windows", "own", "c")
    distinct = scratch.table(distinct, "distinct")
    firsts = distinct.filter("c > 1").select("key", "content", F.col("place").alias("p"), F.col("start").alias("q"))
    equal = cand.join(small(firsts, 100_000), ["key", "content"]).filter("place <> p or start <> q").select("place", "start", "windows")
    equal = scratch.table(equal, "equal")

    wide = distinct.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("o")).filter("n > 1 or o")
    wide = scratch.table(wide.select("key", (F.col("n") > hot_segments).alias("hot")), "wide")
    asked = scratch.table(distinct.join(small(wide, 200_000), "key").select("key", "place", "start", "windows", "hot"), "asked")
    cold, hot = asked.filter("not hot"), asked.filter("hot")
    words = cold.agg(F.coalesce(F.sum(F.col("windows") + size - 1), F.lit(0)).alias("w")).first()["w"]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(words) // shard_words + 1)

    def with_segments(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("place").agg(F.collect_list(F.struct("key", "start", "windows")).alias("segments"))
        return source.join(by_doc, "place").select("doc_id", "place", "text", "segments")

    dealt = with_segments(cold).mapInArrow(_deal(size, shards), f"shard int, doc_id {kind}, place long, start int, words array<long>")
    met = dealt.repartition(shards, "shard").sortWithinPartitions("doc_id", "place", "start").select("place", "start", "words")
    searched = scratch.table(met.mapInArrow(_search(size), "place long, start int, windows int"), "searched")

    each = scratch.table(with_segments(hot).mapInArrow(_windows(size), f"h1 long, h2 long, doc_id {kind}, place long, start int"), "windows")
    earliest = each.groupBy("h1", "h2").agg(F.min(here).alias("f"), F.count("*").alias("c")).filter("c > 1")
    earliest = scratch.table(earliest.select("h1", "h2", F.col("f.place").alias("p"), F.col("f.start").alias("q")), "earliest")
    later = each.join(small(earliest, 100_000), ["h1", "h2"]).filter("place <> p or start <> q").select("place", "start", F.lit(1).alias("windows"))
    later = scratch.table(later, "later")
    scratch.keep("source", "equal", "searched", "later")

    repeats = equal.unionByName(searched).unionByName(later).groupBy("place").agg(F.collect_list(F.struct("start", "windows")).alias("repeats"))
    joined = source.join(repeats, "place", "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(_cut(size), f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
