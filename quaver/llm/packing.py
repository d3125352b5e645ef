"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

How documents fill sequences depends only on how many pieces there are of each length, and there are no
more lengths than the capacity. So the lengths are counted by Spark, the instance is reduced and packed
as a histogram on the driver (a table of at most ``capacity`` rows, whatever the input), and each piece
finds its place by its rank among the pieces of its length. Ranks come from per-partition counts and a
window inside each partition, so a length that is very common is not gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, small

#: (number of sequences, lengths in each of them)
Pattern = tuple[int, tuple[int, ...]]


class _Counts:
    """Lengths that are left, in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def largest(self, limit: int) -> int:
        """The largest length up to ``limit``, or 0."""
        i = bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else 0

    def smallest_sum(self, k: int) -> int:
        """The sum of the k smallest pieces; more than any capacity if there are fewer."""
        total = 0
        for s in self.sizes:
            use = min(k, self.n[s])
            total, k = total + s * use, k - use
            if not k:
                return total
        return 1 << 60


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that can be fixed without losing the optimum, and the lengths that remain.

    For a piece j, a set of at most three pieces with j dominates all others that hold j if every other
    set's pieces fit into its own: a partner that fills the sequence, the largest partner if no two
    others fit or if no two others that fit are longer than it, or the two largest partners if no pair
    has both of its pieces longer than the second.
    """
    left, fixed = _Counts(counts), []
    changed = True
    while changed:
        changed = False
        j = left.largest(capacity)
        while j:
            fix = _dominating(left, j, capacity)
            if fix:
                uses = {s: fix.count(s) for s in fix}
                k = min(left.n[s] // u for s, u in uses.items())
                for s, u in uses.items():
                    left.take(s, u * k)
                fixed.append((k, fix))
                changed = True
                j = left.largest(j)
            else:
                j = left.largest(j - 1)
    return fixed, left.n


def _dominating(left: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    room = capacity - j
    own = left.n[j]
    left.take(j, 1)  # partners come from the other pieces
    try:
        k = left.largest(room)
        if not k:
            return (j,)
        if k == room or left.smallest_sum(2) > room:
            return (j, k)
        if left.smallest_sum(3) <= room:
            return None  # three or more others fit: not decided by small sets
        # no more than two others fit
        best, second = 0, 0
        for a in left.sizes[: bisect_right(left.sizes, room)]:
            b = left.largest(min(a, room - a))
            if b == a and left.n[a] < 2:
                b = left.largest(a - 1)
            if b and a + b <= room:
                best = max(best, a + b)
            if a == k:
                second = b
        if best <= k:
            return (j, k)
        if second:
            above = [s for s in left.sizes if s > second][:2]
            least = 1 << 60
            if above:
                least = 2 * above[0] if left.n[above[0]] > 1 else above[0] + above[1] if len(above) > 1 else 1 << 60
            if least > room:
                return (j, k, second)
        return None
    finally:
        if j not in left.n:
            insort(left.sizes, j)
        left.n[j] = own


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, with sequences of equal content handled together."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, k: int, content: tuple[int, ...]) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([k, content])

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            i = bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                k, content = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[i]
            else:
                room, k, content = capacity, -(-c // (capacity // s)), ()
            each = room // s
            full = min(k, c // each)
            if full:
                put(room - each * s, full, content + (s,) * each)
                c -= full * each
                k -= full
            if k and c and not full:
                put(room - c * s, 1, content + (s,) * c)
                c, k = 0, k - 1
            if k and content:
                put(room, k, content)
    return [(k, content) for group in open_.values() for k, content in group]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[Pattern]:
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Runs of ranks: by (length, rank of the first), the first sequence and the offset in it."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for k, content in patterns:
        at = 0
        for s in content:
            rank = used.get(s, 0)
            rows.append((s, rank, sequence, at))
            used[s] = rank + k
            at += s
        sequence += k
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quaver.llm.tokens import encoder, is_spaced

        coder = encoder(path, "<u4", is_spaced(path))
        end = np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column("doc_id")
            rows, piece, start, length, crc = [], [], [], [], []
            for i, body in enumerate(coder.encode(batch.column("text").to_pylist())):
                body += end
                for k, at in enumerate(range(0, len(body), 4 * capacity)):
                    some = body[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(some) // 4)
                    crc.append(zlib.crc32(some))
            n = len(rows)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids.take(pa.array(rows, pa.int64())),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "part": pa.array([part] * n, pa.int32()),
                    "seq": pa.array(range(seq, seq + n), pa.int64()),
                }
            )
            seq += n

    return run


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # one sorted key for (length, rank): ranks are below 2**48
        keys = (t["length"] << 48) + t["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(t["sequence"][i] + rank - t["rank"][i], pa.int64())
            columns["offset"] = pa.array(t["offset"][i], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document's pieces of at most ``capacity`` tokens in sequences.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A null or empty text is the end id
    alone. Only documents longer than ``capacity`` are cut. Repeated rows are packed one by one; an empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    cut = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _cutter(tokenizer_path, end_id, capacity), schema + ", part int, seq long"
    )
    pieces = scratch.table(cut, "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most one row for each length up to the capacity
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(pack_histogram(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "length").orderBy("seq")
    ranked = (
        pieces.withColumn("own", F.row_number().over(inside) - 1)
        .join(small(base, 200_000), ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).cast("long").alias("rank"))
    )
    return ranked.mapInArrow(_placer(shared), schema + ", sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
