"""Product codes of vectors: one small codebook for each part, trained by whole integer rounds.

Components become integers, so every distance and every sum is exact and the result doesn't depend on how rows
are dealt. In each round the driver builds a kd-tree for each part's codebook (16 entries unless told otherwise)
and broadcasts the trees; tasks find every part's nearest entry by branch and bound and add up the parts of each
entry; the sums, one row for each entry of each part and task, are added by Spark and give the next codebooks.
A branch whose bound equals the best distance is still visited, so the lower of two equally near entries wins.
The table of vectors is only scanned; no vector is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, small

#: Entries in a leaf of a tree.
LEAF = 4
LABEL_ROWS = 100_000


# ---------------------------------------------------------------- the tree


class KDTree:
    """A kd-tree over the rows of an integer matrix, for many queries at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(np.arange(len(entries)))

    def _build(self, ids: np.ndarray):
        points = self.entries[ids]
        low, high = points.min(0), points.max(0)
        axis = int(np.argmax(high - low))
        if len(ids) <= LEAF or low[axis] == high[axis]:
            return (np.sort(ids),)
        values = np.sort(points[:, axis])
        cut = values[(len(ids) - 1) // 2]
        if cut == values[-1]:
            cut = values[values < cut][-1]
        left = points[:, axis] <= cut
        above = values[values > cut][0]  # the least of the right side: no entry lies in between
        return axis, cut, above, self._build(ids[left]), self._build(ids[~left])

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each query's nearest entry, the lowest index among equals."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.entries))
        self._visit(self.root, np.ascontiguousarray(queries.T), np.arange(len(queries)), np.zeros(len(queries), np.int64), best, index)
        return index, best

    def _visit(self, node, columns, rows, bound, best, index) -> None:
        rows = rows[bound <= best[rows]]  # equal bounds too: they may hide an equal distance at a lower index
        if not len(rows):
            return
        if len(node) == 1:
            for e in node[0]:
                gap = columns[:, rows] - self.entries[e][:, None]
                d = np.einsum("ij,ij->j", gap, gap)
                old = best[rows]
                better = (d < old) | ((d == old) & (e < index[rows]))
                best[rows[better]], index[rows[better]] = d[better], e
            return
        axis, cut, above, left, right = node
        x = columns[axis, rows]
        near = 2 * x <= cut + above
        to_left, to_right = np.maximum(x - cut, 0), np.maximum(above - x, 0)
        for here, child, far in ((near, left, 0), (~near, right, 0), (~near, left, 1), (near, right, 1)):
            if here.any():
                gap = (to_left if child is left else to_right)[here] if far else np.zeros(int(here.sum()), np.int64)
                self._visit(child, columns, rows[here], gap * gap, best, index)


# ---------------------------------------------------------------- rounds


def bound(size: int) -> int:
    """The largest integer component (2^27 for 64 components): squared distances of whole vectors stay below 2^62."""
    return math.isqrt((1 << 60) // size)


def integers(vector: Column, scale: int, most: int) -> Column:
    """floor(``scale`` * x) of each component, held within ``most``."""
    return F.transform(vector, lambda x: F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), F.floor(x.cast("double") * scale).cast("double"))).cast("int"))


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, size).astype(np.int64)


def _sums(trees, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, n = size // parts, len(trees.value[0].entries)
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            for p, tree in enumerate(trees.value):
                own = x[:, p * width : (p + 1) * width]
                index, _ = tree.nearest(own)
                counts[p] += np.bincount(index, minlength=n)
                order = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.diff(index[order], prepend=-1))
                if len(first):
                    sums[p][index[order][first]] += np.add.reduceat(own[order], first, axis=0)
        if counts.any():
            at = np.indices((parts, n, width)).reshape(3, -1)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array(at[0], pa.int32()), "entry": pa.array(at[1], pa.int32()), "place": pa.array(at[2], pa.int32()), "n": pa.array(np.repeat(counts.reshape(-1), width)), "total": pa.array(sums.reshape(-1))}
            )

    return run


def _assigned(trees, size: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = size // parts
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, tree in enumerate(trees.value):
                code[:, p], d = tree.nearest(x[:, p * width : (p + 1) * width])
                error += d
            codes = [bytes(row).hex() for row in code]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "label": batch.column("label"), "code": codes, "error": pa.array(error)})

    return run


RESULT = "code string, error long, label_error long, codebooks_sha256 string"


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"):
    """(codes, codebooks): a row (id, code, error, label_error, codebooks_sha256) for each usable vector, and the final
    codebooks as an array (part, entry, place).

    Left out: null vectors, those with null, NaN or infinite components, and those whose length isn't that of
    the first usable vector or that can't be cut into ``parts`` equal parts. The first ``entries`` (at most 256) usable
    vectors by id start the codebooks; null ids come last, equal ids are ordered by their vectors, and fewer vectors
    give fewer entries. Integers are held within ``bound``. Repeated rows count each. Null labels make one group.
    Without usable vectors there are no rows and no codebooks. Other columns are ignored.
    """
    spark = vectors.sparkSession
    raw = F.col(f"`{vector_col}`")
    rows = vectors.filter(usable(raw) & (F.size(raw) > 0) & (F.size(raw) % parts == 0))
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), raw.alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.select("id", "v").orderBy(*order).limit(1).collect()
    empty = spark.createDataFrame([], f"`{id_col}` {dict(vectors.dtypes)[id_col]}, {RESULT}")
    if not first:
        return empty, np.zeros((parts, 0, 0), np.int64)
    size = len(first[0].v)
    rows = rows.filter(F.size("v") == size).withColumn("v", integers(F.col("v"), scale, bound(size)))
    width = size // parts
    start = np.array([r.v for r in rows.select("id", "v").orderBy(*order).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([KDTree(b) for b in books])
        sums = rows.select("v").mapInArrow(_sums(trees, size, parts), "part int, entry int, place int, n long, total long")
        books = books.copy()
        # one row for each number of the codebooks
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0").collect():
            books[r.part, r.entry, r.place] = r.total // r.n
        trees.unpersist()
    trees = spark.sparkContext.broadcast([KDTree(b) for b in books])
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    kinds = dict(rows.dtypes)
    coded = rows.mapInArrow(_assigned(trees, size, parts), f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    scratch = Scratch(spark, "codes")
    coded = scratch.table(coded, "coded")
    sums = scratch.table(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    by_label = small(sums.withColumnRenamed("label", "l"), LABEL_ROWS)
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    return out, books


def query(spark, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql(rounds: int = 6) -> str:
    assign = """a{k} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{k} b USING (part, place) GROUP BY ALL) GROUP BY ALL
)"""
    update = """b{n} AS MATERIALIZED (
  SELECT part, entry, place, coalesce((s - ((s % c) + c) % c) // c, b.x)::BIGINT AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, place, sum(v.x)::BIGINT AS s, count(*) AS c FROM v JOIN a{k} USING (vec_id, part) GROUP BY ALL) USING (part, entry, place)
)"""
    steps = ",\n".join(f"{assign.format(k=k)},\n{update.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""
WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (
  SELECT vec_id, (i * 8) // len(embedding) AS part, i % (len(embedding) // 8) AS place, floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM e, unnest(range(0, len(embedding))) t(i)
),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT 16),
b0 AS MATERIALIZED (SELECT part, entry, place, x FROM v JOIN f USING (vec_id)),
{steps},
{assign.format(k=rounds)},
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN e USING (vec_id), h
"""


SQL = _sql()
