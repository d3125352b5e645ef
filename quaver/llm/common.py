"""Shared helpers: the shared scratch folder, size-checked broadcasts, byte-level word spans."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` where the session has it. Without it a local master
    (tests) gets a temporary folder, and a cluster gets a folder in the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quaver_scratch"
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="quaver-scratch-")
    return _local_roots[app]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/quaver/{spark.sparkContext.applicationId}"


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.schemas = spark, {}
        self.base = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        self.schemas[name] = df.schema
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        _delete(self.spark, self.path(name) if name else self.base)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which a result still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
            if status.getPath().getName() not in names:
                self.drop(status.getPath().getName())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table that this session's application wrote; call it when no result is needed any more."""
    _delete(spark, _own_folder(spark))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted), else ``df``.

    ``df`` is a written table, or columns or distinct values of one, so that counting it repeats no work.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add to ``df`` that it doesn't have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def pinned(c: Column) -> Column:
    """``c``, in a projection below which no filter is pushed.

    A filter pushed through costly projections copies their expressions into its condition, once for each
    use; one column that counts as non-deterministic prevents it. The value is that of ``c``.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# ---------------------------------------------------------------- bytes and words


def text_bytes(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end) of an Arrow string array; nulls are empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    start, end = off[:-1].copy(), off[1:].copy()
    if column.null_count:
        end = np.where(np.asarray(column.is_valid()), end, start)
    return raw, start, end


#: Bytes that separate words: the space and \t to \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Folds A-Z to a-z and leaves other bytes alone.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, sep: np.ndarray):
    """Words of a batch of texts: (word start, word end, first word of each text; one longer).

    ``sep`` says for each byte whether it separates words. Texts are given by byte ranges
    of ``raw`` that follow each other.
    """
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    base, top = int(start[0]), int(end.max(initial=start[0]))
    part = raw[base:top]
    is_word = np.zeros(len(part) + 2, bool)
    is_word[1:-1] = ~sep[part]
    inside = is_word.view(np.int8)
    edge = np.diff(inside)
    starts = edge == 1
    # a text border also ends a word
    cut = end[(end > start) & (end < top)] - base
    both = cut[is_word[cut] & is_word[cut + 1]]
    w_start = np.flatnonzero(starts[: len(part)])
    w_end = np.flatnonzero(edge[1:] == -1) + 1
    if len(both):
        # such a border is inside a run of words, so no word starts or ends there yet
        w_start = np.insert(w_start, np.searchsorted(w_start, both), both)
        w_end = np.insert(w_end, np.searchsorted(w_end, both), both)
    w_start, w_end = w_start + base, w_end + base
    first = np.searchsorted(w_start, np.append(start, end[-1]), side="left")
    if (end[:-1] != start[1:]).any():  # a null text in between that holds bytes
        keep = np.zeros(len(w_start), bool)
        for a, b in zip(np.searchsorted(w_start, start), np.searchsorted(w_start, end)):
            keep[a:b] = True
        w_start, w_end = w_start[keep], w_end[keep]
        first = np.append(np.searchsorted(w_start, start), len(w_start))
    return w_start, w_end, first


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted different values; ``np.unique`` hashes them first, which takes far longer."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_power_cache: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power_cache.get("p", ())) < n:
        size = 1 << int(n - 1).bit_length() if n > 1 else 1
        _power_cache["p"], _power_cache["q"] = _powers(_P, size), _powers(_P_INV, size)
    return _power_cache["p"], _power_cache["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, w_start: np.ndarray, w_end: np.ndarray, fold: np.ndarray | None = None, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of powers (in blocks)."""
    out = np.empty(len(w_start), np.uint64)
    table = _BYTE if fold is None else _BYTE[fold]
    i, n = 0, len(w_start)
    while i < n:
        lo = int(w_start[i])
        j = max(int(np.searchsorted(w_end, lo + block, side="right")), i + 1)
        hi = int(w_end[j - 1])
        p, q = _power_table(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[raw[lo:hi]] * p[: hi - lo], out=acc[1:])
        s, e = w_start[i:j] - lo, w_end[i:j] - lo
        out[i:j] = mix((acc[e] - acc[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words at every word, and a mask of those inside one text."""
    n = len(words)
    acc = np.zeros(n, np.uint64)
    m = max(0, n - k + 1)
    for i in range(k):
        acc[:m] = mix(acc[:m] * np.uint64(_P) + words[i : i + m] + np.uint64(i + 1))
    ok = np.zeros(n, bool)
    ok[:m] = True
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    ok[:m] &= owner[:m] == owner[k - 1 : k - 1 + m]
    return acc, ok


def word_blocks(texts, sep: np.ndarray = SPACES, fold: np.ndarray | None = None, block: int = 4 << 20, hashed: bool = True):
    """An Arrow array of texts by blocks of about ``block`` bytes, which bound the memory of what follows.

    Yields (first text, last text, word hashes, first word of each text, (bytes, word starts, word ends)); no hashes
    (None) if they aren't wanted.
    """
    raw, start, end = text_bytes(texts)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, side="right")))
        w_start, w_end, first = word_spans(raw, start[i:j], end[i:j], sep)
        yield i, j, word_hashes(raw, w_start, w_end, fold) if hashed else None, first, (raw, w_start, w_end)
        i = j
