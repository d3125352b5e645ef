"""Layered proximity graphs as edge tables (src, level, pos, dst): traced search, build, checks."""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.scratch import scratch_table, shared_folder

TRACE = (
    "query long, sequence int, type string, level int, id long, distance double, entries array<long>, "
    "considered array<struct<id:long,distance:double,accepted:boolean,evicted:long,via:long>>, "
    "items array<struct<id:long,distance:double>>, evaluations int"
)


class LocalGraph:
    """A graph that fits in one process: ``links[level][row]`` and the vectors by row."""

    def __init__(self, vectors: dict[int, np.ndarray], links: dict[int, dict[int, list[int]]], entry: int):
        self.place = {r: i for i, r in enumerate(vectors)}
        self.vectors = np.array(list(vectors.values()), np.float32).astype(np.float64)
        self.links, self.entry = links, entry
        self.top, self.size = max(links, default=0), len(vectors)

    def vector(self, row: int) -> np.ndarray:
        return self.vectors[self.place[row]]

    def values(self, rows: list[int]) -> np.ndarray:
        return self.vectors[[self.place[r] for r in rows]]

    def linked(self, row: int, level: int) -> list[int] | tuple[()]:
        return self.links.get(level, {}).get(row, ())

    def distances(self, q: np.ndarray, rows: list[int]) -> list[float]:
        if not rows:
            return []
        # accumulation adds strictly in dimension order
        dots = np.add.accumulate(self.values(rows) * q, axis=1)[:, -1]
        return [0.0 if d < 0 else 2.0 if d > 2 else d for d in (1 - dots).tolist()]

    def layer(self, q, entries: list[int], ef: int, level: int, known: dict[int, float], note) -> list[tuple[float, int]]:
        """Best-first search of one layer: the ef nearest (distance, row) found, in order. ``note`` gets its events, if any are wanted."""

        def measure(rows: list[int]) -> None:
            fresh = [r for r in rows if r not in known]
            known.update(zip(fresh, self.distances(q, fresh)))

        measure(entries)
        frontier = [(known[r], r) for r in entries]
        heapq.heapify(frontier)
        kept = [(-d, -r) for d, r in frontier]
        heapq.heapify(kept)
        seen = set(entries)
        if note:
            note("enter", level, entries=list(entries))
        while frontier:
            d, row = heapq.heappop(frontier)
            worst = (-kept[0][0], -kept[0][1])
            if len(kept) >= ef and (d, row) > worst:
                if note:
                    note("stop", level, id=row, distance=worst[0])
                break
            near = [n for n in self.linked(row, level) if n not in seen]
            seen.update(near)
            measure(near)
            considered = []
            for n in near:
                item = (known[n], n)
                accepted = len(kept) < ef or item < (-kept[0][0], -kept[0][1])
                evicted = None
                if accepted:
                    heapq.heappush(frontier, item)
                    heapq.heappush(kept, (-item[0], -item[1]))
                    if len(kept) > ef:
                        evicted = -heapq.heappop(kept)[1]
                if note:
                    considered.append({"id": n, "distance": item[0], "accepted": accepted, "evicted": evicted, "via": row})
            if note:
                note("expand", level, id=row, distance=d, considered=considered)
        return sorted((-d, -r) for d, r in kept)

    def search(self, q, k: int, ef: int, limit: int = 2048) -> tuple[list[tuple[float, int]], list[dict]]:
        """The k nearest (distance, row) found and the trace of at most ``limit`` events."""
        if not 1 <= k <= ef or ef > self.size or not 0 <= limit <= 10_000:
            raise ValueError("Invalid search budget")
        q = np.asarray(q, np.float32).astype(np.float64)
        known: dict[int, float] = {}
        events: list[dict] = []

        def note(kind, level, **more):
            if len(events) < limit:
                events.append({"sequence": len(events), "type": kind, "level": level, **more, "evaluations": len(known)})

        entries, told = [self.entry], note if limit else None
        for level in range(self.top, 0, -1):
            entries = [self.layer(q, entries, 1, level, known, told)[0][1]]
            note("descend", level, id=entries[0])
        found = self.layer(q, entries, ef, 0, known, told)[:k]
        note("results", 0, items=[{"id": r, "distance": d} for d, r in found])
        return found, events


#: Queries of a row of work, and about how many of them a task searches in its shard, whose graph it reads once.
ASKED = 64
ASKED_OF_TASK = 1024

#: Rows of a block of a whole graph, about, and bytes of such blocks that a worker keeps.
BLOCK_ROWS, KEPT_BYTES = 4096, 256 << 20


def _tables(folder: str) -> Iterator[pa.Table]:
    """The tables of the Parquet files in a folder."""
    store, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    for info in store.get_file_info(pafs.FileSelector(root)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                yield pq.read_table(f)


class BlockGraph(LocalGraph):
    """A graph of any size in stored blocks of neighbouring rows: a search reads those that it touches, and the last used ``kept`` bytes stay.

    ``blocks`` has the first row and the number of each block, in order.
    """

    def __init__(self, path: str, blocks: list[tuple[int, int]], entry: int, top: int, size: int, kept: int = KEPT_BYTES):
        self.path, self.entry, self.top, self.size, self.kept = path, entry, top, size, kept
        self.starts, self.numbers = [start for start, _ in blocks], [number for _, number in blocks]
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        self.bytes = 0

    def _block(self, number: int) -> tuple[np.ndarray, ...]:
        """Rows, vectors, and the links: where each row's levels, each level's links begin, and the links."""
        if number in self.held:
            self.held[number] = self.held.pop(number)  # the last used are last
            return self.held[number]
        part = pa.concat_tables(_tables(f"{self.path}/shard=0/part={number}")).sort_by("row").combine_chunks()
        links = part.column("links").combine_chunks()
        values = part.column("embedding").combine_chunks().flatten().to_numpy().astype(np.float32, copy=False).reshape(part.num_rows, -1)
        block = (part.column("row").to_numpy(), values, links.offsets.to_numpy(), links.values.offsets.to_numpy(), links.values.values.to_numpy())
        self.held[number] = block
        self.bytes += sum(a.nbytes for a in block)
        while self.bytes > self.kept and len(self.held) > 1:
            self.bytes -= sum(a.nbytes for a in self.held.pop(next(iter(self.held))))
        return block

    def _find(self, row: int) -> tuple[tuple[np.ndarray, ...], int]:
        i = bisect_right(self.starts, row) - 1
        block = self._block(self.numbers[i]) if i >= 0 else None
        at = int(np.searchsorted(block[0], row)) if block else 0
        if not block or at == len(block[0]) or block[0][at] != row:
            raise KeyError(row)
        return block, at

    def vector(self, row: int) -> np.ndarray:
        block, at = self._find(row)
        return block[1][at].astype(np.float64)

    def values(self, rows: list[int]) -> np.ndarray:
        return np.array([block[1][at] for block, at in map(self._find, rows)]).astype(np.float64)

    def linked(self, row: int, level: int) -> list[int] | tuple[()]:
        (_, _, levels, begins, links), at = self._find(row)
        own = levels[at] + level
        return links[begins[own] : begins[own + 1]].tolist() if own < levels[at + 1] else ()


_loaded: dict[tuple[str, int], LocalGraph] = {}


def _shard_graph(path: str, shard: int) -> LocalGraph:
    vectors, links, head = {}, {}, {}
    for part in _tables(f"{path}/shard={shard}"):
        values = part.column("embedding").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1)
        for row, v, own in zip(part.column("row").to_pylist(), values, part.column("links").to_pylist()):
            vectors[row] = v
            for level, to in enumerate(own):
                links.setdefault(level, {})[row] = to
        head = {"entry": part.column("entry")[0].as_py()}
    return LocalGraph(vectors, links, head["entry"])


def _stored_graph(path: str, shard: int, whole: tuple | None = None) -> LocalGraph:
    """A shard's graph, read from its files by the task that needs it, or a ``whole`` one read by block; a worker keeps the last one."""
    if (path, shard) not in _loaded:
        _loaded.clear()
        _loaded[path, shard] = BlockGraph(path, *whole) if whole else _shard_graph(path, shard)
    return _loaded[path, shard]


def write_graph(vectors: DataFrame, edges: DataFrame, entry: int, path: str, block: int = BLOCK_ROWS) -> str:
    """Store one given graph as shard 0: (row, embedding, links by level, entry), by parts of about ``block`` neighbouring rows."""
    level = edges.groupBy("src", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("to"))
    top = level.groupBy(F.col("src").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("level", "to"))).alias("by"), F.max("level").alias("top"))
    none = F.array().cast("array<bigint>")
    links = F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0))), lambda x: F.coalesce(F.try_element_at("by", x), none))
    stored = vectors.select("row", "embedding").join(top, "row", "left").select("row", "embedding", links.alias("links"), F.lit(entry).cast("long").alias("entry"), F.lit(0).alias("shard"))
    dealt = stored.repartitionByRange(max(1, -(-vectors.count() // block)), "row").withColumn("part", F.spark_partition_id())
    dealt.write.partitionBy("shard", "part").parquet(path)
    return path


def _blocks_of(stored: DataFrame) -> tuple[list[tuple[int, int]], int, int, int]:
    """First row and number of each block of a whole graph, its entry, highest level and rows."""
    own = stored.groupBy("part").agg(F.min("row").alias("start"), F.max(F.size("links")).alias("levels"), F.first("entry").alias("entry"), F.count("*").alias("n"))
    found = sorted(own.collect(), key=lambda r: r.start)  # one row for each block
    return [(r.start, r.part) for r in found], found[0].entry, max(r.levels for r in found) - 1, sum(r.n for r in found)


def write_shards(vectors: DataFrame, path: str, shards: int, m: int = 12, ef: int = 100, seed: int = 43) -> str:
    """Build a graph for each shard of rows, in parallel, and store them below ``path`` as ``write_graph`` does."""

    def run(key, part):
        part = part.sort_by("row")
        rows, values = part.column("row").to_pylist(), part.column("embedding").to_pylist()
        g = build_graph(rows, values, m, ef, seed)
        links = [[g.links[x][row] for x in range(g.top + 1) if row in g.links[x]] for row in rows]
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "row": pa.array(rows, pa.int64()),
                "embedding": pa.array(values, pa.list_(pa.float32())),
                "links": pa.array(links, pa.list_(pa.list_(pa.int64()))),
                "entry": pa.array([g.entry] * len(rows), pa.int64()),
            }
        )

    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), "row", "embedding")
    # ranges far smaller than a shard put each into a task of its own, which hashes of so few keys don't
    built = dealt.repartitionByRange(4 * shards, "shard").groupBy("shard").applyInArrow(run, "shard int, row long, embedding array<float>, links array<array<long>>, entry long")
    built.write.partitionBy("shard").parquet(path)
    return path


def stored_edges(spark, path: str) -> DataFrame:
    """(shard, src, level, pos, dst, entry) of stored graphs."""
    level = spark.read.parquet(path).select("shard", F.col("row").alias("src"), "entry", F.posexplode("links").alias("level", "to"))
    return level.select("shard", "src", "level", F.posexplode("to").alias("pos", "dst"), "entry")


def search_stored(queries: DataFrame, path: str, k: int, ef: int, limit: int = 2048) -> DataFrame:
    """Trace events, with their shard, of a greedy layered search of every stored graph for each query (query, q).

    The expansion order depends on a heap, so a query in a shard is one task's work. Work is ranged by shard and block of queries, so
    a task has about a thousand queries for one shard and reads that shard's graph itself, of a whole graph the blocks that it touches; no graph passes the driver. In a shard of fewer than ``ef`` rows the
    search is as wide as the shard. Without a ``limit`` there is an event with the results alone.
    """
    spark = queries.sparkSession
    stored = spark.read.parquet(path)
    shards = sorted(r.shard for r in stored.select("shard").distinct().collect())  # one row for each shard
    n = stored.count()
    whole = _blocks_of(stored) if "part" in stored.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), *_trace_fields()])
        for batch in batches:
            for shard, asked in zip(batch.column("shard").to_pylist(), batch.column("asked").to_pylist()):
                g, rows = _stored_graph(path, shard, whole), []
                own = min(ef, g.size)
                for a in asked:
                    found, events = g.search(a["q"], min(k, own), own, limit)
                    if not limit:
                        events = [{"sequence": 0, "type": "results", "level": 0, "items": [{"id": r, "distance": d} for d, r in found]}]
                    rows += [{f: e.get(f) for f in schema.names} | {"query": a["query"], "shard": shard} for e in events]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    if not shards:
        return spark.createDataFrame([], f"shard int, {TRACE}")
    if len(shards) == 1 and (not 1 <= k <= ef or ef > n or not 0 <= limit <= 10_000):
        raise ValueError("Invalid search budget")
    blocks = queries.select("query", "q", F.floor(F.monotonically_increasing_id() / ASKED).alias("block")).groupBy("block").agg(F.collect_list(F.struct("query", "q")).alias("asked"))
    work = blocks.select("block", "asked", F.explode(F.array(*(F.lit(s) for s in shards))).alias("shard")) if len(shards) <= 1000 else blocks.crossJoin(spark.createDataFrame([(s,) for s in shards], "shard int"))
    tasks = len(shards) * max(1, -(-queries.count() // ASKED_OF_TASK))
    return work.repartitionByRange(tasks, "shard", "block").sortWithinPartitions("shard").select("shard", "asked").mapInArrow(run, f"shard int, {TRACE}")


def merged_results(trace: DataFrame, k: int) -> DataFrame:
    """(query, rank, row, distance): the k best of the results that traces of several shards give."""
    from pyspark.sql import Window

    found = trace.filter("type = 'results'").select("query", F.inline("items")).select("query", F.col("id").alias("row"), "distance")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "row", "distance")


def traced_search(vectors: DataFrame, edges: DataFrame, queries: DataFrame, entry: int, k: int, ef: int, limit: int = 2048) -> DataFrame:
    """Trace events of a greedy layered search of one given graph, of any size, for each query (query, q).

    The graph is stored by blocks in the shared folder; a task reads the blocks that its searches touch and keeps a bounded share of them.
    """
    path = write_graph(vectors, edges, entry, f"{shared_folder(vectors.sparkSession)}/catalog/graph-{uuid.uuid4().hex}")
    return search_stored(queries, path, k, ef, limit).drop("shard")


def _trace_fields():
    pair = [("id", pa.int64()), ("distance", pa.float64())]
    return [
        ("query", pa.int64()), ("sequence", pa.int32()), ("type", pa.string()), ("level", pa.int32()), ("id", pa.int64()), ("distance", pa.float64()),
        ("entries", pa.list_(pa.int64())),
        ("considered", pa.list_(pa.struct([*pair, ("accepted", pa.bool_()), ("evicted", pa.int64()), ("via", pa.int64())]))),
        ("items", pa.list_(pa.struct(pair))), ("evaluations", pa.int32()),
    ]


def results_of(trace: DataFrame) -> DataFrame:
    """(query, rank, row, distance) from the results event of each trace."""
    return trace.filter("type = 'results'").select("query", F.posexplode("items").alias("p", "i")).select("query", (F.col("p") + 1).alias("rank"), F.col("i.id").alias("row"), F.col("i.distance").alias("distance"))


def served_trace(trace: DataFrame, served: DataFrame) -> DataFrame:
    """A trace whose results leave held rows out; the traversal still crosses them."""
    item = trace.select("query", "sequence", F.posexplode("items").alias("p", "i"))
    kept = item.join(served.select(F.col("row").alias("ok")), F.col("i.id") == F.col("ok"), "left_semi")
    kept = kept.groupBy("query", "sequence").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "i"))), lambda s: s["i"]).alias("items"))
    return trace.drop("items").join(kept, ["query", "sequence"], "left")


def trace_rows(trace: DataFrame, limit: int = 48) -> DataFrame:
    """(query, row, seq): the distinct rows that a trace names, by first appearance."""
    named = trace.select("query", "sequence", F.array_union(F.coalesce("entries", F.array().cast("array<long>")), F.array_union(F.array_compact(F.array("id")), F.coalesce(F.transform("considered", lambda c: c["id"]), F.array().cast("array<long>")))).alias("rows"))
    each = named.select("query", F.posexplode("rows").alias("p", "row"), "sequence").groupBy("query", "row").agg(F.min(F.struct("sequence", "p")).alias("first"))
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("query").orderBy("first"))
    return each.withColumn("seq", nth).filter(F.col("seq") <= limit).select("query", "row", "seq")


def beats(trace: DataFrame) -> DataFrame:
    """(query, sequence, kind, duration): the events that explain a trace, in order.

    The entry, the first expansion with an accepted candidate, the descent to the lowest level of such expansions, the
    first, middle and last of these at that level, and the last event as results; the later kind of an event wins.
    """
    accepts = lambda e: (e["type"] == "expand") & F.exists(F.coalesce(e["considered"], F.array().cast("array<boolean>")), lambda a: a)
    event = F.struct("sequence", "type", "level", F.transform("considered", lambda c: c["accepted"]).alias("considered"))
    # a trace has a bounded number of events
    t = trace.groupBy("query").agg(F.array_sort(F.collect_list(event)).alias("e"))
    t = t.withColumn("x", F.filter("e", accepts))
    t = t.withColumn("lowest", F.array_min(F.transform("x", lambda e: e["level"]))).withColumn("entry", F.get(F.filter("e", lambda e: e["type"] == "enter"), F.lit(0))["sequence"])
    t = t.withColumn("local", F.filter("x", lambda e: e["level"] == F.col("lowest")))
    down = F.filter("e", lambda e: (e["type"] == "enter") & (e["level"] == F.col("lowest")) & (e["sequence"] > F.col("entry")))
    at = lambda a, i: F.get(a, i)["sequence"]
    n = F.size("local")
    put = [
        (F.col("entry"), "entry", 800), (at(F.col("x"), F.lit(0)), "branch", 540), (at(down, F.lit(0)), "descent", 440),
        (at(F.col("local"), F.lit(0)), "branch", 540), (at(F.col("local"), F.floor((n - 1) / 2).cast("int")), "branch", 540), (at(F.col("local"), n - 1), "branch", 540),
        (at(F.col("e"), F.size("e") - 1), "results", 1600),
    ]
    each = t.select("query", F.posexplode(F.array(*(F.struct(s.alias("sequence"), F.lit(kind).alias("kind"), F.lit(ms).alias("duration")) for s, kind, ms in put))).alias("p", "b"))
    last = each.filter("b.sequence is not null").groupBy("query", "b.sequence").agg(F.max_by("b", "p").alias("b"))
    return last.select("query", "b.sequence", "b.kind", "b.duration")


def beat_edges(trace: DataFrame) -> DataFrame:
    """The three nearest accepted candidates of each expansion; for beats' edges, join with ``beats``."""
    top = F.slice(F.array_sort(F.transform(F.filter("considered", lambda c: c["accepted"]), lambda c: F.struct(c["distance"].alias("distance"), c["id"].alias("id"), c["via"].alias("via")))), 1, 3)
    return trace.filter("type = 'expand'").select("query", "sequence", F.inline(top)).select("query", "sequence", F.col("via").alias("a"), F.col("id").alias("b"), "distance")


def stored_links(edges: DataFrame, row: int, served: DataFrame | None = None) -> DataFrame:
    """(level, links): the links of a row by level in stored order, without held targets."""
    own = edges.filter(F.col("src") == row)
    if served is not None:
        own = own.join(served.select(F.col("row").alias("dst")), "dst", "left_semi")
    return own.groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("links"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, level): each pair of ends once, at its highest level."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("level").alias("level"))


def structure_problems(edges: DataFrame, nodes: DataFrame, m: int) -> DataFrame:
    """(problem, src, level): self links, unknown ends, repeated ends, too many links, a neighbour without that level."""
    levels = edges.groupBy("src").agg(F.max("level").alias("top"))
    known = nodes.select(F.col("row").alias("dst"), F.lit(True).alias("known"))
    flat = edges.join(known, "dst", "left").join(levels.select(F.col("src").alias("dst"), F.col("top").alias("dst_top")), "dst", "left")
    each = flat.select(
        "src",
        "level",
        F.array_compact(
            F.array(
                F.when(F.col("src") == F.col("dst"), "self link"),
                F.when(F.col("known").isNull(), "unknown end"),
                F.when(F.col("known") & (F.coalesce("dst_top", F.lit(0)) < F.col("level")), "neighbour lacks the level"),
            )
        ).alias("p"),
    ).select(F.explode("p").alias("problem"), "src", "level")
    by_node = edges.groupBy("src", "level").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("u"))
    many = by_node.filter(F.col("n") > F.when(F.col("level") == 0, 2 * m).otherwise(m)).select(F.lit("too many links").alias("problem"), "src", "level")
    twice = by_node.filter("n > u").select(F.lit("repeated link").alias("problem"), "src", "level")
    return each.unionByName(many).unionByName(twice)


def first_seen(edges: DataFrame) -> DataFrame:
    """``undirected`` with the link that names a pair first, by row, level and place: first_src, first_level, first_pos."""
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    own = pair.agg(F.max("level").alias("level"), F.min(F.struct("src", "level", "pos")).alias("first"))
    return own.select("a", "b", "level", F.col("first.src").alias("first_src"), F.col("first.level").alias("first_level"), F.col("first.pos").alias("first_pos"))


def reachable(edges: DataFrame, start: int, block: int = 4096) -> DataFrame:
    """(row, hops) from ``start`` over directed level-0 links; ``start`` alone if it has none.

    Rows are dealt to blocks of ``block`` neighbouring rows. In each round the tasks of the blocks that got shorter ways walk
    all links inside of them to the end and send what leaves them to other blocks, least hops first combined. Rounds
    grow with the number of times that a shortest way changes its block, not with its hops. A block's links are bounded by the degree.
    """
    spark, name = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/catalog/seen-{uuid.uuid4().hex}"
    at = lambda c: F.floor(F.col(c) / block).alias("block")
    links = scratch_table(edges.filter("level = 0 and src is not null and dst is not null").select(at("src"), "src", "dst").distinct(), "links")
    seen = lambda: spark.read.schema("row long, hops int").parquet(name).groupBy("row").agg(F.min("hops").alias("hops"))
    asked = spark.createDataFrame([(start, 0)], "row long, hops int")
    asked.limit(0).write.parquet(name)
    k = 0
    while True:
        live = asked.select(at("row")).distinct()
        own = links.join(live, "block", "left_semi")
        known = seen().select(at("row"), "row", "hops").join(live, "block", "left_semi").withColumn("sent", F.lit(False))
        state = known.unionByName(asked.select(at("row"), "row", "hops").withColumn("sent", F.lit(True)))
        step = own.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_block_walk, "row long, hops int, inside boolean")
        step = scratch_table(step, f"walk-{k}")
        k += 1
        step.filter("inside").select("row", "hops").write.mode("append").parquet(name)
        out = step.filter("not inside").groupBy("row").agg(F.min("hops").alias("hops"))
        asked = scratch_table(out.join(seen().withColumnRenamed("hops", "had"), "row", "left").filter("had is null or hops < had").select("row", "hops"), f"asked-{k}")
        if not asked.limit(1).count():
            return seen()


def _block_walk(links: pa.Table, state: pa.Table) -> pa.Table:
    """Shorter ways inside a block, and the ways that leave it: (row, hops, inside)."""
    hops, sent = {}, {}
    for row, h, new in zip(*(state.column(c).to_pylist() for c in ("row", "hops", "sent"))):
        into = sent if new else hops
        into[row] = min(h, into.get(row, h))
    to: dict[int, list[int]] = {}
    for src, dst in zip(links.column("src").to_pylist(), links.column("dst").to_pylist()):
        to.setdefault(src, []).append(dst)
    heap = [(h, row) for row, h in sent.items() if h < hops.get(row, h + 1)]
    heapq.heapify(heap)
    inside = set(to) | set(hops) | set(sent)
    shorter, out = {}, {}
    while heap:
        h, row = heapq.heappop(heap)
        if h >= hops.get(row, h + 1):
            continue
        hops[row] = shorter[row] = h
        for n in to.get(row, ()):
            if n in inside:
                if h + 1 < hops.get(n, h + 2):
                    heapq.heappush(heap, (h + 1, n))
            elif h + 1 < out.get(n, h + 2):
                out[n] = h + 1
    rows = [(r, h, True) for r, h in shorter.items()] + [(r, h, False) for r, h in out.items()]
    return pa.table({"row": pa.array([r[0] for r in rows], pa.int64()), "hops": pa.array([r[1] for r in rows], pa.int32()), "inside": pa.array([r[2] for r in rows], pa.bool_())})


def mulberry32(seed: int) -> Iterator[float]:
    """The 32-bit generator of the graph build."""
    state = seed & 0xFFFFFFFF
    while True:
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = state
        x = ((x ^ x >> 15) * (x | 1)) & 0xFFFFFFFF
        x ^= (x + ((x ^ x >> 7) * (x | 61))) & 0xFFFFFFFF
        yield ((x ^ x >> 14) & 0xFFFFFFFF) / 4294967296


def diverse(graph: LocalGraph, candidates: list[tuple[float, int]], most: int) -> list[int]:
    """Candidates in order that are no nearer to a chosen one than to the query."""
    own = sorted(candidates)
    limit = np.array([d for d, _ in own])
    block = graph.vectors[[graph.place[r] for _, r in own]]
    free, chosen = np.ones(len(own), bool), []
    for i, (_, r) in enumerate(own):
        if free[i]:
            chosen.append(r)
            if len(chosen) == most:
                break
            # each chosen row is held against all later ones at once
            dots = np.add.accumulate(block[i + 1 :] * block[i], axis=1)[:, -1]
            free[i + 1 :] &= np.clip(1 - dots, 0, 2) >= limit[i + 1 :]
    return chosen


def build_graph(rows: list[int], vectors: list, m: int = 12, ef: int = 100, seed: int = 43) -> LocalGraph:
    """Sequential insertion with seeded levels; deterministic in the order of ``rows``."""
    draws = mulberry32(seed)
    graph = LocalGraph(dict(zip(rows, vectors)), {0: {}}, rows[0] if rows else 0)
    top = -1
    for row in rows:
        level = min(24, int(-math.log(max(next(draws), 2.0**-52)) / math.log(m)))
        q = graph.vector(row)
        for x in range(level + 1):
            graph.links.setdefault(x, {})[row] = []
        if top < 0:
            graph.entry, top = row, level
            continue
        known: dict[int, float] = {}
        entries = [graph.entry]
        for x in range(top, level, -1):
            entries = [graph.layer(q, entries, 1, x, known, None)[0][1]]
        for x in range(min(level, top), -1, -1):
            found = graph.layer(q, entries, ef, x, known, None)
            chosen = diverse(graph, found, m)
            graph.links[x][row] = chosen
            for n in chosen:
                own = graph.links[x][n]
                own.append(row)
                most = 2 * m if x == 0 else m
                if len(own) > most:
                    graph.links[x][n] = diverse(graph, list(zip(graph.distances(graph.vector(n), own), own)), most)
            entries = [r for _, r in found]
        if level > top:
            graph.entry, top = row, level
    graph.top = max(top, 0)
    return graph


def shard_count(vectors: DataFrame, rows: int = 10_000) -> int:
    """Shards of about ``rows`` rows, two at least."""
    return max(2, -(-vectors.count() // rows))


def shard_search(vectors: DataFrame, queries: DataFrame, shards: int, k: int, ef: int, m: int = 12, construction: int = 100, seed: int = 43) -> DataFrame:
    """(query, rank, row, distance): the k best of a graph search in every shard, each stored first."""
    path = write_shards(vectors, f"{shared_folder(vectors.sparkSession)}/catalog/shards-{uuid.uuid4().hex}", shards, m, construction, seed)
    return merged_results(search_stored(queries, path, k, ef, 0), k)


def csr(edges: DataFrame) -> DataFrame:
    """(src, level, neighbors, offset): links in stored order and where they begin in the flat array."""
    from pyspark.sql import Window

    packed = edges.groupBy("src", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("neighbors"))
    sized = packed.withColumn("cell", F.floor(F.col("src") / 65536))
    totals = sized.groupBy("cell").agg(F.sum(F.size("neighbors")).alias("n"))
    before = totals.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(F.size("neighbors")).over(Window.partitionBy("cell").orderBy("src", "level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("inside", inside).join(before, "cell").select("src", "level", "neighbors", (F.col("before") + F.col("inside")).alias("offset"))


def from_csr(packed: DataFrame) -> DataFrame:
    return packed.select("src", "level", F.posexplode("neighbors").alias("pos", "dst"))
