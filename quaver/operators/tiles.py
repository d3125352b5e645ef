"""The map: Morton order, quadtree tiles, weighted samples, regions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaver.scratch import scratch_table

BITS = 16
CAP = 1024
MAX_LEVEL = 12


def domain(layout: DataFrame) -> DataFrame:
    """One row (x0, y0, side): the square around the bounds with a margin of 1/512."""
    b = layout.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    side = F.greatest(F.col("b") - F.col("a"), F.col("d") - F.col("c"), F.lit(1e-6)) * (1 + 1 / 512)
    return b.select(((F.col("a") + F.col("b")) / 2 - side / 2).alias("x0"), ((F.col("c") + F.col("d")) / 2 - side / 2).alias("y0"), side.alias("side"))


def _spread(c: Column) -> Column:
    """Zeros between the low 16 bits."""
    v = c.bitwiseAND(0xFFFF)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def morton(qx: Column, qy: Column) -> Column:
    return _spread(qx.cast("long")).bitwiseOR(F.shiftleft(_spread(qy.cast("long")), 1))


def coded(layout: DataFrame) -> DataFrame:
    """Adds qx, qy (16-bit grid) and code; broadcasts the domain, which is one row."""
    top = (1 << BITS) - 1
    grid = lambda c, o: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((F.col(c) - F.col(o)) * ((1 << BITS) / F.col("side")))))
    at = layout.crossJoin(F.broadcast(domain(layout))).withColumn("qx", grid("x", "x0")).withColumn("qy", grid("y", "y0"))
    return at.withColumn("code", morton(F.col("qx"), F.col("qy"))).drop("x0", "y0", "side")


def tile(points: DataFrame, z: int, x: int, y: int, cap: int = CAP) -> DataFrame:
    """(row, weight) of a tile of coded points: all rows if at most ``cap``, else the lowest row of each
    occupied cell of the finest level with at most ``cap`` cells, weighted by the rows in it."""
    if not (0 <= z <= MAX_LEVEL and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError("Tile outside the map")
    prefix = sum(((x >> i & 1) << (2 * i)) | ((y >> i & 1) << (2 * i + 1)) for i in range(z))
    shift = 2 * (BITS - z)
    inside = points.filter((F.col("code") >= prefix << shift) & (F.col("code") < (prefix + 1) << shift))
    depths = range(1, BITS - z + 1)
    # every depth's cells in one pass; counts only grow with the depth
    sizes = inside.agg(F.count("*").alias("total"), *(F.approx_count_distinct(F.shiftright("code", shift - 2 * d)).alias(f"d{d}") for d in depths)).first()
    if sizes["total"] <= cap:
        return inside.select("row", F.lit(1).cast("long").alias("weight"))
    best = None
    guess = max([d for d in depths if sizes[f"d{d}"] <= cap * 1.3], default=1)
    for d in range(min(guess + 1, depths[-1]), 0, -1):  # the estimate is close; the count decides
        cells = inside.groupBy(F.shiftright("code", shift - 2 * d).alias("cell")).agg(F.min("row").alias("row"), F.count("*").alias("weight"))
        if cells.limit(cap + 1).count() <= cap:
            best = cells
            break
    return best.select("row", "weight")


def pyramid(points: DataFrame, levels: int) -> DataFrame:
    """(z, x, y, total) of all occupied tiles of the levels 0 to ``levels``; each level's totals add up to all rows."""
    each = points.select(F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("z"), "qx", "qy")
    cell = lambda c: F.expr(f"shiftright(cast({c} as long), {BITS} - z)")
    return each.groupBy("z", cell("qx").alias("x"), cell("qy").alias("y")).agg(F.count("*").alias("total"))


def overview_sample(layout: DataFrame, cap: int) -> DataFrame:
    """(row, weight): the lowest row of each occupied cell of a grid that shrinks until at most ``cap`` cells are occupied."""
    b = layout.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    x0, x1, y0, y1, n = b
    if n <= cap:
        return layout.select("row", F.lit(1).cast("long").alias("weight"))
    grid = int(np.sqrt(cap))
    while True:
        at = lambda c, o, w, g=grid: F.least(((F.col(c) - F.lit(o)) / F.lit(w) * g).cast("long"), F.lit(g - 1))
        cell = at("x", x0, max(x1 - x0, 1e-9)) * grid + at("y", y0, max(y1 - y0, 1e-9))
        cells = layout.groupBy(cell.alias("cell")).agg(F.min("row").alias("row"), F.count("*").alias("weight"))
        if grid <= 2 or cells.limit(cap + 1).count() <= cap:
            return cells.select("row", "weight")
        grid -= max(1, grid // 16)


def round_robin(points: DataFrame, limit: int) -> DataFrame:
    """Rows of tiles (tile, row) taken in turn: each tile's first, then each one's second, up to ``limit``."""
    turn = F.row_number().over(Window.partitionBy("tile").orderBy("row"))
    return points.withColumn("turn", turn).orderBy("turn", "tile").limit(limit)


def nearest_point(points: DataFrame, px: float, py: float, reach: float = 14.0) -> DataFrame:
    """The nearest point (row, x, y, is_result) within reach; results come first on ties, then lower rows."""
    d = F.hypot(F.col("x") - px, F.col("y") - py)
    return points.withColumn("d", d).filter(F.col("d") <= reach).orderBy("d", F.desc("is_result"), "row").limit(1)


def thin_grid(points: DataFrame, cell: float, budget: int) -> DataFrame:
    """One point (pos, x, y, priority) of each screen cell, the first; priority points always stay; up to ``budget``."""
    key = [F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("priority"), "pos"))
    return points.withColumn("nth", nth).filter(F.col("priority") | (F.col("nth") == 1)).orderBy(F.desc("priority"), "pos").limit(budget)


def edge_budget(edges: DataFrame, points: DataFrame, detail: float, n: int) -> DataFrame:
    """Edges (a, b, pos, length) with both ends shown and length of 2 or more, priority ends first."""
    if detail < 1.6:
        return edges.limit(0)
    shown = points.select("row", "priority")
    both = edges.filter("length >= 2").join(shown.select(F.col("row").alias("a"), F.col("priority").alias("pa")), "a").join(shown.select(F.col("row").alias("b"), F.col("priority").alias("pb")), "b")
    return both.orderBy(F.desc(F.col("pa") | F.col("pb")), "pos").limit(min(160, round(0.6 * n))).select("a", "b", "pos")


def density(points: DataFrame, size: int, alpha: float) -> DataFrame:
    """(px, py, opacity): overlaid points of coverage ``alpha`` on a raster."""
    cell = lambda c: F.least(F.floor(F.col(c) / (1 << BITS) * size), F.lit(size - 1))
    return points.groupBy(cell("qx").alias("px"), cell("qy").alias("py")).agg((1 - F.exp(F.count("*") * F.log1p(F.lit(-alpha)))).alias("opacity"))


def kmeans_regions(layout: DataFrame, k: int, seed: int = 7, steps: int = 80) -> DataFrame:
    """(row, cluster) by k-means++ and Lloyd's steps over all points.

    Each draw and each step is a pass over the rows that returns sums by cell of 65,536 rows or by task and centre.
    """
    import pandas as pd
    import pyarrow as pa

    points = scratch_table(layout.select("row", "x", "y", F.floor(F.col("row") / 65536).alias("cell")), "points")
    rng = np.random.default_rng(seed)
    sizes = dict(sorted((r["cell"], r["n"]) for r in points.groupBy("cell").agg(F.count("*").alias("n")).collect()))
    n = sum(sizes.values())
    k = min(k, n)

    def squared(p: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((p[:, None] - centres[None]) ** 2).sum(2)

    def point_of(weights: dict[int, float], at: float, weigh) -> np.ndarray:
        """The point at which the running sum of weights, in row order, passes ``at``."""
        cells = list(weights)
        ends = np.cumsum([weights[c] for c in cells])
        i = min(int(np.searchsorted(ends, at, side="right")), len(cells) - 1)
        while weights[cells[i]] <= 0:
            i -= 1
        own = points.filter(F.col("cell") == cells[i]).orderBy("row").select("x", "y").toPandas().to_numpy(float)  # one cell
        inside = np.cumsum(weigh(own))
        return own[min(int(np.searchsorted(inside, at - (ends[i] - weights[cells[i]]), side="right")), len(own) - 1)]

    def spread_by_cell(centres: np.ndarray) -> dict[int, float]:
        def run(batches):
            for b in batches:
                p = np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
                yield pa.RecordBatch.from_pydict({"cell": b.column("cell"), "d": pa.array(squared(p, centres).min(1))})

        each = points.mapInArrow(run, "cell long, d double").groupBy("cell").agg(F.sum("d").alias("d"))
        return dict(sorted((r["cell"], r["d"]) for r in each.collect()))

    ones = lambda p: np.ones(len(p))
    centres = point_of(sizes, int(rng.integers(n)), ones)[None] if n else np.zeros((0, 2))
    while len(centres) < k:
        spread = spread_by_cell(centres)
        total = sum(spread.values())
        c = centres
        new = point_of(spread, rng.random() * total, lambda p: squared(p, c).min(1)) if total > 0 else point_of(sizes, int(rng.integers(n)), ones)
        centres = np.vstack([centres, new])

    def sums(centres: np.ndarray) -> pd.DataFrame:
        def run(batches):
            s = np.zeros((len(centres), 3))
            for b in batches:
                p = np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
                own = squared(p, centres).argmin(1)
                for i, w in enumerate((p[:, 0], p[:, 1], None)):
                    s[:, i] += np.bincount(own, w, len(centres))
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(len(centres)), pa.int32()), "x": s[:, 0], "y": s[:, 1], "n": s[:, 2]})

        return points.mapInArrow(run, "c int, x double, y double, n double").groupBy("c").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas()

    for _ in range(steps if k else 0):
        t = sums(centres).sort_values("c")
        held = t["n"].to_numpy()
        new = np.where(held[:, None] > 0, t[["x", "y"]].to_numpy() / np.maximum(held, 1)[:, None], centres)
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new

    def assign(batches):
        for b in batches:
            p = np.column_stack([b.column("x").to_numpy(), b.column("y").to_numpy()])
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "cluster": pa.array(squared(p, centres).argmin(1).astype(np.int32), pa.int32())})

    return points.mapInArrow(assign, "row long, cluster int")


def region_names(clustered: DataFrame, majority: float = 0.4) -> DataFrame:
    """Regions (cluster, n, x, y, name, top) of points (cluster, x, y, genre): named by the most common genre
    with a share of ``majority``, unless it is 'Unknown'; ties go to the first name."""
    counts = clustered.filter(F.trim("genre") != "").groupBy("cluster", "genre").agg(F.count("*").alias("c"))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("c"), "genre"))
    top = counts.withColumn("k", nth).filter("k <= 3").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "genre", "c"))).alias("t"))
    all_ = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    first = F.get("t", F.lit(0))
    named = F.when((first["c"] >= majority * F.col("n")) & (first["genre"] != "Unknown"), first["genre"])
    return all_.join(top, "cluster", "left").select("cluster", "n", "x", "y", named.alias("name"), F.transform("t", lambda s: s["genre"]).alias("top"))


def centred(layout: DataFrame) -> DataFrame:
    """Positions with mean 0, scaled into [-1, 1]."""
    m = layout.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    moved = layout.crossJoin(F.broadcast(m)).select("row", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    top = moved.agg(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")), F.lit(1e-12)).alias("top"))
    return moved.crossJoin(F.broadcast(top)).select("row", (F.col("x") / F.col("top")).alias("x"), (F.col("y") / F.col("top")).alias("y"))




def tile_level(pixels_per_unit: Column, side: float, max_level: int, tile_pixels: int) -> Column:
    """The level whose tiles are at most ``tile_pixels`` wide on the screen, from 0 to ``max_level``."""
    tiles = pixels_per_unit * side / tile_pixels
    # how many powers of two are below: a ceiling of the logarithm without its rounding
    return sum(((tiles > 2**z).cast("int") for z in range(max_level)), F.lit(0))


def region_alpha(detail: Column, low: float, high: float) -> Column:
    """How visible a label is at a zoom: smooth ramps of 0.2 octaves on both sides of its range; no lower end at 0."""
    at = F.log2(F.greatest(F.lit(1e-9), detail))

    def ramp(edge: float) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - math.log2(edge) + 0.2) / 0.4))
        return t * t * (3 - 2 * t)

    fall = 1 - ramp(high)
    return F.least(ramp(low), fall) if low > 0 else fall


def tiles_in_view(spark: SparkSession, domain: tuple[float, float, float], z: int, view: tuple[float, float, float, float]) -> DataFrame:
    """(x, y, distance) of the tiles of level z that meet a rectangle (x0, y0, x1, y1), nearest to its centre first."""
    (ox, oy, side), (x0, y0, x1, y1) = domain, view
    n = 2**z
    s = side / n
    cell = lambda v, o: max(0, min(n - 1, math.floor((v - o) / s)))
    outside = x1 < ox or y1 < oy or x0 > ox + side or y0 > oy + side
    xs = spark.range(cell(x0, ox), cell(x0, ox) if outside else cell(x1, ox) + 1)
    ys = F.sequence(F.lit(cell(y0, oy)).cast("long"), F.lit(cell(y1, oy)).cast("long"))
    away = F.hypot(ox + (F.col("x") + 0.5) * s - (x0 + x1) / 2, oy + (F.col("y") + 0.5) * s - (y0 + y1) / 2)
    return xs.select(F.col("id").alias("x"), F.explode(ys).alias("y")).select("x", "y", away.alias("distance")).orderBy("distance", "x", "y")
