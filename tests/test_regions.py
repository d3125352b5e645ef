import numpy as np

from quaver import catalog_queries as cq
from quaver.operators import tiles


def plain(p, k, seed, steps):
    """k-means++ and Lloyd's steps over all points in one process."""
    rng = np.random.default_rng(seed)
    apart = lambda c: ((p[:, None] - c[None]) ** 2).sum(2)
    centres = p[[rng.integers(len(p))]]
    while len(centres) < k:
        ends = np.cumsum(apart(centres).min(1))
        centres = np.vstack([centres, p[np.searchsorted(ends, rng.random() * ends[-1], side="right")]])
    for _ in range(steps):
        own = apart(centres).argmin(1)
        new = np.array([p[own == c].mean(0) if (own == c).any() else centres[c] for c in range(k)])
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return apart(centres).argmin(1)


def test_all_rows_decide_the_regions(spark):
    n = 210_000
    layout = spark.range(n).selectExpr("id as row", "pmod(id * 7919, 1009) / 1009D as x", "pmod(id * 104729, 99991) / 99991D as y")
    ids = np.arange(n)
    p = np.column_stack([ids * 7919 % 1009 / 1009, ids * 104729 % 99991 / 99991])
    got = tiles.kmeans_regions(layout, 3, steps=5).orderBy("row").toPandas()
    assert (got["row"] == ids).all() and (got["cluster"] == plain(p, 3, 7, 5)).all()


def test_both_levels_have_their_regions(spark, small):
    for name, k in (("t09_kmeans_regions", 12), ("t09_kmeans_regions_48", 48)):
        assert cq.QUERIES[name](spark, small).select("cluster").distinct().count() == k


def test_few_and_equal_points(spark):
    one = spark.createDataFrame([(i, 1.0, 2.0) for i in range(3)], "row long, x double, y double")
    assert [r["cluster"] for r in tiles.kmeans_regions(one, 12).collect()] == [0, 0, 0]
    assert tiles.kmeans_regions(one.limit(0), 12).count() == 0
