"""Searches over blocks of queries against plain forms."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver import catalog_queries as cq
from quaver.operators import search
from tests.test_bound import case, plain


@pytest.mark.parametrize("name", ["unit", "4096", "large", "tiny", "equal", "huge", "nan"])
def test_scan_and_ranks_equal_plain(spark, name):
    r = np.random.default_rng(len(name))
    rows = [(i, v.tolist()) for i, v in enumerate(case(name, r).astype(np.float32))]
    asked = [x for x in rows if x[0] % 60 == 0]
    v = spark.createDataFrame(rows, "row long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query long, q array<float>")
    assert sorted(tuple(x) for x in search.scan_top_k(v, q, 5).collect()) == plain(rows, asked, 5, False)
    want = {(query, row): rank for query, rank, row, _ in plain(rows, asked, len(rows), True)}
    pairs = [(query, row) for query, _ in asked for row in (1, 5, 17, len(rows) - 1)]
    got = search.ranks_of(v, spark.createDataFrame(pairs, "query long, row long")).collect()
    assert {(x["query"], x["row"]): x["rank"] for x in got} == {p: want[p] for p in pairs}


def test_nearest_positions(spark):
    r = np.random.default_rng(3)
    at = r.integers(0, 12, (400, 2)).astype(float)  # many ties
    p = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(at)] + [(400, None, 1.0)], "row long, x double, y double").repartition(3)
    q = p.filter("row % 40 = 0 and row < 400").select(F.col("row").alias("query"), "x", "y")
    want = []
    for i in range(0, 400, 40):
        d = ((at - at[i]) ** 2).sum(1)
        want += [(i, n + 1, row, dist) for n, (dist, row) in enumerate(sorted((dist, row) for row, dist in enumerate(d.tolist()) if row != i)[:6])]
    assert sorted(tuple(x) for x in search.nearest_positions(p, q, 6).collect()) == want


@pytest.mark.parametrize("name", ["v18_projection_quality", "v18_projection_recall", "v22_parity"])
def test_pairs_stay_inside_of_tasks(spark, small, name):
    """No join makes a row for each pair of a query and a row, so no shuffle, sort or spill holds them."""
    out = io.StringIO()
    with redirect_stdout(out):
        cq.QUERIES[name](spark, small).explain()
    assert "BroadcastNestedLoopJoin BuildRight, Inner" not in out.getvalue()
    assert "MapInArrow" in out.getvalue()
