"""Batched search against a plain form, where proposals must be widened or refused."""

import numpy as np
import pytest

from quaver.operators import search


def plain(vectors, queries, k, exclude_self):
    out = []
    for query, q in queries:
        scored = []
        for row, v in vectors:
            if exclude_self and row == query:
                continue
            with np.errstate(all="ignore"):
                dot = np.cumsum(np.asarray(v, np.float32).astype(float) * np.asarray(q, np.float32).astype(float))[-1]
            scored.append((2.0 if np.isnan(dot) else float(np.clip(1 - dot, 0, 2)), row))
        out += [(query, n + 1, row, d) for n, (d, row) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def case(name, r):
    if name == "unit":
        m = r.normal(size=(900, 16))
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    if name == "4096":
        m = r.normal(size=(300, 4096)) + 3  # near each other: products differ by less than their error
        return m / np.linalg.norm(m, axis=1, keepdims=True)
    if name == "large":
        return r.normal(size=(700, 8)) * 100  # most distances are clipped to 0 or 2
    if name == "tiny":
        return r.normal(size=(700, 8)) * 1e-4  # all distances are near 1
    if name == "equal":
        return np.tile(np.eye(8)[0], (700, 1))
    if name == "huge":
        return r.normal(size=(500, 8)) * 1e30  # products overflow in float32
    m = r.normal(size=(400, 8))
    m[5, 2] = np.nan
    return m


@pytest.mark.parametrize("name", ["unit", "4096", "large", "tiny", "equal", "huge", "nan"])
def test_equals_plain(spark, name):
    r = np.random.default_rng(len(name))
    rows = [(i, v.tolist()) for i, v in enumerate(case(name, r).astype(np.float32))]
    asked = [x for x in rows if x[0] % 60 == 0]
    v = spark.createDataFrame(rows, "row long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(asked, "query long, q array<float>")
    for exclude in (False, True):
        got = sorted(tuple(x) for x in search.batch_top_k(v, q, 5, exclude).collect())
        assert got == plain(rows, asked, 5, exclude)
    few = search.batch_top_k(v.filter("row < 3"), q, 5, True).collect()
    assert len(few) == 3 * len(asked) - 1
    first = search.exact_top_k(v, q.filter("query = 0").select("q"), 5).collect()
    assert [(x.row, x.distance) for x in first] == [(x[2], x[3]) for x in plain(rows, asked[:1], 5, False)]
