import numpy as np
import pytest

from quaver.operators import graph


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def brute(x, q, k):
    d = np.clip(1 - np.cumsum(x.astype(float) * q.astype(float), axis=1)[:, -1], 0, 2)
    return sorted(zip(d.tolist(), range(len(x))))[:k]


def test_full_width_search_is_exact():
    x = unit(200, 8, 1)
    g = graph.build_graph(list(range(200)), list(x), m=6, ef=40)
    for q in unit(10, 8, 2):
        assert g.search(q, 5, 200)[0] == brute(x, q, 5)


def test_two_vectors_and_ties():
    g = graph.LocalGraph({0: [1, 0], 1: [0, 1]}, {0: {0: [1], 1: [0]}}, 0)
    assert g.search([1, 0], 1, 2)[0] == [(0.0, 0)]
    same = graph.LocalGraph({i: [1, 0] for i in range(4)}, {0: {i: [(i + 1) % 4] for i in range(4)}}, 2)
    assert [r for _, r in same.search([1, 0], 3, 4)[0]] == [0, 1, 2]


def test_trace_is_bounded_and_budget_checked():
    x = unit(50, 4, 3)
    g = graph.build_graph(list(range(50)), list(x), m=4, ef=20)
    found, events = g.search(x[0], 3, 10, limit=4)
    assert len(events) == 4 and [e["sequence"] for e in events] == [0, 1, 2, 3]
    assert found == g.search(x[0], 3, 10)[0]
    for k, ef in ((0, 5), (6, 5), (3, 51)):
        with pytest.raises(ValueError):
            g.search(x[0], k, ef)


def test_degrees_are_bounded():
    x = unit(150, 6, 4)
    g = graph.build_graph(list(range(150)), list(x), m=4, ef=30)
    for level, by in g.links.items():
        for row, own in by.items():
            assert len(own) <= (8 if level == 0 else 4) and row not in own and len(set(own)) == len(own)


def test_sharded_recall(spark):
    x = unit(300, 8, 5)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row long, embedding array<float>")
    q = v.filter("row % 30 = 0").selectExpr("row as query", "embedding as q")
    got = graph.shard_search(v, q, 3, 5, 60, m=6, construction=40).collect()
    want = {(i * 30, r) for i in range(10) for _, r in brute(x, x[i * 30], 5)}
    assert len(want & {(r["query"], r["row"]) for r in got}) >= 0.9 * len(want)


def test_stored_shards(spark, tmp_path):
    """Stored graphs equal those built in place, give a trace in every shard, and hold bounded links."""
    x = unit(120, 6, 8)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row long, embedding array<float>")
    path = graph.write_shards(v, str(tmp_path / "g"), 3, m=4, ef=30)
    q = v.filter("row % 40 = 0").selectExpr("row as query", "embedding as q")
    edges = graph.stored_edges(spark, path)
    assert graph.structure_problems(edges.select("src", "level", "pos", "dst"), v, 4).count() == 0
    trace = graph.search_stored(q, path, 3, 10).collect()
    for shard in range(3):
        rows = sorted(r["row"] for r in spark.read.parquet(path).filter(f"shard = {shard}").collect())
        g = graph.build_graph(rows, [x[r] for r in rows], m=4, ef=30)
        for query in (0, 40, 80):
            own = sorted((r for r in trace if (r["shard"], r["query"]) == (shard, query)), key=lambda r: r["sequence"])
            found, events = g.search(x[query], 3, 10)
            assert [(r["type"], r["level"], r["id"], r["evaluations"]) for r in own] == [(e["type"], e["level"], e.get("id"), e["evaluations"]) for e in events]
            assert [(i["distance"], i["id"]) for i in own[-1]["items"]] == found
    merged = graph.merged_results(graph.search_stored(q, path, 3, 10, 0), 3).collect()
    assert len(merged) == 9 and {r["row"] for r in merged if r["rank"] == 1} == {0, 40, 80}
    assert graph.search_stored(q.limit(0), path, 3, 10).collect() == []


def test_long_chains_over_blocks(spark):
    edges = spark.createDataFrame([(i, 0, 0, (i * 7 + 3) % 400) for i in range(400)] + [(i, 0, 1, (i + 1) % 400) for i in range(400)], "src long, level int, pos int, dst long")
    want, frontier = {0: 0}, [0]
    while frontier:
        frontier = [t for f in frontier for t in ((f * 7 + 3) % 400, (f + 1) % 400) if want.setdefault(t, want[f] + 1) == want[f] + 1]
        frontier = sorted(set(frontier)) if len(want) < 400 else []
    assert {r["row"]: r["hops"] for r in graph.reachable(edges, 0, 64).collect()} == want


def test_an_expansion_measures_its_neighbours_at_once(monkeypatch):
    x = unit(300, 8, 6)
    g = graph.build_graph(list(range(300)), list(x), m=6, ef=40)
    calls, own = [], g.distances
    monkeypatch.setattr(g, "distances", lambda q, rows: calls.append(len(rows)) or own(q, rows))
    found, events = g.search(x[7], 5, 40)
    assert len(calls) <= sum(e["type"] in ("enter", "expand") for e in events) and sum(calls) == events[-1]["evaluations"]
    assert g.search(x[7], 5, 40, 0)[0] == found


def test_every_shard_is_built_in_a_task_of_its_own(spark, tmp_path):
    x = unit(240, 4, 7)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row long, embedding array<float>")
    path = graph.write_shards(v, str(tmp_path / "g"), 8, m=4, ef=20)
    tasks = spark.read.parquet(path).selectExpr("shard", "regexp_extract(input_file_name(), 'part-([0-9]+)', 1) as task").distinct().collect()
    assert len(tasks) == len({t.task for t in tasks}) == 8
