"""A whole graph that no worker holds: blocks of it give the same traces, at any size."""

import numpy as np
from pyspark.sql import functions as F

from quaver.operators import graph
from quaver.plans.engine import Engine
from quaver.sources import release

LARGE = 200_500


def ring(spark, n):
    """Twelve vectors on an arc, all others far from it, and links to the next two rows."""
    v = spark.range(n).selectExpr("id as row", "if(id < 12, id * 0.05D, 1.5D) as a").selectExpr("row", "array(cast(cos(a) as float), cast(sin(a) as float)) as embedding")
    edges = v.selectExpr("row as src", "0 as level", f"posexplode(array((row + 1) % {n}, (row + 2) % {n})) as (pos, dst)")
    return v, edges


def test_blocks_give_the_traces_of_the_graph_in_one_piece(spark, tmp_path):
    random = np.random.default_rng(4)
    x = random.normal(size=(300, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [int(r) for r in np.sort(random.choice(10**12, 300, replace=False))]  # keys with gaps
    upper = rows[::9]
    links = {0: {r: [rows[i] for i in random.choice(300, 7, replace=False)] for r in rows}, 1: {r: [upper[i] for i in random.choice(len(upper), 3, replace=False)] for r in upper}}
    v = spark.createDataFrame([(r, e.tolist()) for r, e in zip(rows, x)], "row long, embedding array<float>")
    edges = spark.createDataFrame([(s, level, p, d) for level, by in links.items() for s, to in by.items() for p, d in enumerate(to)], "src long, level int, pos int, dst long")
    path = graph.write_graph(v, edges, upper[2], str(tmp_path / "g"), block=16)
    stored = spark.read.parquet(path)
    whole = graph._blocks_of(stored)
    assert whole[1:] == (upper[2], 1, 300) and len(whole[0]) > 10
    want = graph.LocalGraph(dict(zip(rows, x)), links, upper[2])
    tight = graph.BlockGraph(path, *whole, kept=1)
    for q in x[::50]:
        assert tight.search(q, 5, 20) == want.search(q, 5, 20)
        assert len(tight.held) == 1
    asked = v.filter(v.row.isin(rows[::50])).selectExpr("row as query", "embedding as q")
    for r in graph.search_stored(asked, path, 5, 20).filter("type = 'results'").collect():
        assert [(i["distance"], i["id"]) for i in r["items"]] == want.search(x[rows.index(r["query"])], 5, 20)[0]


def test_a_search_reads_the_blocks_that_it_touches(spark, tmp_path):
    v, edges = ring(spark, 2000)
    path = graph.write_graph(v, edges, 0, str(tmp_path / "g"), block=100)
    g = graph.BlockGraph(path, *graph._blocks_of(spark.read.parquet(path)))
    assert [r for _, r in g.search([1, 0], 3, 4)[0]] == [0, 1, 2] and len(g.held) < len(g.starts) / 2


def test_a_whole_graph_of_any_size_is_searched(spark):
    v, edges = ring(spark, LARGE)
    asked = v.filter("row = 2").selectExpr("row as query", "embedding as q")
    assert {r["row"] for r in graph.results_of(graph.traced_search(v, edges, asked, 0, 3, 8)).collect()} == {1, 2, 3}


def test_examples_are_replayed_at_any_size(spark):
    v, edges = ring(spark, LARGE)
    tracks = v.selectExpr("row", "'a' as title", "'b' as artist", "cast(null as string) as album", "'c' as genre")
    examples = v.filter("row in (2, 3)").select(F.col("row").alias("query"), F.col("embedding").alias("q"), F.sha2(F.unbase64(release.packed(F.col("embedding"))), 256).alias("vector_sha256"))
    assert sorted(map(tuple, Engine(tracks, v, edges=edges).replay(examples).collect())) == [(2, True, 1.0), (3, True, 1.0)]
