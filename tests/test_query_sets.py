from quaver import catalog_queries as cq
from quaver import schema
from quaver.operators import graph


def asked(spark, small):
    return {r["row"] for r in schema.vectors(spark, small).filter("row % 20 = 0").collect()}


def test_searches_answer_every_twentieth_row(spark, small):
    for name in ("g01_traced_search", "g02_sharded_graph_search", "v21_graph_recall"):
        assert {r["query"] for r in cq.QUERIES[name](spark, small).select("query").distinct().collect()} == asked(spark, small), name


def test_graph_recall_is_measured(spark, small):
    recall = [r["recall"] for r in cq.QUERIES["v21_graph_recall"](spark, small).collect()]
    assert len(recall) == len(asked(spark, small)) and 0.9 <= sum(recall) / len(recall) <= 1


def test_shards_grow_with_the_rows(spark):
    v = spark.range(25).selectExpr("id as row")
    assert graph.shard_count(v) == 2 and graph.shard_count(v, 5) == 5 and graph.shard_count(v, 10) == 3
