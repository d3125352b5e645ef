"""Results at sizes where a query's SQL stops or cuts short."""

from quaver import catalog_queries as cq
from quaver import schema
from quaver.sources import release


def test_routes_of_seven_digits_stay_apart(spark):
    t = spark.createDataFrame([(n, f"fma:{n}") for n in (7, 100000, 1000000, 1000001)], "row long, id string")
    routes = {r["row"]: r["route"] for r in release.delivery(t, t.filter("row = 7")).collect()}
    assert routes == {7: "/audio/000007.mp3", 100000: "/audio/100000.mp3", 1000000: "/audio/1000000.mp3", 1000001: "/audio/1000001.mp3"}


def test_a_ring_whose_size_is_not_a_multiple_of_ten_has_a_problem_of_its_own(spark, tmp_path):
    spark.range(206).selectExpr("id as vec_id", "array(cast(1 as float)) as embedding", "0 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {tuple(r) for r in cq.QUERIES["g07_structure_problems"](spark, str(tmp_path)).collect()}
    # row 200 links to (200 + 10) % 206 = 4 in level 1, which row 4 lacks
    assert ("neighbour lacks the level", 200, 1) in found and len(found) == 5


def test_rows_beyond_120_hops_are_reached(spark, tmp_path):
    spark.range(1000).selectExpr("id as vec_id", "array(cast(1 as float)) as embedding", "0 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    hops = {r["row"]: r["hops"] for r in cq.QUERIES["g08_reachability"](spark, str(tmp_path)).collect()}
    assert len(hops) == schema.vectors(spark, str(tmp_path)).count() and max(hops.values()) > 120
