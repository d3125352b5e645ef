from quaver import catalog_queries as cq
from quaver import queries_more, schema
from quaver.operators import search
from quaver.sources import release


def test_parity_asks_every_twentieth_row(spark, small, monkeypatch):
    seen = []

    def wrong(v, q, k):
        seen.extend(r["query"] for r in q.collect())
        return search_batch(v, q.filter("query <> 40"), k)

    search_batch = search.batch_top_k
    monkeypatch.setattr(queries_more.search, "batch_top_k", wrong)
    assert cq.QUERIES["v22_parity"](spark, small).first()[0] == 8
    assert set(seen) == {r["row"] for r in schema.vectors(spark, small).filter("row % 20 = 0").collect()}


def test_a_changed_row_beyond_100_is_seen(spark, small, monkeypatch):
    opened = release.open_release

    def changed(*a):
        t = opened(*a)["tracks"]
        return {"tracks": t.selectExpr("row", "id", "if(row = 150, 'x', title) as title")}

    monkeypatch.setattr(queries_more.release, "open_release", changed)
    assert cq.QUERIES["set_prefix_equality"](spark, small).first()[0] == 1
