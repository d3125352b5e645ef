import pytest
from pyspark.sql import functions as F

from quaver import schema
from quaver.operators import graph, lookup
from quaver.plans.engine import Engine, number, parameters, scope_text
from quaver.queries_service import members_of
from quaver.sources import release


@pytest.fixture(scope="module")
def engine(spark, small):
    t = schema.tracks(spark, small)
    return Engine(t, schema.vectors(spark, small), schema.layout(spark, small), schema.ring_edges(spark, small), t.filter("row % 7 <> 0"))


def test_reads(engine):
    served = engine.serving().count()
    assert [r["row"] for r in engine.rows([3, 2, 3]).collect()] == [3, 2, 3]
    assert engine.page(limit=5).rows.count() == 5 and engine.page().total.first()[0] == served
    near = [r["row"] for r in engine.neighbors(8, 17).collect()]
    assert len(near) == 17 and 8 not in near and not [r for r in near if r % 7 == 0]
    assert engine.tile(0, 0, 0).count() > 0 and engine.links(8).count() > 0
    assert sum(bin(b).count("1") for r in engine.availability().collect() for b in r["bits"]) == served
    assert engine.manifest().first()["dimensions"] == 64


def test_credits_are_clamped_and_ids_redirect(engine):
    served = sorted(r["row"] for r in engine.serving().collect())
    assert [r["row"] for r in engine.credits(0).collect()] == served[:50]
    last = (len(served) - 1) // 50
    assert [r["row"] for r in engine.credits(10**6).collect()] == served[last * 50 :]
    row = engine.credit_redirect("fma:60").first()
    assert (row["page"], row["anchor"]) == (served.index(60) // 50 + 1, "fma-60")
    assert engine.credit_redirect("fma:7").count() == 0 and engine.credit_redirect("").count() == 0


def test_replay_checks_digests(spark, engine):
    digest = F.sha2(F.unbase64(release.packed(F.col("embedding"))), 256)
    q = engine.vectors.filter("row in (20, 40)").select(F.col("row").alias("query"), F.col("embedding").alias("q"), F.when(F.col("row") == 20, digest).otherwise("x").alias("vector_sha256"))
    got = {r["query"]: r for r in engine.replay(q).collect()}
    assert got[20]["verified"] and not got[40]["verified"] and all(0 <= r["recall"] <= 1 for r in got.values())


def test_request_parameters():
    assert parameters("q=a+b&page=2&x=", {"q", "page", "x"}) == {"q": "a b", "page": "2", "x": ""}
    for bad in ("q=1&q=2", "z=1", "q=é", "q=" + "a" * 2049, "&".join(f"q{i}=1" for i in range(17))):
        with pytest.raises(ValueError):
            parameters(bad, {"q"} | {f"q{i}" for i in range(17)})
    assert number({}, "k", 5, 1, 9) == 5 and number({"k": "9"}, "k", 5, 1, 9) == 9
    for bad in ("0", "10", "-1", "1e0", "", "٣", "000000001"):
        with pytest.raises(ValueError):
            number({"k": bad}, "k", 5, 1, 9)


def test_pages_and_scopes():
    assert lookup.result_page(25, 9) == (2, 3, 24, 25) and lookup.result_page(0, 3) == (0, 0, 0, 0) and lookup.result_page(25, -1)[0] == 0
    assert scope_text("browse", 2000, 2000, 0, 12, 2000) == "Catalog: 1 to 12 of 2,000 (chosen from 2,000 of 2,000 tracks)"
    assert scope_text("lookup", 2000, 0, 0, 0, 0) == "Names that match: none (chosen from 0 of 2,000 tracks)"
    assert scope_text("sound", 2000, 64, 12, 24, 64) == "Nearest by sound: 13 to 24 of 64 (chosen from 64 of 2,000 tracks)"


@pytest.mark.parametrize("links", [[], [(0, 1), (1, 2), (2, 0), (0, 2), (5, 6)], [(i, i + 1) for i in range(12)] + [(3, 9), (9, 0), (4, 4)]])
def test_hops_in_blocks(spark, links):
    edges = spark.createDataFrame([(s, 0, p, t) for p, (s, t) in enumerate(links * 2)] + [(0, 1, 0, 8), (0, 0, 9, None)], "src long, level int, pos int, dst long")
    want, frontier = {0: 0}, [0]
    while frontier:
        frontier = [t for f in frontier for s, t in links if s == f and want.setdefault(t, want[f] + 1) == want[f] + 1 and t != f]
        frontier = sorted(set(frontier))
    for block in (1000, 2):
        assert {r["row"]: r["hops"] for r in graph.reachable(edges, 0, block).collect()} == want


def test_members_are_all_or_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, ""), (3, "é" * 4000), (4, None)], "doc_id long, text string")
    members = members_of(docs)
    got = release.hydrate(members, str(tmp_path / "a"), 10**6)
    assert {r["id"]: bytes(r["content"]).decode() for r in got.collect()} == {"1": "one", "2": "", "3": "é" * 4000}
    broken = {
        "range": members.withColumn("data", F.expr("substring(data, 2)")), "header": members.withColumn("filename", F.lit("other")), "header sizes": members.withColumn("crc32", F.col("crc32") + 1),
        "content": members.withColumn("sha256", F.lit("x")), "entry": members.withColumn("bytes", F.lit(None).cast("long")),
    }
    for problem, df in broken.items():
        assert {(r["content"], r["problem"]) for r in release.decode_members(df).collect()} == {(None, problem)}
        with pytest.raises(ValueError, match=problem):
            release.hydrate(members.filter("id <> '2'").unionByName(df.filter("id = '2'")), str(tmp_path / "b"), 10**6)
        assert not (tmp_path / "b").exists() and not (tmp_path / "b.staging").exists()
    with pytest.raises(ValueError, match="budget"):
        release.hydrate(members, str(tmp_path / "c"), 10)
    with pytest.raises(ValueError, match="immutable"):
        release.hydrate(members, str(tmp_path / "a"), 10**6)
