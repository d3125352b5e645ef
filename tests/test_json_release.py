"""Releases of documents: round trips, refusals, conversion, upgrade and the identity of a graph."""

import copy
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.operators import graph, lookup
from quaver.sources import json_release as jr
from quaver.sources import release

N, D = 30, 4


def element(i, **more):
    return json.dumps({"id": f"t{i}", "title": f'É "{i}"', "artist": "a\\b", "genre": None, "n": 1.50, "deep": {"z": [1, {"y": "] } ,"}], "a": 2}} | more, ensure_ascii=False, separators=(",", ":"))


def parts(spark):
    x = np.random.default_rng(2).normal(size=(N, D))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = graph.build_graph(list(range(N)), list(x), m=3, ef=20)
    layers = [(r, level, g.links[level][r]) for r in range(N) for level in range(g.top + 1) if r in g.links[level]]
    tables = {
        "tracks": spark.createDataFrame([(i, f"t{i}", element(i)) for i in range(N)], "row long, id string, body string").repartition(4),
        "rights": spark.createDataFrame([(i, f"t{i}", json.dumps({"id": f"t{i}", "use": "yes"})) for i in range(N)], "row long, id string, body string"),
        "layers": spark.createDataFrame(layers, "src long, level int, neighbors array<long>").repartition(3),
        "vectors": spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, embedding array<float>").repartition(3),
    }
    headers = {
        "catalog": {"id": "c:1", "dimensions": D, "note": "123", "schemaVersion": 1, "zones": {"b": [1, "x"], "a": None}},
        "rights": {"catalogId": "c:1"},
        "index": {"M": 3, "count": N, "entry": g.entry, "maxLevel": g.top, "algorithm": "x"},
    }
    return tables, headers


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    tables, headers = parts(spark)
    path = str(tmp_path_factory.mktemp("v1") / "one")
    return path, jr.write_json_release(tables, headers, path), headers


def test_documents(spark, written):
    path, digest, headers = written
    catalog = json.loads(open(f"{path}/catalog.json", "rb").read())
    assert [t["id"] for t in catalog["tracks"]] == [f"t{i}" for i in range(N)] == json.loads(open(f"{path}/ids.json").read())
    assert {k: v for k, v in catalog.items() if k != "tracks"} == headers["catalog"]
    tables, got, _ = jr.load_release(spark, path, digest)
    assert got == headers
    assert [(r.row, r.body) for r in tables["tracks"].orderBy("row").collect()] == [(i, element(i)) for i in range(N)]
    links = json.loads(open(f"{path}/index.json").read())["links"]
    assert [[list(x) for x in own] for own in links] == [[list(r.neighbors) for r in tables["layers"].filter(F.col("src") == i).orderBy("level").collect()] for i in range(3)] + links[3:]
    with pytest.raises(ValueError, match="not the expected"):
        jr.read_release(spark, path, "0" * 64)


def test_conversion_and_back(spark, written, tmp_path):
    path, digest, _ = written
    made = jr.convert(spark, path, digest, str(tmp_path / "v2"), index=False)
    tables = release.open_release(spark, str(tmp_path / "v2"), made)
    pins = jr.reconstruct(tables, str(tmp_path / "back"))
    for name, pin in pins.items():
        assert (tmp_path / "back" / pin["path"]).read_bytes() == open(f"{path}/{pin['path']}", "rb").read(), name
    up = jr.upgrade(spark, str(tmp_path / "v2"), made, str(tmp_path / "v21"))
    new = release.open_release(spark, str(tmp_path / "v21"), up)
    assert lookup.index_problems(new["tracks"], new["grams"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        jr.upgrade(spark, str(tmp_path / "v21"), up, str(tmp_path / "v22"))
    assert not (tmp_path / "v22").exists() and not (tmp_path / "v2.proof").exists()


def test_changed_file(spark, written, tmp_path):
    tables, headers = parts(spark)
    digest = jr.write_json_release(tables, headers, str(tmp_path / "x"))
    file = tmp_path / "x" / "ids.json"
    file.write_bytes(file.read_bytes() + b" ")
    with pytest.raises(ValueError, match="ids.json differs"):
        jr.load_release(spark, str(tmp_path / "x"), digest)


@pytest.mark.parametrize(
    "part,change,problem",
    [
        ("rights", lambda df: df.withColumn("body", F.regexp_replace("body", '"t7"', '"t8"')), "order of rights"),
        ("rights", lambda df: df.filter("row < 29"), "count of rights"),
        ("tracks", lambda df: df.withColumn("id", F.expr("if(row = 7, 't8', id)")), "repeated or null ids"),
        ("tracks", lambda df: df.withColumn("body", F.regexp_replace("body", '"t7"', '"t99"')), "order of tracks"),
        ("vectors", lambda df: df.withColumn("embedding", F.expr("if(row = 3, transform(embedding, x -> x * cast(2 as float)), embedding)")), "vectors that aren't unit"),
        ("layers", lambda df: df.withColumn("neighbors", F.expr("if(src = 3 and level = 0, array(3L), neighbors)")), "links"),
        ("layers", lambda df: df.withColumn("neighbors", F.expr("if(src = 3 and level = 0, array(99L), neighbors)")), "links"),
        ("layers", lambda df: df.withColumn("neighbors", F.expr("if(src = 3 and level = 0, sequence(4L, 20L), neighbors)")), "degrees"),
        ("layers", lambda df: df.withColumn("neighbors", F.expr("filter(neighbors, n -> n <> 7 or level > 0)")), "rows out of reach"),
        ("index", {"entry": 99}, "layers of nodes"),
        ("index", {"maxLevel": 9}, "layers of nodes"),
        ("rights-header", {"catalogId": "other"}, "headers of another catalog"),
    ],
)
def test_refused(spark, tmp_path, part, change, problem):
    tables, headers = parts(spark)
    if callable(change):
        tables[part] = change(tables[part])
    else:
        headers[part.split("-")[0]].update(change)
    digest = jr.write_json_release(tables, headers, str(tmp_path / "x"))
    with pytest.raises(ValueError, match=problem):
        jr.convert(spark, str(tmp_path / "x"), digest, str(tmp_path / "y"))
    assert not (tmp_path / "y").exists()


def test_identity(spark, written):
    path, digest, headers = written
    tables, _, manifest = jr.load_release(spark, path, digest)
    identity = jr.graph_identity(tables, {"M": 3, "efConstruction": 20, "seed": 43}, D)
    assert identity["vectorsSha256"] == manifest["assets"]["vectors"]["sha256"] and identity["orderedIdsSha256"] == manifest["assets"]["ids"]["sha256"]
    good = jr.graph_manifest(identity, "c:1", {"model": "m"})
    check = lambda m: jr.manifest_problems(m, identity, "c:1", {"model": "m"})
    assert check(good) == []
    for name in good:
        bad = copy.deepcopy(good)
        bad[name] = "changed" if name != "graphIdentity" else None
        assert check(bad) == [name]
    for name in good["graphIdentity"]:
        for value in ("changed", True, None):
            bad = copy.deepcopy(good)
            bad["graphIdentity"][name] = value
            assert check(bad) == ["graphId", f"graphIdentity.{name}"]  # the digest of the identity changes too
            bad["graphId"] = "graph:" + hashlib.sha256(jr.compact(bad["graphIdentity"]).encode()).hexdigest()
            assert check(bad) == [f"graphIdentity.{name}"]
    swapped = dict(tables, ids=tables["ids"].withColumn("row", F.expr("case row when 1 then 2 when 2 then 1 else row end")))
    assert jr.graph_identity(swapped, {}, D)["orderedIdsSha256"] != identity["orderedIdsSha256"]
