"""Files of matrices and graphs: round trips, ranges, refused files, commits and aborted writes."""

import json

import numpy as np
import pytest

from quaver.sources import binary

HEAD = {"dimensions": 3, "m": 2, "construction": 10, "seed": 43, "entry": 1, "max_level": 2}
LINKS = [[[1, 2]], [[0], [2], []], [[0, 1], [1]], [[]]]


def layers(spark, links=LINKS):
    return spark.createDataFrame([(r, x, n) for r, own in enumerate(links) for x, n in enumerate(own)], "src long, level int, neighbors array<long>")


def graph_bytes(links=LINKS, head=HEAD):
    """A graph file as its format says."""
    nodes, offsets, flat = [0], [0], []
    for own in links:
        for n in own:
            flat += n
            offsets.append(len(flat))
        nodes.append(len(offsets) - 1)
    values = [head[k] for k in ("dimensions", "m", "construction", "seed", "entry", "max_level")]
    return binary.HEADER.pack(binary.MAGIC, 1, len(links), *values, 0, len(nodes), len(offsets), len(flat)) + np.array(nodes + offsets + flat, "<i4").tobytes()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_matrix(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(1000, 3)).astype("<f4")
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "row long, embedding array<float>").repartition(5)
    binary.write_matrix(df, path, 3)
    back = binary.read_matrix(spark, path, 3, rangeBytes=120)
    got = rows(back, "row")
    assert [r[0] for r in got] == list(range(1000)) and (np.array([r[1] for r in got], "<f4") == m).all()
    assert back.rdd.getNumPartitions() > 50
    listed = json.loads((tmp_path / "m" / binary.LIST).read_text())
    assert listed["rows"] == 1000 and binary.damaged_files(spark, path).count() == 0
    with pytest.raises(Exception, match="already"):
        binary.write_matrix(df, path, 3)
    assert binary.read_matrix(spark, path, 3).count() == 1000
    binary.write_matrix(df.limit(0), path, 3, "overwrite")
    assert binary.read_matrix(spark, path, 3).collect() == []


def test_plain_matrix_files(spark, tmp_path):
    m = np.arange(60, dtype="<f4").reshape(20, 3)
    (tmp_path / "a.f32").write_bytes(m[:7].tobytes())
    (tmp_path / "b.f32").write_bytes(m[7:].tobytes())
    assert rows(binary.read_matrix(spark, str(tmp_path), 3), "row") == [(i, x.tolist()) for i, x in enumerate(m)]
    assert binary.read_matrix(spark, str(tmp_path / "a.f32"), 3).count() == 7
    (tmp_path / "b.f32").write_bytes(m[7:].tobytes()[:-1])
    with pytest.raises(Exception, match="no rows of 3 floats"):
        binary.read_matrix(spark, str(tmp_path), 3).collect()
    with pytest.raises(Exception, match="Nothing at"):
        binary.read_matrix(spark, str(tmp_path / "absent"), 3).collect()


@pytest.mark.parametrize("bad", [[(0, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], [(0, [1.0] * 3), (0, [1.0] * 3)], [(1, [1.0] * 3)], [(0, [1.0, 2.0])], [(0, None)], [(0, [1.0, None, 2.0])]])
def test_refused_matrix(spark, tmp_path, bad):
    path = tmp_path / "m"
    with pytest.raises(Exception):
        binary.write_matrix(spark.createDataFrame(bad, "row long, embedding array<float>"), str(path), 3)
    assert not path.exists() or not [p for p in path.iterdir() if not p.name.startswith(".")]  # nothing is left


def test_graph(spark, tmp_path):
    want = rows(layers(spark), "src", "level")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    binary.write_graph(layers(spark), one, HEAD, files=1)
    file = next((tmp_path / "one").glob("*.csr"))
    assert file.read_bytes() == graph_bytes() and binary.graph_header(str(file)) == {**HEAD, "count": 4, "layers": 7, "links": 7}
    assert rows(binary.read_graph(spark, one), "src", "level") == want == rows(binary.read_graph(spark, str(file), rangeNodes=1), "src", "level")
    binary.write_graph(layers(spark).repartition(3), many, HEAD)
    assert rows(binary.read_graph(spark, many), "src", "level") == want
    edges = binary.read_graph(spark, many).selectExpr("src", "level", "posexplode(neighbors) as (pos, dst)")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "row long")
    # a layer without links above a node's highest link can't be told from edges
    assert rows(binary.packed_layers(edges, nodes), "src", "level") == [w for w in want if w[:2] != (1, 2)]


@pytest.mark.parametrize("at,value", [(0, b"X"), (8, b"\x02"), (12, b"\x05"), (40, b"\x01"), (44, b"\x09"), (68, b"\x01"), (72, b"\x00"), (76, b"\x7f"), (88, b"\x01"), (92, b"\x7f"), (96, b"\x00")])
def test_damaged_graph(spark, tmp_path, at, value):
    data = bytearray(graph_bytes())
    data[at : at + 1] = value
    path = tmp_path / "g.csr"
    path.write_bytes(data)
    with pytest.raises(Exception, match="unknown header|Broken"):
        binary.read_graph(spark, str(path)).collect()


def test_cut_graph_and_changed_file(spark, tmp_path):
    path = tmp_path / "g.csr"
    path.write_bytes(graph_bytes()[:-4])
    with pytest.raises(Exception, match="unknown header"):
        binary.read_graph(spark, str(path)).collect()
    binary.write_graph(layers(spark), str(tmp_path / "g"), HEAD, files=1)
    file = next((tmp_path / "g").glob("*.csr"))
    file.write_bytes(file.read_bytes()[:-4] + b"\x00\x00\x00\x00")
    assert [r.name for r in binary.damaged_files(spark, str(tmp_path / "g")).collect()] == [file.name]


@pytest.mark.parametrize("bad", [[[[1]], [[0], []]], [[[5_000_000_000]]]])
def test_refused_graph(spark, tmp_path, bad):
    rows_ = [(r, x if r == 0 else x + 1, n) for r, own in enumerate(bad) for x, n in enumerate(own)]
    with pytest.raises(Exception):
        binary.write_graph(spark.createDataFrame(rows_, "src long, level int, neighbors array<long>"), str(tmp_path / "g"), HEAD)
