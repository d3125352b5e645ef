"""Builds: a swapped row, a changed parent row, and the inputs of a release."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quaver.functions.digests import ordered_document, vector_sha256
from quaver.sources import builder, release


def inputs(spark, n=12, parent=4):
    vec = [(i, f"v{i}", [float(i), 0.5]) for i in range(n)]
    v = spark.createDataFrame(vec, "row long, id string, embedding array<float>")
    tracks = spark.createDataFrame([(f"v{i}", f"title {i}", f"a{i}") for i in reversed(range(n))], "id string, title string, audio_sha256 string")
    return {
        "selection": spark.createDataFrame([((i * 5) % n, f"v{i}") for i in range(n)], "pos long, id string"),
        "tracks": tracks,
        "rights": tracks.select("id", F.lit("by").alias("license")),
        "vectors": v,
        "parent": v.filter(F.col("row") < parent),
        "provenance": v.filter(F.col("row") >= parent).join(tracks, "id").select("id", "audio_sha256", vector_sha256(F.col("embedding")).alias("vector_sha256")),
        "removed": spark.createDataFrame([("v5",)], "id string"),
    }


def test_build_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "one")
    made = release.open_release(spark, path, builder.build(inputs(spark), path, "x"))
    want = [f"v{i}" for i in sorted(range(12), key=lambda i: i * 5 % 12) if i != 5]
    for name in ("tracks", "rights", "vectors", "provenance"):
        assert [(r.row, r.id) for r in made[name].orderBy("row").collect()] == list(enumerate(want))
    assert {r.id: r.embedding[0] for r in made["vectors"].collect()} == {i: float(i[1:]) for i in want}
    again = str(tmp_path / "two")
    both = release.open_release(spark, again, builder.build(builder.inputs_of(made), again, "x"))
    for name in ("tracks", "rights", "vectors"):
        assert release.same_rows(made[name], both[name].select(made[name].columns))


@pytest.mark.parametrize(
    "part,change,problem",
    [
        ("vectors", "row, case id when 'v7' then 'v8' when 'v8' then 'v7' else id end as id, embedding", "vector differs from its provenance: v7"),
        ("parent", "row, id, if(row = 2, array(9f, 9f), embedding) as embedding", "parent prefix differs: v2"),
        ("parent", "row + 1 as row, id, embedding", "parent prefix differs: v0"),
        ("vectors", "if(row = 3, 30, row) as row, id, embedding", "parent prefix differs: v3"),
        ("tracks", "if(id = 'v9', 'v1', id) as id, title, audio_sha256", "not in tracks: v9"),
        ("tracks", "id, title, if(id = 'v9', 'other', audio_sha256) as audio_sha256", "audio differs from its provenance: v9"),
        ("provenance", "if(id = 'v9', 'w9', id) as id, audio_sha256, vector_sha256", "no provenance: v9"),
    ],
)
def test_breaches(spark, tmp_path, part, change, problem):
    bad = inputs(spark)
    bad[part] = bad[part].selectExpr(*_split(change))
    with pytest.raises(ValueError, match=problem):
        builder.build(bad, str(tmp_path / "bad"), "x")
    assert not (tmp_path / "bad").exists()


def _split(text):
    """Top-level columns of a list of expressions."""
    out, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def test_ordered_document(spark, tmp_path):
    df = spark.range(50_000).select("id", F.concat(F.lit('"x'), "id", F.lit('"')).alias("t")).repartition(6)
    body = ("[" + ",".join(f'"x{i}"' for i in range(50_000)) + "]").encode()
    path = tmp_path / "new" / "ids.json"
    assert ordered_document(df, F.col("t"), ["id"], "[", ",", "]", str(path)) == (hashlib.sha256(body).hexdigest(), len(body))
    assert path.read_bytes() == body
    assert ordered_document(df.limit(0), F.col("t"), ["id"], "[", ",", "]", str(path)) == (hashlib.sha256(b"[]").hexdigest(), 2)
    assert path.read_bytes() == b"[]"
