"""Queries over files of matrices and graphs, built and converted releases, and stored indexes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver import schema
from quaver.functions.vectors import normalised
from quaver.scratch import shared_folder, stored
from quaver.sources import binary, builder, json_release, release

QUERIES, SQL = {}, {}
T, E = schema.TRACKS_SQL, schema.EDGES_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/files/{name}-{uuid.uuid4().hex}"


def _dense(spark, d):
    """Vectors with their places by id as rows."""
    v = schema.table(spark, d, "embeddings").filter("embedding is not null")
    return binary.dense_rows(v, "vec_id").select("row", "vec_id", "embedding", "label")


DENSE = "v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL)"
CHECKSUM = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * floor(embedding[i]::DOUBLE * 1048576)::BIGINT))::BIGINT AS checksum"


def _checksum():
    """A whole number that every component and its place take part in."""
    return F.expr("aggregate(transform(embedding, (x, i) -> (i + 1) * floor(cast(x as double) * 1048576)), 0L, (a, x) -> a + x)").alias("checksum")


@query("s03_matrix_files", f"WITH {DENSE} SELECT row, len(embedding) AS dimensions, {CHECKSUM} FROM v")
def _(spark, d):
    path, v = _folder(spark, "matrix"), _dense(spark, d)
    size = len(v.first().embedding)
    binary.write_matrix(v, path, size)
    return binary.read_matrix(spark, path, size, rangeBytes=1 << 22).select("row", F.size("embedding").cast("long").alias("dimensions"), _checksum())


@query("s04_graph_files", f"WITH {E} SELECT src, level, pos, dst FROM edges")
def _(spark, d):
    path, v = _folder(spark, "graph"), schema.vectors(spark, d)
    binary.write_graph(binary.packed_layers(schema.ring_edges(spark, d), v), path, {"dimensions": 64, "m": 2, "construction": 100, "seed": 43, "entry": 0, "max_level": 1})
    return binary.read_graph(spark, path).select("src", "level", F.posexplode("neighbors").alias("pos", "dst"))


# ---------------------------------------------------------------- built releases


def _build_inputs(spark, d):
    """Inputs of a build: vectors in id order, the first quarter frozen, the selection by label and then id backwards."""
    v = _dense(spark, d).withColumn("id", F.concat(F.lit("v:"), "vec_id"))
    n = v.agg(F.count("*").alias("n"))
    names = schema.table(spark, d, "documents").select(F.concat(F.lit("v:"), "doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("audio_sha256"), F.col("source").alias("title"))
    tracks = v.select("id").join(names, "id", "left").select("id", F.coalesce("title", F.lit("?")).alias("title"), F.coalesce("audio_sha256", F.sha2("id", 256)).alias("audio_sha256"))
    split = v.crossJoin(F.broadcast(n))  # one row
    order = F.struct("label", (-F.col("vec_id")).alias("back"))
    return {
        "selection": v.select(order.alias("pos"), "id"),
        "tracks": tracks,
        "rights": v.select("id", (F.col("label") % 3).alias("license")),
        "vectors": v.select("row", "id", "embedding"),
        "parent": split.filter("row * 4 < n").select("row", "id", "embedding"),
        "provenance": split.filter("row * 4 >= n").join(tracks, "id").select("id", "audio_sha256", builder.vector_sha256(F.col("embedding")).alias("vector_sha256")),
        "removed": v.filter("vec_id % 7 = 3").select("id"),
    }


BUILT = f"""{DENSE}, n AS (SELECT count(*) AS n FROM v),
b AS (SELECT row_number() OVER (ORDER BY label, vec_id DESC) - 1 AS row, 'v:' || vec_id AS id, v.row AS source_row, embedding, vec_id, label,
  CASE WHEN v.row * 4 < n THEN 'parent' ELSE 'new' END AS origin FROM v, n WHERE vec_id % 7 <> 3)"""


@query("s16_release_builder", f"WITH {BUILT} SELECT row, id, coalesce(source, '?') AS title, label % 3 AS license, origin, source_row, {CHECKSUM} FROM b LEFT JOIN documents ON doc_id = vec_id")
def _(spark, d):
    path = _folder(spark, "built")
    made = release.open_release(spark, path, builder.build(_build_inputs(spark, d), path, "built"))
    rows = made["tracks"].join(made["rights"], ["row", "id"]).join(made["vectors"], ["row", "id"]).join(made["provenance"], ["row", "id"])
    return rows.select("row", "id", "title", "license", "origin", "source_row", _checksum())


@query(
    "s16_build_problems",
    f"""WITH {DENSE}, n AS (SELECT count(*) AS n FROM v), x AS (SELECT 'v:' || vec_id AS id, row, n, vec_id % 7 <> 3 AS kept FROM v, n)
SELECT 'parent prefix differs' AS problem, id FROM x WHERE row * 4 < n AND row % 10 = 1
UNION ALL SELECT 'vector differs from its provenance', id FROM x WHERE row * 4 >= n AND row % 10 = 1 AND kept
UNION ALL SELECT 'no provenance', id FROM x WHERE row * 4 >= n AND row % 10 = 2 AND kept
UNION ALL SELECT 'audio differs from its provenance', id FROM x WHERE row * 4 >= n AND row % 10 = 3 AND kept
UNION ALL SELECT 'not in rights', id FROM x WHERE row % 10 = 4 AND kept
UNION ALL SELECT 'repeated id in selection', id FROM x WHERE row % 10 = 5""",
)
def _(spark, d):
    """Every breach is found: vectors changed in one component, lost or changed provenance, lost rights, ids selected twice."""
    good = _build_inputs(spark, d)
    at = good["vectors"].select("id", (F.col("row") % 10).alias("k"))
    told = good["provenance"].join(at, "id").filter("k <> 2").withColumn("audio_sha256", F.expr("if(k = 3, reverse(audio_sha256), audio_sha256)"))
    twice = good["selection"].join(at.filter("k = 5").select("id"), "id", "left_semi")
    changed = F.expr("if(row % 10 = 1, transform(embedding, (x, i) -> if(i = 63, x + cast(1 as float), x)), embedding)")
    bad = good | {
        "vectors": good["vectors"].withColumn("embedding", changed),
        "provenance": told.select("id", "audio_sha256", "vector_sha256"),
        "rights": good["rights"].join(at.filter("k <> 4").select("id"), "id", "left_semi"),
        "selection": good["selection"].unionByName(twice),
    }
    return builder.build_problems(builder.digested(bad))


# ---------------------------------------------------------------- releases of documents


def _documents(spark, d):
    """Tables and headers of a release of documents: a track for each vector, and rings as its graph."""
    v = _dense(spark, d)
    n = v.count()
    around = [F.struct(F.lit(0).alias("level"), F.array_distinct(F.array(*((F.col("row") + k) % n for k in (1, 2, 5)))).alias("neighbors"))]
    above = F.when(F.col("row") % 10 == 0, F.array(F.struct(F.lit(1).alias("level"), F.array(F.when(F.col("row") + 10 < n, F.col("row") + 10).otherwise(0)).alias("neighbors")))).otherwise(F.array())
    layers = v.select(F.col("row").alias("src"), F.inline(F.concat(F.array(*around), above)))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    track = text('{"artist":"a', F.col("vec_id") % 9, '","id":"v:', F.col("vec_id"), '","title":"Léad ', F.coalesce(F.col("label"), F.lit(-1)), '"}')
    tables = {
        "tracks": v.select("row", F.concat(F.lit("v:"), "vec_id").alias("id"), track.alias("body")),
        "rights": v.select("row", F.concat(F.lit("v:"), "vec_id").alias("id"), text('{"id":"v:', F.col("vec_id"), '","use":"', F.col("vec_id") % 2, '"}').alias("body")),
        "layers": layers,
        "vectors": v.select("row", F.transform(normalised(F.col("embedding")), lambda x: x.cast("float")).alias("embedding")),
    }
    size = len(v.first().embedding)
    return tables, {"catalog": {"id": "c:1", "dimensions": size}, "rights": {"catalogId": "c:1"}, "index": {"M": 2, "count": n, "entry": 0, "maxLevel": 1}}


def _written(spark, d):
    """(folder, digest) of such a release, written once."""

    def build(folder):
        digest = json_release.write_json_release(*_documents(spark, d), folder)
        spark.createDataFrame([(digest,)], "digest string").write.parquet(f"{folder}/digest")

    folder = stored(spark, f"{d}/embeddings.parquet", "documents", build)
    return folder, spark.read.parquet(f"{folder}/digest").first().digest


RING = f"""{DENSE}, n AS (SELECT count(*) AS n FROM v),
layers AS (SELECT row, 0 AS level, [(row + 1) % n, (row + 2) % n, (row + 5) % n] AS own FROM v, n
  UNION ALL SELECT row, 1, [CASE WHEN row + 10 < n THEN row + 10 ELSE 0 END] FROM v, n WHERE row % 10 = 0)"""
TRACK = """'{"artist":"a' || (vec_id % 9) || '","id":"v:' || vec_id || '","title":"Léad ' || coalesce(label, -1) || '"}'"""


@query("s02_json_release", f"WITH {RING} SELECT v.row, 'v:' || vec_id AS id, 'Léad ' || coalesce(label, -1) AS title, 'a' || (vec_id % 9) AS artist, level, array_to_string(own, ',') AS neighbors FROM v JOIN layers USING (row)")
def _(spark, d):
    tables, _, _ = json_release.load_release(spark, *_written(spark, d))
    layers = tables["layers"].select(F.col("src").alias("row"), "level", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))
    return tables["tracks"].select("row", "id", "title", "artist").join(layers, "row")


@query("s13_converted_release", f"WITH {RING} SELECT v.row, 'v:' || vec_id AS id, 'lead ' || coalesce(label, -1) AS fold_title, sum(len(own))::BIGINT AS links, '{{\"id\":\"v:' || vec_id || '\",\"use\":\"' || (vec_id % 2) || '\"}}' AS rights FROM v JOIN layers USING (row) GROUP BY ALL")
def _(spark, d):
    path = _folder(spark, "converted")
    made = release.open_release(spark, path, json_release.convert(spark, *_written(spark, d), path))
    links = made["layers"].groupBy(F.col("src").alias("row")).agg(F.sum(F.size("neighbors")).alias("links"))
    return made["tracks"].join(links, "row").join(made["records"].select("row", F.col("right").alias("rights")), "row").select("row", "id", "fold_title", "links", "rights")


@query(
    "s15_reconstructed_documents",
    f"""WITH {RING}, t AS (
  SELECT 'catalog' AS name, '{{"dimensions":' || min(len(embedding)) || ',"id":"c:1","tracks":[' || string_agg({TRACK}, ',' ORDER BY row) || ']}}' AS body FROM v
  UNION ALL SELECT 'ids', '[' || string_agg('"v:' || vec_id || '"', ',' ORDER BY row) || ']' FROM v
  UNION ALL SELECT 'rights', '{{"catalogId":"c:1","tracks":[' || string_agg('{{"id":"v:' || vec_id || '","use":"' || (vec_id % 2) || '"}}', ',' ORDER BY row) || ']}}' FROM v
  UNION ALL SELECT 'index', '{{"M":2,"count":' || count(*) || ',"entry":0,"maxLevel":1,"links":[' || string_agg(own, ',' ORDER BY row) || ']}}' FROM (
    SELECT row, '[' || string_agg('[' || array_to_string(own, ',') || ']', ',' ORDER BY level) || ']' AS own FROM layers GROUP BY row)
) SELECT name, strlen(body)::BIGINT AS bytes, sha256(body) AS sha256 FROM t""",
)
def _(spark, d):
    """The documents written back from the tables of a conversion."""
    path, back = _folder(spark, "converted"), _folder(spark, "documents")
    made = release.open_release(spark, path, json_release.convert(spark, *_written(spark, d), path, index=False))
    pins = json_release.reconstruct(made, back)
    return spark.createDataFrame([(name, pin["bytes"], pin["sha256"]) for name, pin in pins.items() if name != "vectors"], "name string, bytes long, sha256 string")


@query("q09_graph_identity", f"WITH {DENSE} SELECT 'orderedIdsSha256' AS field, sha256('[' || string_agg('\"v:' || vec_id || '\"', ',' ORDER BY row) || ']') AS value FROM v UNION ALL SELECT 'count', count(*)::VARCHAR FROM v UNION ALL SELECT 'swapped rows', 'graphIdentity.orderedIdsSha256, orderedIdsSha256' UNION ALL SELECT 'changed vector', 'graphIdentity.vectorsSha256, vectorsSha256'")
def _(spark, d):
    """A graph's identity, and what a manifest breaks after two ids have changed places, or one vector one component."""
    v = _dense(spark, d).withColumn("id", F.concat(F.lit("v:"), "vec_id"))
    own = {"ids": v.select("row", "id"), "vectors": v.select("row", "embedding")}
    build, audio = {"M": 12, "efConstruction": 100, "seed": 43}, {"model": "m"}
    of = lambda t: json_release.graph_identity(t, build, 64)
    good = of(own)
    manifest = json_release.graph_manifest(good, "c:1", audio)
    swapped = of(own | {"ids": own["ids"].withColumn("row", F.expr("case row when 3 then 4 when 4 then 3 else row end"))})
    changed = of(own | {"vectors": own["vectors"].withColumn("embedding", F.expr("if(row = 5, transform(embedding, (x, i) -> if(i = 9, -x, x)), embedding)"))})
    broken = [(name, ", ".join(json_release.manifest_problems(manifest, x, "c:1", audio))) for name, x in (("swapped rows", swapped), ("changed vector", changed))]
    return spark.createDataFrame([("orderedIdsSha256", good["orderedIdsSha256"]), ("count", str(good["count"])), *broken], "field string, value string")
