"""Queries over stored catalogs, members, plans, replies and views of the map, with their SQL."""

from __future__ import annotations

import bz2
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quaver import schema
from quaver.functions.text import PATTERNS
from quaver.operators import governance, graph, lookup, rerank, tiles
from quaver.plans.engine import Engine
from quaver.queries_search import FOLDED
from quaver.scratch import shared_folder
from quaver.sources import release

QUERIES, SQL = {}, {}
T, E = schema.TRACKS_SQL, schema.EDGES_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _stored(spark, d):
    """The tables of a catalog that was written with folded names and its index."""
    path = f"{shared_folder(spark)}/releases/{uuid.uuid4().hex}"
    return release.open_release(spark, path, release.write_catalog(schema.tracks(spark, d), path, "demo"))


@query("s11_catalog_writer", f"WITH {T}, {FOLDED} SELECT row, id, ft AS fold_title, fta AS fold_title_artist FROM f")
def _(spark, d):
    return _stored(spark, d)["tracks"].select("row", "id", "fold_title", "fold_title_artist")


@query(
    "l12_index_problems",
    f"WITH {T}, {FOLDED} SELECT DISTINCT gram, row, 'missing' AS problem FROM f, unnest(list_transform(range(1, greatest(1, length(fx) - 1)), lambda i: substr(fx, i, 3))) t(gram) WHERE row % 50 = 0 UNION ALL SELECT 'zzz', -1, 'extra'",
)
def _(spark, d):
    own = _stored(spark, d)
    broken = own["grams"].filter("row % 50 <> 0").unionByName(spark.createDataFrame([("zzz", -1)], "gram string, row long"))
    return lookup.index_problems(own["tracks"], broken)


@query(
    "l07_credit_redirects",
    f"WITH {T}, s AS (SELECT id, row_number() OVER (ORDER BY row) - 1 AS k FROM tracks WHERE row % 7 <> 0) SELECT id, k // 50 + 1 AS page, replace(id, ':', '-') AS anchor FROM s",
)
def _(spark, d):
    t = schema.tracks(spark, d)
    return lookup.credit_redirects(t, t.filter("row % 7 <> 0"))


@query(
    "a07_keep_overlaps",
    f"WITH {T} SELECT count(*) AS keep_set, count(*) FILTER (WHERE row % 11 = 0) AS held_by_review, count(*) FILTER (WHERE row % 7 = 0) AS held_by_tags, count(*) FILTER (WHERE row % 77 = 0) AS held_by_both FROM tracks WHERE row % 5 <> 0",
)
def _(spark, d):
    t = schema.tracks(spark, d)
    buckets = t.select("id", F.when(F.col("row") % 5 == 0, "B.old").otherwise("KEEP").alias("bucket"))
    notices = t.select("id", F.when(F.col("row") % 7 == 0, F.array(F.lit("NC"))).otherwise(F.array().cast("array<string>")).alias("kinds"))
    reviews = t.filter("row % 11 = 0").select("id", F.lit("R.names").alias("code"))
    return governance.keep_overlaps(t, buckets, notices, reviews.unionByName(reviews))


@query("q03_nothing_served", "SELECT NULL::VARCHAR AS id, 'nothing served' AS problem")
def _(spark, d):
    t = schema.tracks(spark, d)
    return governance.serving_problems(t, t.select("id", F.lit(False).alias("serve"), F.array(F.lit("HOLD")).alias("reasons")), ["SERVE", "HOLD"])


@query(
    "q07_sampled_index",
    f"WITH {T}, s AS (SELECT row, row_number() OVER (ORDER BY row) - 1 AS k, max(row) OVER () AS last FROM tracks WHERE row % 3 <> 0) SELECT row FROM s WHERE k % 50 = 0 OR row = last",
)
def _(spark, d):
    return governance.sampled_index(schema.tracks(spark, d).filter("row % 3 <> 0"), 50)


@query(
    "j09_plan_agreement",
    f"WITH {T} SELECT id, CASE WHEN row % 17 = 0 THEN 'order' WHEN row % 19 = 0 THEN 'not approved' WHEN row % 23 = 0 THEN 'recording' WHEN row % 29 = 0 THEN 'member bounds' ELSE 'evidence' END AS problem FROM tracks WHERE row % 17 = 0 OR row % 19 = 0 OR row % 23 = 0 OR row % 29 = 0 OR row % 31 = 0",
)
def _(spark, d):
    t = schema.tracks(spark, d).select("row", "id", F.col("audio_bytes").alias("bytes"), F.sha2("title", 256).alias("sha256"), F.concat(F.lit("evidence/"), "row").alias("path"), (F.col("row") * 7).alias("crc32"))
    plan = t.filter("row % 17 <> 0").select(
        "row", "id", (F.col("bytes") + (F.col("row") % 23 == 0).cast("long")).alias("bytes"), "sha256", F.col("bytes").alias("compressed_bytes"),
        (F.col("bytes") + F.when(F.col("row") % 29 == 0, 511).otherwise(512)).alias("range_bytes"), "crc32", "path",
    )
    rights = t.select("id", F.when(F.col("row") % 19 == 0, "held").otherwise("approved").alias("decision"), "path")
    evidence = t.select("path", "bytes", (F.col("crc32") + (F.col("row") % 31 == 0).cast("long")).alias("crc32"))
    return governance.plan_problems(plan, t, rights, evidence)


@query(
    "r04_reply_problems",
    "SELECT * FROM (SELECT vec_id // 10 AS query, vec_id % 10 + 1 AS rank, CASE WHEN vec_id % 50 = 7 THEN vec_id - 1 ELSE vec_id END AS id,"
    " CASE WHEN vec_id % 10 = 9 THEN 'over k' WHEN vec_id % 50 IN (6, 7) THEN 'repeated' WHEN vec_id % 30 = 5 THEN 'out of range' WHEN vec_id % 40 = 3 THEN 'rising' END AS problem FROM embeddings) WHERE problem IS NOT NULL",
)
def _(spark, d):
    v = schema.vectors(spark, d)
    similarity = F.when(F.col("row") % 30 == 5, 1.5).when(F.col("row") % 40 == 3, 0.99).otherwise(1 - (F.col("row") % 10 + 1) * 0.05)
    replies = v.select(F.expr("row div 10").alias("query"), (F.col("row") % 10 + 1).alias("rank"), F.when(F.col("row") % 50 == 7, F.col("row") - 1).otherwise(F.col("row")).alias("id"), similarity.alias("similarity"))
    return rerank.reply_problems(replies, 9)


@query("t12_tile_levels", "SELECT vec_id AS row, greatest(0, least(6, ceil(log2((vec_id + 1) * 2.0 / 128))))::INT AS level FROM embeddings")
def _(spark, d):
    return schema.vectors(spark, d).select("row", tiles.tile_level(F.col("row") + 1, 2.0, 6, 128).alias("level"))


_RAMP = "pow(greatest(0, least(1, (log2(zoom) - log2({e}) + 0.2) / 0.4)), 2) * (3 - 2 * greatest(0, least(1, (log2(zoom) - log2({e}) + 0.2) / 0.4)))"


@query("t12_region_alpha", f"WITH z AS (SELECT vec_id AS row, 0.5 + vec_id % 97 * 0.05 AS zoom FROM embeddings) SELECT row, round(least({_RAMP.format(e='1.5')}, 1 - {_RAMP.format(e='4.0')}), 6) AS alpha, round(1 - {_RAMP.format(e='2.0')}, 6) AS first FROM z")
def _(spark, d):
    zoom = 0.5 + F.col("row") % 97 * 0.05
    return schema.vectors(spark, d).select("row", F.round(tiles.region_alpha(zoom, 1.5, 4.0), 6).alias("alpha"), F.round(tiles.region_alpha(zoom, 0, 2.0), 6).alias("first"))


@query("p10_tiles_in_view", "SELECT x, y, round(sqrt(pow(x + 0.5 - 4.0, 2) + pow(y + 0.5 - 2.55, 2)), 6) AS distance FROM range(2, 6) a(x), range(1, 4) b(y)")
def _(spark, d):
    return tiles.tiles_in_view(spark, (0.0, 0.0, 8.0), 3, (2.5, 1.2, 5.5, 3.9)).select("x", "y", F.round("distance", 6).alias("distance"))


@query(
    "g06_first_seen",
    f"WITH {E}, m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(level) AS level, min({{'s': src, 'l': level, 'p': pos}}) AS f FROM edges GROUP BY 1, 2) SELECT a, b, level, f.s AS first_src, f.l AS first_level, f.p AS first_pos FROM m",
)
def _(spark, d):
    return graph.first_seen(schema.ring_edges(spark, d))


@query(
    "f09_codes_and_contacts",
    f"WITH {T} SELECT row, row % 3 = 0 AS code, row % 2 = 0 AS contact FROM tracks",
)
def _(spark, d):
    code = F.when(F.col("row") % 3 == 0, F.concat(F.lit("T."), "license")).when(F.col("row") % 3 == 1, F.lower("license")).otherwise(F.concat("license", F.lit("\n")))
    contact = F.when(F.col("row") % 2 == 0, F.concat(F.lit("a.b+"), "row", F.lit("@mail.example.org"))).otherwise(F.concat(F.lit("a@b"), "row"))
    return schema.tracks(spark, d).select("row", code.rlike(PATTERNS["code"]).alias("code"), contact.rlike(PATTERNS["contact"]).alias("contact"))


@query(
    "f19_merged_notices",
    "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'albumInformation=a,' ELSE '' END || 'own=s,track_composer=' || CASE WHEN user_id % 2 = 0 THEN 'c' || user_id ELSE 'old' END || ',track_lyricist=l' AS notices FROM events",
)
def _(spark, d):
    e = schema.table(spark, d, "events")
    supplied = F.create_map(F.lit("track_composer"), F.lit("old"), F.lit("own"), F.lit("s"))
    composer = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("c"), F.col("user_id").cast("string"))).otherwise("")
    record = F.create_map(F.lit("track_composer"), composer, F.lit("track_lyricist"), F.lit("l"), F.lit("other"), F.lit("x"))
    merged = release.merged_notices(supplied, record, F.when(F.col("user_id") % 3 == 0, "a"))
    pairs = F.array_sort(F.transform(F.map_entries(merged), lambda p: F.concat(p["key"], F.lit("="), p["value"])))
    return e.select("event_id", F.array_join(pairs, ",").alias("notices"))


def zipped(name: str, content: bytes) -> bytes:
    """A local ZIP member with bzip2 content, padded so that its range is 512 bytes longer than the content."""
    body = bz2.compress(content)
    head = struct.pack("<4s5H3I2H", b"PK\x03\x04", 46, 0, 12, 0, 0, zlib.crc32(content), len(body), len(content), len(name.encode()), 0) + name.encode()
    return head + body + bytes(512 - len(head))


@F.arrow_udf(BinaryType())
def _zipped(names: pa.Array, contents: pa.Array) -> pa.Array:
    return pa.array([zipped(n.as_py(), c.as_py()) for n, c in zip(names, contents)], pa.binary())


def members_of(docs):
    """Members of the texts of (doc_id, text)."""
    named = docs.filter("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.encode("text", "UTF-8").alias("c"), F.concat(F.lit("archive/"), "doc_id").alias("filename"))
    own = named.withColumn("data", _zipped("filename", "c"))
    size = F.octet_length("data").cast("long")
    return own.select("id", "data", "filename", F.octet_length("c").cast("long").alias("bytes"), (size - 512).alias("compressed_bytes"), size.alias("range_bytes"), F.crc32("c").alias("crc32"), F.sha2("c", 256).alias("sha256"))


@query("s18_member_decode", "SELECT doc_id::VARCHAR AS id, sha256(text) AS sha, strlen(text)::BIGINT AS bytes, NULL::VARCHAR AS problem FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    decoded = release.decode_members(members_of(schema.table(spark, d, "documents")))
    return decoded.select("id", F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("bytes"), "problem")


@query("s19_hydration", "SELECT count(*) AS members, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    path = f"{shared_folder(spark)}/releases/{uuid.uuid4().hex}"
    content = release.hydrate(members_of(schema.table(spark, d, "documents")), path, 1 << 40)
    return content.agg(F.count("*").alias("members"), F.sum(F.octet_length("content")).alias("bytes"))


@query("v25_replayed_examples")
def _(spark, d):
    v = schema.vectors(spark, d)
    digest = F.sha2(F.unbase64(release.packed(F.col("embedding"))), 256)
    examples = v.filter("row % 20 = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"), digest.alias("vector_sha256"))
    return Engine(schema.tracks(spark, d), v, edges=schema.ring_edges(spark, d)).replay(examples)
