"""Queries over graphs, governance, aggregates, joins, sources and admission, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver import schema
from quaver.functions import text
from quaver.functions.text import PATTERNS
from quaver.operators import governance as gov
from quaver.operators import graph, lookup, search
from quaver.scratch import scratch_table, stored
from quaver.sources import release
from quaver.streaming import admission

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


E, T = schema.EDGES_SQL, schema.TRACKS_SQL

# ------------------------------------------------------------------ graphs


def _queries(v, step=20):
    return v.filter(F.col("row") % step == 0).select(F.col("row").alias("query"), F.col("embedding").alias("q"))


@query("g01_traced_search")
def _(spark, d):
    v = schema.vectors(spark, d)
    return graph.traced_search(v, schema.ring_edges(spark, d), _queries(v), entry=0, k=8, ef=32)


def _shards(spark, d):
    """Graphs of about 10,000 rows each over the vectors, stored once."""
    v = schema.vectors(spark, d)
    return stored(spark, f"{d}/embeddings.parquet", "shards", lambda folder: graph.write_shards(v, folder, graph.shard_count(v)))


@query("g02_sharded_graph_search")
def _(spark, d):
    return graph.merged_results(graph.search_stored(_queries(schema.vectors(spark, d)), _shards(spark, d), 8, 64, 0), 8)


@query("g01_shard_traces")
def _(spark, d):
    return graph.search_stored(_queries(schema.vectors(spark, d)), _shards(spark, d), 8, 32)


@query("v21_graph_recall")
def _(spark, d):
    v = schema.vectors(spark, d)
    found = QUERIES["g02_sharded_graph_search"](spark, d)
    return search.recall(found.select("query", "row"), search.batch_top_k(v, _queries(v), 8).select("query", "row"), 8)


@query("g05_stored_links", f"WITH {E} SELECT level, string_agg(dst::VARCHAR, ',' ORDER BY pos) AS links FROM edges WHERE src = 10 AND dst % 7 <> 0 GROUP BY level")
def _(spark, d):
    return graph.stored_links(schema.ring_edges(spark, d), 10, schema.served(spark, d)).select("level", F.array_join("links", ",").alias("links"))


@query("g06_undirected_edges", f"WITH {E} SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(level) AS level FROM edges GROUP BY 1, 2")
def _(spark, d):
    return graph.undirected(schema.ring_edges(spark, d))


@query("g07_structure_problems", f"WITH {E}, x AS (SELECT src, level, dst FROM edges UNION ALL SELECT 3, 0, 3 UNION ALL SELECT 4, 0, 5 UNION ALL SELECT 5, 0, 999999999 UNION ALL SELECT 20, 1, 7) SELECT 'self link' AS problem, 3::BIGINT AS src, 0 AS level UNION ALL SELECT 'repeated link', 4, 0 UNION ALL SELECT 'unknown end', 5, 0 UNION ALL SELECT 'neighbour lacks the level', 20, 1 UNION ALL SELECT 'too many links', src, level FROM x GROUP BY src, level HAVING count(*) > 2 * 2 OR level = 1 AND count(*) > 2")
def _(spark, d):
    bad = spark.createDataFrame([(3, 0, 9, 3), (4, 0, 9, 5), (5, 0, 9, 999999999), (20, 1, 9, 7)], "src long, level int, pos int, dst long")
    return graph.structure_problems(schema.ring_edges(spark, d).unionByName(bad), schema.vectors(spark, d), 2)


@query("g08_reachability", f"WITH RECURSIVE {E}, r(row, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, hops + 1 FROM r JOIN edges ON src = row AND level = 0 WHERE hops < 120) SELECT row, min(hops) AS hops FROM r GROUP BY row")
def _(spark, d):
    return graph.reachable(schema.ring_edges(spark, d), 0)


@query("s05_csr_encode", f"WITH {E}, p AS (SELECT src, level, string_agg(dst::VARCHAR, ',' ORDER BY pos) AS neighbors, count(*) AS n FROM edges GROUP BY ALL) SELECT src, level, neighbors, (sum(n) OVER (ORDER BY src, level) - n)::BIGINT AS \"offset\" FROM p")
def _(spark, d):
    return graph.csr(schema.ring_edges(spark, d)).select("src", "level", F.array_join("neighbors", ",").alias("neighbors"), "offset")


@query("s04_csr_decode", f"WITH {E} SELECT src, level, pos, dst FROM edges")
def _(spark, d):
    return graph.from_csr(graph.csr(schema.ring_edges(spark, d)))


@query("g09_trace_rows")
def _(spark, d):
    return graph.trace_rows(QUERIES["g01_traced_search"](spark, d))


@query("g11_beat_edges")
def _(spark, d):
    trace = scratch_table(QUERIES["g01_traced_search"](spark, d), "trace")
    return graph.beat_edges(trace).join(graph.beats(trace).select("query", "sequence"), ["query", "sequence"], "left_semi")


@query("g10_trace_beats")
def _(spark, d):
    return graph.beats(QUERIES["g01_traced_search"](spark, d))


@query("g12_served_trace")
def _(spark, d):
    return graph.results_of(graph.served_trace(QUERIES["g01_traced_search"](spark, d), schema.served(spark, d)))


# ------------------------------------------------------------------ aggregates, joins, sets


@query("a02_count_by_license", f"WITH {T} SELECT license, count(*) AS n FROM tracks GROUP BY license")
def _(spark, d):
    return schema.tracks(spark, d).groupBy("license").agg(F.count("*").alias("n"))


@query("a03_distinct_artists", f"WITH {T} SELECT count(DISTINCT artist_id) AS n FROM tracks")
def _(spark, d):
    return schema.tracks(spark, d).agg(F.countDistinct("artist_id").alias("n"))


@query("a04_contiguity", "SELECT min(vec_id) AS lo, max(vec_id) AS hi, count(*) AS n, max(vec_id) - min(vec_id) + 1 = count(*) AS dense FROM embeddings")
def _(spark, d):
    a = schema.vectors(spark, d).agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("*").alias("n"))
    return a.withColumn("dense", F.col("hi") - F.col("lo") + 1 == F.col("n"))


@query("a06_build_summary", f"WITH {T} SELECT license, genre, count(*) AS n, count(DISTINCT artist_id) AS artists, sum(audio_bytes)::BIGINT AS bytes FROM tracks GROUP BY ALL")
def _(spark, d):
    return schema.tracks(spark, d).groupBy("license", "genre").agg(F.count("*").alias("n"), F.countDistinct("artist_id").alias("artists"), F.sum("audio_bytes").alias("bytes"))


@query("a08_unique_counts", "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS unique_texts FROM documents")
def _(spark, d):
    return schema.table(spark, d, "documents").agg(F.count("*").alias("n"), F.countDistinct(F.sha2("text", 256)).alias("unique_texts"))


@query("a09_availability_bits", "SELECT count(*) FILTER (WHERE vec_id % 7 <> 0) AS n FROM embeddings")
def _(spark, d):
    rows = schema.vectors(spark, d).select("row", (F.col("row") % 7 != 0).alias("available"))
    return release.availability_bits(rows).agg(F.sum(F.bitmap_count("bits")).alias("n"))


@query("j01_tracks_records", f"WITH {T} SELECT t.row, title, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM tracks t JOIN lineitem ON l_partkey = t.row GROUP BY ALL")
def _(spark, d):
    items = schema.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return schema.tracks(spark, d).join(items, "row").select("row", "title", "n", "total")


@query("j05_quarantine_anti", "SELECT d.doc_id AS row FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def _(spark, d):
    bad = schema.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    return schema.table(spark, d, "documents").join(bad, "doc_id", "left_anti").select(F.col("doc_id").alias("row"))


@query("j06_hash_alarm", "WITH q AS (SELECT d.doc_id AS listed, sha256(text) AS h FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1) SELECT d.doc_id AS id, listed FROM documents d JOIN q ON sha256(text) = h WHERE d.doc_id NOT IN (SELECT listed FROM q)")
def _(spark, d):
    docs = schema.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("audio_sha256"))
    bad = schema.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("remove").alias("action"))
    return gov.quarantine(docs, docs.join(bad, "id"))[1]


@query("set_differences", "(SELECT vec_id AS row FROM embeddings EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def _(spark, d):
    v, lab = schema.vectors(spark, d).select("row"), schema.table(spark, d, "labels").select(F.col("doc_id").alias("row"))
    return v.subtract(lab).unionByName(lab.intersect(v.filter("row % 2 = 0")))


@query("set_ordered_distinct", "SELECT l_suppkey AS row, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    return schema.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("row")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


# ------------------------------------------------------------------ functions


@query("f04_hashes", "SELECT doc_id, sha256(text) AS sha FROM documents")
def _(spark, d):
    return schema.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("f05_canonical_json", "SELECT event_id, sha256(json_object('a', trunc(value)::BIGINT, 'b', event_type)) AS sha FROM events")
def _(spark, d):
    j = F.to_json(F.struct(F.col("event_type").alias("b"), F.col("value").cast("long").alias("a")))
    return schema.table(spark, d, "events").select("event_id", text.canonical_sha(j).alias("sha"))


@query("f07_strict_json", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'duplicate key' WHEN 1 THEN 'not finite' WHEN 2 THEN 'syntax' END AS problem FROM events")
def _(spark, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.lit('{"a":1,"a":2}')).when(F.col("event_id") % 5 == 1, F.lit('{"a":NaN}')).when(F.col("event_id") % 5 == 2, F.lit("{a}")).otherwise(F.col("props"))
    return schema.table(spark, d, "events").select("event_id", text.strict_json(broken).alias("problem"))


@query("f08_origins", "SELECT page_id, regexp_matches(url, '^https?://[^/?#@\\s]+([/?#]\\S*)?$') AS source, regexp_matches(split_part(url, '/', 1) || '//' || split_part(url, '/', 3), '^https://[A-Za-z0-9.-]+(:[0-9]{1,5})?$') AS origin FROM pages")
def _(spark, d):
    origin = F.concat(F.split("url", "/")[0], F.lit("//"), F.split("url", "/")[2])
    return schema.table(spark, d, "pages").select("page_id", text.is_source_url(F.col("url")).alias("source"), text.is_https_origin(origin).alias("origin"))


@query("f09_patterns", f"WITH {T} SELECT row, regexp_matches(id, '^fma:[0-9]{{1,9}}$') AS track, regexp_matches(sha256(title), '^[a-f0-9]{{64}}$') AS sha FROM tracks")
def _(spark, d):
    return schema.tracks(spark, d).select("row", F.col("id").rlike(PATTERNS["track"]).alias("track"), F.sha2("title", 256).rlike(PATTERNS["sha256"]).alias("sha"))


@query("f10_routes", f"WITH {T} SELECT row, '/audio/' || lpad(row::VARCHAR, 6, '0') || '.mp3' AS route, row % 7 <> 0 AS available FROM tracks")
def _(spark, d):
    t = schema.tracks(spark, d)
    return release.delivery(t, t.filter("row % 7 <> 0"))


@query("f11_confined_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE false END AS ok FROM pages")
def _(spark, d):
    p = F.element_at(F.array(F.lit("evidence/a.json"), F.lit("../a"), F.lit("/etc/a"), F.lit("a//b")), (F.col("page_id") % 4 + 1).cast("int"))
    return schema.table(spark, d, "pages").select("page_id", text.is_confined(p).alias("ok"))


@query("f12_html_escape", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""")
def _(spark, d):
    return schema.table(spark, d, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("escaped"))


@query("f13_query_limits", "SELECT conv_id, turn, 'vocals' AS field, 9 AS start, 18 AS \"end\" FROM conversations UNION ALL SELECT conv_id, turn, 'language', 19, 29 FROM conversations UNION ALL SELECT conv_id, turn, 'duration', 31, 46 FROM conversations")
def _(spark, d):
    asked = F.lit("🎹 piano no vocals in Spanish, under 3 minutes")
    r = schema.table(spark, d, "conversations").select("conv_id", "turn", F.inline(text.query_limits(F.concat(asked, F.lit("")))))
    return r.select("conv_id", "turn", "field", "start", "end")


@query("s24_base64_vectors", "SELECT vec_id AS row, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def _(spark, d):
    v = schema.vectors(spark, d).select("row", release.packed(F.col("embedding")).alias("p"))
    return v.select("row", F.round(F.aggregate(release.unpacked(F.col("p")), F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("f20_sampling_window", f"WITH {T} SELECT row, (row * 7919) % (audio_bytes - 100) AS start FROM tracks WHERE audio_bytes > 100")
def _(spark, d):
    return schema.tracks(spark, d).filter("audio_bytes > 100").select("row", F.pmod(F.col("row") * 7919, F.col("audio_bytes") - 100).alias("start"))


# ------------------------------------------------------------------ sources


@query("s06_rows_by_position", f"WITH {T} SELECT pos, row, title FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 150)) v(pos, r) JOIN tracks ON row = r")
def _(spark, d):
    return release.rows_by_position(schema.tracks(spark, d), [7, 3, 7, 150]).select("pos", "row", "title")


@query("s07_positions", f"WITH {schema.LAYOUT_SQL} SELECT row, round(x, 6) AS x, round(y, 6) AS y FROM layout WHERE row IN (3, 7, 150)")
def _(spark, d):
    return release.positions(schema.layout(spark, d), [7, 3, 7, 150]).select("row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("s09_verified_blobs", "SELECT doc_id % 10 = 0 AS tampered, count(*) AS n, count(*) FILTER (WHERE doc_id % 10 <> 0) AS good FROM documents GROUP BY 1")
def _(spark, d):
    docs = schema.table(spark, d, "documents").select((F.col("doc_id") % 10 == 0).alias("tampered"), F.col("text").cast("binary").alias("t"))
    blobs = docs.select("tampered", F.when(F.col("tampered"), F.concat("t", F.lit("x").cast("binary"))).otherwise(F.col("t")).alias("data"), F.length("t").alias("bytes"), F.sha2("t", 256).alias("sha256"))
    return release.verified_blobs(blobs).groupBy("tampered").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"))


@query("s12_merged_evidence", "SELECT source AS path, min(length(source)) AS bytes, sha256(source) AS sha256 FROM documents GROUP BY source")
def _(spark, d):
    e = schema.table(spark, d, "documents").select(F.col("source").alias("path"), F.length("source").cast("long").alias("bytes"), F.sha2("source", 256).alias("sha256"))
    return release.merged_evidence(e)


# ------------------------------------------------------------------ governance

_SHA = "sha256(title)"
_BAD = {1: ("license", "r_license"), 2: ("audio pin", "bytes"), 3: ("review", "decision"), 4: ("timestamp", "ts"), 5: ("evidence", "path")}


def _catalog_and_rights(spark, d):
    t = schema.tracks(spark, d).withColumn("k", F.col("row") % 11)
    base = t.select(
        "row", "id", "k", "title", "artist",
        F.lit("CC-BY-4.0").alias("license"), F.lit(gov.LICENSES["CC-BY-4.0"]).alias("license_url"), F.concat(F.lit("https://example.org/t/"), "row").alias("source_url"),
        F.concat_ws(" by ", "title", "artist").alias("attribution"), F.greatest("audio_bytes", F.lit(1)).cast("long").alias("audio_bytes"), F.sha2("title", 256).alias("audio_sha256"),
    )
    rights = base.select(
        "row", "id",
        F.when(F.col("k") == 1, "CC0-1.0").otherwise(F.col("license")).alias("license"), "license_url", "source_url",
        (F.col("audio_bytes") + F.when(F.col("k") == 2, 1).otherwise(0)).alias("audio_bytes"), "audio_sha256",
        F.when(F.col("k") == 3, "pending").otherwise("approved").alias("decision"), F.lit("reviewer").alias("reviewed_by"),
        F.when(F.col("k") == 4, "2024-02-30T00:00:00Z").otherwise("2024-02-29T12:00:00Z").alias("reviewed_at"),
        F.when(F.col("k") == 5, "evidence/../x").otherwise(F.concat(F.lit("evidence/"), "row")).alias("evidence_path"),
    )
    return base.drop("k"), rights


@query("q01_rights_rules", f"WITH {T} SELECT row, CASE row % 11 WHEN 1 THEN 'license' WHEN 2 THEN 'audio pin' WHEN 3 THEN 'review' WHEN 4 THEN 'timestamp' ELSE 'evidence' END AS problem FROM tracks WHERE row % 11 BETWEEN 1 AND 5")
def _(spark, d):
    return gov.check_rights(*_catalog_and_rights(spark, d))


@query("q02_evidence_budget", f"WITH {T}, o AS (SELECT row, audio_bytes, sum(audio_bytes) OVER (ORDER BY row) AS s FROM tracks) SELECT row, 'evidence/' || row AS path, 'budget' AS problem FROM o WHERE s > 1000000")
def _(spark, d):
    e = schema.tracks(spark, d).select("row", F.concat(F.lit("evidence/"), "row").alias("path"), F.col("audio_bytes").alias("bytes"), F.sha2("title", 256).alias("sha256"))
    return gov.evidence_budget(e, 1_000_000)


@query("q03_serving_problems", f"WITH {T} SELECT id, 'unlisted' AS problem FROM tracks WHERE row % 13 = 0 UNION ALL SELECT id, 'undefined reason' FROM tracks WHERE row % 13 = 1")
def _(spark, d):
    t = schema.tracks(spark, d)
    s = t.filter("row % 13 <> 0").select("id", F.lit(True).alias("serve"), F.array(F.when(F.col("row") % 13 == 1, "ODD").otherwise("SERVE")).alias("reasons"))
    return gov.serving_problems(t, s, ["SERVE", "HOLD"])


def _serving(spark, d):
    t = schema.tracks(spark, d)
    buckets = t.select("id", F.when(F.col("row") % 5 == 0, "B.old").otherwise("KEEP").alias("bucket"))
    notices = t.filter("row % 5 <> 0 and row % 7 = 0").select("id", F.array(F.lit("NC+SA"), F.lit("NC")).alias("kinds"))
    reviews = t.filter("row % 5 <> 0 and row % 11 = 0").select("id", F.lit("R.names").alias("code"))
    return t, gov.derive_serving(t, buckets, notices, reviews)


_REASONS = "CASE WHEN row % 5 = 0 THEN ['B.old'] ELSE list_concat(CASE WHEN row % 11 = 0 THEN ['R.names'] ELSE [] END, CASE WHEN row % 7 = 0 THEN ['T.NC', 'T.SA'] ELSE [] END) END"


@query("q04_derive_serving", f"WITH {T}, r AS (SELECT id, {_REASONS} AS r FROM tracks) SELECT id, len(r) = 0 AS serve, CASE WHEN len(r) = 0 THEN 'SERVE' ELSE array_to_string(r, ',') END AS reasons FROM r")
def _(spark, d):
    return _serving(spark, d)[1].select("id", "serve", F.array_join("reasons", ",").alias("reasons"))


@query("a07_serving_counts", f"WITH {T}, r AS (SELECT license, {_REASONS} AS r FROM tracks) SELECT 'served' AS kind, license AS name, count(*) AS n FROM r WHERE len(r) = 0 GROUP BY license UNION ALL SELECT 'held', x, count(*) FROM r, unnest(r) u(x) GROUP BY x")
def _(spark, d):
    t, s = _serving(spark, d)
    return gov.serving_counts(s, t)


@query("q06_publication", f"WITH {T} SELECT row, CASE row % 11 WHEN 1 THEN 'rights license' WHEN 2 THEN 'audio pins' ELSE 'not approved' END AS problems FROM tracks WHERE row % 11 BETWEEN 1 AND 3")
def _(spark, d):
    c, r = _catalog_and_rights(spark, d)
    t = c.select("row", *(F.col(x).alias(f"t_{x}") for x in c.columns if x != "row"))
    joined = t.join(r.select("row", *(F.col(x).alias(f"r_{x}") for x in r.columns if x != "row")), "row")
    return gov.publication_problems(joined).select("row", F.array_join("problems", ",").alias("problems"))


@query("q07_sampled_rows", f"WITH {T} SELECT row FROM tracks WHERE row % 50 = 0 OR row = (SELECT min(row) FROM tracks) OR row = (SELECT max(row) FROM tracks)")
def _(spark, d):
    return gov.sampled_rows(schema.tracks(spark, d), 50)


@query("q10_display_agreement", "SELECT 0::BIGINT AS n")
def _(spark, d):
    return gov.display_problems(lookup.with_folds(schema.lines(spark, d))).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ admission


def _events(spark, d):
    return schema.table(spark, d, "events")


@query("w01_sliding_admission")
def _(spark, d):
    return admission.admit_table(_events(spark, d), 2, 3600.0)


@query("w02_dual_admission")
def _(spark, d):
    e = _events(spark, d).withColumn("search", F.col("event_type") != "view")
    return admission.admit_dual_table(e, 2, 1, 5, 3600.0, 86400.0)


@query("w03_tombstones", "SELECT user_id, event_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM events) WHERE event_type <> 'view' AND epoch_us(ts) - epoch_us(c) < 3600000000")
def _(spark, d):
    e = _events(spark, d).withColumn("event_type", F.when(F.col("event_type") == "view", "cancel").otherwise(F.col("event_type")))
    return admission.tombstones(e, 3600)


@query("w05_latest_generation", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return admission.latest_generation(_events(spark, d))


@query("w06_byte_budget", "SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id FROM (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s > 500 GROUP BY user_id")
def _(spark, d):
    return admission.byte_budget(_events(spark, d), 500.0)


@query("w07_coalesced_requests", "SELECT user_id, (epoch_us(ts) // 1000000) // 3600 AS slot, count(*) AS requests FROM events GROUP BY ALL")
def _(spark, d):
    return admission.coalesced(_events(spark, d), 3600)
