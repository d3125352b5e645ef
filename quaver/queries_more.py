"""Queries over predicates, joins, quality of maps, credits, releases and exports, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaver import schema
from quaver.functions.bpe import Tokeniser, byte_letters
from quaver.functions.text import fold_text
from quaver.operators import governance, graph, lookup, search, tiles
from quaver.plans.engine import credit_article
from quaver.queries_search import _CODED, D, FOLDED
from quaver.scratch import scratch_table, shared_folder
from quaver.sources import release
from quaver.streaming import admission

QUERIES, SQL = {}, {}
T, X = schema.TRACKS_SQL, schema.TEXTS_SQL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p03_equality_filter", f"WITH {X} SELECT row, genre FROM tracks WHERE genre = 'de'")
def _(spark, d):
    return lookup.page_query(lookup.with_folds(schema.lines(spark, d)), genre="de", limit=None).rows.select("row", "genre")


@query("p04_served_filter", f"WITH {T} SELECT row FROM tracks WHERE row IN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0)")
def _(spark, d):
    return schema.tracks(spark, d).join(schema.served(spark, d), "row", "left_semi").select("row")


@query("p05_availability_page", f"WITH {T} SELECT row FROM tracks WHERE row % 3 = 0 ORDER BY row LIMIT 12 OFFSET 12")
def _(spark, d):
    t = schema.tracks(spark, d)
    return lookup.page_query(lookup.with_folds(t), offset=12, available=t.filter("row % 3 = 0").select("row")).rows.select("row")


@query("p07_banned_instrumental", "SELECT vec_id AS row FROM embeddings WHERE vec_id % 11 <> 0 AND vec_id % 3 = 1")
def _(spark, d):
    v = schema.vectors(spark, d).withColumn("vocals", F.when(F.col("row") % 3 == 0, F.lit(True)).when(F.col("row") % 3 == 1, F.lit(False)))
    banned = v.filter("row % 11 = 0").select("row")
    return v.join(banned, "row", "left_anti").filter("vocals = false").select("row")


@query("p08_client_refinement", f"WITH {X}, {FOLDED} SELECT row FROM f WHERE contains(fx, 'er') AND contains(fx, 'src1') AND genre = 'en' AND row % 2 = 0")
def _(spark, d):
    t = lookup.with_folds(schema.texts(spark, d))
    return lookup.page_query(t, refine="ER src1", genre="en", limit=None, available=t.filter("row % 2 = 0").select("row")).rows.select("row")


@query("p08_client_refinement_lines", f"WITH {schema.LINES_SQL}, {FOLDED} SELECT row FROM f WHERE contains(fx, 'er') AND contains(fx, 'src1') AND genre = 'en' AND row % 2 = 0")
def _(spark, d):
    t = lookup.with_folds(schema.lines(spark, d))
    return lookup.page_query(t, refine="ER src1", genre="en", limit=None, available=t.filter("row % 2 = 0").select("row")).rows.select("row")


@query("v18_projection_recall", f"WITH {schema.LAYOUT_SQL}, a AS (SELECT q.vec_id AS query, e.vec_id AS row, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id), b AS (SELECT q.row AS query, e.row, row_number() OVER (PARTITION BY q.row ORDER BY pow(e.x - q.x, 2) + pow(e.y - q.y, 2), e.row) AS r FROM layout e, layout q WHERE q.row % 20 = 0 AND q.row <> e.row), h AS (SELECT a.query, count(*) AS n FROM a JOIN b USING (query, row) WHERE a.r <= 8 AND b.r <= 8 GROUP BY a.query) SELECT round(coalesce(sum(n), 0) / (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) / 8, 6) AS mean FROM h")
def _(spark, d):
    high, low = _projected(spark, d)
    return search.recall(low.select("query", "row"), high.select("query", "row"), 8).agg(F.round(F.avg("recall"), 6).alias("mean"))


@query("v18_projection_quality")
def _(spark, d):
    v = schema.vectors(spark, d)
    high, low = _projected(spark, d)
    low = scratch_table(low, "map-neighbours")  # read twice
    recall = search.recall(low.select("query", "row"), high.select("query", "row"), 8).agg(F.avg("recall").alias("mean"), F.min("recall").alias("minimum"))
    # how far the map's neighbours are beyond the 8th of the vectors, over the stated query set
    ranks = search.ranks_of(v, low)
    beyond = ranks.agg(F.sum(F.greatest(F.col("rank") - 8, F.lit(0))).alias("beyond"), F.countDistinct("query").alias("m"))
    n = v.agg(F.count("*").alias("n"))
    trust = 1 - 2 * F.col("beyond") / (F.col("m") * 8 * (2 * F.col("n") - 3 * 8 - 1))
    return recall.crossJoin(beyond).crossJoin(n).select("mean", "minimum", trust.alias("trustworthiness"))


def _projected(spark, d):
    """The 8 nearest of the stated query set by vectors and by positions."""
    v, p = schema.vectors(spark, d), schema.layout(spark, d)
    asked = v.filter("row % 20 = 0")
    high = search.batch_top_k(v, asked.select(F.col("row").alias("query"), F.col("embedding").alias("q")), 8, exclude_self=True)
    # a stated query set: one row in twenty against all rows
    low = search.nearest_positions(p, p.filter("row % 20 = 0").select(F.col("row").alias("query"), "x", "y"), 8)
    return high, low


@query("v22_parity", "SELECT 0::BIGINT AS differences")
def _(spark, d):
    v = schema.vectors(spark, d)
    asked = v.filter("row % 20 = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"))
    # exact_top_k's distances of the stated query set, against the blocks'
    one = search.scan_top_k(v, asked, 8)
    many = search.batch_top_k(v, asked, 8)
    both = one.withColumn("side", F.lit(1)).unionByName(many.withColumn("side", F.lit(-1)))
    each = both.groupBy("query", "rank", "row", "distance").agg(F.sum("side").alias("side"))
    return each.agg(F.coalesce(F.sum(F.abs("side")), F.lit(0)).alias("differences"))


@query("l08_credit_articles", f"WITH {T} SELECT row, '<article><h2>' || replace(title, '&', '&amp;') || '</h2><p>' || artist || '</p><p>' || license || '</p></article>' AS html FROM tracks")
def _(spark, d):
    return schema.tracks(spark, d).select("row", credit_article().alias("html"))


@query("l11_index_equals_scan", "SELECT 0::BIGINT AS differences")
def _(spark, d):
    folded = lookup.with_folds(schema.tracks(spark, d))
    index = lookup.trigrams(folded)
    word = fold_text(folded.agg(F.min("title")).first()[0]).split()[0]
    scan = folded.filter(F.col("fold_text").contains(word)).select("row")
    found = lookup.indexed_lookup(folded, index, word, 1 << 30)[0].select("row")
    return scan.exceptAll(found).unionByName(found.exceptAll(scan)).agg(F.count("*").alias("differences"))


@query("j02_aligned_zip", f"WITH {T} SELECT t.row, p_retailprice AS price FROM tracks t JOIN part ON p_partkey = t.row")
def _(spark, d):
    prices = schema.table(spark, d, "part").select(F.col("p_partkey").alias("row"), F.col("p_retailprice").alias("price"), F.concat(F.lit("fma:"), "p_partkey").alias("other"))
    same = F.when(F.col("id") == F.col("other"), F.col("price")).otherwise(F.raise_error(F.lit("The tables are not aligned")).cast("double"))
    return schema.tracks(spark, d).join(prices, "row").select("row", same.alias("price"))


@query("j03_id_to_row", f"WITH {T} SELECT l_orderkey, l_linenumber, row FROM lineitem JOIN tracks ON id = 'fma:' || l_partkey WHERE l_quantity > 45")
def _(spark, d):
    items = schema.table(spark, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber", F.concat(F.lit("fma:"), "l_partkey").alias("id"))
    return items.join(schema.tracks(spark, d).select("id", "row"), "id").select("l_orderkey", "l_linenumber", "row")


@query("j09_four_way", "SELECT l_orderkey, l_linenumber, s_name, n_name, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE l_quantity < 3")
def _(spark, d):
    t = lambda n: schema.table(spark, d, n)
    j = t("lineitem").filter("l_quantity < 3").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("l_orderkey", "l_linenumber", "s_name", "n_name", "p_name")


@query("j10_left_outer", "SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS tags FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(spark, d):
    tags = schema.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("tags"))
    return schema.table(spark, d, "customer").join(tags, "c_custkey", "left").select("c_custkey", F.coalesce("tags", F.lit("")).alias("tags"))


@query("f15_bits", "SELECT vec_id AS row, (vec_id >> 3) AS byte, ((vec_id >> (vec_id % 8)) & 1)::INT AS bit FROM embeddings")
def _(spark, d):
    return schema.vectors(spark, d).select("row", F.shiftright("row", 3).alias("byte"), F.expr("cast(getbit(row, cast(row % 8 as int)) as int)").alias("bit"))


@query("f18_math", f"WITH {schema.LAYOUT_SQL} SELECT row, round(sqrt(x * x + y * y), 6) AS radius, ceil(x * 10)::BIGINT AS up, floor(log2(abs(y) + 1e-9))::BIGINT AS octave, round(pow(greatest(0, least(1, x)), 2) * (3 - 2 * greatest(0, least(1, x))), 6) AS smooth FROM layout")
def _(spark, d):
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("x")))
    return schema.layout(spark, d).select(
        "row", F.round(F.hypot("x", "y"), 6).alias("radius"), F.ceil(F.col("x") * 10).alias("up"), F.floor(F.log2(F.abs("y") + 1e-9)).alias("octave"), F.round(F.pow(t, F.lit(2.0)) * (3 - 2 * t), 6).alias("smooth")
    )


@query("f19_evidence_fields", "SELECT event_id, 'fma-artist:' || user_id AS artist_id, (value * 1000)::BIGINT AS bytes FROM events")
def _(spark, d):
    doc = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("artist_id"), F.col("value").alias("v")).alias("rawTrack")))
    parsed = F.from_json(doc, "rawTrack struct<artist_id:string,v:double>", {"mode": "FAILFAST"})
    e = schema.table(spark, d, "events").select("event_id", parsed.alias("j"))
    ident = F.when(F.col("j.rawTrack.artist_id").rlike(r"^[0-9]+\z"), F.concat(F.lit("fma-artist:"), F.col("j.rawTrack.artist_id")))
    return e.select("event_id", ident.alias("artist_id"), F.round(F.col("j.rawTrack.v") * 1000).cast("long").alias("bytes"))


@query("t11_child_tile", f"WITH {_CODED} SELECT row FROM m WHERE qx >> 14 = 2 AND qy >> 14 = 1")
def _(spark, d):
    return tiles.tile(tiles.coded(schema.layout(spark, d)), 2, 2, 1, cap=1 << 20).select("row")


@query("s08_point_lookup", f"WITH {T} SELECT row, id, title FROM tracks WHERE row = 77")
def _(spark, d):
    return schema.tracks(spark, d).filter("row = 77").select("row", "id", "title")


@query("s10_pins", f"WITH {T} SELECT row, id, audio_bytes, sha256(title) AS sha FROM tracks")
def _(spark, d):
    return schema.tracks(spark, d).select("row", "id", "audio_bytes", F.sha2("title", 256).alias("sha"))


@query("s01_release_round_trip", f"WITH {T} SELECT row, id, title, license FROM tracks")
def _(spark, d):
    path = f"{shared_folder(spark)}/releases/{uuid.uuid4().hex}"
    pin = release.write_release({"tracks": schema.tracks(spark, d), "layout": schema.layout(spark, d)}, path, "demo")
    return release.open_release(spark, path, pin)["tracks"].select("row", "id", "title", "license")


@query("s14_same_rows", "SELECT true AS same, false AS changed")
def _(spark, d):
    t = schema.tracks(spark, d)
    same = release.same_rows(t, t.orderBy(F.desc("row")))
    changed = release.same_rows(t, t.withColumn("title", F.when(F.col("row") == 5, "x").otherwise(F.col("title"))))
    return spark.range(1).select(F.lit(same).alias("same"), F.lit(changed).alias("changed"))


@query("s26_kept_export", f"WITH {T} SELECT row, '{{\"id\":\"' || id || '\",\"title\":\"' || title || '\"}}' AS packet FROM tracks WHERE row % 10 = 0")
def _(spark, d):
    return schema.tracks(spark, d).filter("row % 10 = 0").select("row", F.to_json(F.struct("id", "title")).alias("packet"))


@query("s03_matrix_decode", "SELECT count(*) AS n, 64 AS dimensions FROM embeddings")
def _(spark, d):
    v = schema.vectors(spark, d)
    files = v.groupBy(F.floor(F.col("row") / 100).alias("file")).agg(F.array_sort(F.collect_list(F.struct("row", "embedding"))).alias("m"))  # 100 rows a file
    content = F.unbase64(release.packed(F.flatten(F.transform("m", lambda s: s["embedding"]))))
    rows = release.decode_matrix(files.select(content.alias("content")), 64)
    return rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimensions"))


@query("g10_beats", "SELECT 'enter' AS kind, 1::BIGINT AS n UNION ALL SELECT 'results', 1")
def _(spark, d):
    v = schema.vectors(spark, d)
    q = v.filter("row = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"))
    trace = graph.traced_search(v, schema.ring_edges(spark, d).filter("level = 0"), q, 0, 8, 32)
    first = F.row_number().over(Window.partitionBy("query", "type").orderBy("sequence"))
    beats = trace.select("query", "type", "sequence").withColumn("nth", first).filter("nth = 1 and type in ('enter', 'results')")
    return beats.groupBy(F.col("type").alias("kind")).agg(F.count("*").alias("n"))


@query("set_prefix_equality", f"WITH {T} SELECT count(*) AS differences FROM tracks WHERE row <= 100 AND false")
def _(spark, d):
    t = schema.tracks(spark, d)
    # every row of a written release against the catalog
    path = f"{shared_folder(spark)}/releases/{uuid.uuid4().hex}"
    pin = release.write_release({"tracks": t}, path, "demo")
    old, new = release.open_release(spark, path, pin)["tracks"].alias("o"), t.alias("n")
    differs = F.col("n.row").isNull() | F.col("o.row").isNull() | ~(F.col("o.title").eqNullSafe(F.col("n.title")) & F.col("o.id").eqNullSafe(F.col("n.id")))
    return old.join(new, F.col("o.row") == F.col("n.row"), "full").filter(differs).agg(F.count("*").alias("differences"))


@query("a01_filtered_counts", f"WITH {T} SELECT count(*) AS n, count(*) FILTER (WHERE license = 'L1') AS one FROM tracks")
def _(spark, d):
    return schema.tracks(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("license") == "L1").alias("one"))


@query("a05_sum_or_zero", f"WITH {T} SELECT count(*) AS n, coalesce(sum(audio_bytes), 0)::BIGINT AS bytes FROM tracks WHERE license = 'none'")
def _(spark, d):
    return schema.tracks(spark, d).filter("license = 'none'").agg(F.count("*").alias("n"), F.coalesce(F.sum("audio_bytes"), F.lit(0)).alias("bytes"))


@query("f17_notice_kinds", f"WITH {T} SELECT row, CASE row % 3 WHEN 0 THEN 'NC,SA' WHEN 1 THEN 'ND' ELSE '' END AS kinds FROM tracks")
def _(spark, d):
    kinds = F.when(F.col("row") % 3 == 0, F.array(F.lit("SA+NC"), F.lit("NC"))).when(F.col("row") % 3 == 1, F.array(F.lit("ND"))).otherwise(F.array().cast("array<string>"))
    parts = F.array_sort(F.array_distinct(F.flatten(F.transform(kinds, lambda k: F.split(k, r"\+")))))
    return schema.tracks(spark, d).select("row", F.array_join(parts, ",").alias("kinds"))


@query("f14_bpe_tokens")
def _(spark, d):
    letters = list(byte_letters().values())
    merges = [("t", "h"), ("th", "e</w>"), ("i", "n"), ("a", "n"), ("an", "d</w>")]
    names = letters + [x + "</w>" for x in letters] + [a + b for a, b in merges]
    coder = Tokeniser(merges, {s: i for i, s in enumerate(names)}, len(names), len(names) + 1)

    @F.pandas_udf("array<int>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: coder.encode(t or ""))

    return schema.table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", tokens("text").alias("tokens"))


@query("j08_evidence_by_path", "SELECT source AS path, lang, count(*) AS n FROM documents JOIN (SELECT DISTINCT source AS s FROM documents WHERE source <> 'src3') ON s = source GROUP BY ALL")
def _(spark, d):
    docs = schema.table(spark, d, "documents").select(F.col("source").alias("path"), "lang")
    evidence = docs.filter("path <> 'src3'").select("path").distinct()
    return docs.groupBy("path", "lang").agg(F.count("*").alias("n")).join(evidence, "path")


@query("q05_quarantine_clear", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    docs = schema.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("audio_sha256"))
    bad = schema.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("remove").alias("action"))
    return governance.quarantine(docs, docs.join(bad, "id"))[0].select("id")


@query("w04_bounded_queue")
def _(spark, d):
    return admission.queue_table(schema.table(spark, d, "events"), 2, 7200.0)
