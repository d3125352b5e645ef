"""Queries over vectors, names, ranks and tiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver import schema
from quaver.functions.text import fold, words
from quaver.functions.vectors import cosine_distance, is_unit, normalised, squared_norm
from quaver.operators import lookup, rerank, search, tiles
from quaver.scratch import stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


DIST = "greatest(0.0, least(2.0, 1.0 - list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)), lambda s, p: s + p)))"
D = DIST.format(a="q.embedding", b="e.embedding")


def _near(v, row, k, **more):
    return search.exact_top_k(v, search.row_vector(v, row), k, **more)


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 6))


@query("v10_cosine_distance", f"SELECT e.vec_id AS row, round({D}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 7")
def _(spark, d):
    v = schema.vectors(spark, d)
    one = F.broadcast(search.row_vector(v, 7))  # one row
    return v.crossJoin(one).select("row", F.round(cosine_distance(F.col("q"), F.col("embedding")), 6).alias("distance"))


@query("v11_exact_top_k", f"SELECT row_number() OVER (ORDER BY d, row) AS rank, row, round(1 - d, 6) AS similarity FROM (SELECT e.vec_id AS row, {D} AS d FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY d, row LIMIT 16")
def _(spark, d):
    v = schema.vectors(spark, d)
    return search.ranked(_near(v, 0, 16), 16).select("rank", "row", F.round("similarity", 6).alias("similarity"))


_BATCH = f"SELECT query, rank, row, round(d, 6) AS distance FROM (SELECT q.vec_id AS query, e.vec_id AS row, {D} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 {{more}}) WHERE rank <= 8"


@query("v12_batch_top_k", _BATCH.format(more=""))
def _(spark, d):
    v = schema.vectors(spark, d)
    q = v.filter("row % 20 = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"))
    return _rounded(search.batch_top_k(v, q, 8))


@query("v15_score_search", "SELECT id, round(s, 6) AS score FROM (SELECT e.vec_id::VARCHAR AS id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)), lambda a, b: a + b) AS s FROM embeddings e, embeddings q WHERE q.vec_id = 3 AND e.vec_id % 11 <> 0) ORDER BY s DESC, id LIMIT 20")
def _(spark, d):
    v = schema.vectors(spark, d)
    banned = v.filter("row % 11 = 0").select(F.col("row").cast("string").alias("id"))
    return search.score_search(v, search.row_vector(v, 3), 20, banned).select("id", F.round("score", 6).alias("score"))


@query("v16_audio_neighbours", f"SELECT e.vec_id AS row, round({D}, 6) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 7 AND e.vec_id <> 7 AND e.vec_id % 7 <> 0 ORDER BY {D}, e.vec_id LIMIT 16")
def _(spark, d):
    v = schema.vectors(spark, d)
    return _rounded(_near(v, 7, 16, exclude=7, allowed=schema.served(spark, d)))


@query("v17_all_pairs_knn", _BATCH.format(more="AND q.vec_id <> e.vec_id"))
def _(spark, d):
    v = schema.vectors(spark, d)
    q = v.filter("row % 20 = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"))
    return _rounded(search.batch_top_k(v, q, 8, exclude_self=True))


@query("v19_l2_normalise", "SELECT vec_id AS row, round(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE * 3 / sqrt(n * 9), 2))), 6) AS norm2 FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2))) AS n FROM embeddings)")
def _(spark, d):
    v = schema.vectors(spark, d).withColumn("u", normalised(F.transform("embedding", lambda x: x.cast("double") * 3)))
    return v.select("row", F.round(squared_norm(F.col("u")), 6).alias("norm2"))


@query("v20_unit_check", "SELECT count(*) AS n, count(*) FILTER (WHERE abs(sqrt(s) - 1) <= 1e-5) AS unit FROM (SELECT list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2))) AS s FROM embeddings)")
def _(spark, d):
    return schema.vectors(spark, d).agg(F.count("*").alias("n"), F.count_if(is_unit(F.col("embedding"))).alias("unit"))


@query("v21_recall", f"WITH x AS (SELECT q.vec_id AS query, e.vec_id AS row, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D}, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT query, count(*) FILTER (WHERE row % 3 <> 0) / 8 AS recall FROM x WHERE r <= 8 GROUP BY query")
def _(spark, d):
    v = schema.vectors(spark, d)
    q = v.filter("row % 50 = 0").select(F.col("row").alias("query"), F.col("embedding").alias("q"))
    exact = search.batch_top_k(v, q, 8)
    return search.recall(exact.filter("row % 3 <> 0").select("query", "row"), exact.select("query", "row"), 8)


@query("v23_enriched_results", f"WITH {schema.LAYOUT_SQL} SELECT r.row, label, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT e.vec_id AS row FROM embeddings e, embeddings q WHERE q.vec_id = 5 ORDER BY {D}, e.vec_id LIMIT 12) r JOIN layout USING (row)")
def _(spark, d):
    v = schema.vectors(spark, d)
    near = _near(v, 5, 12)
    info = v.select("row", "label").join(schema.layout(spark, d), "row")
    return info.join(F.broadcast(near.select("row")), "row").select("row", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))  # 12 rows


@query("v26_clip_mean", "WITH u AS (SELECT vec_id // 5 AS track, i, embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: pow(x::DOUBLE, 2)))) AS x FROM embeddings, unnest(range(1, 65)) t(i)), m AS (SELECT track, i, avg(x) AS x FROM u GROUP BY ALL), n AS (SELECT track, sqrt(sum(x * x)) AS n FROM m GROUP BY track) SELECT track, round(max(CASE WHEN i = 1 THEN x / n END), 6) AS first, round(max(CASE WHEN i = 64 THEN x / n END), 6) AS last FROM m JOIN n USING (track) GROUP BY track")
def _(spark, d):
    clips = schema.vectors(spark, d).select(F.expr("row div 5").alias("track"), F.col("embedding").alias("v"))
    m = search.mean_of_clips(clips)
    return m.select("track", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.get("vector", F.lit(63)), 6).alias("last"))


# ------------------------------------------------------------------ names

FOLDED = "f AS (SELECT *, lower(strip_accents(coalesce(title, ''))) AS ft, lower(strip_accents(concat_ws(' ', title, artist))) AS fta, lower(strip_accents(title || ' ' || artist || ' ' || coalesce(album, ''))) AS fx FROM tracks)"


def _folded(spark, d, accents=True):
    """A catalog with its folded names, which are stored once."""
    tracks = schema.texts(spark, d) if accents else schema.tracks(spark, d)
    folder = stored(spark, f"{d}/{'documents' if accents else 'part'}.parquet", "folded", lambda path: lookup.with_folds(tracks).write.parquet(path))
    return spark.read.schema(f"{', '.join(f'{c} {t}' for c, t in tracks.dtypes)}, fold_title string, fold_title_artist string, fold_text string").parquet(folder)


def _postings(spark, d):
    folded = _folded(spark, d)
    return lookup.read_postings(spark, stored(spark, f"{d}/documents.parquet", "postings", lambda path: lookup.write_postings(folded, path)))


@query("f01_fold", f"WITH {schema.TEXTS_SQL} SELECT row, lower(strip_accents(coalesce(title, ''))) AS folded FROM tracks")
def _(spark, d):
    return schema.texts(spark, d).select("row", fold(F.col("title")).alias("folded"))


@query("f02_words", f"WITH {schema.TEXTS_SQL} SELECT row, len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> '')) AS n FROM tracks")
def _(spark, d):
    return schema.texts(spark, d).select("row", F.size(words(F.col("title"))).cast("long").alias("n"))


def _sql_page(words_, refine=(), genre="", rest="SELECT row FROM r ORDER BY (ft = '{q}') DESC, row LIMIT 12 OFFSET 12", served="", view=schema.TEXTS_SQL):
    base = " AND ".join([f"contains(fta, '{w}')" for w in words_] + ([served] if served else []) or ["true"])
    more = " AND ".join([f"contains(fx, '{w}')" for w in refine] + ([f"genre = '{genre}'"] if genre else []) or ["true"])
    return f"WITH {view}, {FOLDED}, b AS (SELECT * FROM f WHERE {base}), r AS (SELECT * FROM b WHERE {more}) " + rest.format(q=" ".join(words_))


@query("p02_all_words", _sql_page((), ("th", "an"), rest="SELECT row FROM r"))
def _(spark, d):
    return lookup.page_query(_folded(spark, d), refine="th AN", limit=None).rows.select("row")


@query("l01_page_totals", _sql_page(("é",), ("la",), "fr", rest="SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM b) AS base_total").replace("'é'", "'e'"))
def _(spark, d):
    page = lookup.page_query(_folded(spark, d), query="É", refine="la", genre="fr")
    return page.total.crossJoin(page.base_total.withColumnRenamed("total", "base_total"))


@query("l02_browse_page", f"WITH {schema.TRACKS_SQL} SELECT row, title, artist FROM tracks ORDER BY row LIMIT 12 OFFSET 24")
def _(spark, d):
    return schema.tracks(spark, d).orderBy("row").offset(24).limit(12).select("row", "title", "artist")


@query("l03_lookup_ranking", f"WITH {schema.TRACKS_SQL}, {FOLDED}, q AS (SELECT min(ft) AS q FROM f) SELECT row, ft = q AS exact FROM f, q WHERE list_bool_and(list_transform(string_split(q, ' '), lambda w: contains(fta, w))) ORDER BY (ft = q) DESC, row LIMIT 12")
def _(spark, d):
    folded = _folded(spark, d, accents=False)
    q = folded.agg(F.min("fold_title")).first()[0]
    return lookup.page_query(folded, query=q).rows.select("row", (F.col("fold_title") == q).alias("exact"))


@query("l04_scored_lookup", f"WITH {schema.TRACKS_SQL}, {FOLDED}, q AS (SELECT max(ft) AS q FROM f) SELECT row, CASE WHEN ft = q THEN 110 ELSE 10 END AS score FROM f, q WHERE list_bool_and(list_transform(string_split(q, ' '), lambda w: contains(fta, w))) ORDER BY score DESC, row LIMIT 20")
def _(spark, d):
    folded = _folded(spark, d, accents=False)
    q = folded.agg(F.max("fold_title")).first()[0]
    return lookup.scored_lookup(folded, q, 20).select("row", "score")


@query("l05_facets", f"WITH {schema.TEXTS_SQL}, {FOLDED} SELECT genre, count(*) AS n FROM f WHERE contains(fta, 'on') AND trim(genre) <> '' GROUP BY genre")
def _(spark, d):
    return lookup.page_query(_folded(spark, d), query="on", refine="zz").genres


@query("l07_credits_pages", f"WITH s AS (SELECT vec_id AS row, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE vec_id % 7 <> 0) SELECT row, k // 50 + 1 AS page, k % 50 AS slot FROM s")
def _(spark, d):
    return lookup.credits_pages(schema.vectors(spark, d), schema.served(spark, d))


@query("l09_trigram_lookup", _sql_page((), ("tion", "ther"), rest="SELECT row FROM r"))
def _(spark, d):
    folded = _folded(spark, d)
    return lookup.posted_lookup(folded, _postings(spark, d), "tion ther", folded.count())[0].select("row")


@query("l12_index_integrity", f"WITH {schema.TRACKS_SQL}, {FOLDED} SELECT gram, count(DISTINCT row) AS n FROM f, unnest(list_transform(range(1, greatest(1, length(fx) - 1)), lambda i: substr(fx, i, 3))) t(gram) GROUP BY gram")
def _(spark, d):
    return lookup.trigrams(_folded(spark, d, accents=False)).groupBy("gram").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ names: whole first lines


def _folded_lines(spark, d):
    return lookup.with_folds(schema.lines(spark, d))


@query("f01_fold_lines", f"WITH {schema.LINES_SQL} SELECT row, lower(strip_accents(coalesce(title, ''))) AS folded FROM tracks")
def _(spark, d):
    return schema.lines(spark, d).select("row", fold(F.col("title")).alias("folded"))


@query("f02_words_lines", f"WITH {schema.LINES_SQL} SELECT row, len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> '')) AS n FROM tracks")
def _(spark, d):
    return schema.lines(spark, d).select("row", F.size(words(F.col("title"))).cast("long").alias("n"))


@query("p02_all_words_lines", _sql_page((), ("th", "an"), rest="SELECT row FROM r", view=schema.LINES_SQL))
def _(spark, d):
    return lookup.page_query(_folded_lines(spark, d), refine="th AN", limit=None).rows.select("row")


@query("l01_page_totals_lines", _sql_page(("é",), ("la",), "fr", rest="SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM b) AS base_total", view=schema.LINES_SQL).replace("'é'", "'e'"))
def _(spark, d):
    page = lookup.page_query(_folded_lines(spark, d), query="É", refine="la", genre="fr")
    return page.total.crossJoin(page.base_total.withColumnRenamed("total", "base_total"))


@query("l05_facets_lines", f"WITH {schema.LINES_SQL}, {FOLDED} SELECT genre, count(*) AS n FROM f WHERE contains(fta, 'on') AND trim(genre) <> '' GROUP BY genre")
def _(spark, d):
    return lookup.page_query(_folded_lines(spark, d), query="on", refine="zz").genres


@query("l09_trigram_lookup_lines", _sql_page((), ("tion", "ther"), rest="SELECT row FROM r", view=schema.LINES_SQL))
def _(spark, d):
    folded = _folded_lines(spark, d)
    found, _used = lookup.indexed_lookup(folded, lookup.trigrams(folded), "tion ther", folded.count())
    return found.select("row")


# ------------------------------------------------------------------ ranks

_CAND = f"c AS (SELECT row_number() OVER (ORDER BY {D}, e.vec_id) AS rank, e.vec_id::VARCHAR AS id, 1 - {D} AS similarity, e.label::VARCHAR AS artist FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY rank LIMIT 16)"
_SPREAD = f"{_CAND}, s AS (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY rank) > 1 AS later FROM c), x AS (SELECT *, row_number() OVER (ORDER BY later, rank) AS display_rank FROM s ORDER BY later, rank LIMIT 8)"


def _candidates(spark, d):
    v = schema.vectors(spark, d)
    top = search.ranked(_near(v, 0, 16), 16)
    return v.select("row", "label").join(F.broadcast(top), "row").select("rank", F.col("row").cast("string").alias("id"), "similarity", F.col("label").cast("string").alias("artist"))  # 16 rows


@query("r01_artist_spread", f"WITH {_SPREAD} SELECT display_rank, rank, id, artist, CASE WHEN later THEN 'backfill' ELSE 'first-of-artist' END AS selection FROM x")
def _(spark, d):
    return rerank.artist_spread(_candidates(spark, d), 8).select("display_rank", "rank", "id", "artist", "selection")


@query("r02_spread_diagnostics", f"WITH {_SPREAD}, a AS (SELECT count(DISTINCT artist) AS artists_before, avg(similarity) AS m FROM c WHERE rank <= 8), b AS (SELECT count(DISTINCT artist) AS artists_after, avg(similarity) AS n, count(*) FILTER (WHERE rank <= 8) AS kept, max(rank) AS max_rank FROM x) SELECT artists_before, artists_after, kept, max_rank, round(m - n, 6) AS drop FROM a, b")
def _(spark, d):
    c = _candidates(spark, d)
    g = rerank.spread_diagnostics(c, rerank.artist_spread(c, 8), 8)
    return g.select("artists_before", "artists_after", "kept", "max_rank", F.round("drop", 6).alias("drop"))


@query("r03_contract_problems", f"WITH {_CAND} SELECT rank, id FROM c WHERE rank = 5 OR rank = 6")
def _(spark, d):
    c = _candidates(spark, d)
    return rerank.contract_problems(c.withColumn("id", F.when(F.col("rank").isin(5, 6), "twin").otherwise(F.col("id")))).join(c.select("rank", F.col("id").alias("own")), "rank").select("rank", F.col("own").alias("id"))


@query("r05_nearest_rank", "SELECT quantile_disc(l_quantity, 0.95) AS quantile FROM lineitem")
def _(spark, d):
    return rerank.nearest_rank(schema.table(spark, d, "lineitem"), "l_quantity", 0.95)


# ------------------------------------------------------------------ tiles

_DOMAIN = "dom AS (SELECT (a + b) / 2 - s / 2 AS x0, (c + d) / 2 - s / 2 AS y0, s AS side FROM (SELECT *, greatest(b - a, d - c, 1e-6) * (1 + 1 / 512) AS s FROM (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM layout)))"
_SPREAD_BITS = "list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 16), lambda i: ((({q} >> i) & 1) << (2 * i))::BIGINT)), lambda a, b: a | b)"
_CODED = (
    f"{schema.LAYOUT_SQL}, {_DOMAIN}, g AS (SELECT row, greatest(0, least(65535, floor((x - x0) * (65536 / side))))::BIGINT AS qx, greatest(0, least(65535, floor((y - y0) * (65536 / side))))::BIGINT AS qy FROM layout, dom),"
    f" m AS (SELECT row, qx, qy, {_SPREAD_BITS.format(q='qx')} | ({_SPREAD_BITS.format(q='qy')} << 1) AS code FROM g)"
)


@query("t01_tile_domain", f"WITH {schema.LAYOUT_SQL}, {_DOMAIN} SELECT round(x0, 6) AS x0, round(y0, 6) AS y0, round(side, 6) AS side FROM dom")
def _(spark, d):
    return tiles.domain(schema.layout(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("x0", "y0", "side")))


@query("t03_morton_code", f"WITH {_CODED} SELECT row, qx, qy, code FROM m")
def _(spark, d):
    return tiles.coded(schema.layout(spark, d)).select("row", F.col("qx").cast("long").alias("qx"), F.col("qy").cast("long").alias("qy"), "code")


@query("t04_morton_order", f"WITH {_CODED} SELECT row, row_number() OVER (ORDER BY code, row) AS at FROM m".replace(" AS at", " AS place"))
def _(spark, d):
    from pyspark.sql import Window

    points = tiles.coded(schema.layout(spark, d)).select("row", "code").withColumn("cell", F.shiftright("code", 24))
    counts = points.groupBy("cell").agg(F.count("*").alias("n"))  # at most 256 cells
    before = counts.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("cell").orderBy("code", "row"))
    return points.withColumn("own", own).join(F.broadcast(before), "cell").select("row", (F.col("before") + F.col("own")).alias("place"))


@query("t05_tile_sample", f"WITH {_CODED}, k AS (SELECT d, count(DISTINCT code >> (32 - 2 * d)) AS c FROM m, range(1, 17) t(d) GROUP BY d), b AS (SELECT max(d) AS d FROM k WHERE c <= 64) SELECT min(row) AS row, count(*) AS weight FROM m, b GROUP BY code >> (32 - 2 * b.d)")
def _(spark, d):
    return tiles.tile(tiles.coded(schema.layout(spark, d)), 0, 0, 0, cap=64)


@query("t07_pyramid", f"WITH {_CODED} SELECT z, qx >> (16 - z) AS x, qy >> (16 - z) AS y, count(*) AS total FROM m, range(0, 7) t(z) GROUP BY ALL")
def _(spark, d):
    p = tiles.pyramid(tiles.coded(schema.layout(spark, d)), 6)
    return p.select(F.col("z").cast("long").alias("z"), "x", "y", "total")


@query("t08_overview_sample")
def _(spark, d):
    return tiles.overview_sample(schema.layout(spark, d), 100)


@query("t10_region_names", f"WITH {schema.LAYOUT_SQL}, p AS (SELECT row % 12 AS cluster, x, y, 'g' || label AS genre FROM layout), c AS (SELECT cluster, genre, count(*) AS c FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY c DESC, genre) AS k FROM c), a AS (SELECT cluster, count(*) AS n FROM p GROUP BY cluster) SELECT a.cluster, n, CASE WHEN c >= 0.4 * n AND genre <> 'Unknown' THEN genre END AS name, (SELECT string_agg(genre, ',' ORDER BY k) FROM k k2 WHERE k2.cluster = a.cluster AND k2.k <= 3) AS top FROM a JOIN k ON k.cluster = a.cluster AND k.k = 1")
def _(spark, d):
    p = schema.layout(spark, d).join(schema.vectors(spark, d).select("row", "label"), "row").select((F.col("row") % 12).alias("cluster"), "x", "y", F.concat(F.lit("g"), "label").alias("genre"))
    return tiles.region_names(p).select("cluster", "n", "name", F.array_join("top", ",").alias("top"))


@query("t09_kmeans_regions")
def _(spark, d):
    return tiles.kmeans_regions(schema.layout(spark, d), 12)


@query("t09_kmeans_regions_48")
def _(spark, d):
    return tiles.kmeans_regions(schema.layout(spark, d), 48)


@query("t12_density", f"WITH {_CODED} SELECT least(floor(qx / 65536 * 32), 31)::BIGINT AS px, least(floor(qy / 65536 * 32), 31)::BIGINT AS py, round(1 - exp(count(*) * ln(0.3)), 6) AS opacity FROM m GROUP BY ALL")
def _(spark, d):
    p = tiles.density(tiles.coded(schema.layout(spark, d)), 32, 0.7)
    return p.select(F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py"), F.round("opacity", 6).alias("opacity"))


@query("t13_round_robin", f"WITH r AS (SELECT vec_id AS row, label AS tile, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn FROM embeddings) SELECT row, tile, turn FROM r ORDER BY turn, tile LIMIT 100")
def _(spark, d):
    return tiles.round_robin(schema.vectors(spark, d).select("row", F.col("label").alias("tile")), 100)


@query("t14_nearest_point", f"WITH {schema.LAYOUT_SQL} SELECT row FROM layout WHERE sqrt(pow(x * 100 - 3, 2) + pow(y * 100 - 4, 2)) <= 14 ORDER BY sqrt(pow(x * 100 - 3, 2) + pow(y * 100 - 4, 2)), row % 5 = 0 DESC, row LIMIT 1")
def _(spark, d):
    p = schema.layout(spark, d).select("row", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"), (F.col("row") % 5 == 0).alias("is_result"))
    return tiles.nearest_point(p, 3.0, 4.0).select("row")


@query("t15_centre_scale", f"WITH {schema.LAYOUT_SQL}, m AS (SELECT row, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM layout), t AS (SELECT greatest(max(abs(x)), max(abs(y))) AS t FROM m) SELECT row, round(x / t, 6) AS x, round(y / t, 6) AS y FROM m, t")
def _(spark, d):
    return tiles.centred(schema.layout(spark, d)).select("row", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("t16_subset_bounds", f"WITH {schema.LAYOUT_SQL} SELECT round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1 FROM layout WHERE row % 7 <> 0")
def _(spark, d):
    p = schema.layout(spark, d).join(schema.served(spark, d), "row", "left_semi")
    return p.agg(*(F.round(f(c), 6).alias(f"{c}{k}") for c in "xy" for k, f in ((0, F.min), (1, F.max))))


@query("p10_viewport_tiles", "WITH t AS (SELECT x, y FROM range(0, 8) a(x), range(0, 8) b(y)) SELECT x, y FROM t WHERE x + 1 > 2.5 AND x < 5.5 AND y + 1 > 1.2 AND y < 3.9")
def _(spark, d):
    t = spark.range(64).select((F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"))
    return t.filter("x + 1 > 2.5 and x < 5.5 and y + 1 > 1.2 and y < 3.9").orderBy(F.hypot(F.col("x") + 0.5 - 4.0, F.col("y") + 0.5 - 2.55), "x", "y")


@query("p11_thin_grid", f"WITH {schema.LAYOUT_SQL}, p AS (SELECT row AS pos, x * 400 AS x, y * 400 AS y, row % 50 = 0 AS priority FROM layout), k AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 12), floor(y / 12) ORDER BY priority DESC, pos) AS nth FROM p) SELECT pos, priority FROM k WHERE priority OR nth = 1 ORDER BY priority DESC, pos LIMIT 320")
def _(spark, d):
    p = schema.layout(spark, d).select(F.col("row").alias("pos"), (F.col("x") * 400).alias("x"), (F.col("y") * 400).alias("y"), (F.col("row") % 50 == 0).alias("priority"))
    return tiles.thin_grid(p, 12.0, 320).select("pos", "priority")


@query("p12_edge_budget", f"WITH {schema.EDGES_SQL}, e AS (SELECT src AS a, dst AS b, src * 3 + pos AS pos FROM edges WHERE level = 0) SELECT a, b, pos FROM e WHERE a % 3 <> 0 AND b % 3 <> 0 ORDER BY (a % 10 = 1 OR b % 10 = 1) DESC, pos LIMIT 120")
def _(spark, d):
    e = schema.ring_edges(spark, d).filter("level = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("src") * 3 + F.col("pos")).alias("pos"), F.lit(3.0).alias("length"))
    p = schema.vectors(spark, d).filter("row % 3 <> 0").select("row", (F.col("row") % 10 == 1).alias("priority"))
    return tiles.edge_budget(e, p, 2.0, 200)
