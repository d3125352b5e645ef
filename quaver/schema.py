"""The catalog's tables, as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, id, title, artist, album, genre, license, artist_id, audio_bytes from ``part``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row"),
        F.concat(F.lit("fma:"), F.col("p_partkey")).alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.lit(None).cast("string").alias("album"),
        F.col("p_type").alias("genre"),
        F.concat(F.lit("L"), F.col("p_size") % 4).alias("license"),
        F.col("p_brand").alias("artist_id"),
        (F.col("p_size") * 1000 + F.col("p_partkey") % 7).cast("long").alias("audio_bytes"),
    )


TRACKS_SQL = """tracks AS (SELECT p_partkey AS row, 'fma:' || p_partkey AS id, p_name AS title, p_brand AS artist, NULL::VARCHAR AS album,
  p_type AS genre, 'L' || (p_size % 4) AS license, p_brand AS artist_id, (p_size * 1000 + p_partkey % 7)::BIGINT AS audio_bytes FROM part)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog whose titles are the whole first lines of ``documents``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row"), F.split("text", "\n")[0].alias("title"), F.col("source").alias("artist"), F.lit(None).cast("string").alias("album"), F.col("lang").alias("genre")
    )


TEXTS_SQL = """tracks AS (SELECT doc_id AS row, string_split(text, chr(10))[1] AS title, source AS artist, NULL::VARCHAR AS album, lang AS genre FROM documents)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog with accents: titles are the whole first lines of ``documents``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row"), F.split("text", "\n")[0].alias("title"), F.col("source").alias("artist"), F.lit(None).cast("string").alias("album"), F.col("lang").alias("genre")
    )


LINES_SQL = """tracks AS (SELECT doc_id AS row, string_split(text, chr(10))[1] AS title, source AS artist, NULL::VARCHAR AS album, lang AS genre FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, embedding, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), "embedding", "label")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, x, y: the first two components of each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


LAYOUT_SQL = "layout AS (SELECT vec_id AS row, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)"


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be shown: those that aren't a multiple of 7."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("row"))


def ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, level, pos, dst: level 0 links each row to the next three (mod n), level 1 every tenth row to the next tenth."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    n = v.agg(F.count("*").alias("n"))
    base = v.crossJoin(F.broadcast(n))  # one row
    zero = base.select("src", F.lit(0).alias("level"), F.posexplode(F.array(*(((F.col("src") + k) % F.col("n")) for k in (1, 2, 5)))).alias("pos", "dst"))
    one = base.filter("src % 10 = 0").select("src", F.lit(1).alias("level"), F.lit(0).alias("pos"), ((F.col("src") + 10) % F.col("n")).alias("dst"))
    return zero.unionByName(one)


EDGES_SQL = """n AS (SELECT count(*) AS n FROM embeddings),
edges AS (SELECT vec_id AS src, 0 AS level, pos, (vec_id + k) % n AS dst FROM embeddings, n, (VALUES (0, 1), (1, 2), (2, 5)) j(pos, k)
  UNION ALL SELECT vec_id, 1, 0, (vec_id + 10) % n FROM embeddings, n WHERE vec_id % 10 = 0)"""
