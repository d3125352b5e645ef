from pyspark.sql import functions as F

from quaver import catalog_queries as cq
from quaver import schema


def test_titles_are_whole_first_lines(spark, small):
    text = schema.table(spark, small, "documents").select(F.col("doc_id").alias("row"), "text")
    got = {r["row"]: r["title"] for r in schema.lines(spark, small).select("row", "title").collect()}
    assert got == {r["row"]: r["text"].split("\n")[0] for r in text.collect()}
    assert max(map(len, got.values())) > 80


def test_words_after_the_80th_character_are_found(tmp_path, spark):
    title = "x" * 90 + " nation other"
    spark.createDataFrame([(0, title + "\nmore", "en", "src1")], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r["row"] for r in cq.QUERIES["l09_trigram_lookup_lines"](spark, str(tmp_path)).collect()] == [0]
    assert [(r["genre"], r["n"]) for r in cq.QUERIES["l05_facets_lines"](spark, str(tmp_path)).collect()] == [("en", 1)]
