"""Removal of lines in repeated three-line windows.

Every three consecutive lines of a text are a window. Windows are hashed to 128 bits and counted over all
documents; the first occurrence of a window (by document, then line) stays, all later ones go, and a
line is removed if any removed window covers it. Windows without a word don't count. Only hashes and
positions are shuffled to find repeats; texts are shuffled once, to meet the lines that they lose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, free_names, small


def _windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(h1, h2, doc_id, place, line) of each window."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col("place"), F.split(F.col(text_col), "\n").alias("l"))
    hashed = base.select(
        "doc_id",
        "place",
        F.expr("transform(l, x -> xxhash64(x))").alias("a"),
        F.expr("transform(l, x -> xxhash64(1, x))").alias("b"),
        F.expr(r"transform(l, x -> x rlike '[^ \\t-\\r]')").alias("w"),
    )
    get = lambda c: ", ".join(f"get({c}, i + {k})" for k in range(size))
    has_word = " or ".join(f"get(w, i + {k})" for k in range(size))
    each = F.expr(
        f"if(size(a) < {size}, array(), filter(transform(sequence(0, size(a) - {size}), i -> "
        f"if({has_word}, struct(i as line, xxhash64({get('a')}) as h1, xxhash64({get('b')}) as h2), null)), x -> x is not null))"
    )
    return hashed.select("doc_id", "place", F.inline(each)).select("h1", "h2", "doc_id", "place", "line")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(place, __starts) of the documents that lose lines; ``docs`` has a unique column place."""
    scratch = Scratch(docs.sparkSession, "lines")
    windows = scratch.table(_windows(docs, id_col, text_col, size), "windows")
    here = F.struct("doc_id", "place", "line")
    first = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.table(first.select("h1", "h2", F.col("first.place").alias("p"), F.col("first.line").alias("q")), "first")
    # written, so that the join has plain exchanges whose hot windows AQE can split
    later = windows.join(small(first, 100_000), ["h1", "h2"]).filter("place <> p or line <> q")
    return later.groupBy("place").agg(F.collect_list("line").alias("__starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and columns n_lines and n_removed.

    A text with fewer than ``size`` lines stays as it is; a null text has no lines and stays null; '' has one
    line. Null ids come first; rows of equal id are ordered by their place in the input. The rows are written once
    with their places, so that a place names the same row in every pass. A column of ``docs`` called n_lines or
    n_removed is replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    at, starts, lines, gone = free_names(docs, "place", "starts", "lines", "gone")
    placed = docs.select(*(F.col(f"`{c}`") for c in columns)).withColumn(at, F.monotonically_increasing_id())
    placed = Scratch(docs.sparkSession, "lines-of").table(placed, "placed")
    keyed = placed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(at).alias("place"))
    found = repeated_lines(keyed, "doc_id", "text", size).select(F.col("place").alias(at), F.col("__starts").alias(starts))
    covers = ", ".join(f"i + {k}" for k in range(size))
    cut = placed.join(found, at, "left").withColumn(lines, F.split(F.col(f"`{text_col}`"), "\n")).withColumn(
        gone, F.expr(f"array_distinct(flatten(transform(coalesce({starts}, array()), i -> array({covers}))))")
    )
    kept = F.expr(f"array_join(transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> get({lines}, i)), '\n')")
    return cut.select(
        *(F.when(F.size(gone) > 0, kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in columns),
        F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS g FROM l, unnest(range(1, len(l) - 1)) t(i) WHERE len(l) >= 3),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(g, '[^ \t-\r]')),
c AS (SELECT DISTINCT doc_id, p FROM r, unnest([i, i + 1, i + 2]) t(p) WHERE k > 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.l[p], chr(10) ORDER BY p) AS kept FROM l, unnest(range(1, len(l.l) + 1)) t(p)
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = l.doc_id AND c.p = t.p) GROUP BY l.doc_id)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM l LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
