"""Browse, lookup, refinement, facets and pages over folded metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import contains_all, fold, fold_text

#: Pieces that a task holds before it hands them on, one row's aside.
GRAMS = 65_536

#: Rows of a catalog whose pieces one task holds.
PART_ROWS = 40_000


def row_parts(folded: DataFrame) -> int:
    """Parts of a catalog, dealt by row, whose pieces a task can hold at any size."""
    return max(1, -(-folded.count() // PART_ROWS))


def with_folds(tracks: DataFrame) -> DataFrame:
    """Adds fold_title, fold_title_artist and fold_text; done once, when a catalog is written."""
    album = F.coalesce(F.col("album"), F.lit(""))
    return (
        tracks.withColumn("fold_title", fold(F.col("title")))
        .withColumn("fold_title_artist", fold(F.concat_ws(" ", "title", "artist")))
        .withColumn("fold_text", fold(F.concat_ws(" ", F.col("title"), F.col("artist"), album)))
    )


@dataclass
class Page:
    """A page with its totals, each a DataFrame over the same base."""

    rows: DataFrame
    total: DataFrame
    base_total: DataFrame
    genres: DataFrame


def looked_up(folded: DataFrame, query: str, served: DataFrame | None = None) -> tuple[DataFrame, list[Column]]:
    """The base of a page and its order. A query of spaces browses; one that only folds to nothing matches all."""
    base = folded if served is None else folded.join(served.select("row"), "row", "left_semi")
    if not query.strip():
        return base, [F.col("row")]
    q = fold_text(query)
    return base.filter(contains_all(F.col("fold_title_artist"), q)), [(F.col("fold_title") == q.strip()).desc(), F.col("row")]


def page_query(folded: DataFrame, query: str = "", refine: str = "", genre: str = "", offset: int = 0, limit: int | None = 12, served: DataFrame | None = None, available: DataFrame | None = None) -> Page:
    """Lookup (or browse), then refinement, genre and availability, which change ``total`` and the rows only.

    Without a ``limit`` the rows are all matches, in no order.
    """
    base, order = looked_up(folded, query, served)
    shown = base.filter(contains_all(F.col("fold_text"), fold_text(refine)))
    if genre:
        shown = shown.filter(F.col("genre") == genre)
    if available is not None:
        shown = shown.join(available.select("row"), "row", "left_semi")
    return Page(
        rows=shown if limit is None else shown.orderBy(*order).offset(offset).limit(limit),
        total=shown.agg(F.count("*").alias("total")),
        base_total=base.agg(F.count("*").alias("total")),
        genres=facets(base),
    )


def facets(base: DataFrame) -> DataFrame:
    return base.filter(F.trim("genre") != "").groupBy("genre").agg(F.count("*").alias("n"))


def scored_lookup(folded: DataFrame, query: str, n: int) -> DataFrame:
    q = fold_text(query).strip()
    score = F.when(F.col("fold_title") == q, 100).otherwise(0) + F.when(contains_all(F.col("fold_title_artist"), q), 10).otherwise(0)
    return folded.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "row").limit(n)


def credits_pages(tracks: DataFrame, served: DataFrame | None = None, size: int = 50) -> DataFrame:
    """(row, page, slot): consecutive served rows in pages of ``size``, numbered from 1.

    Ranks come from counts by range of rows and a window within each range, so no task gets all rows.
    """
    rows = tracks.select("row") if served is None else tracks.select("row").join(served.select("row"), "row", "left_semi")
    cell = rows.withColumn("cell", F.floor(F.col("row") / 65536))
    counts = cell.groupBy("cell").agg(F.count("*").alias("n"))
    before = counts.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("cell").orderBy("row")) - 1
    at = cell.withColumn("own", own).join(before, "cell").select("row", (F.col("before") + F.col("own")).alias("at"))
    return at.select("row", (F.floor(F.col("at") / size) + 1).cast("long").alias("page"), (F.col("at") % size).cast("long").alias("slot"))


def trigrams(folded: DataFrame, column: str = "fold_text") -> DataFrame:
    """The inverted table (gram, row) of all three-character pieces, each once for a row, in time linear in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams, rows = [], []
            for row, text in zip(b.column("row"), b.column(column)):
                own = text.as_py() or ""
                pieces = dict.fromkeys(own[i : i + 3] for i in range(len(own) - 2))
                grams += pieces
                rows += [row.as_py()] * len(pieces)
                if len(grams) >= GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(rows, b.column("row").type)], ["gram", "row"])
                    grams, rows = [], []
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(rows, b.column("row").type)], ["gram", "row"])

    return folded.select("row", column).mapInArrow(run, f"gram string, row {dict(folded.dtypes)['row']}")


def query_grams(query: str) -> list[str]:
    """Pieces of the query's words of three characters or more; words with NUL are skipped."""
    out = []
    for w in fold_text(query).split():
        if len(w) >= 3 and "\0" not in w:
            out += [w[i : i + 3] for i in range(len(w) - 2)]
    return sorted(set(out))


def indexed_lookup(folded: DataFrame, index: DataFrame, query: str, total: int, least: int = 64) -> tuple[DataFrame, bool]:
    """Rows whose fold_text has all words, and whether the index was used.

    A bounded probe counts the index matches; the index is worth it only below max(least, total / 10). The
    final substring test keeps results the same either way.
    """
    grams = query_grams(query)
    full = folded.filter(contains_all(F.col("fold_text"), fold_text(query)))
    if not grams:
        return full, False
    matches = index.filter(F.col("gram").isin(grams)).groupBy("row").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("row")
    bound = max(least, total // 10)
    if matches.limit(bound).count() >= bound:
        return full, False
    return full.join(F.broadcast(matches), "row", "left_semi"), True  # fewer than ``bound`` rows


@dataclass(frozen=True)
class Postings:
    """A stored index: ``rows`` (gram, row) ranged and sorted by gram, and ``counts`` (gram, n)."""

    rows: DataFrame
    counts: DataFrame


def write_postings(folded: DataFrame, path: str) -> Postings:
    """Store the trigrams of ``fold_text`` below ``path``, so that a filter on grams reads only the files and row groups that may hold them."""
    spark = folded.sparkSession
    trigrams(folded).repartitionByRange("gram", "row").sortWithinPartitions("gram", "row").write.parquet(f"{path}/rows")
    rows = read_postings(spark, path, rows_only=True)
    rows.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return read_postings(spark, path)


def read_postings(spark, path: str, rows_only: bool = False):
    rows = spark.read.schema("gram string, row long").parquet(f"{path}/rows")
    return rows if rows_only else Postings(rows, spark.read.schema("gram string, n long").parquet(f"{path}/counts"))


def posted_lookup(folded: DataFrame, index: Postings, query: str, total: int, least: int = 64) -> tuple[DataFrame, list[str]]:
    """Rows whose fold_text has all words, and the grams whose postings were read for it (none: the texts were scanned).

    Postings are met from the rarest gram on, until fewer rows are left than max(``least``, ``total`` / 10); what is left is tested
    against the texts, so grams that weren't needed change nothing. A gram that no row has gives no rows. If all grams together
    leave too many rows, or the query has no gram, the texts are scanned.
    """
    grams = query_grams(query)
    full = folded.filter(contains_all(F.col("fold_text"), fold_text(query)))
    if not grams:
        return full, []
    # one row for each gram of the query
    counts = {r.gram: r.n for r in index.counts.filter(F.col("gram").isin(grams)).collect()}
    order = sorted(grams, key=lambda g: (counts.get(g, 0), g))
    bound, used = max(least, total // 10), order[:1]
    rows = index.rows.filter(F.col("gram") == order[0]).select("row")
    left = counts.get(order[0], 0)
    while left >= bound and len(used) < len(order):
        gram = order[len(used)]
        rows = rows.join(index.rows.filter(F.col("gram") == gram).select("row"), "row", "left_semi")
        used.append(gram)
        left = rows.limit(bound).count()
    if left >= bound:
        return full, []
    return full.join(F.broadcast(rows), "row", "left_semi"), used  # fewer than ``bound`` rows


def result_page(total: int, requested: int, size: int = 12) -> tuple[int, int, int, int]:
    """(page, pages, start, end), the page clamped to what there is."""
    pages = -(-total // size)
    page = max(0, min(requested, max(0, pages - 1)))
    return page, pages, page * size, min(page * size + size, total)


def credit_redirects(tracks: DataFrame, served: DataFrame | None = None, size: int = 50) -> DataFrame:
    """(id, page, anchor): where the credit of a served id stands; ids that aren't served have no row."""
    return tracks.select("row", "id").join(credits_pages(tracks, served, size), "row").select("id", "page", F.replace("id", F.lit(":"), F.lit("-")).alias("anchor"))


def index_problems(folded: DataFrame, index: DataFrame) -> DataFrame:
    """(gram, row, problem) where a stored index isn't that of the folded texts: missing, extra or repeated.

    Both sides are dealt by row to parts of bounded size and counted there; nothing is counted before, where a task could have any number of pieces.
    """
    want = trigrams(folded).withColumn("want", F.lit(1)).withColumn("have", F.lit(0))
    have = index.select("gram", "row").withColumn("want", F.lit(0)).withColumn("have", F.lit(1))
    each = want.unionByName(have).repartition(row_parts(folded), "row").groupBy("row", "gram").agg(F.max("want").alias("want"), F.sum("have").alias("n"))
    problem = F.when(F.col("n") == 0, "missing").when(F.col("want") == 0, "extra").when(F.col("n") > 1, "repeated")
    return each.select("gram", "row", problem.alias("problem")).filter("problem is not null")
