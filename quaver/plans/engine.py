"""One object with every read of the catalog service."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions.text import html_escape, query_limits
from quaver.operators import graph, lookup, rerank, search, tiles
from quaver.scratch import scratch_table


class Engine:
    """A catalog: tracks (row, id, title, artist, album, genre, ...), vectors (row, embedding), layout (row, x, y),
    edges (src, level, pos, dst) and the served rows (row). Folded names are kept once for all lookups."""

    #: Bounds of a request.
    MAX_K, MAX_EF, MAX_TRACE = 20, 108, 2048

    def __init__(self, tracks: DataFrame, vectors: DataFrame, layout: DataFrame | None = None, edges: DataFrame | None = None, served: DataFrame | None = None, entry: int = 0):
        self.folded = lookup.with_folds(tracks)
        self.tracks, self.vectors, self.layout, self.edges, self._served, self.entry = tracks, vectors, layout, edges, served, entry
        self._points = None

    def _bounds(self, k: int, ef: int, trace: int = 0) -> None:
        for name, v, low, high in (("k", k, 1, self.MAX_K), ("ef", ef, 1, self.MAX_EF), ("trace", trace, 0, self.MAX_TRACE)):
            if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
                raise ValueError(f"Invalid {name}")
        if ef < k:
            raise ValueError("ef must be at least k")

    def search(self, queries: DataFrame, k: int = 16, ef: int = 32) -> DataFrame:
        """(query, rank, row, distance, similarity) of a query set (query, q), over served rows."""
        self._bounds(k, ef)
        rows = self.vectors if self._served is None else self.vectors.join(self._served.select("row"), "row", "left_semi")
        return search.batch_top_k(rows, queries, k).withColumn("similarity", 1 - F.col("distance"))

    def trace(self, queries: DataFrame, k: int = 16, ef: int = 32, limit: int = 2048) -> DataFrame:
        self._bounds(k, ef, limit)
        found = graph.traced_search(self.vectors, self.edges, queries, self.entry, k, ef, limit)
        return found if self._served is None else graph.served_trace(found, self._served)

    def page(self, query: str = "", refine: str = "", genre: str = "", offset: int = 0, limit: int = 12, available: DataFrame | None = None) -> lookup.Page:
        if len(query) > 200 or len(refine) > 200 or offset < 0 or not 1 <= limit <= 200:
            raise ValueError("Invalid page parameters")
        return lookup.page_query(self.folded, query, refine, genre, offset, limit, self._served, available)

    def rows(self, rows: list[int]) -> DataFrame:
        from quaver.sources.release import rows_by_position

        return rows_by_position(self.tracks, rows)

    def neighbors(self, row: int, k: int = 16) -> DataFrame:
        """The k served rows nearest to a row, itself excluded."""
        return search.exact_top_k(self.vectors, search.row_vector(self.vectors, row), k, exclude=row, allowed=self._served)

    def more_artists(self, candidates: DataFrame, limit: int = 8) -> DataFrame:
        return rerank.artist_spread(candidates, limit)

    def tile(self, z: int, x: int, y: int) -> DataFrame:
        if self._points is None:
            shown = self.layout if self._served is None else self.layout.join(self._served.select("row"), "row", "left_semi")
            self._points = scratch_table(tiles.coded(shown).select("row", "code"), "points")
        return tiles.tile(self._points, z, x, y)

    def links(self, row: int) -> DataFrame:
        return graph.stored_links(self.edges, row, self._served)

    def credits(self, page: int) -> DataFrame:
        """The articles of a page of 50 served rows, the page clamped to what there is."""
        last = -(-self.serving().count() // 50)
        at = lookup.credits_pages(self.tracks, self._served).filter(F.col("page") == min(max(1, page), max(1, last)))
        own = self.tracks.join(at, "row")
        return own.orderBy("slot").select("row", credit_article().alias("html"))

    def credit_redirect(self, ident: str) -> DataFrame:
        """(id, page, anchor) of an id's credit; no row if it isn't served."""
        return lookup.credit_redirects(self.tracks, self._served).filter(F.col("id") == ident)

    def replay(self, examples: DataFrame, k: int = 8, ef: int = 32) -> DataFrame:
        """(query, verified, recall) of recorded examples (query, q, vector_sha256): the traced search against the exact one.

        ``verified`` says whether the stored vector's bytes still have their digest.
        """
        self._bounds(k, ef)
        from quaver.sources.release import packed

        same = examples.select("query", F.sha2(F.unbase64(packed(F.col("q"))), 256).eqNullSafe(F.col("vector_sha256")).alias("verified"))
        asked = examples.select("query", "q")
        found = graph.results_of(graph.traced_search(self.vectors, self.edges, asked, self.entry, k, ef)).select("query", "row")
        return same.join(search.recall(found, search.batch_top_k(self.vectors, asked, k).select("query", "row"), k), "query")

    def serving(self) -> DataFrame:
        return self.tracks.select("row", "id") if self._served is None else self.tracks.join(self._served.select("row"), "row", "left_semi").select("row", "id")

    def availability(self) -> DataFrame:
        from quaver.sources.release import availability_bits

        rows = self.tracks.select("row").join(self.serving().select("row", F.lit(True).alias("a")), "row", "left")
        return availability_bits(rows.select("row", F.coalesce("a", F.lit(False)).alias("available")))

    def manifest(self) -> DataFrame:
        """One row: the sizes and bounds of the catalog."""
        n = self.tracks.agg(F.count("*").alias("tracks"), F.countDistinct("artist_id").alias("artists"))
        v = self.vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dimensions"))
        return n.crossJoin(v).withColumns({"max_k": F.lit(self.MAX_K), "max_ef": F.lit(self.MAX_EF), "max_trace": F.lit(self.MAX_TRACE)})

    @staticmethod
    def review(texts: DataFrame, column: str = "query") -> DataFrame:
        """Requests in descriptions that a search can't honour."""
        return texts.withColumn("requests", query_limits(F.col(column)))


def credit_article():
    """A track's credit as an HTML article, from columns title, artist and license."""
    e = lambda c: html_escape(F.coalesce(F.col(c), F.lit("")))
    return F.concat(F.lit("<article><h2>"), e("title"), F.lit("</h2><p>"), e("artist"), F.lit("</p><p>"), e("license"), F.lit("</p></article>"))


def scope_text(channel: str, catalog: int, candidates: int, start: int, end: int, total: int) -> str:
    """What a list holds: its kind, the rows shown, and how many of the catalog's tracks a refinement chooses from."""
    kind = {"sound": "Nearest by sound", "neighbors": "Nearest by sound", "browse": "Catalog"}.get(channel, "Names that match")
    rows = f"{start + 1:,} to {end:,} of {total:,}" if total else "none"
    return f"{kind}: {rows} (chosen from {candidates:,} of {catalog:,} tracks)"


def parameters(query_string: str, allowed: set[str]) -> dict[str, str]:
    """The parameters of a request: ASCII, at most 16, known, none twice, values of up to 2,048 bytes."""
    if not query_string.isascii():
        raise ValueError("Invalid query string")
    pairs = parse_qsl(query_string, keep_blank_values=True, max_num_fields=16)
    names = [name for name, _ in pairs]
    if len(set(names)) < len(names) or set(names) - allowed or any(len(value.encode()) > 2048 for _, value in pairs):
        raise ValueError("Invalid parameter")
    return dict(pairs)


def number(values: dict[str, str], name: str, default: int, low: int, high: int) -> int:
    """A parameter of one to eight digits within bounds, or its default where it is absent."""
    if name not in values:
        return default
    if not re.fullmatch("[0-9]{1,8}", values[name]) or not low <= int(values[name]) <= high:
        raise ValueError(f"Invalid {name}")
    return int(values[name])
