"""Data-quality and governance operators: rights, serving lists, quarantine, publication."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.functions.text import PATTERNS, is_confined, is_source_url
from quaver.operators.lookup import credits_pages

# Admitted licenses and their addresses.
LICENSES = {
    "CC0-1.0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "CC-BY-3.0": "https://creativecommons.org/licenses/by/3.0/",
    "CC-BY-4.0": "https://creativecommons.org/licenses/by/4.0/",
}


def _license_url(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, url in LICENSES.items():
        out = F.when(c == name, F.lit(url)).otherwise(out)
    return out


def _blank(c: Column, most: int = 1024) -> Column:
    return c.isNull() | (F.trim(c) == "") | (F.length(c) > most)


def rights_problem() -> Column:
    """The first rule that a joined row of catalog (t_*) and rights (r_*) breaks, in order, or null."""
    url = _license_url(F.col("t_license"))
    rules = [
        (~F.col("t_id").eqNullSafe(F.col("r_id")), "row order"),
        (url.isNull() | ~F.col("t_license_url").eqNullSafe(url) | ~F.col("r_license").eqNullSafe(F.col("t_license")) | ~F.col("r_license_url").eqNullSafe(url), "license"),
        (~F.coalesce(is_source_url(F.col("t_source_url")), F.lit(False)) | ~F.col("r_source_url").eqNullSafe(F.col("t_source_url")) | _blank(F.col("t_title")) | _blank(F.col("t_artist")) | _blank(F.col("t_attribution"), 8192), "provenance"),
        (
            ~F.coalesce(F.col("t_audio_bytes").between(1, 20_000_000) & F.col("t_audio_sha256").rlike(PATTERNS["sha256"]), F.lit(False))
            | ~F.col("r_audio_bytes").eqNullSafe(F.col("t_audio_bytes"))
            | ~F.col("r_audio_sha256").eqNullSafe(F.col("t_audio_sha256")),
            "audio pin",
        ),
        (~F.col("r_decision").eqNullSafe(F.lit("approved")) | _blank(F.col("r_reviewed_by"), 200), "review"),
        (~F.coalesce(F.col("r_reviewed_at").rlike(PATTERNS["rfc3339"]), F.lit(False)) | F.try_to_timestamp("r_reviewed_at").isNull(), "timestamp"),
        (~F.coalesce(is_confined(F.col("r_evidence_path")) & F.col("r_evidence_path").startswith("evidence/"), F.lit(False)), "evidence"),
    ]
    out = None
    for bad, name in rules:
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def check_rights(catalog: DataFrame, rights: DataFrame) -> DataFrame:
    """(row, problem) of the rows that break a rule. Both tables are aligned by row; a missing side breaks the order."""
    t = catalog.select("row", *(F.col(c).alias(f"t_{c}") for c in catalog.columns if c != "row"))
    r = rights.select("row", *(F.col(c).alias(f"r_{c}") for c in rights.columns if c != "row"))
    return t.join(r, "row", "full_outer").select("row", rights_problem().alias("problem")).filter("problem is not null")


def evidence_budget(evidence: DataFrame, budget: int) -> DataFrame:
    """(row, path, problem): conflicting pins of a shared path, and first uses beyond the byte budget in row order.

    ``evidence`` has (row, path, bytes, sha256). Unique paths are summed over ranges of rows, then inside them.
    """
    first = F.row_number().over(Window.partitionBy("path").orderBy("row"))
    pins = evidence.groupBy("path").agg(F.countDistinct("bytes", "sha256").alias("pins"))
    own = evidence.withColumn("nth", first).filter("nth = 1").withColumn("cell", F.floor(F.col("row") / 65536))
    totals = own.groupBy("cell").agg(F.sum("bytes").alias("b"))
    before = totals.select("cell", F.coalesce(F.sum("b").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("cell").orderBy("row"))
    spent = own.withColumn("running", running).join(before, "cell").filter(F.col("before") + F.col("running") > budget)
    over = spent.select("row", "path", F.lit("budget").alias("problem"))
    conflict = own.join(pins.filter("pins > 1"), "path").select("row", "path", F.lit("conflict").alias("problem"))
    return conflict.unionByName(over)


def serving_problems(catalog: DataFrame, serving: DataFrame, codes: list[str]) -> DataFrame:
    """(id, problem): unlisted or unknown ids, repeated ids, undefined or missing reasons; a null id if nothing is served.

    ``serving`` has (id, serve, reasons).
    """
    listed = serving.groupBy("id").agg(F.count("*").alias("n"))
    both = catalog.select("id", F.lit(True).alias("own")).join(listed, "id", "full_outer")
    ids = both.select("id", F.when(F.col("n").isNull(), "unlisted").when(F.col("own").isNull(), "unknown id").when(F.col("n") > 1, "repeated").alias("problem"))
    known = F.array(*(F.lit(c) for c in codes))
    reasons = serving.select("id", F.when(F.coalesce(F.size("reasons"), F.lit(0)) < 1, "no reason").when(F.size(F.array_except("reasons", known)) > 0, "undefined reason").alias("problem"))
    none = serving.agg(F.count_if("serve").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("nothing served").alias("problem"))
    return ids.unionByName(reasons).filter("problem is not null").unionByName(none)


def derive_serving(catalog: DataFrame, buckets: DataFrame, notices: DataFrame, reviews: DataFrame, keep: str = "KEEP") -> DataFrame:
    """(id, serve, reasons): rows of other buckets are held for that; kept rows for reviews, then notice kinds.

    ``buckets`` (id, bucket), ``notices`` (id, kinds array, such as NC+SA), ``reviews`` (id, code).
    """
    kinds = F.array_sort(F.array_distinct(F.flatten(F.transform("kinds", lambda k: F.split(k, r"\+")))))
    tags = notices.select("id", F.transform(kinds, lambda k: F.concat(F.lit("T."), k)).alias("tags"))
    held = reviews.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("held"))
    none = F.array().cast("array<string>")
    joined = catalog.select("id").join(buckets, "id").join(tags, "id", "left").join(held, "id", "left")
    reasons = F.when(F.col("bucket") != keep, F.array("bucket")).otherwise(F.concat(F.coalesce("held", none), F.coalesce("tags", none)))
    out = joined.select("id", reasons.alias("reasons"))
    return out.select("id", (F.size("reasons") == 0).alias("serve"), F.when(F.size("reasons") == 0, F.array(F.lit("SERVE"))).otherwise(F.col("reasons")).alias("reasons"))


def serving_counts(serving: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, name, n): served rows by license and held rows by reason."""
    by_license = serving.filter("serve").join(catalog.select("id", "license"), "id").groupBy(F.lit("served").alias("kind"), F.col("license").alias("name")).agg(F.count("*").alias("n"))
    by_reason = serving.filter("not serve").select(F.explode("reasons").alias("name")).groupBy(F.lit("held").alias("kind"), "name").agg(F.count("*").alias("n"))
    return by_license.unionByName(by_reason)


def keep_overlaps(catalog: DataFrame, buckets: DataFrame, notices: DataFrame, reviews: DataFrame, keep: str = "KEEP") -> DataFrame:
    """One row: the kept bucket's size and how many of it reviews, notice kinds and both hold."""
    tagged = notices.filter(F.size("kinds") > 0).select("id").distinct().withColumn("tagged", F.lit(True))
    reviewed = reviews.select("id").distinct().withColumn("reviewed", F.lit(True))
    kept = catalog.select("id").join(buckets.filter(F.col("bucket") == keep), "id").join(tagged, "id", "left").join(reviewed, "id", "left")
    return kept.agg(
        F.count("*").alias("keep_set"), F.count_if("reviewed").alias("held_by_review"), F.count_if("tagged").alias("held_by_tags"), F.count_if(F.col("reviewed") & F.col("tagged")).alias("held_by_both")
    )


def quarantine(catalog: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, alarms): removed or held ids leave; a quarantined audio hash under another id is an alarm."""
    clear = catalog.join(entries.select("id"), "id", "left_anti")
    twins = entries.filter("action = 'remove'").select(F.col("audio_sha256"), F.col("id").alias("listed"))
    alarms = clear.join(twins, "audio_sha256").filter("id <> listed").select("id", "listed")
    return clear, alarms


def publication_problems(joined: DataFrame) -> DataFrame:
    """(row, problems): every reason why a row may not be published."""
    url = _license_url(F.col("t_license"))
    found = F.array_compact(
        F.array(
            F.when(~F.col("t_id").eqNullSafe(F.col("r_id")), "identity"),
            F.when(url.isNull() | ~F.col("t_license_url").eqNullSafe(url), "catalog license"),
            F.when(~F.col("r_license").eqNullSafe(F.col("t_license")), "rights license"),
            F.when(~F.col("t_audio_bytes").eqNullSafe(F.col("r_audio_bytes")) | ~F.col("t_audio_sha256").eqNullSafe(F.col("r_audio_sha256")), "audio pins"),
            F.when(~F.col("r_decision").eqNullSafe(F.lit("approved")), "not approved"),
        )
    )
    return joined.select("row", found.alias("problems")).filter(F.size("problems") > 0)


def sampled_rows(rows: DataFrame, step: int) -> DataFrame:
    """The first and last row and every ``step``-th."""
    ends = F.broadcast(rows.agg(F.min("row").alias("lo"), F.max("row").alias("hi")))
    return rows.crossJoin(ends).filter((F.col("row") == F.col("lo")) | (F.col("row") == F.col("hi")) | (F.col("row") % step == 0)).select("row")


def sampled_index(rows: DataFrame, step: int) -> DataFrame:
    """The first and last row and every ``step``-th by its place in row order, whatever the rows' numbers."""
    last = F.broadcast(rows.agg(F.max("row").alias("last")))  # one row
    return credits_pages(rows, size=step).crossJoin(last).filter("slot = 0 or row = last").select("row")


def plan_problems(plan: DataFrame, catalog: DataFrame, rights: DataFrame, evidence: DataFrame, most: int = 20_000_000) -> DataFrame:
    """(id, problem): the first rule by which a delivery plan's entry disagrees with catalog, rights and evidence.

    ``plan`` (row, id, bytes, sha256, compressed_bytes, range_bytes, crc32, path), ``catalog`` (row, id, bytes, sha256),
    ``rights`` (id, decision, path), ``evidence`` (path, bytes, crc32). A side that is missing breaks its own rule;
    a row of the catalog without an entry, or the reverse, breaks the order.
    """
    p = plan.select("row", F.struct("id", "bytes", "sha256", "compressed_bytes", "range_bytes", "crc32", "path").alias("p"))
    c = catalog.select("row", F.struct("id", "bytes", "sha256").alias("c"))
    r = rights.select(F.col("id").alias("rid"), F.struct("decision", "path").alias("r"))
    e = evidence.select(F.col("path").alias("epath"), F.struct("bytes", "crc32").alias("e"))
    all_ = p.join(c, "row", "full_outer").join(r, F.col("rid") == F.col("c.id"), "left").join(e, F.col("epath") == F.col("p.path"), "left")
    size = lambda name: F.coalesce(F.col(f"p.{name}").between(1, most), F.lit(False))
    rules = [
        (F.col("p.id").eqNullSafe(F.col("c.id")) & F.col("p.id").isNotNull(), "order"),
        (F.col("r.decision").eqNullSafe(F.lit("approved")), "not approved"),
        (F.col("p.bytes").eqNullSafe(F.col("c.bytes")) & F.col("p.sha256").eqNullSafe(F.col("c.sha256")) & F.col("p.path").eqNullSafe(F.col("r.path")), "recording"),
        (size("bytes") & size("compressed_bytes") & F.col("p.range_bytes").eqNullSafe(F.col("p.compressed_bytes") + 512), "member bounds"),
        (F.col("e.bytes").eqNullSafe(F.col("p.bytes")) & F.col("e.crc32").eqNullSafe(F.col("p.crc32")), "evidence"),
    ]
    problem = F.coalesce(*(F.when(~ok, name) for ok, name in rules))
    return all_.select(F.coalesce("p.id", "c.id").alias("id"), problem.alias("problem")).filter("problem is not null")


@dataclass(frozen=True)
class Limits:
    """Limits of a release; values over the ceilings, booleans and non-positive numbers are refused."""

    rows: int = 200_000
    dimensions: int = 512
    asset_bytes: int = 1 << 32
    evidence_bytes: int = 1 << 30

    CEILINGS = {"rows": 1_000_000, "dimensions": 4096, "asset_bytes": 1 << 34, "evidence_bytes": 1 << 32}

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, int) or not 1 <= v <= self.CEILINGS[f.name]:
                raise ValueError(f"Invalid limit {f.name}")


def display_problems(folded: DataFrame) -> DataFrame:
    """Rows whose folded columns don't agree: fold_title_artist must begin fold_text, fold_title must begin it."""
    return folded.filter(~F.col("fold_text").startswith(F.col("fold_title_artist")) | ~F.col("fold_title_artist").startswith(F.col("fold_title"))).select("row")
