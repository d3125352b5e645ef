"""Empirical-Bayes host reputation for URL filtering (DataFrame operations only).

Labelled page outcomes (bad or not) are counted by host, registered domain and suffix. Every level's
rate is shrunk to the level above with a beta-binomial prior whose strength is estimated from the
spread of the level's own rates and held between two limits. A host is blocked if the lower bound of its
posterior bad rate is over the pooled rate of all labelled pages. Listed rules come before the posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, ascii_lower, small


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

# The public suffixes of two labels that the query knows; a table of all of them can be given instead.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
    "com.br", "com.cn", "co.in", "co.nz", "co.za", "com.mx", "com.ar", "com.tr", "co.kr", "com.tw",
)


def url_host(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; '' without ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; may be ''."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_name(host: Column) -> Column:
    """The host without user and port, as which pages of one host are counted together."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def is_address(name: Column) -> Column:
    """Whether a name is an IPv4 or a bracketed IPv6 address."""
    return name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$")


def with_levels(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``names`` (name) with its registered ``domain`` and its ``suffix``.

    The suffix is the longest of the last three, two and one labels that ``suffixes`` (suffix) lists, else the last label; the
    domain has one label more, if there is one. An address is its own domain and suffix.
    """
    known = small(suffixes.select("suffix").distinct(), 100_000)
    out = names
    for k in (3, 2):
        tail = F.substring_index("name", ".", -k)
        found = known.select(F.col("suffix").alias(f"s{k}"))
        # a name of fewer labels is its own tail, which is right: it may be a suffix itself
        out = out.withColumn(f"t{k}", tail).join(found, F.col(f"t{k}") == F.col(f"s{k}"), "left").drop(f"t{k}")
    suffix = F.when(is_address(F.col("name")), F.col("name")).otherwise(F.coalesce("s3", "s2", F.substring_index("name", ".", -1)))
    labels = F.split("name", r"\.")
    more = F.least(F.size(labels), F.size(F.split("suffix", r"\.")) + 1)
    domain = F.when(is_address(F.col("name")), F.col("name")).otherwise(F.concat_ws(".", F.slice(labels, -more, more)))
    return out.withColumn("suffix", suffix).withColumn("domain", domain).drop("s3", "s2")


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits as struct(name, verdict), or null."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def _strength(level: DataFrame, lowest: float, highest: float) -> DataFrame:
    """One row: the prior strength by the method of moments over (n, bad) of a level."""
    overall = level.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count("*").alias("k"))
    spread = level.crossJoin(F.broadcast(overall)).agg(
        F.first("all_n").alias("all_n"),
        F.first("k").alias("k"),
        (F.first("all_bad") / F.first("all_n")).alias("p"),
        (F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("all_bad") / F.col("all_n"), F.lit(2.0))) / F.first("all_n")).alias("s2"),
    )
    tau2 = F.col("s2") - F.col("p") * (1 - F.col("p")) * F.col("k") / F.col("all_n")
    raw = F.col("p") * (1 - F.col("p")) / tau2 - 1
    return spread.select(F.coalesce(F.when(tau2 > 1e-9, F.least(F.greatest(raw, F.lit(lowest)), F.lit(highest))).otherwise(F.lit(highest)), F.lit(highest)).alias("m"))


def host_posteriors(names: DataFrame, outcomes: DataFrame, suffixes: DataFrame, lowest: float = 1.0, highest: float = 20.0) -> DataFrame:
    """Posterior mean and standard deviation of the bad rate of each of ``names`` (name), and the pooled rate.

    ``outcomes`` has (name, bad) per labelled page, bad 0 or 1; its names are among ``names``. Without any outcome all means are 0.5.
    A prior is worth ``lowest`` to ``highest`` pages; where rates don't visibly differ it is worth the most.
    """
    scratch = Scratch(names.sparkSession, "hosts")
    levels = scratch.table(with_levels(names, suffixes), "levels")
    by_host = scratch.table(outcomes.groupBy("name").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")), "counts")
    up = by_host.join(levels, "name")
    by_domain = up.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = up.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    world = by_host.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("p_world"))

    def named(df: DataFrame, x: str) -> DataFrame:
        return df.withColumnsRenamed({"n": f"n_{x}", "bad": f"bad_{x}"})

    one_row = world
    for x, df in (("h", by_host), ("d", by_domain), ("s", by_suffix)):
        one_row = one_row.crossJoin(_strength(df, lowest, highest).withColumnRenamed("m", f"m_{x}"))  # single rows
    all_hosts = (
        levels.join(named(by_host, "h"), "name", "left")
        .join(named(by_domain, "d"), "domain", "left")
        .join(named(by_suffix, "s"), "suffix", "left")
        .crossJoin(F.broadcast(one_row))  # one row of priors
    )

    def shrunk(x: str, prior: Column) -> Column:
        return (F.coalesce(F.col(f"bad_{x}"), F.lit(0)) + F.col(f"m_{x}") * prior) / (F.coalesce(F.col(f"n_{x}"), F.lit(0)) + F.col(f"m_{x}"))

    mean = shrunk("h", shrunk("d", shrunk("s", F.col("p_world"))))
    total = F.coalesce(F.col("n_h"), F.lit(0)) + F.col("m_h")
    return all_hosts.select("name", mean.alias("mean"), total.alias("total"), "p_world").select(
        "name", "mean", F.col("p_world").alias("pooled"), F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1)).alias("sd")
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, margin: float = 1.0, z: float = 1.0, broadcast_rows: int = 100_000, suffixes: DataFrame | None = None) -> DataFrame:
    """Judge every page by rule, else by its host's posterior.

    ``pages`` (page_id, url), ``labels`` (doc_id, quality, toxic): a page is bad if the label of its id
    has quality 0 or toxic 1; repeated labels count once, as bad if one of them is. Returns (page_id,
    host, path, rule, verdict). A host is blocked if its mean less ``z`` deviations is over ``margin`` times the
    pooled rate. Hosts count without user and port; an address belongs to no domain but its own; ``suffixes`` (suffix) lists the
    public suffixes of two and three labels (those of ``SUFFIXES`` unless given). A null url, or one without ``://``, has empty host
    and path, fits no rule and is judged as the host ''. Null ids have no labels. Urls may be of any length. Repeated pages
    stay, other columns are ignored; no pages give no rows.
    """
    if suffixes is None:
        suffixes = pages.sparkSession.createDataFrame([(x,) for x in SUFFIXES], "suffix string")
    scratch = Scratch(pages.sparkSession, "urls")
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = seen.fillna("", ["host", "path"])
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.filter(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    known = known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    seen = seen.withColumn("name", host_name(F.col("host")))
    outcomes = seen.filter(F.col("page_id").isNotNull()).select("page_id", "name").join(known, "page_id").select("name", "bad")
    posts = host_posteriors(seen.select("name").distinct(), outcomes, suffixes)
    blocked = scratch.table(posts.filter(F.col("mean") - z * F.col("sd") > margin * F.col("pooled")).select("name"), "blocked")
    # a host can hold a third of all pages: broadcast where the count allows it, else AQE splits the hot host
    judged = seen.join(small(blocked, broadcast_rows).withColumn("listed", F.lit(True)), "name", "left")
    rule = match_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("r", rule).select(
        "page_id", "host", "path", F.col("r.name").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    twos = ", ".join(f"'{x}'" for x in SUFFIXES)
    rules = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    fit = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda f: "CASE " + " ".join(f"WHEN {fit(r)} THEN '{f(r)}'" for r in rules) + " END"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    m = lambda t: f"""(SELECT coalesce(CASE WHEN tau2 > 1e-9 THEN least(greatest(p * (1 - p) / tau2 - 1, 1.0), 20.0) ELSE 20.0 END, 20.0) FROM (
      SELECT p, s2 - p * (1 - p) * k / all_n AS tau2 FROM (SELECT any_value(p) AS p, count(*) AS k, sum(n) AS all_n, sum(n * pow(bad / n - p, 2.0)) / sum(n) AS s2
      FROM {t}, (SELECT sum(bad) / sum(n) AS p FROM {t}))))"""  # noqa: E731
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM seen),
names AS (SELECT name, CASE WHEN address THEN name WHEN two IN ({twos}) THEN two ELSE l[-1] END AS suffix,
    CASE WHEN address THEN name ELSE array_to_string(l[-(CASE WHEN two IN ({twos}) THEN 3 ELSE 2 END):], '.') END AS domain
  FROM (SELECT DISTINCT name, string_split(name, '.') AS l, array_to_string(string_split(name, '.')[-2:], '.') AS two,
    regexp_matches(name, '^([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}$|^\\[.*\\]$') AS address FROM named)),
hs AS (SELECT name, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM named JOIN known ON page_id = doc_id GROUP BY name),
ds AS (SELECT domain, sum(n) AS n, sum(bad) AS bad FROM hs JOIN names USING (name) GROUP BY domain),
ss AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hs JOIN names USING (name) GROUP BY suffix),
one AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS p, {m('hs')} AS m_h, {m('ds')} AS m_d, {m('ss')} AS m_s FROM hs),
a AS (SELECT names.name, p AS pooled, coalesce(hs.n, 0) + m_h AS total,
    (coalesce(hs.bad, 0) + m_h * ((coalesce(ds.bad, 0) + m_d * ((coalesce(ss.bad, 0) + m_s * p) / (coalesce(ss.n, 0) + m_s))) / (coalesce(ds.n, 0) + m_d))) / (coalesce(hs.n, 0) + m_h) AS mean
  FROM names LEFT JOIN hs USING (name) LEFT JOIN ds USING (domain) LEFT JOIN ss USING (suffix), one),
b AS (SELECT name FROM a WHERE mean - sqrt(mean * (1 - mean) / (total + 1)) > pooled)
SELECT page_id, host, path, {case(lambda r: r.name)} AS rule,
  coalesce({case(lambda r: r.verdict)}, CASE WHEN name IN (SELECT name FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM named
"""


SQL = _sql()
