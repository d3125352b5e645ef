"""Learned decision lists over document statistics (DataFrame operations only).

Statistics come from whole texts by array functions in the JVM; no row is exploded or shuffled.
Sequential covering learns rules for low quality from a bounded sample of labelled rows: a rule grows
threshold by threshold on two thirds of the sample, is pruned on the other third, and is kept if it
is precise there. The list is emitted as one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import pinned

WORD_GAP = r"[ \\t-\\r]+"
SYMBOLS = r"[#*$%&|<>]"

#: The statistics on which rules are learned, as ratios that don't depend on length.
FEATURES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def _quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines, n_upper, n_marks.

    A null text has no words. Repeated rows stay. ``keep`` names further columns of ``docs`` to pass on, prefixed ``in_``.
    """
    k = [F.col(_quoted(c)).alias(f"in_{c}") for c in keep]
    kept = [_quoted(f"in_{c}") for c in keep]
    base = docs.select(F.col(id_col).alias("doc_id"), *k, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = base.select(
        "doc_id",
        *kept,
        F.expr(rf"filter(split(t, '{WORD_GAP}'), w -> w <> '')").alias("w"),
        F.expr(r"filter(split(t, '\n'), l -> l rlike '[^ \\t-\\r]')").alias("lines"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit(r"!")).cast("long").alias("n_marks"),
    )
    passed = ["doc_id", *kept, "n_symbols", "n_upper", "n_marks"]
    hashed = words.select(
        *passed,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
    )
    passed += ["n_words", "word_chars", "n_lines", "n_dup_lines"]
    windows = hashed.select(
        *passed,
        F.expr(
            "if(n_words < 5, array(), transform(sequence(0, cast(n_words as int) - 5),"
            " i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))))"
        ).alias("g"),
    )
    # only texts with a repeated window are sorted
    placed = windows.select(
        *passed,
        F.expr("if(size(array_distinct(g)) = size(g), array(), sort_array(transform(g, (x, i) -> struct(x as x, i as i))))").alias("s"),
    )
    found = placed.select(
        *passed,
        F.expr(
            "sort_array(transform(filter(s, (v, k) -> v.x = get(s, k - 1).x or v.x = get(s, k + 1).x), v -> v.i))"
        ).alias("at"),
    )
    # each repeated window adds the words that the one before it has not covered
    covered = F.expr("aggregate(transform(at, (p, k) -> if(k = 0, 5, least(5, p - get(at, k - 1)))), 0L, (a, x) -> a + x)")
    return found.select(*passed, pinned(covered).alias("n_repeat_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    if p1 == 0:
        return -1.0
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0)))


def _grow(rows: list[dict], max_conditions: int) -> list[Condition]:
    """Add the threshold of the highest gain, halfway between two neighbouring values, while there is one."""
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, best_gain = None, 1e-9
        for feature in FEATURES:
            ordered = sorted((r[feature], r["bad"]) for r in rows)
            p = 0
            for i, ((value, bad), (above, _)) in enumerate(zip(ordered, ordered[1:]), 1):
                p += bad
                if value == above:
                    continue
                for over, p1, n1 in ((True, p0 - p, n0 - i + p), (False, p, i - p)):
                    if (g := _gain(p0, n0, p1, n1)) > best_gain:
                        best, best_gain = Condition(feature, over, (value + above) / 2), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list[dict]) -> tuple[float, int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    p = sum(hit)
    return ((2 * p - len(hit)) / len(hit) if hit else -1.0), p, len(hit)


def learn_rules(rows: list[dict], max_rules: int = 12, max_conditions: int = 3, precision: float = 0.95, least: int = 5) -> list[list[Condition]]:
    """Rules for bad rows by sequential covering; ``rows`` have the features and bad (0 or 1).

    A rule is kept if at least ``precision`` of the rows it covers in the pruning third, and of those in all rows,
    are bad and it covers ``least`` bad rows in all. Rows of one class only give no rules.
    """
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules:
        rule = _grow(grow, max_conditions)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (_worth(r, prune)[0], -len(r)))
        both = grow + prune
        _, p, n = _worth(rule, both)
        _, pp, pn = _worth(rule, prune)
        if p < least or p < precision * n or pp < precision * pn:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """True for rows to keep: an ordered conditional expression over the features."""
    out = None
    for rule in rules:
        fits = rule[0].column()
        for c in rule[1:]:
            fits = fits & c.column()
        out = F.when(fits, F.lit(False)) if out is None else out.when(fits, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def _with_features(stats: DataFrame) -> DataFrame:
    return stats.select("*", *(F.expr(f"cast({e} as double)").alias(f) for f, e in FEATURES.items()))


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> list[dict]:
    """At most ``sample`` labelled rows with their features, by a hash of the id.

    Rows that fail the base rules are left out, as the list never sees them. Labels that disagree count as bad;
    null ids or qualities are ignored; a repeated document counts once.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("doc_id")).agg(F.when(F.min("quality") == 0, 1).otherwise(0).alias("bad"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    mine = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    rows = _with_features(statistics(mine, keep=("bad",))).filter(~base_failed())
    # of several texts under one id, the one whose features come first
    one = rows.groupBy("doc_id").agg(F.first("in_bad").alias("bad"), F.min(F.struct(*FEATURES)).alias("f"))
    found = {r["doc_id"]: {"doc_id": r["doc_id"], "bad": r["bad"], **r["f"].asDict()} for r in one.collect()}  # at most ``sample`` rows
    return [found[k] for k in sorted(found)]


def apply_rules(docs: DataFrame, rules: list[list[Condition]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics of every row with base_failed and kept; false for kept if base_failed, else by the list."""
    stats = _with_features(statistics(docs, keep=keep))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision(rules))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """Learn from ``labels`` (doc_id, quality) and judge all ``docs`` (doc_id, text).

    Without labels, or with labels of one class only, all rows that pass the base rules are kept.
    """
    return apply_rules(docs, learn_rules(labelled_rows(docs, labels, sample)))


def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    judged = apply_rules(docs, learn_rules(labelled_rows(docs, labels, sample)), keep=tuple(docs.columns))
    return judged.filter("kept").select(*(F.col(_quoted(f"in_{c}")).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
