"""Exact Jaccard join on word n-grams by parts of sets, for connected components.

Every text becomes a set of shingle hashes. Hashing deals the shingles to parts, more than the shingles in which sets
that reach the threshold can differ, so such sets have equal parts. A part's shingles together are one token, which hardly any text has
that is no near copy, however often its shingles occur; so tokens stay as rare when the corpus grows. Tokens are
ordered by how common the rarest of their shingles is in the corpus (a count sketch of fixed size over all
documents gives the order; any order is correct, a rare-first one is fast), and sets that reach the threshold
share one among the first few of both, their prefixes.

1. Equal sets are one node; nodes of equal prefix and size are one group, whose number is a hash of both. If a number
   stood for two groups, they would be one with more members, whose pairs are compared like any others.
2. Only groups are posted under their prefix tokens, as narrow rows (token, group, size), once for each task that
   finds one. They are shuffled once, and sorted runs of one group are dropped on the way.
   Group pairs meet at a token and pass if sizes still allow the threshold; they are made distinct.
3. Group pairs are expanded to members, whose odd sketches (parities of shingles, with a distance that never
   exceeds that of the sets) are compared once for each pair, and the sets of the rest are compared exactly.

Components need no full list of pairs, and a large group of near copies must not become all its pairs. So
leaders go first: a few groups of each crowded token, those of the least hashes, meet all others there, and each member
keeps two of the leaders that it may link with, the nearest by sketch and one more. What they join counts as one afterwards. Rounds of leaders
follow as long as the pairs that are left at crowded tokens outnumber the postings there by far and each round cuts them
down; other tokens have a bounded number of pairs for each posting. The last round looks at all group pairs between different
components, within size bands. Nothing is left out: a link
between two components is found there, and pairs inside a component can't change it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import FOLD, SPACES, Scratch, distinct, free_names, gram_hashes, mix, small, word_blocks
from quaver.llm.components import components

#: The count sketch has 2**BITS cells, sent in CHUNKS parts.
BITS, CHUNKS = 22, 64
#: Leaders of a crowded token in a round.
LEADERS = 12
#: Groups that make a token a crowded one.
CROWD = 16
#: 64-bit words of the odd sketch, a power of two.
SKETCH = 8


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow array."""
    for _, _, words, first, _ in word_blocks(texts, SPACES, FOLD):
        grams, _ = gram_hashes(words, first, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            n = b - a
            if n >= k:
                yield distinct(grams[a : b - k + 1])
            elif n:
                short = np.array([n], np.uint64)
                for w in words[a:b]:
                    short = mix(short * np.uint64(0x9E3779B97F4A7C15) + w)
                yield short
            else:
                yield np.zeros(0, np.uint64)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.uint32)  # a task has fewer than 2**32 shingles
        for batch in batches:
            for _, _, words, first, _ in word_blocks(batch.column("text"), SPACES, FOLD):
                grams, ok = gram_hashes(words, first, k)
                np.add.at(counts, _cell(grams[ok]), np.uint32(1))
        for c, part in enumerate(counts.reshape(CHUNKS, -1)):
            top = part.max()
            narrow = part.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "counts": pa.array([narrow.tobytes()], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(b, f"u{len(b) * CHUNKS >> BITS}")
            sums[c] = sums[c] + part if c in sums else part.astype(np.int64)
    if sums:
        ranks = [np.ceil(np.log2(s + 1.0)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "ranks": pa.array(ranks, pa.binary())})


def common_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """For each cell of the sketch, the rounded logarithm of its occurrences in all documents: 2**BITS bytes."""
    partial = docs.select("text").mapInArrow(_count(k), "chunk int, counts binary")
    summed = partial.repartition(min(CHUNKS, 12), "chunk").mapInArrow(_add_up, "chunk int, ranks binary")
    out = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint8)
    for r in summed.collect():  # CHUNKS rows of fixed size
        out[r["chunk"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def differences(n: int, percent: int) -> int:
    """In how many shingles a set of ``n`` can differ from one with which it reaches the threshold."""
    return (100 - percent) * n // percent


def _parts(n: int, percent: int) -> int:
    """Parts of a set of ``n`` shingles, a power of two, so that most of more sizes have as many."""
    return 1 << ((7 * differences(n, percent) + 20) // 5).bit_length()


def prefix_tokens(s: np.ndarray, m: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The tokens under which a set of shingles ``s`` is posted; ``m`` mixes them, ``rank`` is how common they are.

    A pair is looked for among the parts of its larger set's size, so a set has the parts of all sizes up to
    the largest that it can link with. Both have at most ``differences`` tokens that the other lacks, so of
    each order the first ones, one more than that, share one. If both sets have fewer tokens they share one of
    the first shingles.
    """
    size, out, few = len(s), [], percent <= 50
    need = differences(size, percent) + 1
    parts, last = _parts(size, percent), _parts(100 * size // percent, percent)
    mixed = mix(m)
    while percent > 50 and parts <= last:
        of = (m & np.uint64(parts - 1)).astype(np.int64)
        sums, low = np.zeros(parts, np.uint64), np.full(parts, 255, np.uint8)
        np.add.at(sums, of, mixed)
        np.minimum.at(low, of, rank)
        held = np.flatnonzero(np.bincount(of, minlength=parts))
        token = mix(sums[held] + np.uint64(parts))
        out.append(_first(token, low[held], token, need))
        few |= len(held) < need
        parts *= 2
    if few:
        # sharing no shingle among the first size - ceil(percent * size) + 1 makes the threshold unreachable
        out.append(_first(s, rank, m, size - -(-percent * size // 100) + 1))
    return np.concatenate(out)


def _first(values: np.ndarray, rank: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values by rank, and by ``tie`` among equal ones."""
    if n >= len(values):
        return values
    return values[np.argpartition((rank.astype(np.uint64) << np.uint64(56)) | (tie >> np.uint64(8)), n - 1)[:n]]


def _describe(k: int, percent: int, shared):
    """What is kept of each text; a task gives the prefix of a group once, and null for its other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, set()
        for batch in batches:
            n, fa, fb, g, prefixes = [], [], [], [], []
            sketch = np.zeros((batch.num_rows, SKETCH), np.int64)
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                size = len(s)
                n.append(size)
                m = mix(s)
                fa.append(_xor(m))
                fb.append(_sum(m))
                prefix = prefix_tokens(s, m, ranks[_cell(s)], percent) if size else s
                mixed = mix(prefix)
                shape = size, _xor(mixed), _sum(mixed)
                g.append(_number(*shape))
                prefixes.append(None if shape in seen or not size else prefix.view(np.int64))
                seen.add(shape)
                odd = np.bincount((m & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                sketch[i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
            columns = {"doc_id": batch.column("doc_id")}
            columns |= {c: pa.array(v, pa.int64()) for c, v in zip(("n", "fa", "fb", "g"), (n, fa, fb, g))}
            columns["prefix"] = pa.array(prefixes, pa.list_(pa.int64()))
            columns |= {f"s{j}": pa.array(sketch[:, j]) for j in range(SKETCH)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _xor(m: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(m, initial=0).astype(np.int64))


def _sum(m: np.ndarray) -> int:
    return int(m.sum(dtype=np.uint64).astype(np.int64))


def _number(*values: int) -> int:
    """A hash of 63 bits."""
    h = np.zeros(1, np.uint64)
    for v in values:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.array([v], np.int64).view(np.uint64))
    return int(h[0] >> np.uint64(1))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different rows (token, g, n) of tokens that have more than one, of rows in order."""
    columns = ("token", "g", "n")
    held, out = None, False  # the last row, and whether it was given out
    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows)]
        new = np.ones(len(rows[0]), bool)
        new[1:] = np.any([r[1:] != r[:-1] for r in rows], axis=0)
        rows = [r[new] for r in rows]
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        met = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        last = bool(met[-1]) if len(met) > 1 else out
        met[0] &= not out
        held, out = [r[-1:] for r in rows], last
        if met.any():
            yield pa.RecordBatch.from_pydict({c: pa.array(r[met]) for c, r in zip(columns, rows)})


def _full_sets(k: int, limit: int = 1 << 20):
    """(n, fa, fb, set) of each text, in batches of about ``limit`` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                held.append(s)
                size += len(s)
                if size > limit or i + 1 == batch.num_rows:
                    mixed = [mix(x) for x in held]
                    columns = {"n": [len(x) for x in held], "fa": [_xor(m) for m in mixed], "fb": [_sum(m) for m in mixed]}
                    columns = {c: pa.array(v, pa.int64()) for c, v in columns.items()}
                    yield pa.RecordBatch.from_pydict(columns | {"set": pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))})
                    held, size = [], 0

    return run


_SKETCHES = [f"s{j}" for j in range(SKETCH)]
_SET = ["n", "fa", "fb"]


def _sizes_meet(percent: int):
    return F.expr(f"100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)")


_DISTANCE = " + ".join(f"bit_count(x_{s} ^ y_{s})" for s in _SKETCHES)
#: The sketch folded to half its width, for postings: parities of twice as many shingles each.
_HALVES = [f"s{j} ^ s{j + SKETCH // 2} as t{j}" for j in range(SKETCH // 2)]
_HALF_DISTANCE = " + ".join(f"bit_count(x_t{j} ^ y_t{j})" for j in range(SKETCH // 2))


def _sketches_meet(percent: int, distance: str = _DISTANCE):
    # sets that reach the threshold differ in at most (1 - t) / (1 + t) of the sum of their sizes
    return F.expr(f"{100 + percent} * ({distance}) <= {100 - percent} * (x_n + y_n)")


def _sided(df: DataFrame, side: str, *same: str) -> DataFrame:
    return df.select(*(F.col(c) if c in same else F.col(c).alias(f"{side}_{c}") for c in df.columns))


class _Join:
    """The tables of one join and the steps over them."""

    def __init__(self, source: DataFrame, kind: str, k: int, percent: int):
        """``source``: doc_id of type ``kind``, and text."""
        spark = source.sparkSession
        self.source, self.k, self.percent, self.scratch = source, k, percent, Scratch(spark, "jaccard")
        table = self.scratch.table
        shared = spark.sparkContext.broadcast(common_ranks(source, k))
        schema = f"doc_id {kind}, n long, fa long, fb long, g long, prefix array<long>, " + ", ".join(f"{s} long" for s in _SKETCHES)
        whole = table(source.mapInArrow(_describe(k, percent, shared), schema), "whole")
        self.described = table(whole.select("doc_id", *_SET), "described")

        # equal sets are one node; node numbers are written once, so they never change
        first = [F.first(c).alias(c) for c in ("g", *_SKETCHES)]
        equal = whole.filter("n > 0").groupBy(*_SET).agg(F.min("doc_id").alias("low"), *first)
        self.nodes = table(equal.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.members = self.nodes.select("node", "g", "n", *_SKETCHES)

    def postings(self) -> DataFrame:
        """(token, g, n, c) of the prefix tokens that more than one group has."""
        each = self.scratch.read("whole").select(F.explode("prefix").alias("token"), "g", F.col("n").cast("int").alias("n"))
        dealt = each.repartition("token").sortWithinPartitions("token", "g", "n")
        met = self.scratch.table(dealt.mapInArrow(_met, "token long, g long, n int"), "met")
        self.drop("whole")
        shared = self.scratch.table(met.groupBy("token").agg(F.count("*").cast("int").alias("c")), "shared")
        post = self.scratch.table(met.join(shared, "token").select("token", "g", "n", "c"), "post")
        self.drop("met")
        return post

    def group_components(self) -> DataFrame:
        """(g, comp, mixed) of each group; a group whose members are of different components has a number of its own."""
        each = self.known.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        mixed = F.col("lo") < F.col("hi")
        return each.select("g", F.when(mixed, -1 - F.col("g")).otherwise(F.col("lo")).alias("comp"), mixed.alias("mixed"))

    def leader_pairs(self, post: DataFrame, of_groups: DataFrame, r: int) -> DataFrame:
        """Candidate (a, b) of nodes: each member with two of the leaders that it meets, the nearest one and that of the greatest hash."""
        picks = [F.min(F.struct(F.xxhash64(F.lit(r * LEADERS + j), "g").alias("h"), "g", "n", "comp")).alias(f"l{j}") for j in range(LEADERS)]
        columns = ["g", "n", "comp"]
        heads = post.groupBy("token").agg(*picks).select("token", F.explode(F.array(*(F.struct(*(F.col(f"l{j}.{c}") for c in columns)) for j in range(LEADERS)))).alias("l"))
        heads = heads.select("token", *(F.col(f"l.{c}").alias(f"x_{c}") for c in columns))
        met = heads.join(_sided(post, "y", "token"), [heads.token == post.token, F.col("x_comp") != F.col("y_comp"), _sizes_meet(self.percent)])
        own = of_groups.filter("mixed").select(F.col("g").alias("x_g"), F.col("g").alias("y_g"))
        pairs = self.scratch.table(met.select("x_g", "y_g").distinct().unionByName(own), f"groups-{r}")
        # a leader is one member of its group
        columns = ["node", "n", "comp", *_SKETCHES]
        one = self.known.groupBy("g").agg(F.min(F.struct(F.xxhash64(F.lit(r), "node").alias("h"), *columns)).alias("l")).select("g", *(f"l.{c}" for c in columns))
        left = pairs.join(_sided(one, "x"), "x_g").withColumnRenamed("y_g", "with_g")
        both = left.join(_sided(self.known, "y"), [F.col("with_g") == F.col("y_g"), F.col("x_comp") != F.col("y_comp"), _sketches_meet(self.percent)])
        by = F.struct(F.xxhash64(F.lit(r), "x_node").alias("h"), F.col("x_node").alias("a"))
        near = F.struct(F.expr(f"({_DISTANCE}) / (x_n + y_n)").alias("d"), *(by.getField(c).alias(c) for c in ("h", "a")))
        two = both.groupBy("y_node").agg(F.min(near).alias("lo"), F.max(by).alias("hi"))
        return two.select(F.explode(F.array_distinct(F.array("lo.a", "hi.a"))).alias("a"), F.col("y_node").alias("b"))

    def all_pairs(self, post: DataFrame, of_groups: DataFrame) -> DataFrame:
        """Candidate (a, b) of nodes of different components: all that tokens, sizes and sketches allow.

        At a crowded token, groups of one member also bring their sketches, so that pairs that can't link aren't made there.
        """
        lone = self.members.groupBy("g").agg(F.count("*").alias("m"), *(F.first(s).alias(s) for s in _SKETCHES)).filter("m = 1").selectExpr("g", *_HALVES)
        crowded = post.filter(F.col("c") > CROWD).join(lone, "g", "left")
        rest = post.filter(F.col("c") <= CROWD)
        post = self.scratch.table(crowded.unionByName(rest, allowMissingColumns=True).drop("c"), "sketched")
        # a little wider than the ratio of sizes, so that rounding can't move a pair over two borders
        band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / self.percent) * 1.0001)).cast("int") if self.percent < 100 else F.col("n")
        y = _sided(post.withColumn("band", band), "y", "token", "band")
        x = post.withColumn("band", F.explode(F.array(band, band + 1)))
        x = _sided(x, "x", "token", "band")
        order = F.expr("x_n < y_n or x_n = y_n and x_g < y_g") & (F.col("x_comp") != F.col("y_comp"))
        met = x.join(y, [x.token == y.token, x.band == y.band, order, _sizes_meet(self.percent), F.coalesce(_sketches_meet(self.percent, _HALF_DISTANCE), F.lit(True))])
        own = of_groups.filter("mixed").select(F.col("g").alias("x_g"), F.col("g").alias("y_g"))
        pairs = self.scratch.table(met.select("x_g", "y_g").distinct().unionByName(own), "groups-all")
        left = pairs.join(_sided(self.known, "x"), "x_g").withColumnRenamed("y_g", "with_g")
        once = F.expr("x_g <> y_g or x_node < y_node")
        both = left.join(_sided(self.known, "y"), [F.col("with_g") == F.col("y_g"), once, F.col("x_comp") != F.col("y_comp"), _sketches_meet(self.percent)])
        return both.select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))

    def sets(self, pairs: DataFrame, name: str) -> DataFrame:
        """(node, set) of all nodes of ``pairs``, which is written."""
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        ends = self.scratch.table(ends.join(self.nodes.select("node", "low", *_SET), "node").withColumn("h", F.xxhash64("low")), f"ends-{name}")
        asked = self.source.withColumn("h", F.xxhash64("doc_id")).join(small(ends.select("h").distinct(), 1_000_000), "h", "left_semi").select("text")
        made = asked.mapInArrow(_full_sets(self.k), "n long, fa long, fb long, set array<long>")
        # rows of equal id and text make a set more than once
        once = made.join(small(ends.select("node", *_SET), 200_000), _SET).groupBy("node").agg(F.first("set").alias("set"))
        return self.scratch.table(once, f"sets-{name}")

    def links(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs whose sets reach the threshold."""
        left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
        both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        shared = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i"), (F.size("sa") + F.size("sb")).cast("long").alias("u"))
        return self.scratch.table(shared.filter(f"100 * i >= {self.percent} * (u - i)").select("a", "b"), f"links-{name}")

    def look(self, comps: DataFrame, post: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int, int]:
        """Open postings with components, groups, and how many pairs and postings are open at crowded tokens."""
        # written, since a round reads it several times
        self.known = self.scratch.table(self.members.join(small(comps, 200_000), "node", "left").withColumn("comp", F.coalesce("comp", "node")), f"known-{name}")
        self.drop(f"known-{int(name) - 1}")
        of_groups = self.scratch.table(self.group_components(), f"of-groups-{name}")
        # written, since two tables are made of it
        of = self.scratch.table(post.drop("comp", "c").join(small(of_groups.select("g", "comp"), 200_000), "g"), f"labelled-{name}")
        # a token whose holders are one component has nothing more to tell
        each = of.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
        each = each.agg(F.count("*").alias("comps"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("inside")).filter("comps > 1")
        open_ = self.scratch.table(each.select("token", "c", (F.col("c") * F.col("c") - F.col("inside")).alias("pairs")), f"tokens-{name}")
        post = self.scratch.table(of.join(open_.select("token", F.col("c").cast("int").alias("c")), "token").select("token", "g", "n", "c", "comp"), f"open-{name}")
        sums = open_.filter(F.col("c") > CROWD).agg(F.sum("pairs").alias("pairs"), F.sum("c").alias("rows")).first()
        self.drop(f"tokens-{name}", f"labelled-{name}", "shared", "post", f"open-{int(name) - 1}", "of-groups", f"of-groups-{int(name) - 1}")
        return post, of_groups, sums["pairs"] or 0, sums["rows"] or 0

    def first_look(self) -> tuple[DataFrame, DataFrame, int, int]:
        """The same before anything is joined: every node is a component, every group has a number of its own."""
        post = self.postings().withColumn("comp", -1 - F.col("g"))
        sums = self.scratch.read("shared").filter(F.col("c") > CROWD).agg(F.sum(F.col("c").cast("long") * (F.col("c") - 1)).alias("pairs"), F.sum("c").alias("rows")).first()
        of_groups = self.scratch.table(self.members.groupBy("g").agg(F.count("*").alias("m")).select("g", (F.col("m") > 1).alias("mixed")), "of-groups")
        self.known = self.members.withColumn("comp", F.col("node"))
        return post, of_groups, sums["pairs"] or 0, sums["rows"] or 0

    def merged(self, comps: DataFrame | None, pairs: DataFrame, name: str) -> DataFrame:
        """The components after the links among ``pairs``."""
        pairs = self.scratch.table(pairs, f"pairs-{name}")
        found = self.links(pairs, self.sets(pairs, name), name)
        if comps is not None:
            found = found.unionByName(comps.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")))
        out = components(found, self.scratch, f"components-{name}")
        # the components are written, so nothing reads what led to them any more
        self.drop(*(f"{t}-{name}" for t in ("pairs", "ends", "sets", "links", "groups")), "sketched")
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self.scratch.drop(name)

    def own_pairs(self) -> tuple[int, int]:
        """How many pairs of different components groups hold inside of them, and how many members those groups have."""
        each = self.known.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g")
        each = each.agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("inside")).filter("c * c > inside")
        sums = each.agg(F.sum(F.col("c") * F.col("c") - F.col("inside")).alias("pairs"), F.sum("c").alias("rows")).first()
        return sums["pairs"] or 0, sums["rows"] or 0

    def components(self) -> DataFrame:
        """(node, comp) of the nodes with links.

        Leaders have another round while the pairs left, of groups that share crowded tokens or inside of groups, are many for
        their rows and the last round has cut them by a tenth.
        """
        (post, of_groups, *between), comps, r = self.first_look(), None, 0
        inside, before = self.own_pairs(), (math.inf, math.inf)
        while True:
            met, own = (pairs > 8 * rows and pairs <= 0.9 * last for (pairs, rows), last in zip((between, inside), before))
            if not met and not own:
                return self.merged(comps, self.all_pairs(post, of_groups), "all")
            comps = self.merged(comps, self.leader_pairs(post.filter(F.col("c") > CROWD) if met else post.filter("false"), of_groups, r), str(r))
            before, r = (between[0], inside[0]), r + 1
            post, of_groups, *between = self.look(comps, post, str(r))
            inside = self.own_pairs()


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id that links lead to.

    Rows link if 100 * shared >= percent * (all shingles of both). Shingles are ``k`` consecutive words
    (lower-cased A-Z, split at white space), or all words of a shorter text; a text without words is empty, has no
    shingles and links with nothing, and so does a null. Rows of equal id are rows of their own; a null id
    never names a component unless all its rows have none. Other columns are ignored, whatever their names.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    join = _Join(source, docs.schema[id_col].dataType.simpleString(), k, percent)
    comps = join.components()
    known = join.nodes.select("node", "low", *_SET)
    known = known.join(small(comps, 200_000), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = join.scratch.table(known.join(lowest, "comp").select(*_SET, "component_id"), "named")
    join.scratch.keep("described", "named")
    # a set can be that of a third of all rows: plain exchanges, which AQE can split
    out = join.described.select("doc_id", *_SET).join(small(named, 200_000), _SET, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every component, that of the least id (of equal ids, the first row; null ids come last); all columns stay.

    Rows without words all stay. Where ids repeat or are null, the rows are written once with their places, so that a place names the same row
    in every pass; else the ids do, and no copy is made.
    """
    ids = docs.select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("c"))
    if not ids.filter("c > 1 or id is null").limit(1).count():
        comps = jaccard_components(docs, k, percent, id_col, text_col)
        gone = Scratch(docs.sparkSession, "kept").table(comps.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), "gone")
        # those that go are few, so whole rows mostly needn't be shuffled
        return docs.join(small(gone, 500_000), id_col, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    at, as_ = free_names(docs, "place", "key")
    scratch = Scratch(docs.sparkSession, "kept")
    placed = scratch.table(docs.withColumn(at, F.monotonically_increasing_id()), "placed")
    keyed = placed.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(at).alias("place")).alias(as_), text_col)
    comps = jaccard_components(keyed, k, percent, as_, text_col)
    gone = scratch.table(comps.filter("doc_id.place <> component_id.place").select(F.col("doc_id.place").alias(at)), "gone")
    return placed.join(small(gone, 500_000), at, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
