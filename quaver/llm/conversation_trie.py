"""The prefix tree of conversations, found by binary search over prefix digests.

Every conversation is a path of turns from a root without text. A node is a distinct sequence of first turns;
its owner is the smallest conversation that starts with it. A conversation that owns a node owns every deeper
one on its path, so its first owned depth is found by binary search: each round asks, for all open
conversations at once, who the smallest member at the middle depth is (a join with the digests' minima). What a
conversation owns is a chain of nodes; the chain hangs below the node where the search saw another owner last.
Totals of subtrees are summed along chains from their ends, and over chains by doubling the distance to the
chain above, so the number of rounds grows with the logarithm of depth.

Digests are sums of position-dependent hashes (128 bits), so that they come from running sums over
ranged partitions: one very long conversation spreads over many tasks. Texts are read once and never shuffled
beyond the first 64 characters, which order turns of equal number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import Scratch, small

#: Rows of a table that is broadcast: at most 32 bytes each, 16 MB.
BROADCAST_ROWS = 500_000
#: Bytes of ids that are joined in one row before the rows of a group meet; a batch of 10,000 rows stays under 160 MB.
CHUNK = 16_384

NONE_SHA256 = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- running sums


def _running(key: str, sums: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(key).to_numpy()
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts = np.diff(np.append(first, n))
            out = dict(zip(batch.schema.names, batch.columns))
            for name in sums:
                total = np.cumsum(batch.column(name).to_numpy())
                base = np.append(0, total)[first]
                if keys[0] == last:
                    base[0] -= carry[name]
                total -= np.repeat(base, counts)
                carry[name] = total[-1]
                out[name] = pa.array(total)
            last = keys[-1]
            yield pa.RecordBatch.from_pydict(out | {"pid": pa.array(np.full(n, pid, np.int64))})

    return run


def running_sums(df: DataFrame, key: str, order: list[Column], sums: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with its long columns ``sums`` (not negative) replaced by their sums up to each row of equal ``key``.

    Rows are ranged by key and order, so a key of any size spreads over tasks. Only the keys at the borders of the
    ranges, two for each at most, need the totals of earlier ranges.
    """
    columns = df.columns
    ranges = [F.col(key), *order]
    rows = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges).select(*columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    ranged = scratch.table(rows.mapInArrow(_running(key, sums), f"{schema}, pid long"), f"{name}-ranged")
    ends = ranged.groupBy("pid").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    border = ends.select(F.explode(F.array("lo", "hi")).alias(key)).groupBy(key).count().filter("count > 1").select(key)
    totals = ranged.join(F.broadcast(border), key, "left_semi").groupBy("pid", key).agg(*(F.max(s).alias(s) for s in sums))
    before = Window.partitionBy(key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    # two rows for each range at most
    earlier = totals.select("pid", key, *(F.sum(s).over(before).alias(f"__{s}") for s in sums))
    placed = ranged.join(F.broadcast(earlier), ["pid", key], "left")
    return placed.select(*((F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) if c in sums else F.col(c) for c in columns))


# ---------------------------------------------------------------- turns


def ordered_turns(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, at, a, b, words): each turn's place from 0, two hashes of role and text, and the words of the text.

    Ordered by turn, null first; turns of equal number by role, the first 64 characters of the text, then its hash;
    equal rows follow each other. Null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("start"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), role, text).alias("b"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("at"),
        F.monotonically_increasing_id().alias("seq"),
    )
    # of equal rows any may come first; the row's place only keeps them from meeting in one range
    order = [F.col(c) for c in ("turn", "role", "start", "a", "b", "seq")]
    counted = running_sums(rows, "conv_id", order, ["at"], scratch, "turns")
    done = scratch.table(counted.select("conv_id", (F.col("at") - 1).alias("at"), "a", "b", "words"), "turns")
    scratch.drop("turns-ranged")
    return done


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations whose first ``head`` (0 to ``most``) turns are replaced by those of ``base``.

    ``base`` and ``head`` are expressions of conv_id. A base with fewer turns gives all it has, an absent one none.
    """
    convs = turns.groupBy("conv_id").agg((F.max("at") + 1).alias("n")).select("conv_id", "n", base.alias("base"), head.alias("h"))
    heads = turns.filter(F.col("at") < most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "words"))).alias("head"))
    other = convs.filter("conv_id <> base").join(heads, "base", "left")
    other = scratch.table(other.withColumn("head", F.expr("if(head is null, array(), slice(head, 1, h))")), "heads")
    short = other.filter("size(head) < h").select("conv_id", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.withColumn("base", base).withColumn("h", head).filter("conv_id = base or at >= h")
    own = own.join(small(short, BROADCAST_ROWS), "conv_id", "left").select("conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "a", "b", "words")
    given = other.select("conv_id", F.inline("head")).select("conv_id", "at", "a", "b", "words")
    lengths = other.select("conv_id", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("n"))
    lengths = lengths.unionByName(convs.filter("conv_id = base").select("conv_id", "n"))
    return own.unionByName(given), scratch.table(lengths, "lengths")


# ---------------------------------------------------------------- the tree


def _prefixes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, d1, d2, words): the digest of each conversation's first ``depth`` turns, from 1 on."""
    m, n = F.xxhash64("at", "a", "b"), F.xxhash64(F.lit(1), F.col("b"), F.col("at"), F.col("a"))
    halves = {"s1": m, "s2": m, "s3": n, "s4": n}
    low = F.lit(0xFFFFFFFF)
    cut = {k: v.bitwiseAND(low) if k in ("s1", "s3") else F.shiftrightunsigned(v, 32) for k, v in halves.items()}
    rows = turns.select("conv_id", (F.col("at") + 1).alias("depth"), "words", *(v.alias(k) for k, v in cut.items()))
    summed = running_sums(rows, "conv_id", [F.col("depth")], list(cut), scratch, "prefixes")
    digests = summed.select("conv_id", "depth", F.xxhash64(*cut).alias("d1"), F.xxhash64(F.lit(1), *(F.col(c) for c in reversed(cut))).alias("d2"), "words")
    done = scratch.table(digests, "prefixes")
    scratch.drop("prefixes-ranged")
    return done


def first_owned(lengths: DataFrame, prefixes: DataFrame, minima: DataFrame, root: int, scratch: Scratch) -> DataFrame:
    """(conv_id, n, first, up) of every conversation: its first owned depth and the owner of the node above.

    ``first`` is n + 1 for one that owns nothing, and 0 for ``root``, the smallest. ``minima`` (depth, d1, d2, owner)
    holds the nodes of two or more members; any other node is its member's own.
    """
    start = F.when(F.col("conv_id") == root, 0)
    step = lengths.select("conv_id", "n", F.coalesce(start, F.lit(1)).cast("long").alias("lo"), F.coalesce(start, F.col("n") + 1).cast("long").alias("hi"), F.lit(root).cast("long").alias("up"))
    shared, ended, k = small(minima, BROADCAST_ROWS), [], 0
    while True:
        ended.append(step.filter("lo = hi"))
        open_ = step.filter("lo < hi")
        if not open_.limit(1).count():
            break
        asked = small(open_.withColumn("depth", F.expr("(lo + hi) div 2")), BROADCAST_ROWS)
        seen = prefixes.select("conv_id", "depth", "d1", "d2").join(asked, ["conv_id", "depth"]).join(shared, ["depth", "d1", "d2"], "left")
        own = F.expr("owner is null or owner = conv_id")
        step = scratch.table(
            seen.select("conv_id", "n", F.when(own, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(own, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(own, F.col("up")).otherwise(F.col("owner")).alias("up")),
            f"search-{k}",
        )
        k += 1
    out = ended[0]
    for df in ended[1:]:
        out = out.unionByName(df)
    done = scratch.table(out.select("conv_id", "n", F.col("lo").alias("first"), "up"), "chains")
    for i in range(k):
        scratch.drop(f"search-{i}")
    return done


def _chain_totals(totals: DataFrame, ups: DataFrame, root: int, sums: list[str], scratch: Scratch) -> DataFrame:
    """Sums over each chain and all chains below it; ``ups`` (conv_id, up) names the chain above, ``totals`` a chain's own sums.

    In round k a chain adds what it has from chains nearer than 2^k to the chain 2^k above it.
    """
    k = 0
    while True:
        below = ups.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
        totals = scratch.table(totals.join(below, "conv_id", "left").select("conv_id", *((F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0))).alias(s) for s in sums)), f"totals-{k}")
        far = ups.filter(F.col("up") != root)
        if not far.limit(1).count():
            return totals
        above = ups.select(F.col("conv_id").alias("up"), F.col("up").alias("top"))
        ups = scratch.table(far.join(small(above, BROADCAST_ROWS), "up").select("conv_id", F.col("top").alias("up")), f"ups-{k}")
        k += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "member"))))
        out = []
        for (conv, depth), group in groupby(rows, lambda r: r[:2]):
            ids = [r[2] for r in group]
            for i in range(0, len(ids), CHUNK // 21):  # an id and its comma take 21 bytes at most
                part = ids[i : i + CHUNK // 21]
                out.append((conv, depth, part[0], ",".join(map(str, part))))
        if out:
            conv, depth, first, text = zip(*out)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "member": pa.array(first, pa.int64()), "ids": pa.array(text, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key, digest):
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([key[0]], pa.int64()), "depth": pa.array([key[1]], pa.int64()), "ends_sha256": [digest.hexdigest()]})

    held, digest = None, None
    for batch in batches:
        conv, depth, text, done = [], [], [], []
        for c, d, ids in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "depth", "ids"))):
            if held == (c, d):
                digest.update(b"," + ids.encode())
                continue
            if held is not None:
                conv.append(held[0]), depth.append(held[1]), done.append(digest.hexdigest())
            held, digest = (c, d), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": done})
    if held is not None:
        yield row(held, digest)


def ends_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of each node's ``member`` ids, ascending and joined by commas.

    Ranges turn ids into rows of up to 16 KB, in order; a group's rows are then hashed as a stream, with one
    digest's state in memory.
    """
    key = ["conv_id", "depth"]
    chunks = ends.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member").mapInArrow(_chunks, "conv_id long, depth long, member long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "member").mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_tree(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each node of the prefix tree of ``turns`` (conv_id, at, a, b, words; ``at`` from 0 without gaps).

    ``lengths`` (conv_id, n) lists every conversation, turnless ones too. A node is (conv_id, depth), its smallest
    member and its number of turns. n_leaves and saved_tokens are summed over the node's subtree; ends_sha256 is of
    the members that end at the node. No conversations give no nodes.
    """
    spark = turns.sparkSession
    root = lengths.agg(F.min("conv_id")).first()[0]
    if root is None:
        return spark.createDataFrame([], NODES)
    prefixes = _prefixes(turns, scratch)
    groups = prefixes.groupBy("depth", "d1", "d2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    groups = scratch.table(groups, "groups")
    chains = first_owned(lengths, prefixes, groups.filter("n_convs > 1").select("depth", "d1", "d2", "owner"), root, scratch)

    below = chains.filter(F.col("first").between(1, F.col("n")))  # chains that hang below another's node
    kids = below.groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("kids"))
    all_ = lengths.agg(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    nodes = groups.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words").unionByName(all_)
    nodes = nodes.join(chains, "conv_id").join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + F.expr("if(depth < n, 1L, 0L)"))
    nodes = scratch.table(
        nodes.select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.expr("if(n_children = 0, 1L, 0L)").alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "nodes",
    )

    sums = ["leaves", "saved"]
    own = nodes.groupBy("conv_id").agg(*(F.sum(s).alias(s) for s in sums))
    totals = _chain_totals(own, below.select("conv_id", "up"), root, sums, scratch)
    hung = below.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    whole = nodes.join(hung, ["conv_id", "depth"], "left").select(
        *(c for c in nodes.columns if c not in sums), *((F.col(s) + F.coalesce(F.col(f"__{s}"), F.lit(0))).alias(s) for s in sums)
    )
    whole = running_sums(whole, "conv_id", [F.col("depth").desc()], sums, scratch, "subtrees")

    ends = chains.select(F.when(F.col("first") <= F.col("n"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n").alias("depth"), F.col("conv_id").alias("member"))
    ends = scratch.table(ends_digests(ends), "ends")
    out = whole.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE_SHA256)).alias("ends_sha256")
    )
    out = scratch.table(out, "tree")
    scratch.keep("tree")
    return out


def conversation_trie(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """The prefix tree of conversations whose first turns are taken from the first conversation of their block.

    Conversation c is rebuilt from the first crc32(decimal c) % ``most`` turns of conversation c - c % ``block``,
    then its own turns after as many. See ``ordered_turns`` for nulls, ties and repeated rows and ``prefix_tree`` for
    the columns. Texts may be empty or of any length; other columns are ignored; an empty table gives no nodes.
    """
    scratch = Scratch(conversations.sparkSession, "conversations")
    c = F.col("conv_id")
    turns = ordered_turns(conversations, scratch)
    turns, lengths = rebuilt(turns, c - c % block, (F.crc32(c.cast("string").cast("binary")) % most).cast("int"), most - 1, scratch)
    return prefix_tree(turns, lengths, scratch)


def query(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH RECURSIVE steps(n, k, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
    dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS u, len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS b, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a // 256, crc.t[xor(a, b) % 256 + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc
),
r AS (
  SELECT c.conv_id, 0 AS own, i, u, w FROM c JOIN t ON t.conv_id = c.b WHERE i <= h
  UNION ALL SELECT c.conv_id, 1, i, u, w FROM c JOIN t ON t.conv_id = c.conv_id WHERE i > h
),
l AS (
  SELECT c.conv_id, coalesce(us, []) AS us, coalesce(ws, []) AS ws FROM c
  LEFT JOIN (SELECT conv_id, list(u ORDER BY own, i) AS us, list(w ORDER BY own, i) AS ws FROM r GROUP BY conv_id) USING (conv_id)
),
p AS (SELECT conv_id, d, us[1:d] AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, len(us) = d AS at_end FROM l, unnest(range(0, len(us) + 1)) x(d)),
n AS (
  SELECT k, d, min(conv_id) AS o, count(*) AS n, (count(*) - 1) * max(w) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends FROM p GROUP BY k, d
),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (k)),
s AS (SELECT k[1:e] AS k, sum((kids = 0)::BIGINT) AS leaves, sum(saved) AS saved FROM f, unnest(range(0, d + 1)) x(e) GROUP BY 1)
SELECT f.o AS conv_id, f.d AS depth, a.o AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN n a ON f.d > 0 AND a.d = f.d - 1 AND a.k = f.k[1:f.d - 1]
"""
