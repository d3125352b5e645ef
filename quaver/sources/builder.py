"""Building a release from inputs of different orders, with proofs of what may not have changed.

The selection says which ids the release has and in which order. Tracks, rights and vectors come in orders of their own
and are aligned by id. The first vectors of the source must be the frozen parent's, bit for bit; every other vector
needs provenance that names its audio and its own digest. ``build_problems`` lists every breach; a release is only
written if there is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions.digests import vector_sha256
from quaver.scratch import scratch_table
from quaver.sources import release
from quaver.sources.binary import dense_rows

PARTS = ("selection", "tracks", "rights", "vectors", "parent", "provenance", "removed")


def digested(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The inputs with the digests of source and parent vectors, written once for all proofs.

    selection (pos, id); tracks and rights (id, ...; tracks with audio_sha256); vectors and parent (row, id, embedding);
    provenance (id, audio_sha256, vector_sha256); removed (id).
    """
    if set(inputs) != set(PARTS):
        raise ValueError(f"A build takes {', '.join(PARTS)}")
    out = dict(inputs)
    for name in ("vectors", "parent"):
        out[name] = scratch_table(inputs[name].select("row", "id", "embedding", vector_sha256(F.col("embedding")).alias("sha256")), name)
    return out


def build_problems(inputs: dict[str, DataFrame]) -> DataFrame:
    """(problem, id) of digested inputs; empty if a release may be built."""
    found = []

    def note(problem: str, df: DataFrame) -> None:
        found.append(df.select(F.lit(problem).alias("problem"), "id"))

    for name in PARTS:
        note(f"repeated id in {name}", inputs[name].groupBy("id").count().filter("count > 1"))
    wanted = inputs["selection"].join(inputs["removed"], "id", "left_anti").select("id").distinct()
    for name in ("tracks", "rights", "vectors"):
        note(f"not in {name}", wanted.join(inputs[name].select("id"), "id", "left_anti"))
    parent, vectors = inputs["parent"], inputs["vectors"]
    same = vectors.select("row", F.col("id").alias("own"), F.col("sha256").alias("own_sha"))
    note("parent prefix differs", parent.join(same, "row", "left").filter("not (own <=> id and own_sha <=> sha256)"))
    new = wanted.join(parent.select("id"), "id", "left_anti").join(vectors.select("id", "sha256"), "id")
    told = inputs["provenance"].select("id", F.col("audio_sha256").alias("told_audio"), F.col("vector_sha256").alias("told_vector"), F.lit(True).alias("told"))
    new = new.join(told, "id", "left").join(inputs["tracks"].select("id", "audio_sha256"), "id", "left")
    note("no provenance", new.filter("told is null"))
    note("vector differs from its provenance", new.filter("told and not told_vector <=> sha256"))
    note("audio differs from its provenance", new.filter("told and not told_audio <=> audio_sha256"))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def aligned(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The release's tables: tracks, rights and vectors by ``row``, and each row's provenance with its place in the source."""
    kept = inputs["selection"].join(inputs["removed"], "id", "left_anti")
    order = scratch_table(dense_rows(kept.select("pos", "id"), "pos").select("row", "id"), "order")
    origin = inputs["parent"].select("id", F.lit("parent").alias("origin"))
    own = order.join(inputs["vectors"].select(F.col("row").alias("source_row"), "id", "embedding", F.col("sha256").alias("vector_sha256")), "id")
    own = scratch_table(own, "aligned")
    provenance = own.select("row", "id", "source_row", "vector_sha256").join(origin, "id", "left").withColumn("origin", F.coalesce("origin", F.lit("new")))
    return {
        "tracks": order.join(inputs["tracks"], "id"),
        "rights": order.join(inputs["rights"], "id"),
        "vectors": own.select("row", "id", "embedding"),
        "provenance": provenance.select("row", "id", "origin", "source_row", "vector_sha256"),
    }


def build(inputs: dict[str, DataFrame], path: str, release_id: str) -> str:
    """Write the release and return its manifest's digest; raises with the first problems if there are any."""
    inputs = digested(inputs)
    problems = scratch_table(build_problems(inputs), "problems")
    first = problems.orderBy("problem", "id").limit(3).collect()
    if first:
        raise ValueError("; ".join(f"{r.problem}: {r.id}" for r in first))
    return release.write_release(aligned(inputs), path, release_id)


def inputs_of(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The inputs that rebuild a release: its rows as the selection, and its vectors in the order of their source.

    Source rows that the release doesn't hold leave no gap. The parent is the longest run of parent rows at the start.
    """
    order = dense_rows(tables["provenance"].select("id", "source_row", "origin", "vector_sha256"), "source_row")
    order = scratch_table(order.select("row", "id", "origin", "vector_sha256"), "source-order")
    vectors = order.join(tables["vectors"].select("id", "embedding"), "id")
    parent = vectors.filter("origin = 'parent'").select("row", "id", "embedding")
    audio = tables["tracks"].select("id", "audio_sha256")
    return {
        "selection": tables["tracks"].select(F.col("row").alias("pos"), "id"),
        "tracks": tables["tracks"].drop("row"),
        "rights": tables["rights"].drop("row"),
        "vectors": vectors.select("row", "id", "embedding"),
        "parent": parent,
        "provenance": order.filter("origin = 'new'").join(audio, "id").select("id", "audio_sha256", "vector_sha256"),
        "removed": tables["tracks"].limit(0).select("id"),
    }
