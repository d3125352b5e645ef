"""Releases of JSON documents: reading, checking, converting to tables, and writing the documents back byte for byte.

A release is a folder of ``release.json`` and the files that it pins: catalog.json (a header and ``tracks``), ids.json (their ids in
order), rights.json (a header and ``tracks``), index.json (a header and ``links``: node, layer, neighbours), vectors.f32. A document is one
text, so one task parses it; its elements go on as rows, and no document passes the driver but the small
``release.json`` and the headers. Elements keep their exact text, so the documents can be written back with equal digests.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions.digests import ordered_document, vector_bytes
from quaver.functions.vectors import is_unit
from quaver.operators import graph
from quaver.operators.lookup import trigrams, with_folds
from quaver.scratch import scratch_table
from quaver.sources import binary, release

# The files of a release and the member that holds their rows.
FILES = {"catalog": ("catalog.json", "tracks"), "ids": ("ids.json", None), "rights": ("rights.json", "tracks"), "index": ("index.json", "links"), "vectors": ("vectors.f32", None)}
KIND = "catalog-release"


def file_pins(spark: SparkSession, paths: dict[str, str]) -> dict[str, dict]:
    """{name: {bytes, sha256}} of files of any size, each hashed as a stream by a task; an absent file has no entry."""

    def run(batches):
        for b in batches:
            for name, path in zip(b.column("name").to_pylist(), b.column("path").to_pylist()):
                store, root = binary._open(path)
                try:
                    stream = store.open_input_stream(root, compression=None)
                except FileNotFoundError:
                    continue
                digest, size = hashlib.sha256(), 0
                with stream as f:
                    while body := f.read(1 << 20):
                        digest.update(body)
                        size += len(body)
                yield pa.RecordBatch.from_pydict({"name": [name], "bytes": pa.array([size], pa.int64()), "sha256": [digest.hexdigest()]})

    files = spark.createDataFrame(list(paths.items()), "name string, path string").repartition("name")
    return {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in files.mapInArrow(run, "name string, bytes long, sha256 string").collect()}  # one row for each file


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _around(header: dict, member: str | None) -> tuple[str, str]:
    """What stands before and after the elements of a document; its member of elements comes last."""
    if member is None:
        return "[", "]"
    head = compact(header)[:-1]
    return f'{head}{"," if header else ""}"{member}":[', "]}"


def write_documents(tables: dict[str, DataFrame], headers: dict[str, dict], path: str) -> dict[str, dict]:
    """Write the documents of tables and return their pins.

    ``tables``: tracks and rights (row, id, body: an element's JSON text), layers (src, level, neighbors); ``headers`` of catalog,
    rights and index.
    """
    spark, pins = tables["tracks"].sparkSession, {}

    def put(name: str, df: DataFrame, text, order: list[str]) -> None:
        file, member = FILES[name]
        start, end = _around(headers.get(name, {}), member)
        sha, size = ordered_document(df, text, order, start, ",", end, f"{path}/{file}")
        pins[name] = {"path": file, "bytes": size, "sha256": sha}

    put("catalog", tables["tracks"], F.col("body"), ["row"])
    put("ids", tables["tracks"], F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), ["row"])
    put("rights", tables["rights"], F.col("body"), ["row"])
    layer = F.concat(F.lit("["), F.array_join(F.col("neighbors").cast("array<string>"), ","), F.lit("]"))
    # a node's layers are few: its highest level bounds them
    nodes = tables["layers"].select("src", F.struct("level", layer.alias("text")).alias("l")).groupBy("src").agg(F.array_sort(F.collect_list("l")).alias("l"))
    put("index", nodes, F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["text"]), ","), F.lit("]")), ["src"])
    sha, size = ordered_document(tables["vectors"], vector_bytes(F.col("embedding")), ["row"], "", "", "", f"{path}/{FILES['vectors'][0]}")
    pins["vectors"] = {"path": FILES["vectors"][0], "bytes": size, "sha256": sha}
    return pins


def write_json_release(tables: dict[str, DataFrame], headers: dict[str, dict], path: str) -> str:
    """Write a release of documents; returns the digest of its ``release.json``."""
    spark = tables["tracks"].sparkSession
    pins = write_documents(tables, headers, path)
    body = compact({"schemaVersion": 1, "kind": KIND, "catalogId": headers["catalog"]["id"], "count": headers["index"]["count"], "dimensions": headers["catalog"]["dimensions"], "assets": pins})
    store, root = binary._open(f"{path}/release.json")
    with store.open_output_stream(root) as out:
        out.write(body.encode())
    return hashlib.sha256(body.encode()).hexdigest()


# ---------------------------------------------------------------- reading


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _scan(member: str | None):
    """(key, row, body) of a document: its other fields by key, and the elements of ``member`` (or of an array) by row, as exact text."""

    def elements(text: str, at: int):
        decode, skip = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n]*").match
        at = skip(text, at + 1).end()
        while text[at] != "]":
            _, end = decode(text, at)
            yield text[at:end], end
            at = skip(text, end).end()
            at = skip(text, at + 1).end() if text[at] == "," else at
        yield None, at + 1

    def fields(text: str):
        decode, skip = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n]*").match
        at = skip(text, 0).end()
        if member is None:
            yield from ((None, body) for body, _ in elements(text, at) if body is not None)
            return
        at = skip(text, at + 1).end()
        while text[at] != "}":
            key, end = decode(text, at)
            at = skip(text, skip(text, end).end() + 1).end()
            if key == member and text[at] == "[":
                for body, end in elements(text, at):
                    if body is not None:
                        yield None, body
            else:
                _, end = decode(text, at)
                yield key, text[at:end]
            at = skip(text, end).end()
            at = skip(text, at + 1).end() if text[at] == "," else at

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                n, held = 0, []
                for key, body in fields(text):
                    held.append((key, None if key is not None else n, body))
                    n += key is None
                    if len(held) == 1000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    def batch(rows):
        key, row, body = zip(*rows)
        return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "row": pa.array(row, pa.int64()), "body": pa.array(body, pa.string())})

    return run


def _scanned(spark: SparkSession, path: str, member: str | None) -> tuple[DataFrame, dict]:
    """((row, body) of a document's elements, its other fields)."""
    found = scratch_table(_document(spark, path).mapInArrow(_scan(member), "key string, row long, body string"), "document")
    header = {r["key"]: json.loads(r["body"]) for r in found.filter("key is not null").collect()}  # a document's own fields are few
    return found.filter("key is null").select("row", "body"), header


def read_release(spark: SparkSession, path: str, expected_sha256: str) -> tuple[dict[str, DataFrame], dict[str, dict], dict]:
    """(tables, headers, manifest) of a release with the expected digest whose files match their pins; not checked further."""
    text = _document(spark, f"{path}/release.json").first()[0]
    if hashlib.sha256(text.encode()).hexdigest() != expected_sha256:
        raise ValueError("The manifest is not the expected one")
    manifest = json.loads(text)
    if not isinstance(manifest, dict) or set(manifest) != {"schemaVersion", "kind", "catalogId", "count", "dimensions", "assets"} or manifest["schemaVersion"] != 1 or manifest["kind"] != KIND or set(manifest["assets"]) != set(FILES):
        raise ValueError("Unknown manifest")
    have = file_pins(spark, {name: f"{path}/{file}" for name, (file, _) in FILES.items()})
    for name, (file, _) in FILES.items():
        if manifest["assets"][name] != {"path": file, **have.get(name, {})}:
            raise ValueError(f"{file} differs from its pin")
    scans = {name: _scanned(spark, f"{path}/{file}", member) for name, (file, member) in FILES.items() if name != "vectors"}
    headers = {name: scans[name][1] for name in ("catalog", "rights", "index")}
    fields = "id string, title string, artist string, album string, genre string, license string"
    tracks = scans["catalog"][0].withColumn("t", F.from_json("body", fields)).select("row", "t.*", "body")
    rights = scans["rights"][0].select("row", F.get_json_object("body", "$.id").alias("id"), "body")
    ids = scans["ids"][0].select("row", F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<string>")[0].alias("id"))
    nodes = scans["index"][0].select(F.col("row").alias("src"), F.from_json("body", "array<array<bigint>>").alias("own"))
    layers = nodes.select("src", F.posexplode("own").alias("level", "neighbors"))
    tables = {"tracks": tracks, "rights": rights, "ids": ids, "layers": layers}
    tables = {name: scratch_table(df, name) for name, df in tables.items()}
    tables["vectors"] = binary.read_matrix(spark, f"{path}/vectors.f32", int(manifest["dimensions"]))
    return tables, headers, manifest


def release_problems(tables: dict[str, DataFrame], headers: dict[str, dict], manifest: dict) -> list[str]:
    """What a release breaks: counts, ids and their order, rights, unit vectors, links, and whether layer 0 reaches every row."""
    n, out = manifest["count"], []
    catalog, index = headers["catalog"], headers["index"]
    if catalog.get("id") != manifest["catalogId"] or headers["rights"].get("catalogId") != manifest["catalogId"] or catalog.get("dimensions") != manifest["dimensions"]:
        out.append("headers of another catalog")
    for name in ("tracks", "ids", "rights", "vectors"):
        if tables[name].count() != n:
            out.append(f"count of {name}")
    if tables["ids"].filter("id is null").limit(1).count() or tables["ids"].select("id").distinct().count() != n:
        out.append("repeated or null ids")
    for name in ("tracks", "rights"):
        own = tables[name].select("row", F.col("id").alias("own"))
        if tables["ids"].join(own, "row", "full_outer").filter("not id <=> own").limit(1).count():
            out.append(f"order of {name}")
    if tables["vectors"].filter(~F.coalesce(is_unit(F.col("embedding")), F.lit(False))).limit(1).count():
        out.append("vectors that aren't unit")
    layers = tables["layers"]
    tops = layers.groupBy("src").agg(F.max("level").alias("top"))
    top = {r["src"]: r["top"] for r in tops.filter(F.col("src") == index.get("entry", -1)).collect()}
    if tops.count() != n or tops.filter(F.col("top") > index.get("maxLevel", -1)).limit(1).count() or top.get(index.get("entry")) != index.get("maxLevel"):
        out.append("layers of nodes")
    edges = layers.select("src", "level", F.posexplode("neighbors").alias("pos", "dst"))
    of = edges.join(tops.select(F.col("src").alias("dst"), F.col("top").alias("has")), "dst", "left")
    if of.filter("has is null or has < level or dst = src").limit(1).count() or edges.groupBy("src", "level", "dst").count().filter("count > 1").limit(1).count():
        out.append("links")
    if layers.filter(F.size("neighbors") > F.when(F.col("level") == 0, 2 * index.get("M", 0)).otherwise(index.get("M", 0))).limit(1).count():
        out.append("degrees")
    if not out and graph.reachable(edges, index["entry"]).count() != n:
        out.append("rows out of reach")
    return out


def load_release(spark: SparkSession, path: str, expected_sha256: str) -> tuple[dict[str, DataFrame], dict[str, dict], dict]:
    """``read_release``, refused with what it breaks."""
    found = read_release(spark, path, expected_sha256)
    problems = release_problems(*found)
    if problems:
        raise ValueError("; ".join(problems))
    return found


# ---------------------------------------------------------------- converting


def convert(spark: SparkSession, source: str, expected_sha256: str, path: str, index: bool = True) -> str:
    """Write a checked release of documents as one of tables; returns its digest.

    Tables: tracks (with folded names), records (the exact texts), layers, vectors, headers, and grams if an ``index`` is wanted. Before
    anything is published the documents are written back from the tables, and their digests must be the source's.
    """
    tables, headers, manifest = load_release(spark, source, expected_sha256)
    tracks = with_folds(tables["tracks"].drop("body"))
    records = tables["tracks"].select("row", "id", F.col("body").alias("track")).join(tables["rights"].select("row", F.col("body").alias("right")), "row")
    notes = [("release", compact(manifest))] + [(name, compact(h)) for name, h in sorted(headers.items())]
    made = {"tracks": tracks, "records": records, "layers": tables["layers"], "vectors": tables["vectors"], "headers": spark.createDataFrame(notes, "name string, body string")}
    if index:
        made["grams"] = trigrams(tracks)
    made = {name: scratch_table(df, name) for name, df in made.items()}
    again = reconstruct(made, f"{path}.proof")
    fs, proof = release._fs(spark, f"{path}.proof")
    fs.delete(proof, True)
    if again != manifest["assets"]:
        raise ValueError("The tables don't give the documents back: " + ", ".join(sorted(n for n in FILES if again.get(n) != manifest["assets"][n])))
    return release.write_release(made, path, manifest["catalogId"])


def reconstruct(tables: dict[str, DataFrame], path: str) -> dict[str, dict]:
    """Write the documents of a converted release below ``path``; returns their pins."""
    headers = {r["name"]: json.loads(r["body"]) for r in tables["headers"].collect()}  # one row for each document
    own = tables["records"].select("row", "id", F.col("track").alias("body"))
    rights = tables["records"].select("row", "id", F.col("right").alias("body"))
    return write_documents({"tracks": own, "rights": rights, "layers": tables["layers"], "vectors": tables["vectors"]}, headers, path)


def upgrade(spark: SparkSession, source: str, expected_sha256: str, path: str) -> str:
    """Add the lookup index to a release without one; every other table must come over row by row."""
    tables = release.open_release(spark, source, expected_sha256)
    if "grams" in tables:
        raise ValueError("The release has an index already")
    made = tables | {"grams": trigrams(tables["tracks"])}
    digest = release.write_release(made, f"{path}.new", "upgraded")
    new = release.open_release(spark, f"{path}.new", digest)
    fs, staged = release._fs(spark, f"{path}.new")
    if not all(release.same_rows(df, new[name]) for name, df in tables.items()):
        fs.delete(staged, True)
        raise ValueError("A table changed in the upgrade")
    if not fs.rename(staged, release._fs(spark, path)[1]):
        raise ValueError("The release could not be published")
    return digest


# ---------------------------------------------------------------- identity of a graph


def graph_identity(tables: dict[str, DataFrame], construction: dict[str, int], dimensions: int) -> dict:
    """What a graph is bound to: the ordered ids, the vectors' bytes, and how it was built."""
    ids, _ = ordered_document(tables["ids"], F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), ["row"], "[", ",", "]")
    vectors, _ = ordered_document(tables["vectors"], vector_bytes(F.col("embedding")), ["row"], "", "", "")
    return {"schemaVersion": 1, "count": tables["ids"].count(), "dimensions": dimensions, "metric": "cosine", "construction": construction, "orderedIdsSha256": ids, "vectorsSha256": vectors}


def graph_manifest(identity: dict, catalog_id: str, audio: dict) -> dict:
    """A manifest whose graph id is the digest of the identity."""
    whole = identity | {"audio": audio}
    return {"schemaVersion": 1, "catalogId": catalog_id, "graphId": "graph:" + hashlib.sha256(compact(whole).encode()).hexdigest(), "graphIdentity": whole} | {k: identity[k] for k in ("count", "dimensions", "orderedIdsSha256", "vectorsSha256")}


def manifest_problems(manifest: dict, identity: dict, catalog_id: str, audio: dict) -> list[str]:
    """Each field of a manifest that doesn't bind to the tables that ``identity`` was taken from."""
    if not isinstance(manifest, dict) or not isinstance(manifest.get("graphIdentity"), dict):
        return ["graphIdentity"]
    own, out = manifest["graphIdentity"], []
    if manifest.get("graphId") != "graph:" + hashlib.sha256(compact(own).encode()).hexdigest():
        out.append("graphId")
    same = lambda a, b: type(a) is type(b) and a == b  # noqa: E731  True is no 1
    for name, want in {**identity, "audio": audio}.items():
        if not same(own.get(name), want):
            out.append(f"graphIdentity.{name}")
    for name, want in {"schemaVersion": 1, "catalogId": catalog_id, **{k: identity[k] for k in ("count", "dimensions", "orderedIdsSha256", "vectorsSha256")}}.items():
        if not same(manifest.get(name), want):
            out.append(name)
    return out
