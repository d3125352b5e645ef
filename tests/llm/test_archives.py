"""Conversations, archives and vector codes against plain forms, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quaver.llm import conversation_trie, vector_codes, warc
from quaver.llm.common import Scratch
from tests.llm import brute


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- conversations


def plain_tree(table):
    turns = {}
    for c, turn, role, text in sorted((r for r in table if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = turns.get(int(c - np.fmod(c, 20)), [])[:h] + own[h:]
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    kids, saved, leaves = {k: 0 for k in nodes}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k, m in nodes.items():
        cost = (len(m) - 1) * len(brute.WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += cost
            leaves[k[:d]] += not kids[k]
    sha = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(k)).encode()).hexdigest()
    return sorted(((m[0], len(k), nodes[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(k, m)) for k, m in nodes.items()), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_conversations():
    r = random.Random(3)
    table = [(None, 0, "user", "of no conversation"), (7, None, "user", "null first"), (7, 1, None, "x\ty"), (7, 1, None, "a tie"), (7, 1, None, "a tie"), (7, -2, "user", None)]
    table += [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d e f", "é 中"])) for c in range(-25, 130) for t in range(r.randint(0, 4)) if c % 40 != 20]
    table += [(c, t, "user", f"deep {min(t, c - 200)}") for c in range(200, 240) for t in range(c - 190)]  # nested chains
    table += [(c, t, "user", f"same {t}") for c in range(300, 420) for t in range(4)]  # copies
    table += [(500, t, "user", "long " * (t % 3)) for t in range(150)] + [(501, 5, "user", "word " * 50_000)]
    r.shuffle(table)
    return table


def test_conversation_trie(spark):
    table = odd_conversations()
    df = spark.createDataFrame([(*x, "clash", 1) for x in table], "conv_id long, turn long, role string, text string, depth string, at int").repartition(5)
    got = conversation_trie.conversation_trie(df)
    assert got.columns == COLUMNS and rows(got, *COLUMNS) == plain_tree(table)


def test_no_conversations(spark):
    for table in ([], [(None, 1, "user", "x")]):
        df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
        assert conversation_trie.conversation_trie(df).collect() == []


def test_turnless_conversation(spark):
    # 3 takes its first turns from 0, which is absent, and has none of its own after as many
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    table = [(c, 1, "user", "one"), (c, 2, "user", "two")]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert rows(conversation_trie.conversation_trie(df), *COLUMNS) == plain_tree(table)


def test_running_sums_over_many_ranges(spark):
    scratch = Scratch(spark, "test-sums")
    data = [(k, i, i % 7) for k, n in ((1, 500), (2, 1), (3, 2)) for i in range(n)]
    df = spark.createDataFrame(data, "k long, i long, v long").repartition(3)
    from pyspark.sql import functions as F

    got = {(r.k, r.i): r.v for r in conversation_trie.running_sums(df, "k", [F.col("i")], ["v"], scratch, "x").collect()}
    want, total = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + v
        want[k, i] = total[k]
    assert got == want


def test_digest_of_many_ends(spark):
    data = [(1, 2, m) for m in range(-20_000, 20_000)] + [(1, 3, 5), (2, 0, -7), (2, 0, 3)]
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in conversation_trie.ends_digests(spark.createDataFrame(data, "conv_id long, depth long, member long")).collect()}
    want = {}
    for c, d, m in data:
        want.setdefault((c, d), []).append(m)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


# ---------------------------------------------------------------- archives

PAGES = [
    (5, "http://a/1", "<p>" + "copied " * 40),
    (3, "http://a/2", "<p>" + "copied " * 40),
    (3, "http://a/0", "<p>" + "copied " * 40),
    (3, "http://a/0", "<p>" + "copied " * 40),
    (None, "http://b/", "<p>" + "copied " * 40),
    (7, None, "small"),
    (8, "http://c/ with\r\nspaces", "small"),
    (9, "http://d/", None),
    (10, "", ""),
    (-4, "http://é/中", "é中🙂" * 30),
    (11, "http://e/", "x" * 99),
    (12, "http://e/", "x" * 99),
    (13, "http://e/", "y" * 100),
    (14, "http://e/", "y" * 100),
    (15, "http://long/", "line\r\n\r\n" * 300_000),
]


def plain_records(pages):
    bodies = {}
    for page, url, html in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        bodies.setdefault((html or "").encode(), []).append(page)
    out = []
    for body, ids in bodies.items():
        for k, page in enumerate(ids):
            again = k > 0 and len(body) >= 100
            out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(*p, "clash", "n") for p in PAGES], "page_id long, url string, html string, digest string, payload string").repartition(3)
    return warc.archive_pages(df, Scratch(spark, "test-warc"))


def test_archive(spark, archive):
    assert rows(warc.page_records(archive), *RECORD) == plain_records(PAGES)
    assert archive.payloads.count() == len({h or "" for _, _, h in PAGES})
    none = warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), Scratch(spark, "test-warc-0"))
    assert warc.page_records(none).collect() == []


def test_files_and_back(spark, archive, tmp_path):
    files = warc.write_files(archive, str(tmp_path / "warc")).collect()
    assert sum(f.n_records for f in files) == len(PAGES)
    read = warc.read_files(spark.createDataFrame([(f.path,) for f in files], "path string"))
    again = warc.store(read, Scratch(spark, "test-warc-2"))
    assert rows(warc.restore(again), "headers", "digest", "own", "payload") == rows(warc.restore(archive), "headers", "digest", "own", "payload")
    assert rows(warc.page_records(again), *RECORD) == plain_records(PAGES)


def test_foreign_file(spark, tmp_path):
    """Plain records whose digests are of another kind, one without a payload digest, one of another type."""
    rec = lambda head, block: (f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    kind = "Content-Type: application/http; msgtype=response\r\n"
    data = rec("WARC-Type: warcinfo\r\n", b"software: x\r\n") + rec(f"WARC-Type: response\r\nWARC-Payload-Digest: sha1:ABC\r\n{kind}", http + b"body")
    data += rec(f"WARC-Type: revisit\r\nWARC-Payload-Digest: sha1:ABC\r\n{kind}", http) + rec(f"WARC-Type: response\r\n{kind}", http)
    path = tmp_path / "x.warc"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path),)], "path string")
    got = warc.restore(warc.store(warc.read_files(files), Scratch(spark, "test-warc-3"))).orderBy("at").collect()
    assert [bytes(r.payload) for r in got] == [b"software: x\r\n", b"body", b"body", b""]
    assert b"".join(bytes(r.headers) + (bytes(r.payload) if r.own else b"") + b"\r\n\r\n" for r in got) == data
    path.write_bytes(data[:-9])
    with pytest.raises(Exception, match="cut short"):
        warc.read_files(files).collect()


def test_damaged_payload(spark, archive):
    from pyspark.sql import functions as F

    other = warc.compressed(F.concat(warc.decompressed("frame"), F.lit(b"!")))
    bad = warc.Archive(archive.records, archive.payloads.withColumn("frame", other))
    with pytest.raises(Exception, match="Damaged payload"):
        warc.page_records(bad).collect()


# ---------------------------------------------------------------- vector codes


def plain_codes(table, parts=8, entries=16, rounds=6, scale=4096):
    size = next((len(v) for i, v, _ in sorted(table, key=lambda r: (r[0] is None, r[0] or 0)) if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)), 0)
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], g) for i, v, g in table if v and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = size // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, xs in members.items():
                books[p][k] = tuple(sum(col) // len(xs) for col in zip(*xs))
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, g), e in zip(kept, error):
        by[g] = by.get(g, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by[g], sha) for (i, _, g), f, e in zip(kept, found, error)), key=repr)


CODES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes(spark):
    r = random.Random(8)
    table = [(i, [r.choice([-0.5, 0.0, 0.25, 0.25, 1.0]) for _ in range(16)], r.choice([None, 1, 2])) for i in range(-20, 200)]
    table += [(i, [0.25] * 16, 3) for i in range(300, 420)] + [(7, [0.5] * 16, None), (7, [0.5] * 16, None), (None, [0.1] * 16, 1)]
    table += [(500, None, 1), (501, [], 1), (502, [None] + [0.0] * 15, 1), (503, [float("nan")] + [0.0] * 15, 1), (504, [float("-inf")] + [0.0] * 15, 1), (505, [0.1] * 8, 1), (506, [0.1] * 15, 1)]
    df = spark.createDataFrame([(*t, "clash", 0) for t in table], "vec_id long, embedding array<float>, label int, code string, v int").repartition(4)
    got, books = vector_codes.vector_codes(df)
    assert rows(got, *CODES) == plain_codes(table) and books.shape == (8, 16, 2)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = [(2, [0.1] * 8, 1), (1, [0.3] * 8, 1)]
    assert rows(vector_codes.vector_codes(spark.createDataFrame(few, kind))[0], *CODES) == plain_codes(few)
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [], 1)], kind))[0].collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([], kind))[0].columns == CODES
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38, -3e38] * 4, 1), (2, [0.0] * 8, 1)], kind))[0].collect()
    assert [r.error for r in huge] == [0, 0]


def test_kd_tree():
    r = np.random.default_rng(1)
    for _ in range(200):
        e = r.integers(-3, 4, (r.integers(1, 17), r.integers(1, 5))).astype(np.int64)
        q = r.integers(-4, 5, (60, e.shape[1])).astype(np.int64)
        index, d = vector_codes.KDTree(e).nearest(q)
        every = ((q[:, None] - e[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (d == every.min(1)).all()
