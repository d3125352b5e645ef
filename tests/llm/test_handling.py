"""Odd names, repeated rows and null ids in the operators of the pipeline."""

import random

from pyspark.sql import functions as F

from quaver.llm import decontamination, lines, ngram_join, packing, quality, sharding
from tests.llm import brute


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def test_quality_keeps_columns_of_any_name(spark):
    rows = [(i, words(i, 40), i) for i in range(6)] + [(6, None, 6), (7, "", 7), (None, words(9, 40), 8), (1, words(1, 40), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumn("t`x", F.lit(1)).withColumn("w", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, quality int")
    kept = quality.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["a.b"] for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 8]


def test_labelled_rows_are_one_for_each_id(spark):
    good, bad = words(1, 60), "### $$$ " * 20 + words(2, 60)
    docs = spark.createDataFrame([(1, good), (1, bad), (1, bad), (2, good), (None, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 1)], "doc_id long, quality int")
    for order in ("text", F.desc("text")):
        got = quality.labelled_rows(docs.orderBy(order).coalesce(1), labels)
        assert [(r["doc_id"], r["bad"]) for r in got] == [(1, 1), (2, 0)] and got[0]["symbol_share"] == 0


def test_short_windows_leave_other_tables_alone(spark):
    long_ = [(str(i), words(i, 30)) for i in range(50)]
    alone = {t.m for t in decontamination.tables_of(long_, 10)}
    both = {t.m for t in decontamination.tables_of([*long_, ("x", "a b c d e f g h i j")], 10)}
    assert alone < both and len(both) == len(alone) + 1


def test_repeated_rows_and_null_ids(spark):
    a, b = words(1, 60), words(2, 60)
    rows = [(1, a), (1, a), (None, a), (2, b), (2, b), (None, None), (3, ""), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    item = " ".join(a.split()[5:20])
    found = decontamination.find_contamination(docs, spark.createDataFrame([(7, item), (7, item), (None, b)], "item_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_hit) for r in found.collect()) == sorted((i is None, i or 0, 15 if t == a else 0) for i, t in rows)
    shards = sharding.shard_by_bytes(docs, 3).collect()
    assert len(shards) == len(rows) and sum(r.size for r in shards) == sum(len(t or "") + 8 for _, t in rows)
    for s in range(3):
        assert sorted(r.slot for r in shards if r.shard == s) == list(range(sum(r.shard == s for r in shards)))
    kept = ngram_join.keep_one(docs, 5, 80).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    cut = lines.dedup_lines(docs)
    assert cut.count() == len(rows)
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(pieces) == len(rows) and all(r.start == 0 for r in pieces)


def test_near_copies_in_one_group(spark):
    """Members of one group of equal prefix and size are joined through leaders, not as all pairs."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        v = list(base)
        v[r.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(v)))
    docs += [(1000 + i, " ".join(r.choice(base) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, 5, 80).collect()}
    assert got == brute.components(docs, 5, 80)


def test_unique_ids_need_no_copy(spark, monkeypatch):
    """Rows that ids name are not written again, and a token's groups are met in one pass over sorted rows."""
    written = []
    table = ngram_join.Scratch.table
    monkeypatch.setattr(ngram_join.Scratch, "table", lambda self, df, name: (written.append(name), table(self, df, name))[1])
    docs = [(i, words(i // 2, 40)) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == set(range(0, 20, 2))
    assert "placed" not in written and "groups" not in written


def test_met_rows_over_batches():
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    rows = sorted((r.randrange(30), r.randrange(4), 7) for _ in range(60))
    want = sorted({x for x in rows if len({y for y in rows if y[0] == x[0]}) > 1})
    for size in (1, 2, 3, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows[i : i + size])], ["token", "g", "n"]) for i in range(0, 60, size)]
        assert [tuple(x.values()) for b in ngram_join._met(iter(batches)) for x in b.to_pylist()] == want


def test_words_with_marks_take_known_ids():
    import numpy as np
    import public_tokenizers

    from quaver.llm.tokens import UnitEncoder, is_spaced

    r = random.Random(6)
    own = ["".join(r.choice("abcdeéü") for _ in range(9)) for _ in range(500)]
    text = "x " + " ".join(w + m for m in ("", ".", "$$$", "?!", "9,", "';") for w in own)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        coder = UnitEncoder(path, "<u4", is_spaced(path))
        whole, asked = coder.tokenizer, []

        class Counted:
            def encode_batch_fast(self, texts, **options):
                asked.append(sum(map(len, texts)))
                return whole.encode_batch_fast(texts, **options)

        coder.tokenizer = Counted()
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert sum(asked) < 0.6 * len(text)  # "w", "w9," and "w';" of six forms of each word


def test_suffix_array():
    import numpy as np

    from quaver.llm.fm_index import suffix_array

    r = random.Random(7)
    for n in (0, 1, 2, 3, 5, 8, 40, 200):
        for most in (1, 3, n, 100_000):
            seq = [r.randint(0, most) for _ in range(n)]
            want = sorted(range(n), key=lambda i: seq[i:])
            for seed in (1, 2, 4, 8, 16):
                order, rank = suffix_array(np.array(seq, np.int64), seed)
                assert order.tolist() == want
                heads = [seq[i : i + seed] for i in range(n)]
                assert [rank[i] <= rank[j] for i in range(0, n, 7) for j in range(n)] == [heads[i] <= heads[j] for i in range(0, n, 7) for j in range(n)]


def test_crowded_tokens_among_many_rare_ones(spark, monkeypatch):
    """Near copies are joined through leaders however many pairs of texts the rest of the corpus has, so their candidates don't grow with their square."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        v = list(base)
        v[r.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(v)))
    docs += [(1000 + i, words(i // 2, 100) + (" end" if i % 2 else "")) for i in range(1200)]
    made = {}
    merged = ngram_join._Join.merged
    monkeypatch.setattr(ngram_join._Join, "merged", lambda self, comps, pairs, name: (made.update({name: pairs.filter("a < b").unionByName(pairs.filter("a > b")).count()}), merged(self, comps, pairs, name))[1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(df, 5, 80).collect()}
    assert got == brute.components(docs, 5, 80)
    assert list(made)[-1] == "all" and made["all"] < 600 + 5 * 60, made


def test_words_at_text_borders_without_hashing(monkeypatch):
    """Words of texts that touch are cut, and shingles made distinct, without numpy's sets, which hash every value."""
    import re

    import numpy as np
    import pyarrow as pa

    from quaver.llm import common

    def refuse(*_, **__):
        raise AssertionError("hashes every value")

    monkeypatch.setattr(np, "union1d", refuse)
    monkeypatch.setattr(np, "unique", refuse)
    r = random.Random(8)
    for _ in range(60):
        texts = [None if r.random() < 0.2 else "".join(r.choice("ab \n") for _ in range(r.randrange(7))) for _ in range(9)]
        raw, start, end = common.text_bytes(pa.array(texts, pa.string()))
        begin, stop, first = common.word_spans(raw, start, end, common.SPACES)
        got = [raw[a:b].tobytes().decode() for a, b in zip(begin.tolist(), stop.tolist())]
        assert [got[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())] == [re.findall(r"\S+", t or "") for t in texts]
        assert [len(s) for s in ngram_join.shingle_sets(pa.array(texts, pa.string()), 2)] == [len(set(zip(w, w[1:])) or w[:1]) for w in (re.findall(r"\S+", t or "") for t in texts)]
