import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaver.llm import decontamination, html_extraction, lines, ngram_join, packing, quality, sharding, substrings, tokenfile, urls
from quaver.llm import queries as llm
from quaver.llm.dom import parse
from quaver.llm.fm_index import FMIndex, repeated_windows
from quaver.llm.html_pages import labelled_page
from tests.compare import same
from tests.llm import brute

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeats, near copies, odd white space, and columns with names used inside."""
    r = random.Random(5)
    vocabulary = "ab cd ef gh ij Kl mn".split()
    base = [" ".join(r.choice(vocabulary) + str(r.randint(0, 30)) for _ in range(70)) for _ in range(4)]
    texts = [None, "", " ", "one", "One", "two words", "x " * 60, "x\ty\x0bz " * 30, "é ü 中 🙂 " * 25, "a\r\nb\n\nc", "\n\n\n\n", "<|endoftext|> I'll go!!"]
    texts += base + base[:2] + [b + " tail" for b in base] + ["head words " + b[40:] + "\nmore" for b in base]
    texts += ["l1 a\nl2 b\nl3 c\nl4 d", "z\nl1 a\nl2 b\nl3 c\nq", "l1 a\nl2 b\nl3 c"]
    for b in base:
        w = b.split()
        for _ in range(6):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts.append(" ".join(r.choice(vocabulary) + str(r.randint(0, 300)) for _ in range(20_000)))
    rows = [(i, t, "n", 1, 2, "p") for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("odd") / "odd.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, n string, place int, n_removed int, part string").repartition(3).write.parquet(path)
    return spark.read.parquet(path), [(i, t) for i, t, *_ in rows]


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_equals_sql(spark, small, name):
    same(llm.QUERIES[name](spark, small), llm.SQL[name], small)


def test_decontamination(spark, odd):
    df, docs = odd
    items = [(2, docs[12][1]), (10, "one"), (3, None), (4, "... !"), (5, docs[13][1][:120].upper()), (6, "b c")]
    bench = spark.createDataFrame([*items, (None, "x y")], "item_id long, text string")
    want = {i: brute.contamination(t, items) for i, t in docs}
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert by_id(decontamination.find_contamination(df, bench).select(*columns)) == want
    assert by_id(decontamination.find_contamination(df, bench, block_bytes=200).select(*columns)) == want
    kept = decontamination.remove_contaminated(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]} and kept.columns == df.columns


def test_jaccard_components(odd):
    df, docs = odd
    for k, percent in ((3, 90), (5, 80)):
        got = by_id(ngram_join.jaccard_components(df, k, percent).select("doc_id", "n_shingles", "component_id"))
        assert got == brute.components(docs, k, percent)
    kept = {r.doc_id for r in ngram_join.keep_one(df, 3, 90).collect()}
    assert kept == {i for i, (n, c) in brute.components(docs).items() if i == c}


def test_substrings(odd):
    df, docs = odd
    import hashlib

    for hot in (4000, 1):
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.dedup_substrings(df, hot_segments=hot).collect()}
        assert got == brute.substrings(docs)


def test_fm_index():
    for seed in range(40):
        r = np.random.default_rng(seed)
        segments = [r.integers(1, r.integers(2, 6), r.integers(5, 30)) for _ in range(r.integers(1, 9))]
        seq = np.concatenate([np.append(s, 0) for s in segments])
        at = np.cumsum([0, *(len(s) + 1 for s in segments)])[:-1]
        index = FMIndex(seq, (1, 2, 4)[seed % 3])
        assert index.sa.tolist() == sorted(range(len(seq)), key=lambda i: tuple(seq[i:]))
        seen, want = set(), []
        for a, s in zip(at, segments):
            for i in range(len(s) - 4):
                g = tuple(s[i : i + 5])
                if g in seen:
                    want.append(a + i)
                seen.add(g)
        assert sorted(repeated_windows(index, seq, at, np.array([len(s) - 4 for s in segments]), 5).tolist()) == want


def test_lines(odd):
    df, docs = odd
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(df).collect()}
    assert got == brute.lines(docs)


def test_quality_statistics(spark, odd):
    df, docs = odd
    got = by_id(quality.statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == {i: brute.quality(t) for i, t in docs}
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(df, none).collect()}
    for i, t in docs:
        n, _, _, _, rep = brute.quality(t)
        failed = n < 10 or 100 * rep > 20 * n
        assert judged[i] == (failed, not failed)


def test_quality_rules_are_learned():
    r = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append({"bad": int(bad), "symbol_share": r.uniform(0.1, 0.4) if bad else r.uniform(0, 0.02), **{f: r.random() for f in quality.FEATURES if f != "symbol_share"}})
    rules = quality.learn_rules(rows)
    assert rules and all(any(all(c.holds(x) for c in rule) for rule in rules) == bool(x["bad"]) for x in rows)
    assert quality.learn_rules([x for x in rows if not x["bad"]]) == []


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = quality.learn_rules(quality.labelled_rows(docs, labels.filter("doc_id % 2 = 0")))
    judged = quality.apply_rules(docs, half).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    good = [r.kept for r in judged if r.quality == 1]
    bad = [r.kept for r in judged if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_packing(odd):
    df, docs = odd
    t = Tokenizer.from_file(WORDS)
    want = {}
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 256)):
            want[i, p] = (a, len(ids[a : a + 256]), brute.crc(ids[a : a + 256]))
    rows = packing.pack_documents(df, WORDS, capacity=256).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256


def test_packing_is_optimal_on_small_instances():
    def best(sizes, capacity):
        sizes = sorted(sizes, reverse=True)
        found = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= found[0]:
                return
            if i == len(sizes):
                found[0] = len(rooms)
                return
            for j, room in enumerate(rooms):
                if room >= sizes[i] and room not in rooms[:j]:
                    place(i + 1, [*rooms[:j], room - sizes[i], *rooms[j + 1 :]])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return found[0]

    for seed in range(150):
        r = random.Random(seed)
        counts = {}
        for _ in range(r.randint(1, 9)):
            s = r.randint(1, 20)
            counts[s] = counts.get(s, 0) + 1
        fixed, rest = packing.reduce_instance(counts, 20)
        sizes = [s for s, c in counts.items() for _ in range(c)]
        left = [s for s, c in rest.items() for _ in range(c)]
        assert sum(k for k, _ in fixed) + best(left, 20) == best(sizes, 20), counts  # reduction keeps the optimum
        packed = packing.pack_histogram(counts, 20)
        back = {}
        for k, content in packed:
            assert sum(content) <= 20
            for s in content:
                back[s] = back.get(s, 0) + k
        assert back == counts


def test_token_files(odd):
    df, docs = odd
    t = Tokenizer.from_file(BYTES)
    at, want, stream = 0, {}, []
    for i, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), brute.crc(ids))
        at += len(ids)
        stream += ids
    manifest = tokenfile.write_token_files(df, BYTES, 2, length=64)
    assert by_id(tokenfile.read_documents(manifest)) == want
    back = []
    for f in sorted(manifest.collect(), key=lambda r: r.part):
        reader = tokenfile.open_sequences(f.path)
        rows = sum(reader.get_batch(b).num_rows for b in range(reader.num_record_batches))
        for k in range(rows):
            ids, mask = tokenfile.sequence(reader, k)
            assert len(ids) == 64
            back += ids[mask].tolist()
    assert back == stream


def test_unit_ids_equal_the_tokenizers():
    from quaver.llm.tokens import UnitEncoder, is_spaced

    letters = [*"abcXYZ019 \n\t.,!?$|<>'-_", "İ", "ı", "ß", "ſ", "é", "e\u0301", "\u0307", "\u0308", "\u0345", "Σ", "ς", "ŉ", "ǰ", "ﬁ", "中", "🙂", "\u200d", "\x85", "\x1c", "\xa0", "\u2028", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'s", "'LL", "  "]
    r = random.Random(3)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    for path in (WORDS, BYTES):
        t = Tokenizer.from_file(path)
        got = UnitEncoder(path, "<u4", is_spaced(path)).encode(texts)
        for text, ids, e in zip(texts, got, t.encode_batch(texts, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, text


def test_new_units_are_encoded_together():
    from quaver.llm.tokens import UnitEncoder, is_spaced

    r = random.Random(4)
    text = " ".join("".join(r.choice("abcdeéüñß.,") for _ in range(9)) for _ in range(3000))
    for path in (WORDS, BYTES):
        coder = UnitEncoder(path, "<u4", is_spaced(path))
        whole, asked = coder.tokenizer, []

        class Counted:
            def encode_batch_fast(self, texts, **options):
                asked.append(len(texts))
                return whole.encode_batch_fast(texts, **options)

        coder.tokenizer = Counted()
        ids = np.frombuffer(coder.encode([text])[0], "<u4").tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids
        assert sum(asked) <= 3  # not one text for each new word


@pytest.mark.parametrize("percent", [30, 51, 80, 90, 100])
def test_linked_sets_share_a_prefix_token(percent):
    from quaver.llm.common import mix

    r = np.random.default_rng(percent)
    for n in [*range(1, 60), *range(60, 700, 20)]:
        pool = mix(r.integers(0, 2**62, 4 * n).astype(np.uint64))
        far = ngram_join.differences(n, percent)
        for lost in {0, far // 2, min(far, n - 1)}:
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[lost:n], pool[n : n + min(far - lost, 3 * n)]]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                tokens = [ngram_join.prefix_tokens(s, mix(s), (s >> np.uint64(60)).astype(np.uint8), percent) for s in (a, b)]
                assert len(np.intersect1d(*tokens)), (n, lost)


def test_texts_of_common_shingles_share_few_tokens(spark):
    """Texts of a small vocabulary meet at every shingle, but not at whole parts of sets."""
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefghijklmnopqrst") for _ in range(250))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert ngram_join._Join(df, "bigint", 3, 90).postings().count() < 1_000
    rows = ngram_join.jaccard_components(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.components(docs)


def test_shards(odd):
    df, docs = odd
    rows = sorted(sharding.shard_by_bytes(df, 5).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 8 for _, t in docs]
    assert [r.size for r in rows] == sizes and [r.shard for r in rows] == sorted(r.shard for r in rows)
    for s in range(5):
        own = [r for r in rows if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))


def test_urls(spark):
    pages = spark.createDataFrame(
        [(i, u, "x") for i, u in enumerate([None, "nothing", "http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://b.com/de/", "http://xcom/fr/1", "ftp://c.co.uk", "://", "http://bad.net/1", "http://bad.net/2"])],
        "page_id long, url string, host string",
    )
    labels = spark.createDataFrame([(8, 0, 0), (9, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, labels, margin=0.5).collect()}
    assert got[0] == ("", "", None, got[0][3]) and got[1][:3] == ("", "", None)
    assert got[2] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4] == ("b.com", "/de/", "com/de/", "block") and got[5][2] is None
    assert got[8][3] == got[9][3] == "block"
    none = urls.filter_urls(pages, labels.limit(0)).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}


def test_url_posteriors_shrink_at_three_levels(spark):
    seen = [(h, b) for h, n, b in (("a.bad.net", 30, 1), ("b.bad.net", 30, 1), ("a.good.net", 40, 0), ("x.one.zz", 30, 1), ("x.two.zz", 30, 1), ("y.fine.org", 80, 0), ("odd.fine.org", 1, 1)) for _ in range(n)]
    hosts = [*{h for h, _ in seen}, "new.bad.net", "new.good.net", "new.three.zz", "new.four.org"]
    df = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate([h for h, _ in seen] + hosts)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(seen)], "doc_id long, quality int, toxic int")
    got = {r.host: r.verdict for r in urls.filter_urls(df, labels).collect()}
    blocked = {h for h, v in got.items() if v == "block"}
    assert blocked == {"a.bad.net", "b.bad.net", "new.bad.net", "x.one.zz", "x.two.zz", "new.three.zz"}


def test_url_posteriors_decide_on_the_tables(spark):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "labels"))
    own = [r.verdict for r in urls.filter_urls(pages, labels).filter("rule is null").collect()]
    assert 0 < own.count("block") < 0.3 * len(own)


def test_html_held_out_accuracy():
    weights, pairs = html_extraction.trained()
    rng = np.random.default_rng(12345)
    right = blocks = wrong = 0
    for _ in range(150):
        page, content = labelled_page(rng)
        want = [n.text for n in parse(page) if n.tag == "#text" and n.text in content]
        got = html_extraction.extract([page], weights, pairs)[0]
        right += got == "\n".join(want)
        blocks += len(want)
        wrong += len(set(got.split("\n")) ^ set(want))
    assert right >= 135 and wrong <= 0.05 * blocks


def test_html_pages(spark):
    page = '<html><body><nav><a href="/">Home</a></nav><div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>One  two\n three<br>four &eacute;.<script>var a="</p>";</script><p>Five <b>six</b> seven eight nine ten.<!-- no --></article><div class="comments"><p>Nice words here.</p></div><footer>&copy; me</footer>'
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "v", "", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extraction.extract_pages(df).collect()}
    assert got[1].text == "A & B\nOne two three four é.\nFive six seven eight nine ten." and got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[2].n_chars == 0 and got[3].text == ""


def test_marginals_equal_enumeration():
    import itertools

    nodes = parse("<div><p>a b</p><ul><li>c<li>d</ul></div>")
    f = html_extraction.Forest([nodes])
    r = np.random.default_rng(3)
    w, p = r.normal(size=html_extraction.N_FEATURES), r.normal(size=(html_extraction.KINDS, 2, 2))
    own = f.unary(w)
    total, ones = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(own[i] for i in range(len(nodes)) if y[i]) + sum(p[f.kind[i], y[f.parent[i]], y[i]] for i in range(len(nodes)) if f.parent[i] >= 0)
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
    assert np.allclose(html_extraction.marginals(f, w, p)[0], ones / total)


def test_clashing_names_and_changed_splits(spark, odd):
    """Columns named like those used inside keep their values, and a change of file splits between passes changes nothing."""
    df, docs = odd
    extra = {c: f"own {c}" for c in ("place", "_place", "starts", "lines", "gone", "key", "__place", "__l", "h", "comp")}
    from pyspark.sql import functions as F

    wide = df.select("doc_id", "text", *(F.lit(v).alias(c) for c, v in extra.items()))
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    for out in (lines.dedup_lines(wide), ngram_join.keep_one(wide), decontamination.remove_contaminated(wide, bench)):
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        rows = out.collect()
        spark.conf.unset("spark.sql.files.minPartitionNum")
        assert rows and all(r[c] == v for r in rows for c, v in extra.items())
        assert len({r.doc_id for r in rows}) == len(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, text), (1, text), (None, text), (None, None), (2, ""), (2, None), (3, "l\n1\n2"), (3, "l\n1\n2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect()), key=repr) == sorted(
        [(1, 24, 1), (1, 24, 1), (None, 24, 1), (None, 0, None), (2, 0, 2), (2, 0, 2), (3, 1, 3), (3, 1, 3)], key=repr
    )
    kept = sorted(map(tuple, ngram_join.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, text), (None, None), (2, ""), (2, None), (3, "l\n1\n2")], key=repr)
    cut = sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(df).collect() if r.doc_id == 3)
    assert cut == [(3, 0), (3, 3)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.dedup_substrings(df).collect() if r.n_words > 20)
    assert got == [(0, 0), (1, 26), (1, 26)]  # a null id comes first


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not decontamination.find_contamination(docs, bench).count()
    assert not ngram_join.jaccard_components(docs).count()
    assert not substrings.dedup_substrings(docs).count()
    assert not lines.dedup_lines(docs).count()
    assert not quality.judge(docs, labels).count()
    assert not packing.pack_documents(docs, WORDS).count()
    assert not tokenfile.read_documents(tokenfile.write_token_files(docs, BYTES, 2)).count()
    assert not sharding.shard_by_bytes(docs).count()
    assert not urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), labels).count()
    assert not html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count()
