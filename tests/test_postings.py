"""The stored index against scans, and what it reads."""

import io
import time
from contextlib import redirect_stdout

import pytest

from quaver.operators import lookup
from quaver.sources import release


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    words = ["Électro", "love", "lady", "night", "ab", "the", "thé", "rare zebra", "x\x00y", "🙂🙂🙂", ""]
    rows = [(i, f"{words[i % 11]} {words[i * 7 % 11]} n{i % 13}", words[i % 5], None, "g") for i in range(3000)] + [(5000, None, None, None, None), (5001, "unique quokka", "b", None, "g")]
    folded = lookup.with_folds(spark.createDataFrame(rows, "row long, title string, artist string, album string, genre string")).cache()
    return folded, lookup.write_postings(folded, str(tmp_path_factory.mktemp("index") / "p"))


@pytest.mark.parametrize("query", ["love", "the night", "Électro", "ü", "lady love", "zzzz not here", "zebra rare", "quokka", "unique love", "n12 zebra", "", "ab", "x\x00y love", "🙂🙂🙂", "the"])
def test_equals_scan(catalog, query):
    folded, index = catalog
    scan = {r.row for r in folded.filter(lookup.contains_all(folded.fold_text, lookup.fold_text(query))).collect()}
    found, used = lookup.posted_lookup(folded, index, query, 3002)
    assert {r.row for r in found.collect()} == scan
    assert set(used) <= set(lookup.query_grams(query)) and (not used or len(scan) < 300)


def test_uses_rarest_grams_only(catalog):
    folded, index = catalog
    assert len(lookup.posted_lookup(folded, index, "unique quokka love", 3002)[1]) == 1
    assert lookup.posted_lookup(folded, index, "love", 3002)[1] == []  # in more than a tenth of the rows
    found, used = lookup.posted_lookup(folded, index, "night lady", 9000)  # either word is in 900 rows or more, both are in fewer
    assert len(used) > 1 and 0 < found.count() < 900


def test_filter_reaches_the_files(catalog):
    folded, index = catalog
    out = io.StringIO()
    with redirect_stdout(out):
        lookup.posted_lookup(folded, index, "quokka", 3002)[0].explain("formatted")
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram," in out.getvalue()


def test_grams_of_long_texts_take_linear_time(spark):
    """A text of 200,000 characters: a substring from the start for each piece would walk 20,000,000,000 characters."""
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(199_990)) + "é🙂ab\x00"
    texts = [(1, long), (2, None), (3, "ab"), (4, "🙂🙂🙂🙂"), (5, "abcabc")]
    began = time.perf_counter()
    got = {(r.gram, r.row) for r in lookup.trigrams(spark.createDataFrame(texts, "row long, fold_text string")).collect()}
    assert time.perf_counter() - began < 20
    assert got == {(t[i : i + 3], row) for row, t in texts if t for i in range(len(t) - 2)}


def test_a_catalog_in_one_file_becomes_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    """A small file of many rows is one task's; its grams, their check and their comparison are not."""
    monkeypatch.setattr(lookup, "PART_ROWS", 100)
    monkeypatch.setattr(release, "FILE_ROWS", 1500)
    tracks = spark.range(1000).repartition(1).selectExpr("id as row", "concat('title number ', id) as title", "'a' as artist", "cast(null as string) as album")
    path = str(tmp_path / "r")
    own = release.open_release(spark, path, release.write_catalog(tracks, path, "demo"))
    files = own["grams"].selectExpr("input_file_name() as f").groupBy("f").count().collect()
    assert len(files) >= 10 and max(f["count"] for f in files) <= 1500
    assert own["grams"].count() == lookup.trigrams(own["tracks"]).count()
    broken = own["grams"].filter("row <> 7").unionByName(own["grams"].filter("row = 8")).unionByName(spark.createDataFrame([("zzz", 9)], "gram string, row long"))
    found = lookup.index_problems(own["tracks"], broken)
    assert found.rdd.getNumPartitions() == 10
    grams = {n: {r.gram for r in own["grams"].filter(f"row = {n}").collect()} for n in (7, 8)}
    want = {(g, 7, "missing") for g in grams[7]} | {(g, 8, "repeated") for g in grams[8]} | {("zzz", 9, "extra")}
    assert {tuple(r) for r in found.collect()} == want


def test_same_rows_sees_nulls_and_places(spark):
    of = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    assert release.same_rows(of(("x", None), ("y", "z")), of(("y", "z"), ("x", None)))
    for other in (of((None, "x"), ("y", "z")), of(("x", None)), of(("x", None), ("y", "z"), ("y", "z")), of(("x", ""), ("y", "z"))):
        assert not release.same_rows(of(("x", None), ("y", "z")), other)
