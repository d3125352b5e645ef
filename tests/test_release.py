import pytest

from quaver import schema
from quaver.functions.bpe import Tokeniser
from quaver.functions.text import fold_text, review_query, strict_json_problem
from quaver.operators.governance import Limits
from quaver.sources import release


def test_release_is_immutable_and_pinned(spark, small, tmp_path):
    path = str(tmp_path / "r1")
    pin = release.write_release({"tracks": schema.tracks(spark, small)}, path, "one")
    assert release.open_release(spark, path, pin)["tracks"].count() == 200
    with pytest.raises(ValueError):
        release.write_release({"tracks": schema.tracks(spark, small)}, path, "one")
    with pytest.raises(ValueError):
        release.open_release(spark, path, "0" * 64)
    part = next((tmp_path / "r1" / "tracks").glob("part-*"))
    (part.parent / f".{part.name}.crc").unlink()
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(ValueError):
        release.open_release(spark, path, pin)


def test_same_rows_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,)], "x int")
    assert release.same_rows(a, a) and not release.same_rows(a, b)


def test_text_functions():
    assert fold_text("Électro ﬁ Ｆ") == "electro fi f" and fold_text(None) == "" and fold_text("́") == ""
    assert [r["field"] for r in review_query("female vocals only English under 3 minutes")] == ["vocals", "language", "duration"]
    assert strict_json_problem('{"a":1e999}') == "not finite" and strict_json_problem('"\\ud800"') == "lone surrogate" and strict_json_problem("[1]") is None


def test_bpe():
    merges = [("l", "o"), ("lo", "w</w>"), ("e", "r</w>")]
    names = ["l", "o", "w", "e", "r", "w</w>", "lo", "low</w>", "er</w>", "!</w>"]
    t = Tokeniser(merges, {s: i for i, s in enumerate(names)}, 100, 101)
    assert t.encode("Low!  lower") == [100, 7, 9, 6, 2, 8, 101]
    assert len(t.encode("low " * 200)) == 77


def test_limits():
    for bad in (0, True, 2_000_000):
        with pytest.raises(ValueError):
            Limits(rows=bad)
