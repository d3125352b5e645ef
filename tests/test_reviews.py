import pytest

from quaver.functions.text import review_query

CASES = {
    "piano no vocals in Spanish, under 3 minutes": [("vocals", "no vocals"), ("language", "in Spanish"), ("duration", "under 3 minutes")],
    "without any singing": [("vocals", "without any singing")],
    "with female vocals": [("vocals", "with female vocals")],
    "male voices, only instrumentals": [("vocals", "male voices"), ("vocals", "only instrumentals")],
    "wordless and Instrumental only": [("vocals", "wordless"), ("vocals", "Instrumental only")],
    "not in French; non-English; only Latin": [("language", "not in French"), ("language", "non-English"), ("language", "only Latin")],
    "English lyrics": [("language", "English lyrics")],
    "a 3-minute song, ten mins long, at least 1.5min": [("duration", "3-minute song"), ("duration", "ten mins long"), ("duration", "at least 1.5min")],
    "less than sixty seconds": [("duration", "less than sixty seconds")],
    "vocals, English, 3 minutes, x3 minutes long, no-vocals, notvocals": [],
    "": [],
}


@pytest.mark.parametrize("text", sorted(CASES))
def test_requests(text):
    got = review_query(text)
    assert [(r["field"], r["source_text"]) for r in got] == CASES[text]
    assert all(text.encode("utf-16-le")[2 * r["start"] : 2 * r["end"]].decode("utf-16-le") == r["source_text"] for r in got)


def test_offsets_count_utf16_units():
    assert review_query("\U0001f3b9 no vocals")[0]["start"] == 3
