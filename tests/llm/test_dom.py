import pytest

from quaver.llm import dom


def runs(page):
    nodes = dom.parse(page)
    return [(n.text, nodes[n.parent].tag, nodes[n.parent].depth) for n in nodes if n.tag == "#text"]


@pytest.mark.parametrize("tag", ["select", "object", "svg", "math", "template"])
def test_unclosed_containers_keep_the_page(tag):
    assert [r[0] for r in runs(f"<p>a</p><{tag}><p>b</p><{tag}><p>c</p>")] == ["a", "b", "c"]
    inside = [] if tag in ("svg", "template") else ["x"]  # the model judges what select and object hold; math is text
    assert [r[0] for r in runs(f"<p>a</p><{tag}>x</{tag}><p>c</p>")] == ["a", *inside, "c"]


def test_unclosed_scripts_still_end_the_page():
    assert [r[0] for r in runs("<p>a</p><script>x<p>b</p>")] == ["a"]


def test_closing_tags_of_deep_elements_close_their_own():
    got = runs("<section>" + "<div>" * 250 + "in" + "</div>" * 60 + "after" + "</div>" * 190 + "out</section>")
    assert [(t, d) for t, _, d in got] == [("in", 251), ("after", 191), ("out", 1)]
