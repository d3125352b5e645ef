"""Pages written by hand, in layouts that the generator of labelled pages doesn't draw."""

import pytest

from quaver.llm import html_extraction
from quaver.llm.dom import parse

NAV = '<nav><a href="/">Home</a> <a href="/b">News</a></nav>'
FOOT = "<footer>&copy; 2024 Site. All rights reserved.</footer>"
ONE = "The committee met on Tuesday to discuss the new budget for the coming year."
TWO = "Several members said that they would vote against it, and others agreed."
BODY = f"<p>{ONE}</p><p>{TWO}</p>"
TEXT = f"{ONE}\n{TWO}"
LINKS = "<ul><li><a href=1>One link</a><li><a href=2>Another link</a><li><a href=3>Third</a></ul>"

CASES = {
    "grid": (f'{NAV}<div id="wrapper"><div class="row"><div class="col-8"><h1>The Title</h1>{BODY}</div><div class="col-4">{LINKS}</div></div></div>{FOOT}', f"The Title\n{TEXT}"),
    "deep article": (f"{NAV}<article>{'<div>' * 30}{BODY}{'</div>' * 30}</article>{FOOT}", TEXT),
    "comments": (f"{NAV}<article><!-->{BODY}<!-- x --!><p>The last words come here at the end.</p></article>{FOOT}", f"{TEXT}\nThe last words come here at the end."),
    "hidden": (f'{NAV}<article>{BODY}<div style="display:none"><p>You can not see this sentence here.</p></div></article>{FOOT}', TEXT),
    "math": (f"{NAV}<article><p>The value <math><mi>x</mi></math> is always greater than zero here.</p>{BODY}</article>{FOOT}", f"The value x is always greater than zero here.\n{TEXT}"),
    "unclosed select": (f"{NAV}<article>{BODY}</article><form><select><option>One<option>Two</form>{FOOT}", TEXT),
}

# pages labelled by hand, whose names and layouts the generator doesn't draw: (page, blocks of its article)
A, B = ONE, TWO
C = "A final decision is expected before the end of the month, the chair said."
LABELLED = {
    "foreign links": (f'<div class="kopf"><a href=/>Willkommen</a></div><div class="inhalt"><p>{A}</p><p>{B}</p><p>{C}</p></div><div class="fuss"><a href=/i>Impressum</a> | <a href=/d>Datenschutz</a></div>', [A,B,C]),
    "sections": (f'{NAV}<main><section><h2>One</h2><p>{A}</p></section><section><h2>Two</h2><p>{B}</p></section></main>{FOOT}', ["One",A,"Two",B]),
    "linked first": (f'{NAV}<main><p><a href="/x">{A}</a></p><p>{B}</p></main>{FOOT}', [A,B]),
    "one short": (f'{NAV}<article><p>One short.</p></article>{FOOT}', ["One short."]),
    "dl": (f'{NAV}<article><p>{A}</p><dl><dt>Term<dd>{B}</dl><p>{C}</p></article>{FOOT}', [A,"Term",B,C]),
    "figure": (f'{NAV}<article><p>{A}</p><figure><img src=x><figcaption>A view of the town hall in the morning.</figcaption></figure><p>{B}</p></article>{FOOT}', [A,"A view of the town hall in the morning.",B]),
    "notice": (f'<div id="cc">We use cookies to improve your visit. <button>Accept</button></div>{NAV}<main><p>{A}</p><p>{B}</p></main>{FOOT}', [A,B]),
    "foreign": (f'<div class="kopf">Willkommen</div><div class="inhalt"><p>{A}</p><p>{B}</p></div><div class="fuss">Impressum | Datenschutz</div>', [A,B]),
    "modal after": (f'{NAV}<main><h1>The Title</h1><p>{A}</p><p>{B}</p></main><div>Sign up for our letter and never miss a story. <button>Join</button></div>{FOOT}', ["The Title",A,B]),
    "aside in article": (f'{NAV}<article><p>{A}</p><aside>Read more about this in our archive.</aside><p>{B}</p></article>{FOOT}', [A,B]),
    "list": (f'{NAV}<article><p>{A}</p><ol><li>First, do this thing.<li>Then, do that one.</ol><p>{B}</p></article>{FOOT}', [A,"First, do this thing.","Then, do that one.",B]),
    "pre": (f'{NAV}<article><p>{A}</p><pre>x = 1\ny = 2</pre><p>{B}</p></article>{FOOT}', [A,"x = 1 y = 2",B]),
    "comments": (f'{NAV}<article><p>{A}</p><p>{B}</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>I think that this is a very bad idea, to be honest.</p></div><div class="comment"><p>So do I.</p></div></section>{FOOT}', [A,B]),
    "german menu": (f'<div class="kopfzeile"><ul><li><a href=1>Start</a><li><a href=2>Aktuelles</a><li><a href=3>Kontakt</a></ul></div><div class="inhalt"><h1>Titel</h1><p>{A}</p><p>{B}</p></div>', ["Titel",A,B]),
    "banner before": (f'<section>Our summer sale ends soon, so be quick. <button>Shop now</button></section>{NAV}<article><h1>Head</h1><p>{A} {B}</p><p>{C}</p></article>{FOOT}', ["Head",f"{A} {B}",C]),
    "two p": (f'<body><p>{A}</p><p>{B}</p>', [A,B]),
    "form": (f'{NAV}<main><p>{A}</p><p>{B}</p><form><label>Your name</label><input><button>Send</button></form></main>{FOOT}', [A,B]),
    "details": (f'{NAV}<article><p>{A}</p><details><summary>More on this</summary><p>{B}</p></details></article>{FOOT}', [A,"More on this",B]),
    "table": (f'{NAV}<article><p>{A}</p><table><tr><th>Year<th>Sum<tr><td>2020<td>12</table><p>{B}</p></article>{FOOT}', [A,"Year","Sum","2020","12",B]),
    "header in article": (f'{NAV}<article><header><h1>The Title</h1></header><p>{A}</p><p>{B}</p></article>{FOOT}', ["The Title",A,B]),
    "nothing": (f'{NAV}{FOOT}', []),
    "address": (f'{NAV}<main><h1>T</h1><p>{A}</p><p>{B}</p></main><footer><address>1 Main Street</address></footer>', ["T",A,B]),
}


@pytest.mark.parametrize("name", sorted(LABELLED))
def test_labelled_pages(name):
    page, blocks = LABELLED[name]
    assert html_extraction.extract([f"<html><body>{page}</body></html>"], *html_extraction.trained()) == ["\n".join(blocks)]


def test_groups_of_pages_change_nothing():
    pages = [f"<html><body>{p}</body></html>" for p, _ in LABELLED.values()] + [None, "", "x" * 5000]
    model = html_extraction.trained()
    assert html_extraction.extract(pages, *model, group=300) == html_extraction.extract(pages, *model)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 6, 10, 40, 300])
def test_articles_in_bare_elements(depth):
    page = f"<html><body>{NAV}{'<div>' * depth}<h1>The Title</h1>{BODY}{'</div>' * depth}{FOOT}"
    assert html_extraction.extract([page], *html_extraction.trained()) == [f"The Title\n{TEXT}"]


@pytest.mark.parametrize("name", sorted(CASES))
def test_ordinary_pages(name):
    page, want = CASES[name]
    assert html_extraction.extract([f"<html><body>{page}</body></html>"], *html_extraction.trained()) == [want]


def test_deep_elements_keep_their_parents():
    nodes = parse(f"<body><div class='outer'><section>{'<div>' * 250}{'</div>' * 260}<p>after</p></section>")
    p = next(n for n in nodes if n.tag == "p")
    assert nodes[p.parent].tag in ("body", "section")
    nodes = parse(f"{'<div>' * 205}<nav>x</nav>")
    assert any(n.tag == "nav" for n in nodes)


def test_long_page_and_many_closing_tags():
    body = "".join(f"<p>Number {i}: {ONE} {TWO if i % 2 else ''}</p>" for i in range(3000))
    got = html_extraction.extract([f"<body>{NAV}<article>{body}</article>{FOOT}", "<div>" * 20000 + "</p></ul>" * 20000], *html_extraction.trained())
    assert got[0].count("\n") == 2999 and got[1] == ""


def test_repeated_rows_and_clashing_columns(spark):
    html = f"<body>{NAV}<article>{BODY}</article>{FOOT}"
    rows = [(1, "u", html, "a", 7, "r")] * 3 + [(None, None, html, "a", 7, "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, role string")
    got = [tuple(r) for r in html_extraction.extract_pages(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, "u", TEXT, len(TEXT))] * 3 + [(None, None, TEXT, len(TEXT))], key=repr)
