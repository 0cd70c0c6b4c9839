import pytest

from sitewright.llm.html_text import extract, main_text

NAV = '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'
P1, P2, P3 = ("Long first paragraph " * 12).strip(), ("Second text, also long " * 9).strip(), "Short."


def page(body, tail="</body></html>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body>{body}{tail}"


@pytest.mark.parametrize(("body", "text"), [
    (f"{NAV}<div class='ad'>Buy now</div><article><h1>Head &amp; line</h1><p>{P1}</p><p>{P3}</p></article><footer>&copy; x</footer>", f"Head & line\n{P1}\n{P3}"),
    (f"{NAV}<article><h1>H</h1><p><b>{P1}<br><p>{P2}</article><footer>f</footer>", f"H\n{P1}\n{P2}"),
    (f"<header><a href=/>Site</a><p>Slogan of the site</p></header><main><header><h1>H</h1></header><p>{P1}</p></main><aside>Side {P3}</aside>", f"H\n{P1}"),
    (f"<div id=content><p>{P1}</p><div class='comments'><p>{P2}</p></div><p>{P2}</p></div><div class='sidebar'><p>{P2}</p></div>", f"{P1}\n{P2}"),
    (f"<div class='cookie-notice'>We use cookies {P2}</div><div><h2>Title</h2><p>{P1}</p><form>Name <input> <button>Send</button></form></div>", f"Title\n{P1}"),
    (f"<div>{P1}<br>{P2}</div>", f"{P1} {P2}"),
    (f"<table><tr><td>{P1}<td>{P2}</table>", f"{P1}\n{P2}"),
    (f"<p>a &lt;b&gt; c &nbsp; d\n\t e</p><p>{P1}</p>", f"a <b> c d e\n{P1}"),
    (f"<!-- {P2} --><p>{P1}</p><script>{P2}", P1),
    (f"<p>1 < 2 and {P1}</p>", f"1 < 2 and {P1}"),
    (f"<p>x<p hidden>{P2}</p><p style='display: none'>{P2}</p><p>{P1}", f"x\n{P1}"),
])
def test_pages(body, text):
    assert main_text(page(body)) == text
    assert main_text(page(body, "")) == text


def test_odd_input():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<nav>x</nav>") == ""
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<p>" * 5000 + "deep") == "deep"
    assert main_text("<div>" * 5000 + "deep") == "deep"
    assert main_text("<" * 300 + "x") != ""
    assert main_text("<a href='x" * 50) is not None
    long = "word " * 100_000
    assert main_text(page(f"<article><p>{long}</p></article>")) == long.strip()


def test_extract_keeps_rows_and_columns(spark):
    rows = [(1, "u", None, "x"), (1, "u", page(f"<p>{P1}</p>"), "x"), (2, None, "", None), (1, "u", page(f"<p>{P1}</p>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "main_text"]
    assert sorted(r["main_text"] for r in got.collect()) == ["", "", P1, P1]
    assert extract(df, name="text").columns == ["page_id", "url", "text"]
    assert extract(df.limit(0)).count() == 0


ART = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p>"
TEXT = f"Title\n{P1}\n{P2}"
SAID = "".join(f"<div class=comment><p>Reader {i} says: {P2}</p></div>" for i in range(9))


@pytest.mark.parametrize(("body", "text"), [
    (f"{NAV}<div class='layout has-sidebar'>{ART}</div>", TEXT),
    (f"{NAV}<div id='page' class='comments-open'>{ART}</div><div class='site-footer'>{P3}</div>", TEXT),
    (f"<div class='sidebar-left'>{ART}<div class='sidebar'><p>{P2}</p></div></div><div class='copyright'>{P3}</div>", TEXT),
    (f"<div>{P3}</div><div class='social'>{ART}</div>", TEXT),
    (f"<div class='fixed-header'>{ART}</div>", TEXT),
    (f"<article>{ART}<h2 id='related-work'>Related work</h2><p>{P2}</p><h2 id='search'>Search</h2><p>{P1}</p></article>", f"{TEXT}\nRelated work\n{P2}\nSearch\n{P1}"),
    (f"<div class=doc><h1>Title</h1><section id='search'><h2>Find</h2><p>{P1}</p></section><section id='copyright'><h2>C</h2><p>{P2}</p></section></div>", f"Title\nFind\n{P1}\nC\n{P2}"),
    (f"<h1>Title</h1><section id='search'><h2>Search</h2><p>{P1}</p></section><section id='notice'><h2>Notice</h2><p>{P2}</p></section>", f"Title\nSearch\n{P1}\nNotice\n{P2}"),
    (f"<div id=comments><div>{P1}</div><div>{P2}</div></div>", f"{P1}\n{P2}"),
])
def test_marks_on_a_frame_or_a_section_do_not_lose_the_article(body, text):
    assert main_text(page(body)) == text
    assert main_text(page(body, "")) == text


@pytest.mark.parametrize("body", [
    f"<div id=page><div class=post>{ART}</div><div id=comments>{SAID}</div></div>", f"<div>{ART}<div class='related-posts'><p>{P2}</p></div></div>",
    f"<main>{ART}</main><div class=sidebar>{f'<p>{P2}</p>' * 6}</div>", f"<div class=post>{ART}</div><ol class=commentlist><li>{P1}<li>{P1}<li>{P1}</ol>",
])
def test_marks_still_leave_out_what_stands_beside_the_article(body):
    assert main_text(page(body)) == TEXT


@pytest.mark.parametrize(("body", "text"), [
    (f"<form id='aspnetForm'><input type=hidden name=state value=1><div><label>Search</label><input><button>Go</button></div><div>{ART}</div></form>", TEXT),
    (f"<form id='aspnetForm'><input type=hidden name=state value=1>{ART}</form><footer>f</footer>", TEXT),
    (f"<form><p>{P1}</p><input><input><select><option>a</select><input type=submit></form>", P1),
    (f"<form><div><div class=post>{ART}</div><div class=comments>{SAID}</div><fieldset><label>Name</label><input><label>Text</label><textarea></textarea></fieldset></div></form>", TEXT),
    (f"<article>{ART}<p>Let <math><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation>x+1</annotation></math> be.</p></article>", f"{TEXT}\nLet x+1 be."),
    (f"<article>{ART}<p>A <label>label's text</label> here</p><fieldset><legend>Note</legend><p>{P1}</p></fieldset></article>", f"{TEXT}\nA label's text here\nNote\n{P1}"),
    (f"<article>{ART}<dialog open><p>{P1}</p></dialog><object data=x><p>{P2}</p></object></article>", f"{TEXT}\n{P1}\n{P2}"),
])
def test_forms_around_the_article_and_formulas_in_it_stay(body, text):
    assert main_text(page(body)) == text
    assert main_text(page(body, "")) == text


@pytest.mark.parametrize(("body", "text"), [
    ("<h1>Contact</h1><form><label>Name</label><input><label>Mail</label><input><textarea></textarea><button>Send</button></form>", "Contact"),
    (f"<article>{ART}<form><p>Subscribe to our letter now.</p><input type=email><button>Go</button></form></article>", TEXT),
    (f"<dialog open><p>{P1}</p></dialog><article>{ART}</article>", TEXT),
])
def test_forms_and_windows_are_still_left_out(body, text):
    assert main_text(page(body)) == text


@pytest.mark.parametrize("start", ["<form>", "<div class=ad>", "<section id=search>", "<article><div class=sidebar>", "<h1><div class=comment>", "<div id=search><h1>"])
def test_deep_pages_with_marks_and_forms(start):
    assert main_text(start * 2000 + "deep") == "deep"


def test_depth_costs_linear_time():
    import time

    started = time.perf_counter()
    assert main_text("<div>" * 200_000 + "hello world") == "hello world"
    assert "end" in main_text("<p>" + "<b><i></b>" * 50_000 + "end")
    assert time.perf_counter() - started < 30
