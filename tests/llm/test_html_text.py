import html
import random
import re

from kilonova.llm.html_text import extract_text, main_text

P1 = "This is the first paragraph of the story, with commas, and enough words to be taken for running text by anyone."
P2 = "A second one follows, it is nearly as long, and it ends the matter, more or less, for the time being at least."


def test_pages_of_the_table(spark):
    """The generated pages hold one <article>; its blocks are the text."""
    rows = extract_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(raw)
    for r in rows:
        body = re.search("<article>(.*?)(?:</article>|<footer>|$)", raw[r.row.page_id], re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*(?:>|$)", "", x))).strip() for x in re.split("</?(?:p|h1)>", body))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_surroundings_go():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
    <nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We use cookies, really, a lot of them, for your good, as you know.</p></div>
    <div id="wrap" class="with-sidebar"><div class="content"><h2>Head &amp; line</h2><p>{P1}<p>{P2}
    <div class="ad">Buy this, now, and that, and more, much more, cheaper than ever, today, only today, at all our shops.</div>
    <ul><li>one<li>two <b>bold</b>&nbsp;x</ul><form><p>Your mail, please, all of it</p><input value=x></form></div>
    <div class="sidebar"><p>Other stories, many of them, are here, and here, and there, all over the place, do read them all.</p></div>
    <section id="comments"><p>I agree, with all of this, and with more, as I said before, often, and will say again, in time.</p></section></div>
    <footer>&copy; all, rights, reserved</footer><script>var a = "<p>no, no, no</p>"</script></body></html>"""
    assert main_text(page) == f"Head & line\n{P1}\n{P2}\none\ntwo bold x"


def test_siblings_join_and_links_count_less():
    links = "".join(f"<p><a href=/{i}>A long line of link text, number {i}, with commas, to many pages, of this site, and others</a></p>" for i in range(9))
    page = f"<div><div>{links}</div><div><p>{P1}</p><p>{P2}</p></div><p>{P1}</p></div>"
    assert main_text(page) == f"{P1}\n{P2}\n{P1}"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p> \n </p>") == main_text("<script>x</script>") == ""
    assert main_text("plain &lt;text&gt;  only") == "plain <text> only"
    assert main_text("<article><p>cut in a tag</p><p clas") == "cut in a tag"
    assert main_text("<article><p>a < b and &am") == "a < b and &am"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    long = "word, " * 200_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert main_text("<article><!-- <p>no</p> --><p>yes<!-- open") == "yes"


def test_frames(spark):
    cols = "page_id long, url string, html string, text string, n_chars int, row string"
    rows = [(1, "u", f"<article><p>{P1}</p></article>", "t", 1, "r")] * 2 + [(None, None, None, None, None, None)]
    got = extract_text(spark.createDataFrame(rows, cols)).collect()
    assert sorted((r.text, r.n_chars, r.row.text) for r in got[:3] if r.text) == [(P1, len(P1), "t")] * 2 and len(got) == 3
    assert extract_text(spark.createDataFrame([], cols)).count() == 0


def test_head_without_end_tag():
    want = f"{P1}\n{P2}"
    body = f"<p>{P1}<p>{P2}"
    for head in ("<head><title>T</title>", "<head><meta charset=utf-8><noscript><style>p{}</style></noscript><link rel=x>", "<html><head>\n<script>a()</script>\n", "<head>"):
        assert main_text(f"{head}<body class=x>{body}") == main_text(f"{head}{body}") == main_text(f"{head}</head><body>{body}") == want
    assert main_text(f"<head><noscript><body>{body}") == want
    assert main_text("<head><title>T</title>only text") == "only text"
    assert main_text("<head><title>T</title>some <b>text</b>") == "some text"
    assert main_text("<head><title>T</title> <meta name=a> ") == ""


LINKS = "<ul>" + "".join(f"<li><a href=/{i}>Page number {i}</a>" for i in range(6)) + "</ul>"


def test_text_beside_the_best_container():
    assert main_text(f"<body><h1>Title</h1><div class=entry-content><p>{P1}</div><ul><li>one<li>two</ul>") == f"Title\n{P1}\none\ntwo"
    # the article lies straight in the body, a small container has the better name
    page = f"""<body><h1>Title</h1><p>{P1}</p><pre>x = 1</pre><table><tr><td>a<td>b</table><p>{P2}<ul><li>one</ul>
        <div class="content text"><p>A small box.</p></div><p>See <a href=/m>the manual</a> for the rest of it.</p>{LINKS}"""
    assert main_text(page) == f"Title\n{P1}\nx = 1\na\nb\n{P2}\none\nA small box.\nSee the manual for the rest of it."
    # bare text, other tags, other levels; a list of links goes with its heading
    page = f"""<div><h1>Title</h1><div><div class=content><p>{P1}</p><p>{P1}</p></div>bare <b>text</b><section><p>{P2}</p></section><h3>More</h3>{LINKS}</div>
        <blockquote>Quoted.</blockquote></div>{LINKS}"""
    assert main_text(page) == f"Title\n{P1}\n{P1}\nbare text\n{P2}\nQuoted."
    assert main_text(f"<body>{LINKS}<div>left</div><div>right</div>") == "left\nright"


def test_pages_without_an_article():
    """Random pages: every part of the text stays in order, every surrounding goes."""
    rnd = random.Random(11)
    away = [f"<nav>{LINKS}</nav>", f"<div class=sidebar><p>Other stories</p></div>", f"<footer><p>{P1}</p></footer>"]
    for n in range(300):
        parts, want = [f"<p>{P1}</p>"], [P1]
        for i in range(rnd.randint(2, 9)):
            t = f"{rnd.choice([P1, P2])} {i}"
            html_of = [f"<p>{t}</p>", f"<h2>Head {i}</h2><p>{t}</p>", f"<ul><li>{t}<li>x</ul>", f"<pre>{t}</pre>", f"<blockquote>{t}</blockquote>",
                       f"<section><p>{t}</p></section>", f"<div>{t}</div>", f"<table><tr><td>{t}</table>", f"<p>Short <a href=/>li</a> {i}</p>",
                       f"<div class='entry-content'><p>{t}</p></div>"]
            k = rnd.randrange(len(html_of))
            parts.append(html_of[k])
            want += [f"Head {i}", t] if k == 1 else [t, "x"] if k == 2 else [f"Short li {i}"] if k == 8 else [t]
            if rnd.random() < 0.3:
                parts.append(rnd.choice(away))
        page = "".join(parts)
        for whole in (f"<body>{page}", f"<body><div id=wrap>{page}</div></body>", f"<body>{away[0]}<div><div class=main>{page}</div></div>{away[1]}"):
            assert main_text(whole) == "\n".join(want), whole


def test_odd_nesting_takes_linear_time():
    """Shapes of a megabyte that a climb per tag or a backtracking pattern would work on for hours."""
    import time

    n = 30_000
    pages = {
        "".join(f"<div>text {i}" for i in range(n)): "\n".join(f"text {i}" for i in range(n)),
        "<b>" * n + "".join(f"<p>para {i}" for i in range(n)): "\n".join(f"para {i}" for i in range(n)),
        "<a b " * n + '"': "", '<a b="' + "<a b " * n: "", "<p>x" + "<" * n: "x" + "<" * n,
        "<i><div>" + "<b></i>x" * n: "x" * n, "<ul>" + "<li><div>x" * n: "\n".join("x" * n),
        "<table>" + "<tr><td><table>" * n + "x": "x", "<div class=ad>" * n + "x": "x", "<div class=sidebar>" * n + "<article>x": "x",
        "<div>" + "</span>x" * n: "x" * n, "<!--" * n: "",
    }
    began = time.time()
    for page, want in pages.items():
        assert main_text(page) == want, page[:60]
    assert time.time() - began < 120


def test_quotes_and_spaces():
    assert main_text("<p title='a > b'>one</p><p t=\"x>y\" u = 'z>'>two</p>") == "one\ntwo"
    assert main_text("<p it's>one</p><p a=\">two</p>") == "one\ntwo"
    assert main_text("<p>a b　\u0085c d&nbsp;e​f</p>") == "a b c d e​f"
    assert main_text("<td>x</table></td>y<td><b>z</td></b>w") == "x\ny\nz\nw"
