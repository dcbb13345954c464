import re

import pytest

from tidelog.llm import pages as P

SENTENCE = "One sentence of some words that tells a thing."
SHELL = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other page</a></li></ul></nav>{}<footer>&copy; someone</footer></body></html>'
LABELLED = [SHELL.format(f'<div class="ad">Buy this</div><article><h1>Head</h1><p>{SENTENCE}<br><p><b>More.</b> {SENTENCE}</p></article>')] * 5
WEIGHTS = P.learn(LABELLED)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>x  y\n z<p>caf&eacute; &lt;b&gt; &#x41;</article>", "A & B\n\nx y z\n\ncafé <b> A"),
        (f'<div class="sidebar"><p>{SENTENCE}</p></div><article><p>{SENTENCE}</p><aside>note</aside><p>End.</p></article>', f"{SENTENCE}\n\nEnd."),
        (f'<div id="content"><p>{SENTENCE}</p><p>{SENTENCE}</p></div><div class="comments"><p>I like it a lot, really.</p></div>', f"{SENTENCE}\n\n{SENTENCE}"),
        (f"<main><p>{SENTENCE}<form><p>Name <input name=a></form><p>After</main>", f"{SENTENCE}\n\nAfter"),
        (f'<article><p>{SENTENCE}</p><!-- <p>no</p> --><style>p{{}}</style><div class="cookie-notice">We use cookies</div><p title="a>b">Last</p></article>', f"{SENTENCE}\n\nLast"),
        (f'<article><p>{SENTENCE}</p><section class="comments"><p>First!</p></section></article>', SENTENCE),
        (f"<article><p>{SENTENCE} <a href=x>with a link</a> in it</p></article>", f"{SENTENCE} with a link in it"),
        (f'<article><p>{SENTENCE}</p><div class="share-price"><p>{SENTENCE}</p></div></article>', f"{SENTENCE}\n\n{SENTENCE}"),
        (f'<main><p>{SENTENCE} {SENTENCE}</p><article class="comment"><p>{SENTENCE}</p></article></main>', f"{SENTENCE} {SENTENCE}"),
        (f'<main><article><p>{SENTENCE}</p></article><article class="comment reply"><p>I like it.</p></article></main>', SENTENCE),
        (f'<article><p>{SENTENCE}</p><div class="comment-list"><p>{SENTENCE}</p></div></article>', SENTENCE),
        ("", ""),
    ],
)
def test_cases(body, text):
    assert P.extract(SHELL.format(body), WEIGHTS) == text


def test_unusual_pages():
    assert P.extract(None, WEIGHTS) == "" == P.extract("", WEIGHTS) == P.extract("<p", WEIGHTS)
    assert P.extract("just words", WEIGHTS) == "just words"
    long = "<article>" + f"<p>{SENTENCE}" * 20_000 + "</article>"
    assert P.extract(long, WEIGHTS) == "\n\n".join([SENTENCE] * 20_000)


def test_best_run_equals_trying_all():
    """The scan's run has the highest sum of all runs."""
    for body in (f"<article><p>{SENTENCE}</p></article>", f"<div>a b</div><div><a>x y z</a><p>{SENTENCE}</p></div><p>ok</p>"):
        parts = list(P.pieces(SHELL.format(body)))
        marked = any(k == "text" and v[1][2] and v[2] and not v[0].isspace() for k, v in parts)
        score = [(0 if v[1] else WEIGHTS.tag(v[0])) if kind == "tag" else WEIGHTS.text(v, marked) for kind, v in parts]
        top = max(((sum(score[i:j]), -j, i) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)))
        words = " ".join(" ".join(v[0].split()) for k, v in parts[top[2] : -top[1]] if k == "text" and v[2]).split()
        assert P.extract(SHELL.format(body), WEIGHTS).split() == words


def test_query_shape(spark):
    rows = [(1, "u", SHELL.format(f"<article><p>{SENTENCE}</p></article>"), 3), (2, None, None, 3), (1, "u", "", 3), (None, "v", "<p>x", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = P.main_text(df, P.train(df)).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == [(0, "v", 1), (1, "u", 0), (1, "u", len(SENTENCE)), (2, "", 0)]
    assert P.main_text(df.limit(0), P.train(df.limit(0))).collect() == []


def test_words_in_pages_of_the_test_data(spark):
    """On pages that mark their article the text is that element's, by a plainer parse."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in P.main_text(df, P.train(df)).join(df.select("page_id", "html"), "page_id").collect():
        import html

        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article.replace("<br>", " ").replace("<b>", ""))]
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_labels_of_nested_articles():
    """An article in a main has the weights of an article without one: a tag inside is inside at any depth."""
    page = SHELL.format(f"<article><h1>Head</h1><p>{SENTENCE}</p><p>{SENTENCE}</p></article>")
    nested = page.replace("<article>", "<main><article>").replace("</article>", "</article></main>")
    one, two = P.learn([page] * 3), P.learn([nested] * 3)
    assert one.tags["p"] == two.tags["p"] == -0.05 and one.words == two.words


def test_a_class_is_learnt():
    """A class that names furniture is taken for main text where labelled pages have their sentences under it."""
    page = SHELL.format(f'<article><div class="notices"><p>{SENTENCE} {SENTENCE}</p></div></article>')
    assert P.extract(page, WEIGHTS) == ""
    assert P.extract(page, P.learn([page] * 5)) == f"{SENTENCE} {SENTENCE}"
