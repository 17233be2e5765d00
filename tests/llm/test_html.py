"""Extraction against pages with a known article."""

import pytest

from sigloom.llm.html_blocks import blocks, features
from sigloom.llm.html_extract import article_blocks, op3_html, trained
from sigloom.llm.html_training import labelled_pages


@pytest.fixture(scope="module")
def model():
    return trained()


def text(page, model):
    return "\n".join(b.text for b in article_blocks(page, model))


def test_blocks():
    page = "<title>t</title><script>var a='<p>x</p>';</script><!-- <p>no</p> --><div>a&amp;b <b>c<br>d</div><ul><li>one<li>two</ul><p>x &lt;\n y<p>z<table><tr><td>1<td>2</table>tail"
    assert [b.text for b in blocks(page) if not b.hidden] == ["a&b c", "d", "one", "two", "x < y", "z", "1", "2", "tail"]
    assert blocks(None) == [] and blocks("") == [] and features([]) == []
    assert [b.text for b in blocks("<p>open <a href='x'>link") if not b.hidden] == ["open link"]


def test_held_out_accuracy(model):
    rows = labelled_pages(150, 12345)
    good = sum(p == y for row, labels in rows for p, y in zip(model.decode(features(row)), labels, strict=True))
    assert good / sum(len(y) for _, y in rows) > 0.99


PARTS = {
    "menu": "<nav><ul><li><a href='/a'>Alpha</a></li><li><a href='/b'>Beta</a></li></ul></nav>", "header": "<header><h2>The Site</h2><p>Our motto here.</p></header>", "ad": "<div class='ad'>Buy this now, please.</div>",
    "cookie": "<div id='cookie-banner'><p>We use cookies. They are good for you.</p><button>OK</button></div>", "aside": "<aside><h3>Related</h3><p>Other stories that you may read next.</p></aside>",
    "form": "<form><label>Your name</label><input><p>We never share it.</p></form>", "comments": "<section class='comments'><h3>Two comments</h3><div class='comment'><p>I agree with all of this, and more.</p></div></section>",
    "footer": "<footer>&copy; The Site &middot; All rights are reserved.</footer>",
}


@pytest.mark.parametrize("part", sorted(PARTS))
@pytest.mark.parametrize("core", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
def test_parts_are_left_out(model, part, core):
    article = "<h1>A title</h1><p>The first paragraph tells a story, at some length, of what was.</p><ul><li>One point.</li><li>Another one.</li></ul><p>It ends here.</p>"
    want = "A title\nThe first paragraph tells a story, at some length, of what was.\nOne point.\nAnother one.\nIt ends here."
    page = "<html><body>" + (PARTS[part] if part in ("menu", "header", "ad", "cookie") else "") + core.format(article) + (PARTS[part] if part not in ("menu", "header") else "") + "</body></html>"
    assert text(page, model) == want


@pytest.mark.parametrize("extra", ["<ul class='commentlist'><li>I agree with it, and more.</li></ul>", "<div id='siteFooterLinks'><a href='/i'>Imprint</a></div>", "<div class='cookieconsent'><p>We use cookies to make this better.</p></div>", "<div role='navigation'><a href='/'>Home</a></div>"])
def test_longer_names_tell_too(model, extra):
    assert text(f"<body><article><h1>T</h1><p>A story, told at length, of what was.</p></article>{extra}</body>", model) == "T\nA story, told at length, of what was."


def test_query(spark, data):
    out = op3_html(spark, data).collect()
    assert len(out) == spark.read.parquet(f"{data}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in out)


def test_odd_pages(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<p>" * 500 + "deep"), (5, "u", "<<<>>> <p a=\"x>y\">ok</p"), (6, "u", "<script>never closed"), (None, "u", "<article><p>Fine words, in a row.</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in op3_html(spark, str(tmp_path)).collect()}
    assert len(out) == 7 and out[1].text == "" and out[2].n_chars == 0 and out[6].text == "" and out[None].text == "Fine words, in a row."
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert op3_html(spark, str(tmp_path)).count() == 0


ARTICLE = "<h1>A title</h1><p>The first paragraph tells a story, at some length, of what was.</p><p>It went on for a while. Then it ended.</p>"
ARTICLE_TEXT = "A title\nThe first paragraph tells a story, at some length, of what was.\nIt went on for a while. Then it ended."


@pytest.mark.parametrize("part", ["", "footer", "comments", "aside", "cookie"])
@pytest.mark.parametrize(
    "wrapper",
    [
        "<body class='has-sidebar'><article>{}</article>{}", "<body class='page comments-open cookie-bar-on'><article>{}</article>{}", "<body class='has-sidebar'><div class='content'>{}</div>{}", "<body class='no-sidebar menu-open'><div>{}</div>{}",
        "<div class='layout-with-sidebar'><div class='post'>{}</div></div>{}", "<form id='aspnetForm'><div class='content'>{}</div>{}</form>", "<form method='post'><div>{}</div>{}</form>", "<div class='sidebar-layout'><div>{}</div>{}</div>",
        "<div class='widget widget-article'><article>{}</article></div>{}", "<body class='modal-open'>{}{}", "<table><tr><td>{}</td></tr></table>{}", "<div class='promo-page'><div class='story'>{}</div></div>{}",
    ],
)
def test_wrappers_named_for_a_layout_are_no_boilerplate(model, wrapper, part):
    assert text(wrapper.format(ARTICLE, PARTS[part] if part else ""), model) == ARTICLE_TEXT


def test_comments_longer_than_the_article(model):
    talk = "<section class='comments'>" + "".join(f"<article><b>Ann {k}</b><p>I do not agree with a word of this, and I shall say so at length, once more.</p></article>" for k in range(12)) + "</section>"
    assert text(f"<body><article>{ARTICLE}</article>{talk}</body>", model) == ARTICLE_TEXT


def test_broken_quotes_and_signs_without_width(model):
    assert text('<article><p>See <a href="foo>the link</a> here, at length of words.</p></article>', model) == "See the link here, at length of words."
    assert text("<article><p title=it's>A <b don't>bold</b> word, and more of them.</p></article>", model) == "A bold word, and more of them."
    assert text("<article><p>zero​width holds, and <math><mi>x</mi><mo>=</mo><mn>2</mn></math> too.</p></article>", model) == "zero​width holds, and x=2 too."


def test_long_and_deep_pages(model):
    long = "<article>" + "".join(f"<p>Paragraph {k} of a long story, which goes on and on.</p>" for k in range(20000)) + "</article>"
    assert text(long, model).count("\n") == 19999
    deep = "<div>" * 20000 + ARTICLE
    assert text(deep, model) == ARTICLE_TEXT


def test_viterbi_and_marginals_agree_with_enumeration(model):
    import itertools

    import numpy as np

    row = blocks("<body><nav><a href='/'>Home</a></nav><article>" + ARTICLE + "</article><footer>&copy; us</footer></body>")
    s = model.scores(*model._ids(features(row)))
    n = len(s)
    every = list(itertools.product((0, 1), repeat=n))
    total = np.array([sum(s[k, y] for k, y in enumerate(ys)) + sum(model.pair[a, b] for a, b in zip(ys, ys[1:], strict=False)) for ys in every])
    assert tuple(model.decode(features(row))) == every[int(total.argmax())]
    p = np.exp(total - total.max())
    p /= p.sum()
    one, two = model.marginals(s)
    assert np.allclose(one[:, 1], [sum(q for q, ys in zip(p, every, strict=True) if ys[k]) for k in range(n)])
    pairs = [[sum(q * sum(z == (a, b) for z in zip(ys, ys[1:], strict=False)) for q, ys in zip(p, every, strict=True)) for b in (0, 1)] for a in (0, 1)]
    assert np.allclose(two, pairs)


def test_repeated_rows_and_columns_of_any_name(spark):
    from sigloom.llm.html_extract import extract

    rows = [(k % 3, "u", f"<article>{ARTICLE}</article>", "mine", 7) for k in range(9)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert {(r.text, r.n_chars) for r in out.collect()} == {(ARTICLE_TEXT, len(ARTICLE_TEXT))} and out.count() == 9


OLD = {
    "<html><head><title>T</title></head><body>This is the first line of a story, told plainly.<br>It goes on here, and has another sentence. And one more.<br><br>The end comes at last.</body></html>": "This is the first line of a story, told plainly.\nIt goes on here, and has another sentence. And one more.\nThe end comes at last.",
    "Just a text with no tags at all, which goes on for a while. It has two sentences.": "Just a text with no tags at all, which goes on for a while. It has two sentences.",
    "<body>One line of text, <b>bold words</b> and more of it.<br>Second line, with a stop.<br>&copy; 2004 Me</body>": "One line of text, bold words and more of it.\nSecond line, with a stop.",
    "<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td><p>The story begins here, and it is a good one. It has sentences.</p><p>It goes on for long, as stories do.</p></td></tr><tr><td colspan=2>&copy; 2003 Somebody</td></tr></table>": "The story begins here, and it is a good one. It has sentences.\nIt goes on for long, as stories do.",
    "<html><body><table width=100%><tr><td>My Site</td></tr><tr><td><a href=/a>Home</a> | <a href=/b>News</a></td><td>Text in a cell, with line breaks, is the article.<br>It has a second line.</td></tr><tr><td>Copyright 2003 Someone</td></tr></table></body></html>": "Text in a cell, with line breaks, is the article.\nIt has a second line.",
    "<article><h1>On sums</h1><p>We know that <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is the sum of both.</p></article>": "On sums\nWe know that a+b is the sum of both.",
}


def test_pages_in_old_layouts():
    """No element that holds a block, and layouts by tables."""
    model = trained()
    for page, text in OLD.items():
        assert "\n".join(b.text for b in article_blocks(page, model)) == text
