"""HTML extraction: the blocks of odd pages, held-out accuracy, and the articles of the given pages."""

import re

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from towerlens.llm import html_blocks, html_extract
from towerlens.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


@pytest.fixture(scope="module")
def model():
    return html_extract.fit()


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("plain\n text &amp &lt;b&#62; &am", ["plain text & <b> &am"]),
        ("<p>a<b>b</b> c<p>d</p>e", ["ab c", "d", "e"]),
        ("<p>x<br>y</p><script>var t='</p>'; <p>no</script><style>q</style>z", ["x", "y", "z"]),
        ("<!-- <p>no</p> --><ul><li>1<li>2</ul><!--> 3 <!--open <p>no", ["1", "2", "3"]),
        ("<a title='x > y' href=q>link</a> <img alt=\"a>b\">more", ["link more"]),
        ("a < b and c<d", ["a < b and c<d"]),
        ("<div><p>open <i>tags", ["open tags"]),
        ("<textarea><p>no</p></textarea><noscript>no</noscript><select><option>no</select>yes", ["yes"]),
        ("<td>1<td>2<tr><td>3", ["1", "2", "3"]),
        ("</p></div>text</b>", ["text"]),
        ("<p class='a\">x</p>\"'>y", ["y"]),
        ("<title>no", []),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths():
    found = html_blocks.blocks('<body><div class="siteNav x2" id=top><ul><li><a href=x>go</a> on</li></ul></div><p>t')
    assert found[0].path == (("body", ()), ("div", ("nav", "site", "top")), ("ul", ()), ("li", ()))
    assert round(found[0].linked, 2) == 0.4
    assert found[1].path == (("body", ()), ("p", ()))


@pytest.mark.parametrize("page", ["<a" * 200_000, '<a b="' * 50_000, "<p>" * 50_000 + "x", "<div>" * 50_000 + "x", "<!--" * 100_000])
def test_hostile_pages_take_linear_time(page):
    assert len(texts(page)) <= 1


def test_held_out_pages(model):
    hit = near = missed = 0
    for names, words, measured, labels in html_extract.training_pages(300, 77):
        read = model.read(names @ model.path, words, measured)
        found = model.scores(*html_extract._padded([read], html_extract.INPUT))[:, 0] >= 0.5
        hit += int((found & (labels > 0)).sum())
        near += int((found & (labels == 0)).sum())
        missed += int((~found & (labels > 0)).sum())
    assert hit / (hit + near) > 0.98 and hit / (hit + missed) > 0.98


def test_kinds_of_parts(model):
    body = "<p>The river ran low that summer, and nobody in the town could say why. It had done so before.</p>"
    page = (
        "<html><head><title>T</title></head><body><header class='site-header'><h1>The Daily</h1></header>"
        "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>News</a></li></ul></nav>"
        "<div class='cookie-banner'><p>We use cookies to improve this site. Accept all of them?</p></div>"
        f"<article><h1>Low water</h1>{body * 4}<div class='ad'>Buy now and save a lot</div>{body}</article>"
        "<aside class='sidebar'><h3>Related</h3><ul><li><a href=/x>Another story</a></li></ul></aside>"
        f"<section id='comments'><h3>2 Comments</h3><div class='comment'><b>Ann says</b>{body}</div></section>"
        "<form class='newsletter'><label>Your e-mail</label><input><button>Send</button></form>"
        "<footer>&copy; 2024 The Daily. All rights reserved.</footer></body></html>"
    )
    text = body[3:-4]
    assert html_extract.Reader(model).texts([page]) == [" ".join(["Low water", *[text] * 5])]


def test_pieces_of_long_pages(model, monkeypatch):
    page = "<nav><a>x</a></nav><article>" + "".join(f"<p>Sentence number {i} of the page.</p>" for i in range(700)) + "</article>"
    whole = html_extract.Reader(model).texts([page, "<p>short one.</p>", None, page[:500]])
    monkeypatch.setattr(html_extract, "STEP_BLOCKS", 50)
    monkeypatch.setattr(html_extract, "PADDED_BLOCKS", 10)
    assert html_extract.Reader(model).texts([page, "<p>short one.</p>", None, page[:500]]) == whole
    assert whole[0].startswith("Sentence number 0") and whole[0].endswith("699 of the page.")


def test_gradients_are_those_of_the_loss():
    rows = html_extract.training_pages(3, 4)

    class Still:
        def random(self, shape, kind=None):
            return np.ones(shape)

    model = html_extract.Labeller(2)
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))

    def loss():
        total = n = 0
        for names, words, measured, labels in rows:
            p = model.scores(*html_extract._padded([model.read(names @ model.path, words, measured)], html_extract.INPUT))[:, 0]
            total -= np.log(np.where(labels > 0, p, 1 - p).astype(np.float64)).sum()
            n += len(labels)
        return total / n

    grads = html_extract._gradients(model, rows, Still())
    for name in model.NAMES:
        value, step = getattr(model, name), 1e-2
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        before = value[at]
        value[at] = before + step
        up = loss()
        value[at] = before - step
        down = loss()
        value[at] = before
        assert abs((up - down) / (2 * step) - grads[name][at]) < 0.02 * abs(grads[name][at]) + 1e-4, name


def test_odd_table(spark, model):
    rows = [
        (1, "u", None, "t", 1), (1, "u", None, "t", 1), (None, None, "", None, None), (2, None, "<p>" + "x" * 3_000_000, None, 2),
        (3, "v", "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><footer>&copy; 2024</footer>", "", 3),
    ]
    made = html_extract.extracted(spark.createDataFrame(rows, SCHEMA), model)
    assert made.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, made.collect()), key=repr)
    assert len(got) == 5 and all(n == len(t) for _, _, t, n in got)
    assert (1, "u", "", 0) in got and (None, None, "", 0) in got and (3, "v", "", 0) in got
    assert html_extract.extracted(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_articles_of_the_given_pages(spark):
    sf = f"{DATA}/sf0.01"
    want = {}
    for key, page in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        article = re.search("<article>(.*?)</article>", page, re.S).group(1)
        want[key] = html_blocks.plain(re.sub("</?b>", "", re.sub("</?(?!b>)[a-z0-9]+>", " ", article)))
    got = {r.page_id: r.text for r in QUERIES["op13_html_extract"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)
