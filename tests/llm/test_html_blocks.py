"""Main text of varied pages, block kind by block kind, with the weights the registered query fits on the test pages."""

import time

import pytest
from pyspark.sql import functions as F

from skeinrank.llm import html_extract as he

LINES = ("The river rose in the night and the old bridge did not hold.", "Nobody in the village had seen such water for forty years.", "By morning the road was open again.", "They counted the cost slowly, house by house.")
KINDS = {
    "paragraph": "<p>{}</p>", "cell": "<table><tr><td>{}</td><td>cell two</td></tr></table>", "head cell": "<table><thead><tr><th>{}</th></tr></thead></table>", "code": "<pre>{}</pre>", "item": "<ul><li>{}</li></ul>",
    "quotation": "<blockquote>{}</blockquote>", "caption": "<figure><figcaption>{}</figcaption></figure>", "term": "<dl><dt>term</dt><dd>{}</dd></dl>", "heading": "<h2>{}</h2>", "box": "<div>{}</div>", "bare": "{}",
}
PARTS = ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', "<main><article>{}</article></main>")
HEADS = ("", "<header><h1>Site name</h1></header>", '<nav><a href="/">Home</a> <a href="/b">About</a></nav>', '<header><h1>Site</h1><p>Tagline of it</p></header><nav><ul><li><a href="x">Home</a></li></ul></nav>')


@pytest.fixture(scope="module")
def weights(spark):
    return he.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def labelled(weights, page):
    model = he.Labeller()
    model.p = weights
    blocks = he.blocks(page)
    return he.main_text(blocks, he._scores(model, [blocks])[0] > 0) if blocks else ""


def test_every_kind_of_block_is_kept_and_no_header(weights):
    right, all_ = {}, 0
    for kind, form in KINDS.items():
        for part in PARTS:
            for head in HEADS:
                body = f"<h1>The flood</h1><p>{LINES[0]}</p>" + form.format(LINES[1]) + f"<p>{LINES[2]}</p>" + form.format(LINES[3])
                page = f"<html><head><title>x</title></head><body>{head}{part.format(body)}<aside><p>Related stories</p></aside><footer>Copyright 2024</footer></body></html>"
                want = "\n".join(b.text for b in he.blocks(body))
                right[kind] = right.get(kind, 0) + (labelled(weights, page) == want)
                all_ += 1
    assert sum(right.values()) >= 0.95 * all_ and min(right.values()) >= 12, right


def test_text_without_parts_and_an_articles_own_header(weights):
    assert labelled(weights, "Just plain text of a page, no tags at all.") == "Just plain text of a page, no tags at all."
    assert labelled(weights, f"<p>{LINES[0]}</p><p>{LINES[1]}</p>") == f"{LINES[0]}\n{LINES[1]}"
    assert labelled(weights, f"<article><header><h1>Title</h1><p>by line</p></header><p>{LINES[0]}</p></article>") == f"Title\nby line\n{LINES[0]}"


def test_clashing_columns_repeated_and_missing_rows(spark):
    page = f"<nav><a href='/'>Home</a></nav><article><p>{LINES[0]}</p></article>"
    rows = [(1, "u", page, "a", 1), (1, "u", page, "a", 1), (None, None, page, None, 2), (2, "v", None, "b", 3)]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), epochs=30)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 4
    assert got.where("page_id = 1").distinct().count() == 1 and got.where("page_id = 2").first().text == ""
    assert he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").where(F.lit(False))).count() == 0


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>x" * 60_000, '<p title="' * 100_000, "<p><div>" + "<x>" * 30_000 + "</p>" * 30_000, "<p " + " style=a" * 120_000 + ">x", "<!" * 400_000, "<script " * 120_000, "<p>hello there.</p>" * 60_000])
def test_long_pages_take_seconds(weights, page):
    began = time.time()
    labelled(weights, page)
    assert time.time() - began < 60


def test_slices_score_as_a_whole(weights):
    model = he.Labeller()
    model.p = weights
    blocks = he.blocks("".join(f"<div class='c{i % 7}'><p>word {i} of it.</p></div>" for i in range(500)))
    x, mask = he.padded([he.vectors(blocks)])
    a, b = model.score(lambda i, j: x[:, i:j], mask, width=10**6), model.score(lambda i, j: x[:, i:j], mask, width=64)
    assert abs(a - b).max() < 1e-9 and len(model._run(x, mask, "f")[1]) == 500
