"""HTML extraction where ratios, not element names, must decide, and edge cases through Spark."""

import random
import time

import pytest

from folio.llm import html

A = ["The first paragraph of the story is long enough to be text, with commas, and goes on for a while.", "The second one is as long, and it tells more of the same story in other words, to the end of it.", "Short one.", "A third long paragraph ends the story with one more sentence of about the same number of words."]
LINKS = "".join(f"<div><a href='/{k}'><b>Topic</b> <i>{k}</i></a></div>" for k in range(12))


def page(inner):
    return f"<html><body><div class='x1'>{LINKS}</div><div class='x2'>{inner}</div><div class='x3'>{LINKS}</div></body></html>"


def test_ratios_choose_the_region(monkeypatch):
    story = "".join(f"<p>{t}</p>" for t in A)
    assert html.extract(page(story)) == " ".join(A)
    assert html.extract(page(f"<div>{story}</div><div>{story}</div>")) == " ".join([*A, *A])
    monkeypatch.setattr(html, "smoothed", lambda values, sigma=0: [1.0] * len(values))
    assert "Topic" in html.extract(page(story))  # without ratios the lists stay


def test_smoothing_keeps_short_lines_between_long_ones(monkeypatch):
    story = "".join(f"<p>{t}</p>" for t in A)
    both = f"<html><body><div><div>{story}</div><div>{LINKS}</div></div></body></html>"
    assert html.extract(both) == " ".join(A)
    values = [0.0, 0.0, 30.0, 1.0, 30.0, 0.0, 0.0]
    assert html.smoothed(values)[3] > 10 > html.smoothed(values)[0] and sum(html.smoothed([2.0] * 9)) == pytest.approx(18)


def test_marked_sections_and_text_outside_elements():
    assert html.extract("<p>a</p><![foo[ x ]]>b") == "a b"  # a comment up to the first >, as in browsers
    assert html.extract("<p>a</p><![foo[ x > y ]]>b") == "a y ]]>b" and html.extract("<p>a</p><![if !IE]><p>b<![endif]>") == "a b"
    assert html.extract("<p>a<![CDATA[x") == "a<![CDATA[x"


@pytest.mark.parametrize("seed", range(4))
def test_no_markup_stops_it(seed):
    r = random.Random(seed)
    parts = ["<![", "<!", "<?", "</", "<", ">", "]]>", "&#", "&#x110000;", '"', "'", "<!--", "-->", "<script>", "<a b=", "\0", "<![CDATA[", "</p", "<svg>", "<textarea>", "<![temp[", "<!DOCTYPE", "<title>", "<plaintext>"]
    base = page("".join(f"<p class=c>{t}</p>" for t in A))
    for _ in range(2500):
        h = base
        for _ in range(r.randint(1, 8)):
            at = r.randrange(len(h) + 1)
            h = h[:at] + r.choice(parts) + h[at + r.choice([0, 1, 5, 40]) :]
        assert isinstance(html.extract(h), str)


@pytest.mark.parametrize("one", ["<div>x", "<p>x<span>", "<li>x<ul>", "<b>x</i>", "</p>x<hr>", "<table><tr><td>x"])
def test_depth_costs_no_more_than_length(one):
    took = []
    for n in (2000, 16000):
        began = time.process_time()
        html.extract(one * n + "<hr>" * n + "</span>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_edges(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<p>a</p>", "x"), (2, "u", "<article><p>" + "word " * 200_000 + "</p></article>", "x"), (2, "u", "<article><p>b &lt; c", "x")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(x["text"][:9] for x in got) == ["", "", "a", "b < c", "word word"] and max(x["n_chars"] for x in got) == 999_999
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
