"""Layout-aware rendering: pages with odd tags, deep pages, and all visible words of random pages."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quern.llm.html_layout import extract_text, render


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p title=it's>don't stop</p>", "don't stop"),
        ('<a title=5">x</a> and <b>y</b> "q" z', 'x and y "q" z'),
        ("<table><tr>hello<td>x", "hello\nx"),
        ("<table><tbody><div>stray</div><tr><td>1", "stray\n1"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tbody><tr><td rowspan=9>A<td>B</tbody><tbody><tr><td>C</table>", "A  B\nC"),
        ("<ol reversed><li>a<li value=7>b<li>c</ol>", "3. a\n7. b\n6. c"),
        ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<svg><text>hi</text></svg> <math><mi>x</mi></math>", "hi\nx"),
        ("<dialog>no</dialog><dialog open>yes</dialog><details><summary>S</summary>body</details><details open><summary>T</summary>more</details>", "yes\nS\nT\nmore"),
        ("<p style='x-display:none'>shown</p><p style='color:red; display : none'>not</p>", "shown"),
        ("<ul><li><p>one</p><p>two</p></ul>", "- one\n\n  two"),
        ("<p>a<p>b<div>c</div>", "a\n\nb\n\nc"),
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("a < b > c", "a < b > c"),
    ],
)
def test_pages(html, text):
    assert render(html) == text


@pytest.mark.parametrize("html", ["<div>" * 50_000, "<div>" * 25_000 + "</b>" * 25_000, "<b><table><tr><td>" + "<div>" * 25_000 + "</b>" * 25_000, "<table><tr><td>" * 10_000, "<ul><li>" * 10_000, "<p>" * 50_000, "<td>" * 50_000])
def test_deep_pages(html):
    began = time.time()
    assert render(html + "word").split()[-1] == "word"
    assert time.time() - began < 30


def page(rng, depth, words, shown):
    """A random page; words are numbered, and those shown are gathered in order."""
    parts = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.choice("text text inline block list table hidden void".split()) if depth else "text"
        if kind == "text":
            words.append(f"w{len(words)}")
            shown.append(words[-1])
            parts.append(f" {words[-1]} ")
        elif kind == "void":
            parts.append(rng.choice(["<br>", "<hr>", "<!-- <b> -->", "<wbr>", "<img alt=''>"]))
        elif kind == "hidden":
            gone = []
            inner = page(rng, depth - 1, words, gone)
            parts.append(rng.choice(['<div hidden title="a>b">{}</div>', "<span style='display:none'>{}</span>", "<datalist>{}</datalist>"]).format(inner))
        elif kind == "list":
            end = rng.choice(["", "</li>"])
            parts.append("<ul>" + "".join(f"<li class=a'b>{page(rng, depth - 1, words, shown)}{end}" for _ in range(2)) + "</ul>")
        elif kind == "table":
            parts.append("<table>" + "".join("<tr>" + "".join(f"<td>x{page(rng, 0, words, shown)}" for _ in range(2)) for _ in range(2)) + "</table>")
        else:
            name = rng.choice(["b", "i", "span"] if kind == "inline" else ["div", "section", "blockquote", "h2"])
            parts.append(f'<{name} data-x="{rng.randrange(9)}">{page(rng, depth - 1, words, shown)}</{name}>')
    return "".join(parts)


def test_all_visible_words_and_no_others():
    rng = random.Random(3)
    for _ in range(300):
        shown = []
        html = page(rng, 4, [], shown)
        assert [w for w in render(html).replace("xw", "x w").split() if w.startswith("w")] == shown, html


def test_extract_text(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (None, None, None), (3, "", "v"), (4, "<p>" + "long " * 300_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, rendered_text string").withColumn("_html", F.lit(7)).withColumn("a b", F.lit("c"))
    found = extract_text(pages)
    assert sorted(found.columns) == sorted(pages.columns)
    got = sorted([(r.page_id or 0, len(r.rendered_text), r["_html"], r["a b"]) for r in found.collect()])
    assert got == [(0, 0, 7, "c"), (1, 1, 7, "c"), (1, 1, 7, "c"), (3, 0, 7, "c"), (4, 1_499_999, 7, "c")]
    assert extract_text(pages.limit(0)).count() == 0
