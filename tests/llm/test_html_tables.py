"""No visible text is lost in tables whose rows hold more than cells, nor in svg and math."""

import random

import pytest

from quern.llm.html_layout import render


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<table><tr><form><td>Name</td><td>Age</td></form></tr></table>", "Name  Age"),
        ("<table><form><tr><td>a</td></tr></form><tr><td>b</td></tr></table>", "a\nb"),
        ("<table><tr>text <b>bold</b><td>cell</td></tr></table>", "text bold\ncell"),
        ("<table><tbody><div>stray</div><tr><td>cell</tbody></table>", "stray\ncell"),
        ("<table><tr><div>in<td>cell</td></tr></table>", "in\ncell"),
        ("<table><tr hidden>shown<td>no</td></tr></table>", "shown"),
        ("<p>a <svg><title>no</title><defs/><path d='M0'/><text>one</text><text>two</text></svg>", "a\none\ntwo"),
        ("x = <math><mi>y</mi><mo>+</mo><mn>2</mn><annotation>no</annotation></math>", "x = y+2"),
    ],
)
def test_visible_text_is_kept(page, wanted):
    assert render(page) == wanted


def test_no_word_is_lost_in_odd_tables():
    rng = random.Random(5)
    for _ in range(300):
        tags = [rng.choice("table tbody thead tr td th form div b caption p".split()) for _ in range(30)]
        page = "<table>" + "".join(f"<{'/' * (rng.random() < 0.3)}{tag}>w{k} " for k, tag in enumerate(tags))
        assert sorted(render(page).split()) == sorted(f"w{k}" for k in range(30)), page
