"""Pages that nest deeply or close what was never opened: the work stays in proportion to the page."""

from __future__ import annotations

import time

import pytest

from plumbline.llm import html_extract

PAGES = {
    "nested divs with text": "".join(f"<div>some text, with commas, and words number {i} " for i in range(20_000)),
    "stray end tags": "<div>" * 20_000 + "</b></ul>" * 20_000,
    "inline ends below": "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000,
    "headers": "<header>" * 30_000,
    "list items": "<ul>" + "<li>x" * 100_000,
    "open inline": "<span>" * 50_000 + "<p>text" + "</span>" * 50_000,
    "one long text": "<p>" + "word, " * 400_000,
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_time_is_linear(name):
    start = time.time()
    html_extract.extract(PAGES[name])
    assert time.time() - start < 2


def test_nested_text_is_whole():
    page = PAGES["nested divs with text"]
    assert html_extract.extract(page) == " ".join(f"some text, with commas, and words number {i}" for i in range(20_000))


def test_end_tags_close_only_what_is_open():
    page = "<body><p>First <b>bold</i> text</b>, which is long enough to count here.</ul></em><p>Second</p></p> text, also long enough to be counted.</body>"
    assert html_extract.extract(page) == "First bold text, which is long enough to count here. Second text, also long enough to be counted."
    assert html_extract.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    # an inline end tag does not reach out of its block
    assert html_extract.extract("<b>x<div>y</b>z</div>w") == "x yz w"
