"""Markup that once lost text: end tags of left-out elements, body-level siblings, class words inside articles."""

import pytest

from tickloom.llm import html_consensus

LONG = "A long paragraph with enough words to count as the text of an article, again and again. " * 3
P = f"<p>{LONG}</p><p>last one</p>"
TEXT = f"{LONG.strip()}\nlast one"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>T</h1><select><option>1<option>2</select>{P}</article>", f"T\n{TEXT}"),
        (f"<article><h1>T</h1><select><optgroup label=a><option>1<option>2</select>{P}</article>", f"T\n{TEXT}"),
        (f"<article><button><p>Subscribe</button>{P}</article>", TEXT),
        (f"<article><label><div>x</label>{P}</article>", TEXT),
        (f"<article><video><p>no video</video>{P}</article>", TEXT),
        (f"<article><span hidden><div>x</span>{P}</article>", TEXT),
        (f"<article><b><p>bold</b> text</p>{P}</article>", f"bold text\n{TEXT}"),
        (f"<body><h1>Title</h1><p>Opening</p><div class=a>{P}</div><div class=b><p>{LONG * 2}</p></div>", f"Title\nOpening\n{TEXT}\n{(LONG * 2).strip()}"),
        (f"<body><div class=a>{P}</div><div class=b><p>{LONG * 2}</p></div>", f"{TEXT}\n{(LONG * 2).strip()}"),
        (f"<body><div class=menu>menu</div><div class=a>{P}</div><div class=b><p>more</p></div><div class='footer'>end</div>", f"{TEXT}\nmore"),
        (f"<body><p>Teaser</p><article>{P}</article><div class=x9><p>{LONG}</p></div>", TEXT),
        (f"<article><p class=related-work>Earlier work</p><div class=notice-board-history>The board</div>{P}<div class=related-posts>no</div><div class='share'>no</div><ul class='social_share-buttons'><li>no</ul></article>", f"Earlier work\nThe board\n{TEXT}"),
        (f"<body><div class=related-work>no</div><article>{P}</article>", TEXT),
    ],
)
def test_no_text_is_lost(page, text):
    assert html_consensus.main_text(page, None) == text
