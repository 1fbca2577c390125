"""Main text that wrappers, links and forms stand around."""

import pytest

from textloom.llm import html

P = "Two hundred letters of a paragraph. " * 6
T = P.strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<h1>Title</h1><section><p>{P}</p></section><section><p>Short one.</p></section>", f"Title\n{T}\nShort one."),
        (f"<div><div><div><h2>Title</h2></div></div></div><div><div><div><p>{P}</p></div></div></div><div><div><div><p>End.</p></div></div></div>", f"Title\n{T}\nEnd."),
        (f"<p>{P}</p><p><a href=x>See the whole report</a></p><p>{P}</p>", f"{T}\nSee the whole report\n{T}"),
        (f"<body><form id=aspnetForm><input><nav>n</nav><article><h1>T</h1><p>{P}</p></article></form></body>", f"T\n{T}"),
        (f"<body><form id=aspnetForm><div><h1>T</h1><p>{P}</p></div></form><p>Foot.</p></body>", f"T\n{T}\nFoot."),
        (f"<div class='widget page'><main><p>{P}</p><div class=comments>{P}</div></main></div>", T),
        (f"<div class='modal'><p>{P}</p></div>", T),
        (f"<article><p>A</p><form>{P}</form></article><div class=comments>{P}{P}</div>", "A"),
        (f"<p>{P}</p><section id=comments><article>{P}{P}</article></section>", T),
        (f"<p>{P}</p><div hidden>{P}{P}{P}</div><form><p>Your name</p></form>", T),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>", "So x=1 holds."),
        ("<div class=menu>one</div><form>Name</form>", ""),
    ],
)
def test_main_text_in_wrappers(page, want):
    assert html.main_text(page) == want
