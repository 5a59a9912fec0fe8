import time

import pytest

from fleetlens.llm import html_text

WEIGHTS = html_text.weights_from({"word": (900, 100), "aside": (0, 50), "p": (60, 2), "li": (0, 40), "div": (2, 20)})
LONG = "w " * 19 + "w"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p class="share">Share<p>First.</p><p>Second.</p></article>', "First.\nSecond."),
        ("<ul><li class=share>Share<li>one two three four five six</ul><p>seven</p>", "one two three four five six\nseven"),
        ("<article><dl><dt class=ad>Buy<dd>one two</dl></article>", "one two"),
        ("<table><tr><td class=ad>Buy<td>one two three<tr><td>four five</table>", "one two three\nfour five"),
        (f"<body><div class=ad>Buy<article><div><p>{LONG}</p></div><div><p>{LONG}</p></div></article></body>", f"{LONG}\n{LONG}"),
        ("<main><section><span class=ad>Buy</section><p>one <span>two</span></p></main>", "one two"),
        ("<video-player></video-player><p>body words</p>", "body words"),
        ("<object-x>\n<p>body words</p></object-x>", "body words"),
        ("<p>before</p><svg width=1 /><p>body words</p>", "before\nbody words"),
        ("<template-a><p>one</p></template-a><video src=x><p>two</p>", "one\ntwo"),
        ("<script>if (a<b) '<p>no</p>'", ""),
    ],
)
def test_elements_end_where_html_ends_them(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


def test_parsing_is_linear():
    began = time.monotonic()
    for page in ("<div class=ad>" * 50_000, "<video>" * 50_000, "<ul><li>" * 50_000, "<b><p class=ad>x" * 50_000, "<li>" + "<div><li></p></x>" * 50_000):
        html_text.elements(page)
    assert time.monotonic() - began < 60


BODY = "<h1>Title here</h1><p>one two three four five six</p><p>seven eight nine ten</p>"
SHOWN = "Title here\none two three four five six\nseven eight nine ten"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        *((f'<body><nav>Home</nav><div class="{c}"><article>{BODY}</article></div><footer>f</footer>', SHOWN) for c in (
            "content has-sidebar", "no-sidebar", "site has-header", "post-with-comments", "search", "form")),
        *((f'<body><nav>Home</nav><div class="{c}">{BODY}</div><footer>f</footer>', SHOWN) for c in ("content has-sidebar", "post-with-comments")),
        (f"<body><nav>{'menu ' * 100}</nav><section class=no-sidebar>{BODY}</section>", SHOWN),
        (f"<body id=social><section class=notice><p>{LONG}</p></section><section class=alert><p>{LONG}</p></section><section class=form><p>{LONG}</p></section>"
         f"<section class=share><p>{LONG}</p></section>", "\n".join([LONG] * 4)),
        ("<article><p>one two three</p><p class=notice>of note</p><p>four five six</p></article>", "one two three\nof note\nfour five six"),
        (f"<article class=post>{BODY}<div class=share>Share</div></article><div class=comments><article class=comment>{'c ' * 6}</article></div>", SHOWN),
        (f"<article>{BODY}</article><div class=comments>{'c ' * 60}</div>", SHOWN),
        (f"<form id=aspnet><nav>Home</nav><main>{BODY}</main></form>", SHOWN),
        (f"<body><div class=ad>Buy now</div><section>{BODY}</section><section class=related>More like this</section>", SHOWN),
        (f"<div hidden>{BODY}</div><p>one</p>", "one"),
    ],
)
def test_class_words_take_no_page_away(page, want):
    assert html_text.main_text(page, WEIGHTS) == want


def test_labelled_words_in_named_wrappers_count():
    inside, outside = html_text.token_counts(f'<div class="content has-sidebar"><article>{BODY}</article></div><div class=ad>Buy now</div>')
    assert inside["word"] == 12 and outside["word"] == 0 and outside["suspect word"] == 2


@pytest.mark.parametrize(
    ("tag", "shown"),
    [
        ('<div class="box hidden lg">', True),
        ('<section class="grid hidden md">', True),
        ('<div title="A hidden gem">', True),
        ("<div data-hidden=1>", True),
        ('<div title=\'say "hidden"\' >', True),
        ('<div style="color:red; overflow:hidden">', True),
        ('<div data-class="sidebar" title="class=ad">', True),
        ("<div hidden>", False),
        ('<div class=x HIDDEN="">', False),
        ('<div style="color:red;Display : none">', False),
        ("<div style='visibility:hidden'>", False),
    ],
)
def test_hidden_is_an_attribute_not_a_word(tag, shown):
    name = tag[1:].split()[0]
    page = f"<body><article><p>{LONG}</p>{tag}<p>{LONG}</p></{name}></article></body>"
    assert html_text.main_text(page, WEIGHTS) == (f"{LONG}\n{LONG}" if shown else LONG)


def test_attributes():
    assert html_text.attributes("""A=1 b = "x y" c='z"' d E/ a=2 'loose' f=""") == {"a": "1", "b": "x y", "c": 'z"', "d": "", "e": "", "f": ""}
