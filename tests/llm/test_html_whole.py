"""Main text of pages without a single article element, or with telling words on wrappers."""

import pytest

from tallyloom.llm.html_extract import main_text

LONG = "A very long paragraph with many words that goes on and on. " * 40
BODY = LONG.strip()
MENU = "<div>" + "".join(f"<a href=/{i}>Some link of the site {i}</a> " for i in range(9)) + "</div>"


def test_title_and_short_part_stay():
    assert main_text(f"<div><h1>Title</h1><div><p>{LONG}</p></div><div><p>short</p></div></div>") == f"Title\n{BODY}\nshort"
    assert main_text(f"<body><div><div><p>{LONG}</p></div><div><p>short</p></div></div></body>") == f"{BODY}\nshort"
    assert main_text(f"<body><h1>Title</h1><div><p>{LONG}</p></div><div><p>short</p></div></body>") == f"Title\n{BODY}\nshort"


def test_blocks_far_from_each_other_stay():
    parts = [LONG * 20, "A usual paragraph of a few words.", "x", "Another usual paragraph, as they are."]
    page = "<body><div>" + "".join(f"<section><div><p>{p}</p></div></section><hr>" for p in parts) + "</div></body>"
    assert main_text(page) == "\n".join(p.strip() for p in parts)


def test_all_articles_stay():
    assert main_text(f"<body><article><p>{LONG}</p></article><article><p>short</p></article></body>") == f"{BODY}\nshort"
    assert main_text(f"<body><article><p>{LONG}</p><article><p>in it</p></article></article><p>out</p></body>") == f"{BODY}\nin it"


@pytest.mark.parametrize("start,end", [
    ("<div class='page has-sidebar'>", "</div>"), ("<div id='no-comments'>", "</div>"), ("<div class='social'>", "</div>"), ("<form action=/>", "</form>"), ("<div role=form>", "</div>"), ("<div id=widget><div class=social>", "</div></div>"),
])
@pytest.mark.parametrize("inner", ["<h1>Title</h1><div><p>{}</p></div>", "<article><h1>Title</h1><p>{}</p></article>", "<main><h1>Title</h1><p>{}</p></main>"])
def test_wrappers_do_not_take_the_page(start, end, inner):
    noise = "<div class='sidebar'><p>Other stories to read.</p></div>"
    assert main_text(f"<body>{start}{inner.format(LONG)}{noise}{end}</body>") == f"Title\n{BODY}"


def test_short_article_in_a_marked_wrapper_stays():
    assert main_text("<body><div class=widget><article><p>The text.</p></article></div><p>" + "Some other words. " * 9 + "</p></body>").startswith("The text.")


def test_long_comments_go():
    comments = f"<div id=comments><p>{LONG}</p></div>"
    for text in ("<article><p>The text itself.</p></article>", "<div><p>The text itself.</p></div>"):
        assert main_text(f"<body>{text}{comments}</body>") == "The text itself."


def test_links_beside_the_content_go():
    assert main_text(f"<body><div>{MENU}<div><p>{LONG}</p></div></div></body>") == BODY


def test_deep_pages_take_linear_time():
    import time

    def took(n):
        page = "<div><p>some words" * n
        t = time.perf_counter()
        main_text(page)
        return time.perf_counter() - t

    took(50)
    assert took(4_000) < 30 * max(took(400), 0.02)


def test_a_teaser_article_does_not_take_the_page():
    story = f"<div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>"
    teaser = "<article><h2>Another story</h2><p>Some words that tell of another story, as many as a teaser has, and a few more.</p></article>"
    for page in (f"<body>{story}{teaser}</body>", f"<body>{teaser}{story}</body>"):
        text = main_text(page)
        assert f"Title\n{BODY}\n{BODY}" in text


def test_main_keeps_what_stands_beside_its_article():
    assert main_text(f"<body><main><h1>Title</h1><article><p>{LONG}</p></article><p>After it.</p></main><p>Elsewhere.</p></body>") == f"Title\n{BODY}\nAfter it."


@pytest.mark.parametrize("piece", ["&lt;<x ", "<x a='", '<x a="b', "<!-- ", "</x ", "<x <y", "<![CDATA[", "<?x "])
@pytest.mark.parametrize("end", ["", ">"])
def test_open_tags_take_linear_time(piece, end):
    import time

    def took(n):
        page = f"<p>{LONG}</p>" + piece * n + end
        t = time.perf_counter()
        assert main_text(page).startswith(BODY)
        return time.perf_counter() - t

    took(50)
    assert took(20_000) < 40 * max(took(2_000), 0.02)
