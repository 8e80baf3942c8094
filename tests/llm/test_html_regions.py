"""Nothing of an article goes because of how its parts are wrapped."""

from fotolake.llm import html_text

LEAD, BODY = "A lead, short but said. " * 3, "The body, longer than the lead; it goes on, and on. " * 6


def _said(*parts):
    return "\n\n".join(p.strip() for p in parts)


def test_lead_and_title_beside_the_body_stay():
    page = f"<html><body><article><h1>Title</h1><div class='lead'>{LEAD}</div><div class='body'>{BODY}</div></article></body></html>"
    assert html_text.main_text(page) == _said("Title", LEAD, BODY)
    paragraphs = f"<p>{BODY}</p><p>{BODY}</p>"
    page = f"<html><body><div id='page'><h1>Title</h1><div class='entry-content'>{paragraphs}</div><div class='links'><a href='/'>Home</a></div></div></body></html>"
    assert html_text.main_text(page) == _said("Title", BODY, BODY)


def test_selected_paths_stay():
    for page in (f"<body><div class='one'><p>{BODY}</p></div><div class='two'><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div></body>", f"<body><article><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></article><div class='more'><p>{BODY}</p></div></body>"):
        assert html_text.main_text(page) == _said(*[BODY] * 4)


def test_names_skip_no_whole_page():
    for page in (
        f"<html class='no-cookie'><body class='has-sidebar'><main id='search'><article class='post social'><header class='entry-header'><h1>Title</h1></header><p>{BODY}</p></article></main></body></html>",
        f"<html><body><div id='content-side'><h1>Title</h1><p>{BODY}</p></div></body></html>",
        f"<html><body><div class='widget'><h1>Title</h1><p>{BODY}</p></div><div class='share'>Share, now!</div></body></html>",
    ):
        assert html_text.main_text(page) == _said("Title", BODY)


def test_names_skip_what_they_name():
    comments = f"<div id='comments'><div class='reply'><p>{BODY}</p></div><p>{BODY}</p></div>"
    for more in ("<div class='sidebar left share'>A, b, c.</div>", "<div class='cookie-notice'>A, b, c.</div>", comments):
        assert html_text.main_text(f"<body><article><h1>Title</h1><p>{BODY}</p>{more}</article></body>") == _said("Title", BODY)


def test_end_of_skipped_element_is_found():
    fonts = "<font>" * 1000
    assert html_text.main_text(f"<body><div class='menu'>Home{fonts}</div><article><p>{BODY}</p></article></body>") == _said(BODY)
    assert html_text.main_text(f"<body><nav>Home{fonts}</nav><p>{BODY}</p></body>") == _said(BODY)


def test_compound_names_skip():
    for name in ("id='user-comments'", "class='comments-area'", "class='comment-list'", "class='site-footer'", "class='related-posts'", "class='main-nav'", "class='ad-container'", "class='relatedPosts'", "class='shareBar'", 'id="disqus_thread"'):
        more = f"<div {name}><p>{BODY}</p><ul><li>One, two.</li></ul></div>"
        for page in (f"<body><article><h1>Title</h1><p>{BODY}</p>{more}</article></body>", f"<body><article><h1>Title</h1><p>{BODY}</p></article>{more}</body>", f"<body><div class='content'><h1>Title</h1><p>{BODY}</p><p>{BODY}</p></div>{more}</body>"):
            assert html_text.main_text(page) == _said("Title", *[BODY] * (2 if "content" in page else 1)), (name, page)


def test_layout_names_do_not():
    for name in ("has-sidebar", "no-comments", "with-share", "is-sponsored", "entry-header", "page-with-menu", "lead", "commentary", "navigator-story"):
        page = f"<body><article><div class='{name}'><p>{BODY}</p></div><p>{LEAD}</p><p>{LEAD}</p></article></body>"
        assert html_text.main_text(page) == _said(BODY, LEAD, LEAD), name


def unnamed(article):
    """A page whose other parts have no telling names, tags or roles."""
    links = "".join(f"<div class='x1'><a href='/{i}'>Part {i}</a></div>" for i in range(12))
    small = "".join(f"<div class='x2'><span>{w}</span></div>" for w in ("Zurich", "12 March", "Login", "Print", "Map"))
    return f"<html><body><div id='top'>{small}{links}</div><div id='c7'>{article}</div><div id='low'>{links}{small}</div></body></html>"


def test_ratios_decide(monkeypatch):
    """With the threshold switched off the same pages come out otherwise."""
    pages = [(unnamed(f"<h2>Title</h2><p>{BODY}</p><p>Short, too.</p><p>{BODY}</p>"), _said("Title", BODY, "Short, too.", BODY)), (unnamed(f"<div><p>{BODY}</p></div><div><p>{LEAD}</p><p>{BODY}</p></div>"), _said(BODY, LEAD, BODY))]
    assert [html_text.main_text(p) for p, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(html_text, "DEVIATIONS", -1e9)
    assert all(html_text.main_text(p) != t and "Part 3" in html_text.main_text(p) for p, t in pages)


def test_equal_regions_and_paths():
    """Ties: of two equal articles both stay, in page order; one path alone is content."""
    assert html_text.main_text(f"<body><article><p>{BODY}</p></article><article><p>{BODY}</p></article></body>") == _said(BODY, BODY)
    assert html_text.main_text("<p>a</p><p>a</p>") == "a\n\na"
