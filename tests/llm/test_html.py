"""Tree scoring against a plain recursion over generated pages without article or main, and in linear time."""

import random
import time

from deckloom.llm import html_text

WORDS = "sun moon, river stone, house and tree garden, over under light".split()


def grow(rng, depth=0):
    """A random element: (name, children)."""
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randrange(1, 30)))
    if depth > 4 or rng.random() < 0.45:
        name = rng.choice(["p", "p", "p", "h2", "blockquote"])
        return name, [x for _ in range(rng.randrange(1, 4)) for x in (text(), (rng.choice(["a", "b"]), [text()]))]
    if rng.random() < 0.15:
        return "ul", [("li", [("a", [text()])] if rng.random() < 0.5 else [text()]) for _ in range(rng.randrange(1, 6))]
    return rng.choice(["div", "section"]), [x for _ in range(rng.randrange(1, 6)) for x in ([text()] if rng.random() < 0.2 else []) + [grow(rng, depth + 1)]]


def written(x):
    return f" {x} " if isinstance(x, str) else f"<{x[0]}>{''.join(map(written, x[1]))}</{x[0]}>"


def strings(x, inside_link=False):
    if isinstance(x, str):
        yield x, inside_link
    else:
        for y in x[1]:
            yield from strings(y, inside_link or x[0] == "a")


def own(x):
    """Texts of an element outside the blocks within it."""
    for y in x[1]:
        if isinstance(y, str):
            yield y
        elif y[0] not in html_text.BLOCK:
            yield from own(y)


def expected(page):
    parent, order = {}, []

    def visit(x, up):
        parent[id(x)] = up
        order.append(x)
        for y in x[1]:
            if not isinstance(y, str):
                visit(y, x)

    visit(page, None)
    said = {id(x): " ".join(own(x)) if x[0] in html_text.BLOCK else "" for x in order}
    points, scored = {}, []
    for x in order:
        if x[0] in html_text.PARAGRAPHS and len(said[id(x)]) >= 25:
            gain = 1 + said[id(x)].count(",") + min(len(said[id(x)]) / 100, 3)
            up, share = (x if x[0] in ("div", "section") else parent[id(x)]), [1, 1 / 2, 1 / 3, 2 / 9]
            for s in share:
                if up is None:
                    break
                if id(up) not in points:
                    points[id(up)] = 1e-9
                    scored.append(up)
                points[id(up)] += s * gain
                up = parent[id(up)]

    def density(x):
        return sum(len(t) for t, link in strings(x, False) if link) / max(1, sum(len(t) for t, _ in strings(x)))

    def worth(x):
        return points.get(id(x), 0) * (1 - density(x))

    if not scored:
        kept = [page]
    else:
        best = max(scored, key=worth)
        up = parent[id(best)]
        kept = [best] if up is None else []
        for x in up[1] if up else []:
            if isinstance(x, str):
                continue
            prose = x[0] == "p" and len(said[id(x)]) >= 80 and density(x) < 0.25
            if x is best or worth(x) >= max(10.0, 0.2 * worth(best)) or prose or (x[0] == "h2" and not kept):
                kept.append(x)

    def pieces(x):
        if isinstance(x, str):
            return x + " "
        edge = "\0" if x[0] in html_text.BLOCK else ""
        return edge + "".join(map(pieces, x[1])) + edge

    return "\n\n".join(t for x in kept for t in (" ".join(p.split()) for p in pieces(x).split("\0")) if t)


def test_scores_are_a_plain_recursions():
    rng, chosen = random.Random(1), 0
    for _ in range(400):
        page = ("html", [grow(rng) for _ in range(rng.randrange(1, 6))])
        want = expected(page)
        assert html_text.main_text(f"<html><body>{''.join(map(written, page[1]))}</body></html>") == want
        chosen += len(want) < 0.8 * sum(len(t) for t, _ in strings(page))
    assert chosen > 100  # pages where the scores leave something out


def test_deep_and_unclosed_pages_take_linear_time():
    for html, count in (("<div>some words, here " * 20_000, 20_000), ("<span>some words, here</b></i> " * 20_000, 20_000), ("<b><div>" + "<span>some words, here</b>" * 20_000, 20_000)):
        began = time.process_time()
        text = html_text.main_text(html)
        assert time.process_time() - began < 2 and 0 < text.count("some words, here") <= count


def test_repeated_rows_clashing_columns_and_a_long_page(spark):
    long = "<p>" + "word, " * 400_000 + "</p>"
    rows = [(1, "u", "<p>same, same text that is long enough</p>", "x", "y"), (1, "u", "<p>same, same text that is long enough</p>", "x", "y"), (2, "v", long, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted((r.page_id, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(1, 35), (1, 35), (2, 400_000 * 6 - 1)]


ARTICLE = "<h1>The title of it</h1>" + "".join(f"<p>Paragraph {k} of the article, with words, commas, and some sense in it for readers.</p>" for k in range(5))
TEXT = html_text.main_text(f"<body>{ARTICLE}</body>")
OTHER = "<p>Some other words, quite long, but, they are not part of the article at all.</p>" * 2
WRAPPERS = [
    '<div class="container no-sidebar">%s</div>',
    '<div id="page" class="layout with-sidebar">%s</div>',
    '<form id="aspnetForm" action="x">%s</form>',
    '<div class="sidebar-layout">%s</div>',
    '<div class="has-comments"><div>%s</div></div>',
    '<div class="discussion"><div>%s</div></div>',
    '<div class="content">%s</div>',
]
NAMES_BESIDE = (
    "post-comments content-sidebar main-nav article-share content-ad sidebar-left comment-list related-posts cookie-banner newsletter-signup "
    "comments-area ad-container commentList postComments"
).split()
BESIDE = [f'<div class="{c}">{OTHER}</div>' for c in NAMES_BESIDE] + [
    f'<div style="DISPLAY:NONE">{OTHER}</div>',
    f'<div style="display : none">{OTHER}</div>',
    f'<div aria-hidden="TRUE">{OTHER}</div>',
    f"<footer>{OTHER}</footer>",
]


def test_names_of_wrappers_never_empty_a_page_and_what_is_beside_the_article_goes():
    assert TEXT.count("Paragraph") == 5
    for wrapper in WRAPPERS:
        assert html_text.main_text(f"<body>{wrapper % ARTICLE}</body>") == TEXT
        for part in BESIDE:
            for html in (wrapper % (ARTICLE + part), wrapper % ARTICLE + part, wrapper % (part + ARTICLE), part + wrapper % ARTICLE, wrapper % f"<article>{ARTICLE}{part}</article>"):
                assert html_text.main_text(f"<body>{html}</body>") == TEXT, (wrapper, part)


def test_a_hint_in_a_name_cuts_links_only():
    inside = '<div class="search-theory"><h2>Search theory</h2><p>About search, and more to read about it, all in all.</p></div>'
    menu = '<div class="navbar-collapse"><a href="a">One page</a> <a href="b">Another page</a></div>'
    text = html_text.main_text(f"<article>{ARTICLE}{inside}{menu}</article>")
    assert text == TEXT + "\n\nSearch theory\n\nAbout search, and more to read about it, all in all."


def test_pages_of_comments_or_notices_alone():
    assert html_text.main_text(f'<div class="comments">{OTHER}</div>') == ""
    assert html_text.main_text(f'<div class="cookie-notice">{OTHER}</div><div><p>Short.</p></div>') == "Short."
