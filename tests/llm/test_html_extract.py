import html
import re

from tidegate.llm import html_extract as m

SCHEMA = "page_id long, url string, html string, text string"


def expected(page):
    """What the generated pages hold between their article tags, read by plain patterns."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|div|article)[^>]*>", body)
    return "\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " " , b.replace("<b>", "").replace("</b>", "")))).strip()))


def test_every_generated_page_equals_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "html", m.extract(pages["html"]).alias("got")).collect()
    wrong = [r.page_id for r in rows if r.got != expected(r.html)]
    assert len(rows) == 250 and not wrong


PAGES = {
    "article with the lot": (
        """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
        <div id="cookie-notice">We use cookies, lots and lots of cookies, on this site.</div><article><header><h1>The  Title</h1></header>
        <p>First &amp; foremost, this is <b>bold</b> and <a href="y">linked</a>.<p>Second&nbsp;paragraph<br>with a break &#8212; and a dash.
        <script>var x = "</p>";</script><ul><li>one<li>two</ul><pre>a
        b</pre><form><input name=q>Search</form><div class="share-buttons">Share this</div><blockquote>quoted</blockquote></article>
        <section class="comments"><p>Great post, I read all of it twice and loved every word!</p></section><aside>More</aside><footer>&copy; Site</footer></body></html>""",
        "The Title\nFirst & foremost, this is bold and linked.\nSecond paragraph with a break — and a dash.\none\ntwo\na b\nquoted",
    ),
    "divisions only": (
        """<body><div class="menu"><a href=a>A</a> <a href=b>B</a></div><div id=wrap><div><a href=1>Link one</a><a href=2>Link two</a><a href=3>Link three</a></div>
        <div class=body><h1>Head</h1><p>A long enough paragraph of plain prose with nothing linked in it at all.</p><p>Short.</p><p>Another paragraph of prose, as long as the first one was.</p></div>
        <div><a href=4>Next story</a> <a href=5>Last story</a></div></div><div class="footer">Imprint</div>""",
        "Head\nA long enough paragraph of plain prose with nothing linked in it at all.\nShort.\nAnother paragraph of prose, as long as the first one was.",
    ),
    "no tags": ("just  some\n text", "just some text"),
    "empty": ("", ""),
    "markup only": ("<html><body><script>x()</script><!-- c --></body>", ""),
    "cut off": ("<article><p>Begins well<p>and then <b>it sto", "Begins well\nand then it sto"),
    "main": ("<main><p>One two three four.</p><p>Five.</p></main><div>Other words that are long enough to count for something here.</div>", "One two three four.\nFive."),
}


def test_page_shapes():
    for name, (page, want) in PAGES.items():
        assert m.main_text(page) == want, name


def test_nulls_empty_very_long_deep_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {k} of a very long page</p>" for k in range(20000)) + "</article>"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", long, "x"), (4, "u", deep, "x"), (5, "u", deep, "x"), (5, "u", deep, "x"), (None, "u", "<p>a</p><p></b></p></p><p <b>", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = df.select("page_id", m.extract(df["html"]).alias("t")).collect()
    assert [r.t for r in got[:2]] == ["", ""] and got[2].t.count("\n") == 19999
    assert {r.t for r in got[3:6]} == {"deep text"}
    assert got[6].t.startswith("a")
    empty = spark.createDataFrame([], SCHEMA)
    assert empty.select(m.extract(empty["html"])).count() == 0


def test_generated_pages_without_article_elements_equal_their_articles():
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    wrong = [k for k, h in enumerate(pages) if m.main_text(h.replace("<article>", "<div>").replace("</article>", "</div>")) != expected(h)]
    assert len(pages) == 250 and not wrong


HEAD = "<h1>The title of it</h1>"
STORY = HEAD + "".join(f"<p>Paragraph number {k} with some plain words of prose in it, as articles have.</p>" for k in range(6))
LINES = "\n".join(re.sub("<[^>]*>", "", x) for x in re.findall("<h1>.*?</h1>|<p>.*?</p>", STORY))
NAV = "<nav><a href=a>A</a></nav>"
SHAPES = {
    "head never ended": f"<html><head><title>t</title><body>{NAV}<article>{STORY}</article>",
    "neither head nor body ended": f"<head><title>t</title><meta charset=x><article>{STORY}</article>",
    "a class that names what is beside": f"<body>{NAV}<div class='content has-sidebar'>{STORY}</div>",
    "a class that names what is above": f"<body>{NAV}<div class='post with-header'>{STORY}</div>",
    "drawing closed by a slash": f"<body>{NAV}<svg class='i'/><article>{STORY}</article>",
    "drawing never closed": f"<body>{NAV}<svg class='i'><path d=x><article>{STORY}</article>",
    "main with little text": f"<main><p>Short main.</p></main><div>{STORY}</div>",
    "a form around the page": f"<form id=page>{NAV}<div>{STORY}</div></form>",
    "remarks longer than the story": f"<div><div class=post>{STORY}</div><div class=comments>{STORY.replace('h1', 'h3') * 5}</div></div>",
    "remarks within the article": f"<article>{STORY}<section id=comments>{STORY.replace('h1', 'h3') * 3}</section></article>",
    "advert and sharing within": f"<article>{STORY[:200]}<div class=ad-slot>Buy this now.</div>{STORY[200:]}<div class=share-buttons><a href=x>Share</a></div></article>".replace(STORY[:200] + "<div", STORY[: STORY.index("</p>") + 4] + "<div").replace("</div>" + STORY[200:], "</div>" + STORY[STORY.index("</p>") + 4 :]),
    "paragraphs in the body itself": f"<body>{NAV}{STORY}<footer>Imprint</footer>",
    "a table for the layout": f"<table><tr><td><a href=1>One</a> <a href=2>Two</a><td>{STORY}</table>",
    "an attribute with brackets and quotes": f"<body><div title='a > b \"c\"'>{STORY}</div>",
    "text kept from readers": f"<article>{STORY}<p hidden>No.</p><div style='display: none'>No.</div><!-- <p>No.</p> --><template><p>No.</p></template></article>",
}


def test_shapes_that_names_or_markup_could_mislead():
    for name, page in SHAPES.items():
        assert m.main_text(page) == LINES, name
    assert m.main_text(f"<article>{STORY}<p class='market-share'>Shares rose.</p></article>") == LINES + "\nShares rose."


def slow(node):
    """(characters, tags, linked ones of both, density's inputs) of a node by plain recursion."""
    chars = tags = link_chars = link_tags = 0
    for k in node.kids:
        if isinstance(k, str):
            chars += len("".join(k.split()))
        elif not k.drop:
            c, t, lc, lt = slow(k)
            chars, tags, link_chars, link_tags = chars + c, tags + t + 1, link_chars + lc, link_tags + lt
    return (chars, tags, chars, tags + 1) if node.tag == "a" else (chars, tags, link_chars, link_tags)


def test_densities_equal_the_formula_written_out():
    import math

    page = f"<body>{NAV}<div><a href=x>One <b>link</b></a> text <p>more text</p></div><div>{STORY}</div><ul><li><a href=y>Y</a><li>z</ul>"
    root = m.parse(page)
    nodes = m.measure(root)
    total, _, total_links, _ = slow(root)
    for n in nodes:
        c, t, lc, lt = slow(n)
        want = 0.0
        if c:
            t, lt1, lc1 = max(1, t), max(1, lt), max(1, lc)
            base = math.log(c / max(1, c - lc) * lc + total_links / total * c + math.e)
            want = max(0.0, c / t * math.log(max(1.0, c / lc1 * t / lt1)) / math.log(max(math.e, base)))
        assert math.isclose(n.density, want, rel_tol=1e-9, abs_tol=1e-12), n.tag
        assert math.isclose(n.total, sum(k.density for k in n.kids if not isinstance(k, str) and not k.drop), rel_tol=1e-9, abs_tol=1e-12)
    best = max((n for n in nodes if n is not root and n.tag not in m.PARTS), key=lambda n: n.total)
    assert m.main_nodes(root)[0] is best


def test_hostile_markup_takes_linear_time():
    import time

    def seconds(page):
        began = time.perf_counter()
        m.main_text(page)
        return time.perf_counter() - began

    for bad in ('<a "', '<p>a<b c="d', "<", "</", "<!--", "<svg><p>", "<div a='"):
        assert seconds(bad * 40_000) < 5, bad


LONG = "A reader's remark that goes on for a good while, as they do, and says nothing that the story said."
NAMED = "".join(f"<div class={c}><p>Remark by a reader, number {c}, that is as long as a paragraph of the story itself.</p></div>" for c in "ab")
SAID = "".join(f"<div class=x7><b>{who}</b> <span>{k + 2} days ago</span><p>{LONG}</p><a href=r>Reply</a></div>" for k, who in enumerate(("Anna", "Ben", "Cleo", "Dora", "Emil", "Fay", "Gus", "Hal")))
UNNAMED = "<div>" + "".join(f"<div><b>{who}</b><p>{LONG} {LONG}</p></div>" for who in ("Anna", "Ben", "Cleo", "Dora", "Emil", "Fay")) + "</div>"
MIDDLE = STORY.index("</p>") + 4


def test_names_alone_cut_nothing_out_of_an_article():
    first, second, *rest = LINES.split("\n")
    for name in ("class=share-price", "class=menu-of-the-day", "class=notice-period", "class=comment-analysis", "id=related-work", "class=advertising-history", "id=discussion", "class='review thread-safety'", "class=social-policy"):
        page = f"<body>{NAV}<article>{STORY[:MIDDLE]}<div {name}><p>A paragraph that belongs here.</p></div>{STORY[MIDDLE:]}</article>"
        assert m.main_text(page) == "\n".join([first, second, "A paragraph that belongs here.", *rest]), name


def test_parts_whose_names_say_nothing_else_go():
    for name in ("share-buttons", "ad-slot", "adSlot top", "related-articles", "newsletter-signup", "cookie-notice", "social-links", "sidebar-left", "sponsored_content", "promo-box"):
        page = f"<body>{NAV}<article>{STORY[:MIDDLE]}<div class='{name}'><p>Not of the story.</p></div>{STORY[MIDDLE:]}</article>"
        assert m.main_text(page) == LINES, name


def test_remarks_are_told_by_names_anywhere_and_by_shape():
    for name in ("comments", "user-comments", "comment-list", "reader-comments-section", "disqus_thread", "post-comments", "commentArea"):
        for page in (f"<body>{NAV}<div class=post>{STORY}</div><section class='{name}'>{NAMED * 6}</section>", f"<article>{STORY}<section id='{name}'>{NAMED}</section></article>"):
            assert m.main_text(page) == LINES, name
    for around in ("<div>{}</div>", "<section class=discussion>{}</section>", "<ul class=q>{}</ul>", "<div class='b9 z'>{}</div>"):
        remarks = around.format(SAID if "<ul" not in around else SAID.replace("<div class=x7>", "<li class=x7>").replace("</div>", "</li>"))
        for page in (f"<body>{NAV}<div class=post>{STORY}</div>{remarks}", f"<article>{STORY}{remarks}</article>", f"<body>{NAV}<main>{STORY}</main>{remarks}"):
            assert m.main_text(page) == LINES, around
    nested = "".join(f"<article><header><a href=u>{w}</a> <time>10:3{k}</time></header><p>{LONG}</p></article>" for k, w in enumerate(("Anna", "Ben", "Cleo")))
    assert m.main_text(f"<article>{STORY}{nested}</article>") == LINES
    says = "".join(f"<li><p>{w} says: on 2024-01-0{k + 1}</p><p>{LONG}</p></li>" for k, w in enumerate(("Anna", "Ben", "Cleo")))
    assert m.main_text(f"<article>{STORY}<ol>{says}</ol></article>") == LINES


def test_what_only_looks_like_remarks_stays():
    terms = "".join(f"<li><b>Term {k}</b> is explained here in some words.</li>" for k in range(4))
    live = "".join(f"<div class=entry><time>1{k}:30</time><h3>What happened</h3><p>Some words on what happened then.</p></div>" for k in range(4))
    parts = "".join(f"<section><h2>Part {k}</h2><p>Some words of the part, as parts have them.</p></section>" for k in range(4))
    said = "".join(f"<blockquote><p>Quoted words number {k}.</p></blockquote>" for k in range(3))
    for part, n in ((f"<ul>{terms}</ul>", 4), (live, 12), (parts, 8), (said, 3)):
        got = m.main_text(f"<article>{STORY}{part}</article>").split("\n")
        assert got[:7] == LINES.split("\n") and len(got) == 7 + n, part


def test_forms_around_the_page_and_forms_in_it():
    page = f"<form id=aspnetForm>{NAV}<article>{STORY}</article><div class=comments>{NAMED * 8}</div></form>"
    assert m.main_text(page) == LINES
    assert m.main_text(f"<body><div>{STORY}<form><label>Your name</label><p>Fill in this form to hear from us.</p></form></div>") == LINES


def test_a_short_main_element_beside_a_long_list_of_remarks():
    assert m.main_text(f"<body>{NAV}<main><p>One sentence is all there is.</p></main>{UNNAMED}") == "One sentence is all there is."
    assert m.main_text(f"<body>{NAV}<main><p>One sentence is all there is.</p></main><div class=comments>{NAMED * 9}</div>") == "One sentence is all there is."


def test_nested_open_tags_take_linear_time():
    import time

    n = 20_000
    for bad in ("<i>" * n + "<td>x" * n, "<p><x-a>" + "<i>" * n + "<div></div>" * n, "<svg><foreignobject>" + "<i>" * n, "<div>" * n + "<header></header>" * n, "<ul>" + "<i>" * n + "<li>x" * n, "<dl>" + "<b>" * n + "<dd>x<dt>y" * n, "<table>" + "<tr><td>" * n, ("<div><b>a</b> 10:30 " * 3000) + "x"):
        began = time.perf_counter()
        m.main_text(bad)
        assert time.perf_counter() - began < 6, bad[:40]


def slow_choice(root):
    """The first choice by the rules written out over all nodes, for pages whose names and shapes say nothing."""
    every, todo = [], [root]
    while todo:
        n = todo.pop()
        every.append(n)
        todo += [k for k in n.kids if not isinstance(k, str) and not k.drop]
    sums = {id(n): sum(k.density for k in n.kids if not isinstance(k, str) and not k.drop) for n in every}
    inner = [n for n in every if n is not root and slow(n)[0] and n.tag not in m.PARTS]
    loose = sum(len("".join(k.split())) if isinstance(k, str) else slow(k)[0] for k in root.kids if isinstance(k, str) or k.tag in m.PARTS and not k.drop)
    best = max(inner, key=lambda n: (sums[id(n)], n.density, -n.depth)) if inner and 2 * loose <= slow(root)[0] else root
    up = best
    while up is not None:
        if up.tag in m.CONTAINER and 2 * slow(best)[0] >= slow(up)[0]:
            return {id(up)}
        up = up.up
    return {id(best)}


def test_the_choice_equals_the_rules_written_out():
    import random

    rng = random.Random(11)

    def page(depth=0):
        kind = rng.random()
        words = " ".join(rng.choice(("plain", "words", "of", "a", "text")) for _ in range(rng.randint(1, 25)))
        if depth > 4 or kind < 0.4:
            return f"<p>{words}</p>"
        if kind < 0.5:
            return f"<ul>{''.join(f'<li><a href=x>{rng.choice(words.split())}</a>' for _ in range(rng.randint(1, 5)))}</ul>"
        tag = rng.choice(("div", "div", "section", "article", "main", "table"))
        inner = "".join(page(depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<table><tr><td>{inner}</table>" if tag == "table" else f"<{tag}>{inner}</{tag}>"

    for _ in range(300):
        root = m.parse("<body>" + "".join(page() for _ in range(rng.randint(1, 3))))
        nodes = m.measure(root)
        m.mark(nodes)
        if any(n.hint or n.weak for n in nodes):
            continue
        want = slow_choice(root)
        for n in nodes:
            n.chars = n.tags = n.link_chars = n.link_tags = 0
            n.density = n.total = 0.0
        chosen = m.main_nodes(root)
        covered = {id(x) for top in chosen for x in m._order(top)}
        assert want <= covered
