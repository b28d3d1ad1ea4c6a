import random
import time

import numpy as np

from attesta.llm import ann
from attesta.llm.html_text import TagEnds, extract_main, main_text

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, a lot of them, really, accept.</p></div>
<!-- ad --><div class="ad">Buy this, now, and that.</div><article class="post"><h1>A &amp; B</h1><p>First  paragraph,\nwith <b>bold</b> &eacute;&nbsp;text.<br>next
<p>Second paragraph <a href="x">linked</a>, unclosed<ul><li>one<li>two</ul><form><p>Sign up, please, now</p></form>
<aside>beside, this, text</aside><pre>code  here</pre></article><div id="comments"><p>Great, great, great, great, great, great post by a reader</p></div>
<footer>&copy; site</footer></body></html>"""


def test_article_text():
    assert main_text(PAGE) == "A & B\nFirst paragraph, with bold é text. next\nSecond paragraph linked, unclosed\none\ntwo\ncode here"


def test_scoring_finds_plain_containers():
    filler = "some words of prose, and more of them, to read here at length. "
    page = f"<body><div><a href=a>Menu one</a> <a href=b>Menu two</a></div><div><div id=main><h2>Head</h2><div><p>{filler * 3}</p><p>{filler}</p></div><p>{filler * 2}</p></div></div><div><a href=c>{filler}</a></div></body>"
    text = main_text(page)
    assert text.startswith("Head\n") and "Menu" not in text and text.count("prose") == 6


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "plain text, no tags"), (4, "u", "<p>unclosed <b>bold"), (5, "u", "<script>only</script>"), (6, "u", "a < b & c > d <"), (7, "u", "<div>" * 2000 + "deep"), (8, "u", PAGE), (8, "u", PAGE), (9, "u", "<p title='a>b'>quoted \" one</p><!-- never ends")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "'y' as n")
    found = sorted((r.page_id, r.text) for r in extract_main(pages).collect())
    assert found[:7] == [(1, ""), (2, ""), (3, "plain text, no tags"), (4, "unclosed bold"), (5, ""), (6, "a < b & c > d <"), (7, "deep")]
    assert found[7] == found[8] and found[9] == (9, 'quoted " one')
    assert extract_main(pages.limit(0)).count() == 0


def test_names_do_not_remove_article_text():
    prose = "Some prose of this article, with commas, goes on for a good while, and ends here at last."
    inside = [
        f'<p title="Hidden gems">{prose} 1</p>',
        f'<p>{prose} 2 <a href="/hidden-valley">the valley</a></p>',
        f'<div data-id="ad 7"><p>{prose} 3</p></div>',
        f'<h2 id="related-work">Related work</h2><p>{prose} 4</p><h2 id="legal-background">Legal</h2>',
        f'<section class="discussion"><h2>Discussion</h2><p>{prose} 5</p></section>',
        f'<section id="social-consequences"><p>{prose} 6</p></section>',
        f'<p id="comments">{prose} 7</p><div class="has-sidebar no-ads"><p>{prose} 8</p></div>',
    ]
    text = main_text(f"<body><nav><a href=/>Home</a></nav><article>{''.join(inside)}</article><footer>end</footer></body>")
    assert [text.count(f"at last. {k}") for k in range(1, 9)] == [1] * 8
    assert all(x in text for x in ("the valley", "Related work", "Legal", "Discussion"))
    wrapped = main_text(f'<body><form id=aspnetForm><div class="content-sidebar-wrap"><div><p>{prose}</p><p>{prose}</p></div></div></form></body>')
    assert wrapped.count("at last.") == 2


def generated_page(rng):
    """A page and the text of its article, which is known as the page is made."""
    words = ["river", "stone", "market", "winter", "engine", "letter", "garden", "signal", "harbour", "method"]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(8, 16))).capitalize() + ", " + " ".join(rng.choices(words, k=rng.randint(6, 12))) + "."
    paragraph = lambda: " ".join(sentence() for _ in range(rng.randint(2, 5)))
    slug = lambda: "-".join(rng.choices(["related", "legal", "social", "notice", "advert", "share", "comments", *words], k=2) + [rng.choice(words)])
    beside = [
        lambda: f'<div class="comments"><div class="comment"><p>{paragraph()}</p></div></div>',
        lambda: f'<div class="ad-slot"><p>{sentence()}</p></div>',
        lambda: f'<div class="share-buttons"><a href=x>{sentence()}</a></div>',
        lambda: f'<section class="discussion"><div class="comment-body"><p>{paragraph()}</p></div></section>',
        lambda: f'<div id="cookie-notice"><p>{sentence()}</p></div>',
        lambda: f'<form><p>{sentence()}</p><input></form>',
        lambda: f'<div hidden><p>{paragraph()}</p></div><div style="display: none">{sentence()}</div>',
        lambda: f'<aside>{sentence()}</aside><ul class="menu"><li><a href=a>{sentence()}</a></ul>',
    ]
    parts, expected = [], []
    for k in range(rng.randint(2, 6)):
        title, body = " ".join(rng.choices(words, k=3)), paragraph()
        opening = rng.choice(["<section>", '<section class="discussion">', f'<section id="{slug()}">', f'<div data-class="ad comments" id="{slug()}">'])
        parts.append(f'{opening}<h2 id="{slug()}">{title}</h2><p title="hidden {title}">{body} <a href="/hidden/comments">{title}</a></p></{opening[1:].split()[0].strip(">")}>')
        expected += [title, f"{body} {title}"]
        if rng.random() < 0.7:
            parts.append(rng.choice(beside)())
    article = rng.choice(["article", "main"])
    page = f"<html><head><title>no</title></head><body><nav><ul><li><a href=/>Home</a></ul></nav>{rng.choice(beside)()}<{article}>{''.join(parts)}</{article}>{rng.choice(beside)()}<footer>{sentence()}</footer></body></html>"
    return page, "\n".join(expected)


def test_generated_pages():
    rng = random.Random(3)
    for _ in range(300):
        page, expected = generated_page(rng)
        assert main_text(page) == expected, page


def test_long_odd_pages_take_linear_time():
    for page in ("<p>" + "<b>" * 70_000 + "x" + "</i>" * 150_000, "<div>x " * 100_000, "<b>" * 60_000 + "<div>a</div>" * 60_000, '<a "' * 200_000, "<a '>" * 150_001, "<ul><li><p>some text" * 40_000):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 6


def vectors(n, dim=16, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


def brute(rows, k=10):
    sound = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    found = set()
    for q in (i for i in sound if i % 100 == 0):
        order = sorted((float(np.sqrt(((sound[i] - sound[q]) ** 2).sum())), i) for i in sound if i != q)[:k]
        found |= {(q, r + 1, i) for r, (_, i) in enumerate(order)}
    return found


def run(spark, rows):
    return ann.nearest(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")).collect()


def test_recall_and_scores(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(1500))]
    found, true = run(spark, rows), brute(rows)
    assert len({(r.query_id, r.vec_id) for r in found} & {(q, i) for q, _, i in true}) >= 0.9 * len(true)
    x = np.array([v for _, v in rows], np.float32).astype(float)
    assert all(abs(r.score - np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())) < 1e-12 for r in found)


def test_odd_vectors_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 7)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(120, 4))]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2100, [0.0] * 4), (2200, [1.0, float("nan"), 0.0, 0.0]), (2300, [1.0, None, 0.0, 0.0]), (2400, [float("inf"), 0.0, 0.0, 0.0]), (2500, [1.0, 2.0]), (None, [1.0] * 4), (5, rows[5][1])]
    found = {(r.query_id, r["rank"], r.vec_id) for r in run(spark, rows)}
    true = brute([r for r in rows if r[0] != 2500])
    assert {x for x in found if x[0] == 1000} == {x for x in true if x[0] == 1000}
    assert len(found & true) >= 0.9 * len(true) and {q for q, *_ in found} == {q for q, *_ in true}


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])]
    assert {(r.query_id, r["rank"], r.vec_id) for r in run(spark, rows)} == brute(rows)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, [(1, None)]) == []


def test_outliers_short_buckets_and_ties_are_answered_exactly(spark):
    rows = [(i + 1, v.tolist()) for i, v in enumerate(vectors(30, 8))] + [(100, [90.0, -70.0] + [0.0] * 6)]
    assert {(r.query_id, r["rank"], r.vec_id) for r in run(spark, rows)} == brute(rows)
    ties = [(i, [float(i == j) for j in range(220)]) for i in range(220)]  # all at one distance
    assert {(r.query_id, r["rank"], r.vec_id) for r in run(spark, ties)} == brute(ties)


def test_blocks_of_exact_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_NUMBERS", 16)
    monkeypatch.setattr(ann, "GROUP_NUMBERS", 1 << 10)
    rows = [(i, (v * 1000 if i % 100 == 0 else v).tolist()) for i, v in enumerate(vectors(500, 8, seed=4))]
    assert {(r.query_id, r["rank"], r.vec_id) for r in run(spark, rows)} == brute(rows)


def test_one_id_with_two_vectors(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(40, 4, seed=2))] + [(0, [5.0, 5.0, 5.0, 5.0]), (3, [1.0, 1.0, 1.0, 1.0])]
    found = run(spark, rows)
    assert [r["rank"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 11)) and len({r.vec_id for r in found}) == 10


def test_many_long_tags_leak_nothing():
    """However many tags are long, what stands in their quotes is no text; unclosed quotes cost no more than the page."""
    image = '<img data-x="' + "y" * 70_000 + ' > leaked ">'
    prose = "<p>" + "A sentence, with commas, that is long enough to read as prose. " * 5 + "</p>"
    page = "<html><body><div>" + (image + prose) * 40 + "</div></body></html>"
    text = main_text(page)
    assert "leaked" not in text and "yyy" not in text and text.count("A sentence") == 200
    open_quotes = "<html><body>" + "<b title=\"x>one</b> <i class='z>two</i>\n" * 20_000 + prose + "</body></html>"
    began = time.process_time()
    main_text(open_quotes)
    assert time.process_time() - began < 20


def test_ends_of_tags():
    """Against a plain walk over the letters."""
    rng = random.Random(6)
    for _ in range(300):
        page = "".join(rng.choices("<>\"'ab /", k=60))
        ends = TagEnds(page)
        for at in range(len(page)):
            quote, found = None, None
            for i in range(at, len(page)):
                if quote:
                    quote = None if page[i] == quote else quote
                elif page[i] in "\"'":
                    quote = page[i]
                elif page[i] == ">":
                    found = i
                    break
            assert ends.end(at) == found
