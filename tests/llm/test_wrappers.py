"""Wrappers: alignment, and main text of hand-made templates, hosts and broken pages."""

import json
import random

import pytest

from quarry.llm import wrappers as w

PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body class="has-sidebar">
<div id=cookie-notice>We use cookies <button>OK</button></div><header><a href=/>Home</a><h1>Site</h1></header>
<div class="layout"><aside><p>Popular posts {i}</p></aside><div id="content-{i}"><h2>Fixed &amp; heading</h2>
<p>First <b>para</b>graph {i}
 with   text.<br>After a break</p><blockquote>Quote {i}</blockquote><ul><li>item one<li>item two {i}</ul>
<div class="advertisement">Buy now</div><div class="box">Posted by the staff</div><p>Second&nbsp;para {i}.</p>
<form><input><label>Name</label></form><section class="reader-comments"><p>I disagree {i}</p></section></div></div>
<nav><ul><li><a href="/a">A</a></li></ul></nav><footer>c {i}</footer><script>var a="<p>no</p>"</script></body></html>"""
WANT = "Fixed & heading\nFirst paragraph {i} with text.\nAfter a break\nQuote {i}\nitem one\nitem two {i}\nSecond para {i}."


def article(i, paragraphs):
    return (f"<html><body><nav><a href=/>x</a></nav><div class=ad>Ad {i}</div><article><h1>Title {i}</h1><p><b>Bold {i}"
            + "<br>".join(f"<p>Paragraph {i} {j} &lt;x&gt;</p>" for j in range(paragraphs)) + "</article><footer>f")


def test_single_pages():
    assert w.extract(PAGE.format(i=1)) == WANT.format(i=1).replace("\nSecond", "\nPosted by the staff\nSecond")
    want = "Title 3\nBold 3\n" + "\n".join(f"Paragraph 3 {j} <x>" for j in range(4))
    assert w.extract(article(3, 4)) == want


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("text only", "text only"), ("<script>never", ""), ("<p>a<p>b", "a\nb"),
    ("</p></div>x<td>y", "x\ny"), ("<<<>>>", "<<<>>>"), ("<p hidden>no</p><p>yes</p>", "yes"),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<article class=comment>c</article><article>a</article>", "a"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>&#233;&eacute;&amp;amp;</p>", "éé&amp;"),
])
def test_odd_pages(html, text):
    assert w.extract(html) == text


def test_alignment_makes_optional_repeated_and_slots():
    pages = ["<body><h1>a</h1><p>x</p><p>y</p><i>z</i></body>", "<body><h1>a</h1><div>d</div><p>q</p></body>"]
    got = json.loads(w.merge([w.dump(w.fold_all(w.parse(p)[0])) for p in pages]))
    body = got[0][2][0]
    assert [(k[0], k[1]) for k in body[2]][:3] == [("h1", 0), ("div", 2), ("p", 1)]
    leaf = got[1]
    assert leaf[0][0] == "a" and leaf[2][0] is None


def test_merge_does_not_depend_on_order():
    trees = [w.dump(w.fold_all(w.parse(article(i, i % 3))[0])) for i in range(6)]
    assert w.merge(trees) == w.merge(trees[::-1])


def by_wrapper(pages):
    """The text of pages of one host, without Spark and without the fallback."""
    read = [w.read_page(p) for p in pages]
    tree = w.load(w.merge([w.dump(w.fold_all(w.parse(p)[0])) for p in pages]))
    chosen = w.classify(tree)
    out = []
    for spec, texts, leaf, _ in read:
        own = w.matched(w.build(json.loads(spec), iter(lambda: ["", 1, 0, 0], None)), tree, chosen)
        out.append([t for t, i in zip(texts, leaf, strict=True) if i in own])
    return out


def test_repeated_groups_match_again():
    pages = ["<article><p>a</p><ul><li>b</ul><p>c</p></article>", "<article><ul><li>d</ul><p>e</p><ul><li>f</ul></article>"]
    assert by_wrapper(pages) == [["a", "b", "c"], ["d", "e", "f"]]


@pytest.mark.parametrize("seed", range(40))
def test_every_child_of_an_article_has_a_place_in_the_wrapper(seed):
    rnd = random.Random(seed)
    tags = ["p", "h2", "pre", "blockquote", "h3", "table", "h4"][:rnd.randint(2, 7)]
    want = [[f"text {i} {j}" for j in range(rnd.randint(1, rnd.choice([6, 60])))] for i in range(rnd.randint(2, 12))]
    pages = []
    for texts in want:
        kinds = [rnd.choice(tags) for _ in texts]
        pages.append("<nav>menu</nav><article>" + "".join(f"<{k}>{t}</{k}>" for k, t in zip(kinds, texts, strict=True)))
    assert by_wrapper(pages) == want


def test_hosts(spark):
    rows = [(i, f"http://a.com/{i}", PAGE.format(i=i)) for i in range(12)]
    rows += [(100 + i, f"http://b.com/{i}", article(i, i % 5)) for i in range(12)]
    rows += [(200, "http://a.com/odd", "<p>Unlike the others</p>"), (201, None, None), (202, "nourl", "<p>x</p>"),
             (203, "http://c.com", ""), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = w.main_text(df.repartition(5)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(12):
        assert by[i].text == WANT.format(i=i)  # the fixed box of the template went, the fixed heading stayed
        want = "\n".join([f"Title {i}", f"Bold {i}", *(f"Paragraph {i} {j} <x>" for j in range(i % 5))])
        assert by[100 + i].text == want
    assert (by[200].text, by[201].text, by[202].text, by[203].text) == ("Unlike the others", "", "x", "")
    assert all(r.n_chars == len(r.text) for r in got)


def test_many_structures_of_one_host_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 3)
    tags = ["h2", "ul", "table", "pre", "dl"]
    rows = [(i, f"http://a.com/{i}", "<nav>menu</nav><article><p>t%d</p>%s</article>" % (
        i, "".join(f"<{t}>x{i}</{t}>" for j, t in enumerate(tags) if i >> j & 1))) for i in range(32)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.main_text(df).collect()}
    assert all(got[i] == "\n".join([f"t{i}"] + [f"x{i}"] * bin(i).count("1")) for i in range(32))


def test_empty_table(spark):
    assert w.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_generated_articles_lose_nothing():
    """Pages built from known blocks; every block of the article must come back, and nothing else."""
    rnd = random.Random(12)
    for _ in range(500):
        said, body = [], []

        def text():
            return " ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(rnd.randint(8, 20)))

        for _ in range(rnd.randint(2, 9)):
            t = text()
            said.append(t)
            depth = rnd.choice([0, 0, 1, 5, 300])
            body.append(rnd.choice([
                f"<p>{t}</p>", f"<section id=search-algorithms><p>{t}</p></section>", f"<h2 class=related>{t}</h2>",
                f"<blockquote>{t}</blockquote>", f"<p class='share-price'>{t}</p>", f"<p>{t}", f"<ul><li>{t}</ul>",
                "<div>" * depth + f"<p>{t}</p>" + "</div>" * depth, f"<ul><li><a href=/x>{t}</a></li></ul>"]))
            body.append(rnd.choice(["", "", "<script>if (a <!-- b) x();</script>", "<style><!-- p{} </style>",
                                    "<!-- a <p>no</p> -->", f"<div class=ad>{text()}</div>", f"<form>{text()}</form>",
                                    f"<div class='related-posts'><p>{text()}</p></div>",
                                    f"<section class='comments'><p>{text()}</p></section>"]))
        page = (f"<html><head><title>{text()}</title></head><body><nav><ul><li><a href=/>{text()}</a></ul></nav><article>"
                + "".join(body) + f"</article><footer><p>{text()}</p></footer></body></html>")
        assert w.extract(page) == "\n".join(said), page
