import html
import re

import pytest
from cases import SF

from assaylens.llm import html_main
from assaylens.llm.queries import QUERIES


def plain(page):
    """The article of the given tables' pages."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.DOTALL)
    text = re.sub(r"</?(?:p|h1|br)>", "\0", inner[1]) if inner else ""
    text = html.unescape(re.sub(r"</?b>", "", text)).replace("\0", " ")
    return " ".join(text.split())


def test_query_against_brute_force(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op6_html_main"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in rows} == {
        i: (p.url, plain(p.html), len(plain(p.html))) for i, p in pages.items()
    }


def text(page, literals=()):
    return html_main.main_text(html_main.tokens(page), set(literals))


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<body><nav>menu</nav><main><h1>A</h1><p>b <b>c</b>d\n e</main><footer>x</footer>", "A b cd e"),
        ("<article><header><h1>T</h1></header><p>x<script>var a='</p>'</script>y</p><aside>no</aside></article>", "T xy"),
        ("<article>a<!-- x > y -->b<div class='share-bar ad'>no</div><p>c &amp; d&nbsp;&eacute;</article>z", "ab c & d é"),
        ("<article>text<section id=comments><p>nice!</p></section></article>", "text"),
        ("<div class=sidebar>s</div><div><p>long text here</p><p>more</p></div><div>x</div>", "long text here more x"),
        ("<article>1 < 2 <p title=\"a > b\">q</p><form><input><p>no</form></article>", "1 < 2 q"),
        ("<ARTICLE>Up<BR>down</ARTICLE>", "Up down"),
        ("no markup at all", "no markup at all"),
        ("<div class=cookie-notice>we use</div>", ""),
        ("", ""),
        (None, ""),
        ("<article>cut <p>off &am", "cut off &am"),
        ("<article><script>never closed", ""),
    ],
)
def test_articles(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<p class='notice'>n</p><article>all of it</article>", "all of it"),
        ("<p class='notice'>n<article>all of it</article>", "all of it"),
        ("<article><p class=ad>Ad</p><div><p>real</p></div></article>", "real"),
        ("<article><p class=ad>Ad<div><p>real</p></div></article>", "real"),
        ("<article><p class=promo>no</p><h2>head</h2><ul><li>one</li></ul></article>", "head one"),
        ("<article><p class=promo>no<h2>head</h2><p>x</article>", "head x"),
        ("<article><ul><li class=share>s<ul><li>t</li></ul>u</li><li>one</ul>two</article>", "one two"),
        ("<article><ul><li class=share><div>s<li>one</ul>two</article>", "one two"),
        ("<article><ul><li><p class=ad>a</li>b</ul>c</article>", "b c"),
        ("<article><table><tr class=ad><td>a<td>b</tr><tr><td class=ad>c<td>d<tr><td>e</table>f</article>", "d e f"),
        ("<article><td class=ad><table><tr><td>a</td></tr></table>b</td>c</article>", "c"),
        ("<article><dl><dt class=ad>a<dd>b<dt>c</dl></article>", "b c"),
    ],
)
def test_marked_elements_of_implied_end(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<div><div><p>a</p></div><div><p>b</p></div></div>", "a b"),
        ("<body><div><p>first</p></div><div><div><p>second, longer</p></div></div></body>", "first second, longer"),
        ("<body><div><p>a</p><ul><li>long item one<li>long item two</ul><p>b</p></div></body>", "a long item one long item two b"),
        ("<div><p>a</p><pre>a long listing</pre><blockquote>a long quotation</blockquote>b</div>", "a a long listing a long quotation b"),
        ("<h1>t</h1><div><p>a</p></div><section>b</section>c", "t a b c"),
        ("<body><nav>n</nav><h1>t</h1><div>a</div><div class=ad>x</div><div>b</div><footer>f</footer>", "t a b"),
    ],
)
def test_articles_over_several_containers(page, expected):
    assert text(page) == expected


ARTICLE = "<article><h1>Title</h1><p>The whole story.</p></article>"


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ('<article class="post comments-open category-alert"><p>all</p></article>', "all"),
        (f'<div class="content has-sidebar">{ARTICLE}</div>', "Title The whole story."),
        (f'<div class="page-header-fixed">{ARTICLE}</div>', "Title The whole story."),
        (f'<div class="banner-layout menu-page">{ARTICLE}</div><div class=x>other</div>', "Title The whole story."),
        (f"<form id=f><nav>n</nav>{ARTICLE}<input></form>", "Title The whole story."),
        ("<form><header>h</header><div><p>no article element</p></div></form>", "no article element"),
        (f"<head><title>x</title><meta name=a><body>{ARTICLE}", "Title The whole story."),
        ("<head><title>x</title><div>text</div>", "text"),
        (f"<body><nav><ul><li>one<li>two</ul>{ARTICLE}</body>", "Title The whole story."),
        ("<body><nav><ul><li>one</ul><div><p>a</p><p>b</p></div></body>", "a b"),
        ("<article><div class='article-header'><h1>Title</h1></div><p>x</p></article>", "Title x"),
        ("<div class='article-header'><h1>Title</h1></div><div class=site-header>s</div><p>x</p>", "Title x"),
        (
            "<div>Intro line one here of the story.</div><div><p>long long long long long long long</p></div><div>An end.</div>",
            "Intro line one here of the story. long long long long long long long An end.",
        ),
        ("<div class='side-by-side'>a</div><div class='left-side'>b</div><div class='search-results'>c</div>", "a c"),
        ("<div>text</div><div class=related-posts><article>teaser</article></div>", "text"),
        ("<p>text</p><ol class=comment-list><li><article class=comment-body>nice</article></ol>", "text"),
        (f"{ARTICLE}<article class='comment' id=comment-5>nice</article>", "Title The whole story."),
        ("<article>text<section id=comments><p>nice, and the page ends here", "text"),
        ("<p>text<form><p>Name</p><input></form>", "text"),
    ],
)
def test_marks_around_articles(page, expected):
    assert text(page) == expected


@pytest.mark.parametrize(("pages", "kept"), [(5, True), (6, False)])
def test_texts_of_articles_are_literals_on_more_pages(pages, kept):
    page = "<body><div>Site</div><article><p>A series of ours.</p><p>part {}</p></article></body>"
    known = wrapper([page.format(i) for i in range(pages)])
    read = html_main.tokens(page.format(1))
    inside = {k for k, article in html_main.outline(read) if article}
    found = html_main.nearest([(known, set())], html_main.own_wrapper(read), inside)
    assert html_main.main_text(read, found) == ("A series of ours. part 1" if kept else "part 1")
    assert "Site" in {read[k].text for k in found}


def wrapper(pages):
    return html_main.merge([html_main.own_wrapper(html_main.tokens(p)) for p in pages])


def shape(nodes):
    return " ".join(
        f"({shape(n.body)}){n.kind}" if n.kind in "+?" else ("lit" if n.kind == "#" and n.low == n.high else n.key)
        for n in nodes
    )


def test_inferred_wrapper():
    pages = [
        "<body><div>Site</div><ul><li>a</li><li>b</li></ul><h1>one</h1><p>x</p><p>y</p></body>",
        "<body><div>Site</div><ul><li>c</li></ul><h1>two</h1><hr><p>z</p></body>",
        "<body><div>Site</div><ul><li>d</li><li>e</li></ul><h1>three</h1><p>u</p><p>v</p></body>",
    ]
    found = shape(wrapper(pages))
    assert found == "body div lit /div ul (li #)+ /ul h1 # /h1 (hr)? (p #)+ /body"
    assert found == shape(wrapper(pages[::-1]))
    again = html_main.own_wrapper(html_main.tokens(pages[0]))
    literals = html_main.roles(wrapper(pages), again)
    tokens = html_main.tokens(pages[0])
    assert [tokens[k].text for k in literals] == ["Site"]


def pages_frame(spark, rows):
    return spark.createDataFrame(
        [(i, u, h, "x", "y", 1) for i, u, h in rows], "page_id bigint, url string, html string, host string, wrapper string, id int"
    )


def test_literals_of_a_host_are_no_article(spark):
    page = "<body><div>Welcome to the site of sites, dear reader</div><div><p>{0}</p><p>{0} more</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(f"own text {i}" * 3)) for i in range(60)]
    found = {r.id: r.text for r in html_main.extract(pages_frame(spark, rows).repartition(7)).collect()}
    assert all(found[i] == f"{f'own text {i}' * 3} {f'own text {i}' * 3} more" for i in range(60))


def literal_texts(pages, page):
    """Texts of a page that are literals of the wrapper of some."""
    read = html_main.tokens(page)
    return [read[k].text for k in sorted(html_main.roles(wrapper(pages), html_main.own_wrapper(read)))]


def test_copies_and_repeats_are_one_page():
    page = "<body><h1>title</h1><div>intro</div><p>same</p><p>same</p><p>same</p></body>"
    assert literal_texts([page], page) == []
    assert literal_texts([page] * 5, page) == []
    # a copy whose advertisement differs is a copy
    copies = [page.replace("<h1>", f"<div class=ad>{i}</div><h1>") for i in range(5)]
    assert literal_texts(copies, copies[0]) == []
    others = [page.replace("title", f"t{i}").replace("<p>", f"<p>{i} ") for i in range(3)]
    assert literal_texts([page, page, *others[:1]], page) == []
    assert literal_texts([page, page, *others], page) == ["intro"]


def test_copies_keep_their_text(spark):
    page = "<body><div>all</div><section>of the text</section></body>"
    rows = [(i, "http://c.org/", page) for i in range(4)] + [(9, "http://d.org/", "<p>one</p>" * 3)]
    found = {r.id: r.text for r in html_main.extract(pages_frame(spark, rows)).collect()}
    assert found[9] == "one one one"
    assert all("of the text" in found[i] for i in range(4))


@pytest.mark.parametrize("element", ["article", "main", "div", "section"])
def test_template_text_in_the_article(spark, element):
    rows, expected = [], {}
    for i in range(40):
        parts = [f"own text {i} {j}" for j in range(1 + i % 4)]
        paragraphs = "".join(f"<p>{p}</p>" for p in parts)
        rows.append((
            i, f"http://h{i % 2}.org/{i}",
            f"<body><div>Site</div><{element}><p>All rights reserved here.</p><h1>title {i}</h1>{paragraphs}"
            f"<p>Tell your friends about this.</p></{element}><div>Printed on paper</div></body>",
        ))
        expected[i] = " ".join([f"title {i}", *parts])
    rows.append((99, "http://alone.org/", rows[0][2]))
    found = {r.id: r.text for r in html_main.extract(pages_frame(spark, rows)).collect()}
    alone = found.pop(99)
    assert found == expected
    assert "All rights reserved here. title 0 own text 0 0 Tell your friends about this." in alone


def test_varied_and_long_pages_keep_their_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html_main, "NODES", 30)
    monkeypatch.setattr(html_main, "LONGEST", 40)
    rows, expected = [], {}
    for i in range(24):  # six kinds of pages that do not fit into one wrapper
        kind = "abcdef"[i % 6]
        parts = [(f"h{1 + (i + j) % 2}", f"own {i} {j}") for j in range(9)]
        inner = "".join(f"<{h} class={kind}{'xyz'[j % 3]}>{t}</{h}>" for j, (h, t) in enumerate(parts))
        rows.append((i, f"http://h.org/{i}", f"<body><div class={kind}>Site {kind}</div>{inner}</body>"))
        expected[i] = " ".join(t for _, t in parts)
    for i in range(100, 104):  # pages longer than what is aligned at once
        kinds = [f"<h{1 + j * j % 5} class=q{chr(97 + j % 23)}>own {i} {j}</h{1 + j * j % 5}>" for j in range(60)]
        rows.append((i, f"http://long.org/{i}", f"<body><div>Top</div>{''.join(kinds)}<div>End</div></body>"))
        expected[i] = " ".join(f"own {i} {j}" for j in range(60))
    frame = pages_frame(spark, rows)
    lists = [[html_main.own_wrapper(html_main.tokens(h)) for _, u, h in rows if u.startswith("http://h.")]]
    assert len(html_main.families(lists[0])) > 1
    for _, _, page in rows:
        read = html_main.tokens(page)
        own = html_main.own_wrapper(read)
        host = lists[0] if "Site" in page else [
            p for _, u, h in rows if "long" in u for p in html_main.pieces(html_main.own_wrapper(html_main.tokens(h)))
        ]
        known = [(w, {n.sign() for n in w}) for w in html_main.families(host)]
        found = html_main.main_text(read, html_main.nearest(known, own))
        assert found in expected.values()
    assert len(html_main.wrappers(frame, fan_in=4).collect()) == 2


def test_ids_of_headings_are_no_structure():
    page = "<body><div id=top>Site</div><h2 id='{0}'>{0}</h2><p id={0}>text {0}</p><h3 id=related>no</h3></body>"
    pages = [page.format(w) for w in ("one", "two", "three")]
    assert len({" ".join(n.sign() for n in html_main.own_wrapper(html_main.tokens(p))) for p in pages}) == 1
    assert text(pages[0]) == "Site one text one"
    assert "Site" in literal_texts(pages, pages[0])


def test_a_text_unlike_the_literal_stays():
    page = "<body><div>{}</div><p>{}</p></body>"
    pages = [page.format("Site", f"own {i}") for i in range(3)]
    assert literal_texts(pages, pages[0]) == ["Site"]
    assert literal_texts(pages, page.format("news", "x")) == []


def test_awkward_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    many = "<article>" + "".join(f"<p class=c{i}>w</p><h{i % 6}>" for i in range(20_000)) + "</article>"
    rows = [
        (1, None, None), (2, "", ""), (3, "no host", "<article>x</article>"), (3, "no host", "<article>x</article>"),
        (None, "http://a/b", "<article>y</article>"), (5, "http://a/c", deep), (6, "http://a/d", many),
        (7, "http://a/e", "<" * 50_000), (8, "http://a/f", "<a title='" * 5_000),
    ]
    df = pages_frame(spark, rows)
    found = html_main.extract(df).collect()
    assert len(found) == len(rows)
    by_id = {r.id: r for r in found}
    assert by_id[1].text == by_id[2].text == "" and by_id[3].text == "x" and by_id[None].text == "y"
    assert by_id[5].text == "deep" and by_id[6].text == " ".join(["w"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_main.extract(df.limit(0)).count() == 0


def test_rounds_leave_one_wrapper_per_host(spark):
    rows = [(i, f"http://h{i % 2}.org/", "<body>" + "".join(f"<t{j}>" for j in range(i % 37)) + "x</body>") for i in range(150)]
    found = html_main.wrappers(pages_frame(spark, rows), fan_in=3).collect()
    assert sorted(r.host for r in found) == ["h0.org", "h1.org"]
