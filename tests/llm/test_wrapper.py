import json
import re
from html import unescape

import pytest

from hostledger.llm import queries
from hostledger.llm.wrapper import blocks_of, extract_text, folded, main_text, matched, merge, parse, wrapper_of


def tree(label, *children):
    return [label, 1, "", 0, False, list(children)]


def best_match(a, b):
    """Simple tree matching by its definition."""
    if a[0] != b[0]:
        return 0

    def pairs(x, y):
        if not x or not y:
            return 0
        return max(pairs(x[1:], y), pairs(x, y[1:]), pairs(x[1:], y[1:]) + best_match(x[0], y[0]))

    return 1 + pairs(a[5], b[5])


def test_matching():
    a = tree("r", tree("a", tree("x")), tree("b"), tree("c", tree("y"), tree("z")))
    b = tree("r", tree("b"), tree("a"), tree("c", tree("z")), tree("d"))
    assert matched(a, b)[0] == best_match(a, b) == 4
    assert matched(a, a)[0] == best_match(a, a) == 7
    assert [c[0] for c in merge(a, b)[5]] == ["b", "a", "b", "c", "d"]


def text(page):
    return "\n".join(blocks_of(parse(page)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>One <b>two</b>\n three<p>Four", "One two three\nFour"),
        ("<p>a<br>b</p>loose<div>c</div>d", "a b\nloose\nc\nd"),
        ("<p>x &amp; y &eacute; &#233; &#xe9; &copy; &unknown; &amp", "x & y é é é © &unknown; &"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes<!-- <p>no --></p>", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
        ("<nav>n</nav><form><p>f</p></form><div class='cookie-banner'>c</div><p>k", "k"),
        ("<p title='a>b'>q</p><p hidden>h</p><p aria-hidden=true>h</p>", "q"),
        ("<p>1 < 2 and 3 <", "1 < 2 and 3 <"),
        ("<p>cut <a href='", "cut"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
        ("<div class=shadow>kept, shadow is no ad</div>", "kept, shadow is no ad"),
    ],
)
def test_blocks(page, want):
    assert text(page) == want


def site(i, region):
    return (
        f"<html><head><title>t{i}</title></head><body><div class=top>Our site</div><div id=menu><a href=/>home {i}</a></div>"
        f"<div class=wrap><div class=left>Always the same box</div><div class=text-{i}>{region}</div></div>"
        f"<div class=comments><p>reader {i}</p></div><footer>f{i}</footer></body></html>"
    )


def test_wrapper_without_article_element():
    pages = [site(i, f"<h2>Head {i}</h2><p>Body {i} words words words</p><p>Said on every page</p>") for i in range(5)]
    template = folded(parse(pages[0]))
    for p in pages[1:]:
        template = merge(template, folded(parse(p)))
    assert wrapper_of(template) == ["html", "body", "div.wrap", "div.text-#"]
    assert main_text(pages[2], wrapper_of(template)) == "Head 2\nBody 2 words words words\nSaid on every page"


def expected(page):
    """The article of the test pages, by patterns that hold for them alone."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1].replace("<br>", " ")
    parts = [" ".join(unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in queries.table(spark, sf_dir, "pages").collect()}
    got = queries.op6_main_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text) == (pages[r.page_id].url, expected(pages[r.page_id].html)) and r.n_chars == len(r.text)


def test_odd_rows(frame):
    rows = [
        (1, None, None, "x"), (2, "http://a.com/", "", "x"), (3, "no host", "<p>alone", "x"), (None, "http://a.com/1", "<article><p>a</article><p>b", "x"),
        (4, "http://a.com/2", "plain text only", "x"), (4, "http://a.com/2", "plain text only", "x"), (5, "http://b.com", "<p>x</p>" * 3000, "x"),
    ]
    got = extract_text(frame(rows, "page_id long, url string, html string, host string")).collect()
    assert sorted(((r.page_id, r.text, r.n_chars, r.host) for r in got), key=str) == sorted(
        [(1, "", 0, "x"), (2, "", 0, "x"), (3, "alone", 5, "x"), (None, "a", 1, "x"), *[(4, "plain text only", 15, "x")] * 2,
         (5, "\n".join("x" * 3000), 5999, "x")], key=str,
    )
    assert extract_text(frame([], "page_id long, url string, html string")).count() == 0


def test_text_after_a_deep_part():
    deep = "<div>" * 1500 + "<nav>menu far below</nav>word" + "</div>" * 1500
    page = f"<body><div class=box><div class=story><p>first part</p>{deep}<p>last part</p></div></div><div class=foot>other</div></body>"
    assert main_text(page, ["html", "body", "div.box", "div.story"]) == "first part\nword\nlast part"
    spans = "<div class=story><p>first part</p><div>" + "<font>" * 5000 + "deep</div><p>last part</p></div><div class=foot>other</div>"
    assert main_text(spans, ["html", "div.story"]) == "first part\ndeep\nlast part"
    json.dumps(merge(folded(parse(page)), folded(parse(page.replace("word", "term")))))


def slug(n):
    return "x" + "".join(chr(97 + int(d)) for d in str(n))


def induced(pages):
    template = folded(parse(pages[0]))
    for page in pages[1:]:
        template = merge(template, folded(parse(page)))
    return template, wrapper_of(json.loads(json.dumps(template)))


def test_article_after_many_siblings_with_labels_of_their_own():
    pages = []
    for p in range(4):
        boxes = "".join(f"<div class={slug(1000 * p + i)}>box</div>" for i in range(250))
        pages.append(f"<body>{boxes}<div class=story><p>story number {p} {slug(p) * 400}</p></div></body>")
    template, path = induced(pages)
    assert [main_text(p, path) for p in pages] == [f"story number {p} {slug(p) * 400}" for p in range(4)]
    body = template[5][0]
    assert any(c[0] == "div.story" and c[1] == 4 for c in body[5]) and len(body[5]) <= 202


def test_article_container_with_a_label_of_its_own():
    pages = [
        f"<body><div class=top>same</div><div class={slug(p)}><p>a long story of {slug(p)}</p></div><div class=box><p>{p} {p}</p></div></body>"
        for p in range(100, 106)
    ]
    path = induced(pages)[1]
    assert [main_text(p, path) for p in pages] == [f"a long story of {slug(p)}" for p in range(100, 106)]


ARTICLES = [" ".join(f"w{k * n % 97}" for k in range(2, 52)) for n in range(3, 11)]
MENU = "<nav><a href=/>Home</a></nav>"
SEARCH = "<form action=/s><label>Search here</label><input name=q></form>"
CONTAINERS = {
    "plain class": ("<div class=content><p>", "</p></div>"),
    "state class": ('<div class="content has-sidebar"><p>', "</p></div>"),
    "negated class": ('<div class="entry no-comments"><p>', "</p></div>"),
    "tag class": ('<div class="post tag-social-media"><p>', "</p></div>"),
    "topic class": ('<div class="news-alert story"><p>', "</p></div>"),
    "slug id": ('<div id="side-effects-of-x"><p>', "</p></div>"),
    "page form": ("<form id=aspnetForm><div><p>", "</p></div></form>"),
    "form round an article": ("<form><article><p>", "</p></article></form>"),
    "no class": ("<div><p>", "</p></div>"),
}


@pytest.mark.parametrize("kind", CONTAINERS)
def test_articles_stay_whatever_their_container_is_called(frame, kind):
    before, after = CONTAINERS[kind]
    pages = [
        (i, f"http://host.test/{i}", f'<html><body>{MENU}{SEARCH}<div class="sidebar-left">About us</div>{before}{a}{after}<div class="ad-box">Buy {i}</div>'
         f'<div class="comments">Nice, {i}</div><footer>bye</footer></body></html>')
        for i, a in enumerate(ARTICLES)
    ]
    got = {r.page_id: r.text for r in extract_text(frame(pages, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(ARTICLES))


def test_forms_without_the_article_are_set_apart():
    assert text(f"<p>{ARTICLES[0]}</p><form><p>Your name</p><input></form>") == ARTICLES[0]
    assert text(f"<form><p>{ARTICLES[0]}</p><form>x</form></form><p>bye</p>").startswith(ARTICLES[0])
