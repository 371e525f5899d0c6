import html
import random
import re

import pytest

from sheetstorm.llm.html_extract import Page, extract_group, extract_main_text, template

from .helpers import SF

WORDS = [f"word{i}" for i in range(400)]


def sentence(rng, n=14):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def made_page(rng, kind):
    """A page and its main text: blocks among all that does not belong to it."""
    blocks = [sentence(rng, rng.randint(10, 40)) + " & café < 5" for _ in range(rng.randint(3, 7))]
    body = "".join(f"<p>{html.escape(b)}</p>\n" for b in blocks)
    beside = (
        '<div class="cookie-notice">We use cookies.</div><header><a href="/">Site</a></header><nav><ul>' + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.choices(WORDS, k=5)) + "</ul></nav>"
        f"<aside><p>{sentence(rng)}</p></aside><div class='ad banner'>{sentence(rng)}</div><form><p>Subscribe now</p><input name=x><button>Go</button></form>"
    )
    after = f"<div id='comments'><p>{sentence(rng)}</p><p>{sentence(rng)}</p></div><footer><p>&copy; Site {rng.randint(1, 9)}</p></footer>"
    inner = f"<article>{body}</article>" if kind == "article" else f"<div class='content'><div>{body}</div></div>"
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{beside}<!-- x -->{inner}{after}</body></html>", "\n\n".join(blocks)


def test_made_pages(spark):
    rng = random.Random(4)
    for kind in ("article", "div"):
        pages = [made_page(rng, kind) for _ in range(12)]
        assert extract_group([p for p, _ in pages]) == [t for _, t in pages]
        assert extract_group([pages[0][0]] * 5 + [pages[1][0]]) == [pages[0][1]] * 5 + [pages[1][1]]


def test_near_copies_are_no_template():
    rng = random.Random(7)
    for inner in ("article", "div"):
        texts = ["A short heading", sentence(rng, 30), "Short words", sentence(rng, 40)]
        body = "".join(f"<p>{t}</p>" for t in texts)
        pages = [f"<html><body><div class='ad'>{sentence(rng)}</div><{inner}>{body}</{inner}><footer>{i}</footer></body></html>" for i in range(5)]
        assert extract_group(pages) == ["\n\n".join(texts)] * 5


def test_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.DOTALL)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?(b|i|br)>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, "http://a.org/", None), (2, None, ""), (None, "http://a.org/", "<p>just &amp; text"), (4, "http://a.org/", "plain &lt;b&gt; text"), (5, "x", "<div" * 2000), (6, "x", "<p>a</p>" * 5000), (6, "x", "<p>a</p>" * 5000), (7, "x", "<script>never ends"), (8, "x", "a b<br>c<P>d</P>")]
    got = extract_main_text(spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, html string, host string, groups long")).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    assert len(got) == 9 and by_id[1][0].text == by_id[2][0].text == by_id[7][0].text == "" and len(by_id[6]) == 2
    assert by_id[None][0].text == "just & text" and by_id[4][0].text == "plain <b> text" and by_id[8][0].text == "a b c\n\nd" and by_id[6][0].n_chars == 5000 * 3 - 2
    assert extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_of_tokens():
    pages = [Page(f"<div><h2>Menu</h2><ul>{'<li><i>x</i></li>' * n}</ul></div><p>{n} own</p>") for n in (2, 3, 5)]
    root, *inner = template(pages)
    assert root.tokens == ["<div", "<h2", "=Menu", "</h2", "<ul", "</ul", "</div", "<p", "</p"] and root.parent is None
    assert [c for c in inner if c.tokens == ["<li", "<i", "=x", "</i", "</li"] and c.parent == 0 and c.slot == 5]


def test_classes_nest_and_keep_their_order():
    def page(sizes):
        return Page("<table>" + "".join("<tr><th>k</th>" + "<td>v</td>" * n + "</tr>" for n in sizes) + "</table>")

    rows = template([page(x) for x in ((2, 3), (1, 1, 4), (5, 5, 5, 5))])
    outer = next(k for k, c in enumerate(rows) if "<tr" in c.tokens)
    cells = next(c for c in rows if "<td" in c.tokens)
    assert rows[outer].tokens == ["<tr", "<th", "=k", "</th", "</tr"] and cells.parent == outer and cells.tokens == ["<td", "=v", "</td"]
    mixed = template([Page(x) for x in ("<s>a</s><u>b</u><s>a</s><u>b</u>", "<u>b</u><s>a</s>", "<s>a</s><u>b</u>" * 3)])
    assert not [c for c in mixed if "=a" in c.tokens and "=b" in c.tokens]


def plain_page(rng, site, article, *, fixed="All rights reserved by the owner of this fine site"):
    """No element or class that tells what it is."""
    menu = "".join(f"<td><a href='/{w}'>{w}</a></td>" for w in rng.choices(WORDS, k=6))
    blocks = "".join(f"<p>{b}</p>" for b in article[1:])
    return f"<html><body><table><tr>{menu}</tr></table><div><span>{sentence(rng, 6)}</span></div><div class='x1 {site}'><h1>{article[0]}</h1>{blocks}</div><div><p>{fixed}</p></div></body></html>"


def test_pages_without_telling_names():
    rng = random.Random(11)
    articles = [[sentence(rng, 5), *(sentence(rng, rng.randint(20, 40)) for _ in range(rng.randint(2, 6)))] for _ in range(9)]
    assert extract_group([plain_page(rng, "s", a) for a in articles]) == ["\n\n".join(a) for a in articles]


def test_wrappers_classes_inside_and_unclosed_heads():
    rng = random.Random(12)
    for inner in ("article", "div"):
        articles = [[sentence(rng, 25) for _ in range(4)] for _ in range(6)]
        pages = [
            "<html><head><title>t</title><body><div class='layout-with-sidebar'><div class='sidebar'><p>" + sentence(rng, 8) + f"</p></div><{inner} class='content'>"
            + f"<p class='search-results'>{a[0]}</p>" + "".join(f"<p>{x}</p>" for x in a[1:]) + f"</{inner}></div></body></html>"
            for a in articles
        ]
        assert extract_group(pages) == ["\n\n".join(a) for a in articles], inner
        assert [extract_group([p])[0] for p in pages] == ["\n\n".join(a) for a in articles], inner


def test_a_passage_that_articles_share_stays():
    rng = random.Random(13)
    shared = sentence(rng, 6)
    articles = [[sentence(rng, 30), shared, sentence(rng, 30)] for _ in range(5)]
    pages = [made_around(rng, "".join(f"<p>{x}</p>" for x in a)) for a in articles]
    assert extract_group(pages) == ["\n\n".join(a) for a in articles]


def made_around(rng, body):
    return f"<html><body><nav><a href='/'>Home</a></nav><article>{body}</article><footer>{rng.random()}</footer></body></html>"


STORY = ["The river rose by two metres in a single night and took the old bridge with it.", "Nobody in the village had seen such water before, the mayor said on {day}.", "A ferry now carries {n} people a day across, among them the pupils of the school."]


def stories(n, frame):
    """n pages of a host in a frame, each with its own article of three paragraphs and a few more."""
    for i in range(n):
        own = [p.format(day=["Monday", "Tuesday", "Friday", "Sunday", "Thursday", "Saturday"][i % 6], n=100 + 7 * i) + f" Report {i} {'abcdefgh'[i] * 5}." for p in STORY] + [f"More of the story {i}, line {k}, told by witness {chr(65 + i + k)}." for k in range(i % 3)]
        yield frame("".join(f"<p>{p}</p>" for p in own), i), "\n\n".join(own)


@pytest.mark.parametrize("opens", [lambda k: f'<div class="col{k}">', lambda k: f'<div class="css-{k}ab">', lambda k: "<div>"])
def test_equal_divs_are_told_apart_by_their_place(opens):
    menu, footer = '<a href="/">Home</a> About us and our readers, since 1901', "Copyright of the river courier, all rights reserved"
    pages = list(stories(6, lambda article, i: f"<html><body>{opens(1)}{menu}</div>{opens(2)}{article}</div>{opens(3)}{footer}</div></body></html>"))
    assert extract_group([p for p, _ in pages]) == [t for _, t in pages]


def test_rows_that_repeat_beside_the_article_go():
    """Readers' comments in rows of a nested class, inside the element around the article."""

    def frame(article, i):
        rows = "".join(f'<div class="row"><b>reader {i * 7 + k}</b> <a href="#">Reply</a><span>I saw that too in place {i}{k}, well done</span></div>' for k in range(1 + i % 4))
        return f'<html><body><main><div class="story">{article}</div><div class="talk"><h4>What readers say</h4>{rows}</div></main></body></html>'

    pages = list(stories(8, frame))
    assert extract_group([p for p, _ in pages]) == [t for _, t in pages]


def test_class_words_decide_nothing_inside_an_article():
    alone = '<html><body><article><h1>Notice</h1><div class="share-your-notice-page"><p>All of the notice stands here, and it is long enough to be read.</p></div></article></body></html>'
    assert extract_group([alone]) == ["Notice\n\nAll of the notice stands here, and it is long enough to be read."]

    def frame(article, i):
        extra = '<div class="social-history"><p>A social history of the valley, as told by its oldest people.</p></div>' if i == 2 else ""
        return f'<html><body><div class="top">Menu of the courier</div><div class="text">{article}{extra}</div><div class="end">Imprint of the courier</div></body></html>'

    found = extract_group([p for p, _ in stories(6, frame)])
    assert "A social history of the valley" in found[2] and not any("courier" in x for x in found)
