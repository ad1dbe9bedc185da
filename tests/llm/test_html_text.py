import re

import pytest

from litevidence.llm import html_text as ht
from litevidence.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "The quick brown fox jumps over the lazy dog near the river bank today. "


def text(page, learned=None):
    return ht.extract(page, ht.Weights(learned or {}))


def test_article_and_its_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t='</p><p>no</p>';</script></head><body>"
        "<nav><ul>" + "<li><a href='/x'>menu entry here</a></li>" * 8 + "</ul></nav><!-- ad --><div class=\"ad\">Buy this thing now please.</div>"
        "<article><h1>A &amp; B&eacute; &#169;</h1><p><b>First   line\n here.<br><p>" + LONG * 2 + "</p>"
        "<aside>Aside words that are not wanted at all</aside><p>Last <i>in</i>line&nbsp;text.</p></article>"
        "<section class='comments'>" + "<p>I like this very much, thank you all.</p>" * 12 + "</section>"
        "<form>Name <input> <button>Send</button></form><footer>&copy; site words words</footer></body></html>"
    )
    assert text(page).split("\n\n") == ["A & Bé ©", "First line here.", (LONG * 2).strip(), "Last inline text."]


@pytest.mark.parametrize("page", ["", "   ", "<nav>only menu</nav>", "<script>x</script>", "<div", "<!-- x", "<p class='", "</p></div>"])
def test_nothing(page):
    assert text(page) == ""


def test_without_tags_or_ends():
    assert text("just &lt;text&gt;\n here") == "just <text> here"
    assert text("<p>one<p>two<div>three") == "one\n\ntwo\n\nthree"
    assert text("<ul><li>a b c<li>d e f</ul> 1 < 2") == "a b c\n\nd e f\n\n1 < 2"


def test_scan_finds_the_best_region():
    page = "<p>few words</p>" + "<td></td>" * 30 + "<p>" + LONG * 3 + "</p>" + "<td></td>" * 50 + "<p>few words</p>"
    assert text(page) == (LONG * 3).strip()


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG.strip()
    assert len(text("<article><p>" + LONG * 20000 + "</article>")) == len(LONG) * 20000 - 1


def test_learned_weights(spark):
    pages = [(i, f"<body><div class='zzz'>{'side words ' * 6}</div><article><p>{LONG * 3}</article></body>") for i in range(8)]
    learned = ht.learn(spark.createDataFrame([*pages, (9, None), (10, "")], "page_id long, html string"))
    assert learned[".zzz"] < 0 and "p" not in learned
    page = f"<div class='zzz'>{'side words ' * 40}</div><div><p>{LONG}</div>"
    assert text(page, learned) == LONG.strip() and "side" in text(page)


def test_query(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op7_best_region"](spark, SF).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", html[r.page_id], re.DOTALL).group(1)
        parts = [" ".join(__import__("html").unescape(re.sub("<[^>]+>", "", p)).split()) for p in re.split(r"<br>|</?p>|</?h1>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_table_edges(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "u", "")], "page_id long, url string, html string")
    got = ht.extract_pages(pages, ht.learn(pages)).collect()
    assert [r._text for r in got] == ["", "", ""]
    assert ht.extract_pages(pages.limit(0), {}).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single-post has-sidebar'><article><p>{}</p></article></body>",
        "<html class='no-menu'><body class=\"no-comments\"><div><p>{}</p></div></body></html>",
        "<body><main class='with-sidebar'><p>{}</p></main></body>",
        "<body><article class='post comments-open' id='search-7'><p>{}</p></article></body>",
        "<body><div class='page has-sidebar'><div><article><p>{}</p></article></div></div></body>",
        "<body><div id='search-page'><main><p>{}</p></main></div></body>",
    ],
)
def test_class_names_of_the_frame(page):
    menu = "<div class='sidebar'>" + "<p>Side words of no use.</p>" * 3 + "</div>"
    comments = "<section class='comments'>" + "<p>I like this very much.</p>" * 3 + "</section></"
    assert text(page.format(LONG * 2)) == (LONG * 2).strip()
    assert text(page.replace("<p>{}</p></", "<p>{}</p>" + menu + comments).format(LONG * 2)) == (LONG * 2).strip()
    assert ht.label(page.format(LONG)) is None or set(ht.label(page.format(LONG))[0]) == {"", "p"}


def test_comments_as_articles():
    comments = "<section class='comments'>" + f"<article class='comment'><p>{LONG}</p></article>" * 4 + "</section>"
    assert text(f"<body class='comments'><article><p>{LONG * 2}</p></article>{comments}</body>") == (LONG * 2).strip()
    assert text(f"<body class='comments'><article><p>{LONG * 2}</p>{comments}</article></body>") == (LONG * 2).strip()


def test_borders_are_outermost():
    parts = "Short title", LONG.strip(), "The end."
    assert text("<main><h1>{}</h1><article><p>{}</p></article><p>{}</p></main>".format(*parts)).split("\n\n") == list(parts)
    assert text("<article><article><p>{1}</p></article><p>{2}</p></article>".format(*parts)).split("\n\n") == list(parts[1:])


def test_articles_side_by_side():
    some = ["One short one.", LONG.strip(), "Another.", (LONG * 2).strip(), "The last of all."]
    page = "<body><div>{}</div></body>".format("\n<hr>\n".join(f"<article class='post'><p>{t}</p></article>" for t in some))
    assert text(page).split("\n\n") == some
    apart = f"<article><p>{LONG}</p></article><p>Words between.</p><article><p>Few words.</p></article>"
    assert text(apart) == LONG.strip()


@pytest.mark.parametrize("mark", ["class='comment'", "class='comment-body' id='div-comment-3'", "class='post-reply depth-2'", "id='comment-17'"])
def test_comment_articles_are_no_text(mark):
    comment = f"<article {mark}><p>{LONG}</p></article>"
    own = f"<article class='post comments-open'><p>{LONG * 2}</p></article>"
    for page in (own + comment, f"<div>{own}{comment * 3}</div>", own.replace("</article>", f"{comment * 2}</article>"), f"<main>{own}{comment}</main>"):
        assert text(f"<body>{page}</body>") == (LONG * 2).strip()


def test_boxes_of_related_articles():
    box = "<article class='related'><p>Read this as well.</p></article>"
    assert text(f"<main><article><p>{LONG}</p></article>{box}</main>") == LONG.strip()


@pytest.mark.parametrize("name", ["has-sidebar", "page no-comments", "with-menu is-search"])
def test_wrappers_that_tell_what_a_page_has(name):
    side = "<div class='sidebar'>" + "<p>Side words of no use.</p>" * 3 + "</div>"
    assert text(f"<body><div class='{name}'><div><p>{LONG * 2}</p></div>{side}</div></body>") == (LONG * 2).strip()


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + LONG, "<article>" + "<b>" * 50_000 + LONG, "<div class='menu'>" * 50_000 + LONG, "<b>x" * 20_000 + "<li>y" * 20_000,
    "<article><p>" + "<i>a</b>" * 30_000, "</div>" * 50_000 + "<p>" * 50_000 + LONG,
])
def test_deep_pages_take_linear_time(page):
    import time

    start = time.process_time()
    text(page)
    assert time.process_time() - start < 4


def test_region_is_the_best_of_all():
    """Against all contiguous regions, on random pages without content elements."""
    import random

    rng = random.Random(4)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.choice(["p", "nav", "div", "ul"])
            parts.append((kind, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 30)))))
        page = "".join(f"<{k}>{t}</{k}>" for k, t in parts)
        scores, texts = [], []
        for kind, words in parts:
            bad = kind == "nav"
            n = len(words.split())
            scores += [ht.EDGE if bad else ht.TAG, n * (-ht.LIMIT if bad else ht.WORD), ht.TAG]
            texts += [None, None if bad or not n else words, None]
        best = max(((sum(scores[i:j]), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0))
        if best[0] <= 0:
            assert text(page) == ""
            continue
        options = {
            "\n\n".join(t for t in texts[i:j] if t)
            for i in range(len(scores)) for j in range(i + 1, len(scores) + 1) if abs(sum(scores[i:j]) - best[0]) < 1e-9
        }
        assert text(page) in options
