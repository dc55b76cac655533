import html as entities
import random
import re

from pyspark.sql import functions as F

from tessera.llm import htmldiff
from tessera.llm.queries import op4_html_text

from .conftest import SF01


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def subsequence(x, y):
    it = iter(y)
    return all(c in it for c in x)


def test_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randint(-2, 3) for _ in range(rng.randint(0, 14))] for _ in "ab")
        at = htmldiff.shared_lines(a, b)
        assert at == sorted(set(at)) and len(at) == lcs(a, b) and subsequence([a[i] for i in at], b)


def test_query_gives_the_articles(spark):
    """The given pages hold one article each; its blocks are the truth."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    got = op4_html_text(spark, SF01).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGES = [
    ("http://h/a/1", "<html><body><p>Site name<p>First &amp; own</p><div>All rights</div>"),
    ("http://h/a/2", "<body><p>Site  name<p>Second<br>own &lt;p&gt;</p><p>more</p><div>All rights</div>"),
    ("http://h/b/1", "<body><p>Site name</p><p>Third</p><div>All rights</div>"),
    ("http://i/x", "<p>lonely</p><p>page"),
    ("http://j/c", "<p>copy</p>"), ("http://j/d", "<p>copy</p>"),
    ("http://k/1", "<nav><a>Menu</a></nav><header>Top</header><article><header><h1>Title</h1></header><p>Body</p><div class='share-buttons'>Share</div><aside>Side</aside>"
                   "<section id=comments><p>Reader says</p></section><p>End&nbsp; now</p></article><footer>Foot</footer>"),
    ("http://k/2", "<div class=cookie-notice>Cookies<div>inner</div></div><div>Text <script>x('<p>no</p>')</script>here</div><form><p>name</p></form><p hidden>gone</p><p class=ad>Buy<p>Stay</p>"),
    ("http://k/3", "<style>p{}</style><!-- <p>no</p> --><p>cut <b>off &am"),
    ("http://k/4", "text <a href='x>y'>link</a> end <"), (None, None), (None, ""), ("no url", "<p>plain"), ("http://h/a/1", "<html><body><p>Site name<p>First &amp; own</p><div>All rights</div>"),
]
WANT = ["First & own", "Second own <p>\nmore", "Third", "lonely\npage", "copy", "copy", "Title\nBody\nEnd now", "Text here\nStay", "cut off &am", "text link end <", "", "", "plain", "First & own"]


def test_differencing_and_odd_pages(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string")
    df = df.withColumn("lines", F.lit("clash")).withColumn("p", F.lit("clash")).withColumn("host", F.lit("clash"))
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in htmldiff.main_text(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert [got[i] for i in range(len(WANT))] == WANT
    assert htmldiff.main_text(df.limit(0)).collect() == []


def test_whole_texts_stay():
    def text(html):
        lines = htmldiff.page_lines(html)
        return htmldiff.kept_text([x for x, _ in lines], [k for _, k in lines], [])

    assert text("<p>one</p><svg-icon></svg-icon><p>two</p><video-js><p>three</p></video-js><p>four</p>") == "one\ntwo\nthree\nfour"
    assert text("<p>one</p><svg><text>x</text></svg><video src=a>no</video><p>two</p>") == "one\ntwo"
    for frame in ("<body class='right-sidebar'>", "<body class='menu-open'>", "<body class='sidebar'>", "<html class=nav><body id=form>", "<article class='post has-comments'>", "<main class='widget'>", "<div class='has-comments'>"):
        assert text(frame + "<p>one</p><div class='box ad'>no</div><p>two</p>") == "one\ntwo", frame
    assert text("<article><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><noscript><p>a picture</p></noscript><p>end</p></article>") == "where x=2 holds\na picture\nend"
    assert text("<p>one</p><noscript>no</noscript><p>two</p>") == "one\ntwo"


def test_compound_names():
    gone = ["share-buttons", "cookie-notice", "ad-slot", "comments-list", "site-footer", "main-nav", "comment-form", "left_sidebar", "newsletter-box", "ad", "social_share", "page-header"]
    stay = ["has-comments", "no-sidebar", "with-ads", "post-has-comments", "long-form", "notice-of-sale", "related-work", "article-body", "share-price-text", "header-1", "-", "_", "share"[:-1]]
    for name in gone:
        assert htmldiff.page_lines(f"<body><div class='x {name}'>a</div><p id={name}>b</p><p>c")[-1] == ("c", htmldiff.OPEN), name
        assert [k for _, k in htmldiff.page_lines(f"<div class='x {name}'>a</div><p id={name}>b</p>")] == [htmldiff.UNWANTED] * 2, name
    for name in stay:
        assert [k for _, k in htmldiff.page_lines(f"<div class='x {name}'>a</div><p id={name}>b</p>")] == [htmldiff.OPEN] * 2, name
    assert htmldiff.page_lines("<article><div class=page-header>a</div></article>") == [("a", htmldiff.ARTICLE)]
    assert htmldiff.page_lines("<body class='right-sidebar'><article class='post site-footer'>a")[0] == ("a", htmldiff.ARTICLE)
