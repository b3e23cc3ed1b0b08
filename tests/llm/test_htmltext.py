"""Main text of planted pages, the linear scan against all ranges, and odd markup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import htmltext

WORDS = "river old bridge town market winter stone garden letter music harbour field window paper evening summer".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


NAV = '<nav><ul><li><a href="/a">home page</a></li><li><a href="/b">other news</a><li><a href=/c>last <b>things</b></a></ul></nav>'
FOOT = "<footer>&copy; 2024 all rights &middot; some firm and its words</footer>"
SIDE = '<aside><h3>Read more</h3><p>A long teaser of another story that is not this one at all.</p></aside>'
FORM = "<form><label>Your mail address please</label><input name=x><button>Send it now</button></form>"
COOKIE = '<div id="cookie-notice"><p>We use cookies to make this page better for all of you, do you agree?</p></div>'
COMMENTS = '<section class="comments"><h2>Comments</h2><div class="comment"><p>First! What a fine text this is, thank you so much for it.</p></div></section>'
AD = '<div class="ad">Buy the best stone garden in town today.</div>'
HEAD = '<!DOCTYPE html><html><head><title>A title</title><style>p{margin:0}</style><script>var t="</p><p>not a text";if(a<b){}</script></head><body>'


def page(kind, title, paragraphs):
    each = [f"<p>{p}</p>" for p in paragraphs]
    body, half = "".join(each), len(each) // 2
    shapes = {
        "article": f"{HEAD}<header><p>The daily paper of this town</p></header>{NAV}{AD}<article><h1>{title}</h1>{body}</article>{SIDE}{COMMENTS}{FOOT}</body></html>",
        "main": f"{HEAD}{NAV}<main><h1>{title}</h1>{body}</main>{FORM}{FOOT}",
        "inside": f"{HEAD}{COOKIE}{NAV}<article><h1>{title}</h1>{"".join(each[:half])}{AD}{FORM}{SIDE}{"".join(each[half:])}{COMMENTS}</article>{FOOT}</body></html>",
        "open": f"{HEAD}{NAV}<div class=ad>{sentence(np.random.default_rng(1), 30)}</div><article><h1>{title}</h1><p><b>" + "<br><p>".join(paragraphs) + f"</article>{FOOT}",
        "plain": f"{HEAD}<div class='site-header'>The daily paper of this town</div>{NAV}<div class=content><h1>{title}</h1>{body}</div>{COMMENTS}{FOOT}</body></html>",
    }
    return shapes[kind]


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(250):
        title, parts = sentence(rng, 5), [sentence(rng, int(rng.integers(6, 60))) for _ in range(int(rng.integers(2, 9)))]
        rows.append((i, f"http://x/{i}", page(["article", "main", "inside", "open", "plain"][i % 5], title, parts)))
        want[i] = "\n".join([title, *parts])
    return rows, want


def test_planted_pages(spark, planted):
    rows, want = planted
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    weights = htmltext.learn_weights(pages)
    assert weights.words and weights.tags and max(weights.tags.values()) < 0
    got = htmltext.extract_text(pages, weights)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    wrong = [i for i in want if found[i] != (want[i], len(want[i]))]
    assert not wrong, (found[wrong[0]], want[wrong[0]])
    fixed = {i: htmltext.main_text(h, htmltext.Weights()) for i, _, h in rows}
    assert fixed == want


def test_scan_against_all_ranges():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = rng.integers(-4, 4, int(rng.integers(0, 12))).astype(float)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        low, high = htmltext.best_region(s)
        assert (low, high) == (0, 0) if best <= 0 else sum(s[low:high]) == best


CASES = [
    (None, ""),
    ("", ""),
    ("<p></p>", ""),
    ("just text", "just text"),
    ("a < b and c > d &lt;p&gt;", "a < b and c > d <p>"),
    ("<p>one&nbsp;two\n\t three</p><p>fo<b>ur</b><!-- no --> five</p>", "one two three\nfour five"),
    ("<p>&#x41;&#66;&eacute;&amp;amp; &copy &unknown; &#0;</p>", "ABé&amp; © &unknown; �"),
    ("<p>one<br>two<br/>three</p>", "one two three"),
    ("<article><p>one two</p><script>if (a < b) document.write('<p>x</p>')</script><style>p{}</style><p>three</p></article>", "one two\nthree"),
    ("<article><p>one two three", "one two three"),
    ("<p>never closed <!-- comment <p>gone</p>", "never closed"),
    ("<article><p title='a > b' class=\"x>y\">one two</p></article>", "one two"),
    ("<article><ul><li>one<li>two three</ul><table><tr><td>four</td><td>five</td></tr><tr><td>six</table></article>", "one\ntwo three\nfour five\nsix"),
    ("<nav>menu one two</nav><header>top of it</header><footer>end of it</footer>", ""),
    ("<article><header><h1>Head line</h1></header><p>and text</p></article>", "Head line\nand text"),
    ("<article><p><a href=x>all of this is a link</a></p><p>and this is not</p></article>", "all of this is a link\nand this is not"),
    ("<NAV>menu</NAV><ARTICLE><P>upper case tags</P></ARTICLE>", "upper case tags"),
    ("<p>日本語 テキスト</p>", "日本語 テキスト"),
    ("<div hidden=\"<p>\">some text here</div", "some text here"),
]


@pytest.mark.parametrize("html, text", CASES)
def test_odd_markup(html, text):
    assert htmltext.main_text(html or "", htmltext.Weights()) == text


def test_rows_stay_and_clashes_are_refused(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one two</p>", "kept"), (1, "u", "<p>one two</p>", "kept"), (None, None, None, None)], "page_id long, url string, html string, text string")
    weights = htmltext.learn_weights(pages)
    assert weights == htmltext.Weights()
    with pytest.raises(ValueError):
        htmltext.extract_text(pages, weights)
    got = sorted(map(str, htmltext.extract_text(pages, weights, prefix="main_").select("page_id", "text", "main_text", "main_n_chars").collect()))
    assert got == ["Row(page_id=1, text='kept', main_text='one two', main_n_chars=7)"] * 2 + ["Row(page_id=None, text=None, main_text='', main_n_chars=0)"]
    assert htmltext.extract_text(pages.limit(0), weights, prefix="m_").count() == 0


def test_long_pages_are_read_whole():
    body = "".join(f"<p>paragraph number {i} of this page</p>" for i in range(30_000))
    text = htmltext.main_text(f"<nav>menu</nav><article>{body}</article><footer>end</footer>", htmltext.Weights())
    assert text.count("\n") == 29_999 and text.endswith("number 29999 of this page")
    assert htmltext.main_text("<a x='" * 20_000 + "text", htmltext.Weights()) is not None


def test_given_pages(spark, folder):
    """The article of the given pages, which have one each."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = htmltext.extract_text(pages, htmltext.learn_weights(pages)).join(pages.select("page_id", F.regexp_extract("html", r"(?s)<article>(.*?)(</article>|$)", 1).alias("inner")), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        squeezed = htmltext.html.unescape(htmltext.re.sub(r"<[^>]*>", " ", r.inner)).split()
        assert r.text.split() == squeezed
