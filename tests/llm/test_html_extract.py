import html
import random
import re
import time

import pytest

from tickloom.llm import html_extract as hx

SCHEMA = "page_id long, url string, html string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (page("<nav>menu</nav><article><h1>A &amp; B</h1><p>x  y\n z</p></article><footer>f</footer>"), "A & B\nx y z"),
        (page("<article><p><b>one<br><p>two</p><ul><li>three</li><li>four</ul></article>"), "one\ntwo\nthree\nfour"),
        (page('<article><p>keep</p><div class="comments"><p>no</p></div><aside>no</aside><form>no</form><script>var t="</p>";</script><p>too</p></article>'), "keep\ntoo"),
        (page('<div class="cookie-notice">no</div><div id="sidebar">no</div><main><p>yes</p></main><div role="contentinfo">no</div>'), "yes"),
        (page("<article><p>a < b &lt; c &#233; &eacute; &copy;</p><!-- no --><style>no</style></article>"), "a < b < c é é ©"),
        (page("<header>no</header><article><header><h1>Title</h1></header><p>t<em>e</em>xt</p><table><tr><td>1</td><td>2</td></tr></table></article>"), "Title\ntext\n1 2"),
        (page('<article><p data-x="a>b">kept</p><p hidden>no</p></article>'), "kept"),
        ("<article><p>cut <a href=", "cut"),
        ("<head><title>t</title><body><article>no head end</article>", "no head end"),
        ('<main class="col no-sidebar"><p>kept</p></main>', "kept"),
        ('<div class="has-banner"><article class="post has-related comment-open"><h2 id="related-work">Related work</h2><p>kept</p><h3 id="alert-systems">Alerts</h3></article></div>', "Related work\nkept\nAlerts"),
        (page('<article><p>a</p><svg width="1"/><p>b <svg><text>no</text></svg>c</p></article>'), "a\nb c"),
        (page('<article><p class="ad">buy<p>real<ul><li class="share">x<li>keep</ul></article>'), "real\nkeep"),
        (page("<article><p>the sum <math><mi>x</mi>+1</math> is<button>no</button> here</p></article>"), "the sum x+1 is here"),
        (page('<article><p>it <span class="ad">no</span>stays <a title="x>y" href=it\'s>one</a> block</p></article>'), "it stays one block"),
        (page('<article><div class="related"><article><p>teaser</p></article></div><p>text</p></article>'), "text"),
        (page("<article><select><option>a<option>b</select><dl><dt>t<dd>d</dl><table><tr><td>1<td>2<tr><td>3</table></article>"), "t\nd\n1 2\n3"),
        ("<p>a</div></p>b</b><!-- cut", "a\nb"),
        ("", ""),
        (None, ""),
        ("<nav>only</nav>", ""),
    ],
)
def test_markup(source, text):
    assert hx.chosen(hx.blocks(source), [], 0, 8)[0] == text


def slow(rows, depth=8):
    """Covered tokens of each page by comparing all suffixes of all streams of its host."""
    streams = {k: (re.match(hx.HOST, url)[1], hx.tokens(hx.blocks(source))) for k, url, source in rows}
    out = {}
    for k, (host, own) in streams.items():
        others = {tuple(s) for h, s in streams.values() if h == host and s}
        marked = set()
        for at in range(len(own) - depth + 1):
            n = sum(any(s[j : j + depth] == tuple(own[at : at + depth]) for j in range(len(s))) for s in others)
            if n >= hx.MIN_PAGES and hx.SHARE * n >= len(others):
                marked |= set(range(at, at + depth))
        out[k] = len(marked)
    return out


@pytest.mark.parametrize("depth", [3, 8])
def test_array_equals_brute_force(spark, depth):
    """Also: however the pages are dealt, and whatever their number a task."""
    rnd = random.Random(depth)
    rows, phrases = [], [" ".join(rnd.choices("abcd", k=11)) for _ in range(4)]
    for k in range(60):
        parts = [" ".join(rnd.choices("abc", k=rnd.randint(1, 12))) if rnd.random() < 0.5 else rnd.choice(phrases) for _ in range(rnd.randint(0, 4))]
        rows.append((k, f"http://h{rnd.randrange(3)}.example/{k}", "".join(f"<div>{p}</div>" for p in parts)))
    rows += [(100 + k, "http://h0.example/same", "<div>a b c a b c a b c a</div>") for k in range(5)]
    want = slow(rows, depth)
    docs = spark.createDataFrame(rows, SCHEMA)
    one = {r.page_id: (r.text, r.n_covered) for r in hx.extract(docs.repartition(1), depth=depth).collect()}
    assert {k: n for k, (_, n) in one.items()} == want and any(want.values())
    assert {r.page_id: (r.text, r.n_covered) for r in hx.extract(docs.repartition(7, "html"), depth=depth).collect()} == one


def test_boilerplate_without_markup_is_found_by_repetition(spark):
    """No article element: what pages of a host share goes, what is unique stays."""
    menu = "<div>home news sport weather travel money arts more sections here</div>"
    rows = [(k, f"http://a.example/{k}", f"<body>{menu}<div>{' '.join(f'w{k}x{j}' for j in range(30))}</div></body>") for k in range(20)]
    rows.append((99, "http://b.example/", f"<body>{menu}<div>alone</div></body>"))
    got = {r.page_id: r for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].text == " ".join(f"w{k}x{j}" for j in range(30)) and got[k].n_covered == 10 for k in range(20))
    assert got[99].text == "home news sport weather travel money arts more sections here\nalone"


def test_array_decides_what_the_markup_hints(spark):
    """Beside an article and in softly named elements: repeated text goes, long unique text stays."""
    again, own = "read more of our stories in the daily letter that we send", lambda k: " ".join(f"u{k}y{j}" for j in range(9))
    body = lambda k: f'<p>{again}</p><p>{own(k)}</p><article><p>text {k}</p><div class="widget"><p>{again}</p><p>{own(100 + k)}</p></div></article>'
    rows = [(k, f"http://a.example/{k}", page(body(k))) for k in range(8)]
    got = {r.page_id: r for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k].text == f"{own(k)}\ntext {k}\n{own(100 + k)}" and got[k].n_covered > 0 for k in range(8))


def test_repeated_article_passages_stay(spark):
    shared = "a passage that many pages of this host have word for word in their articles"
    rows = [(k, "http://a.example/", page(f"<article><p>{shared}</p><p>own {k}</p></article>")) for k in range(10)]
    got = hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.text for r in got) == sorted(f"{shared}\nown {k}" for k in range(10))


def article(source):
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("<br>", ""))
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_whole_test_table(spark):
    """The table's pages all have an article: what it says, decoded, is the text."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in hx.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_table_without_its_markup(spark):
    """The pages without article, nav and footer elements and class names, dealt to hosts of six pages that each have a menu and a footer of
    their own in plain elements: the array alone finds them, and the text is that of the full pages."""
    pages = [r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if len(article(r.html)) < 3000][:60]
    rows, want = [], {}
    for k, r in enumerate(pages):
        h = k // 6
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        menu = "".join(f"<div>section {h} {j} of site</div>" for j in range(5))
        rows.append((r.page_id, f"http://h{h}.example/{k}", page(f"{menu}<div>{inner}</div><div>all rights of host number {h} are kept by its owners</div>")))
        want[r.page_id] = article(r.html)
    got = {r.page_id: r for r in hx.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in want if got[k].text != want[k]] == []


@pytest.mark.parametrize("piece", ["<b ", "<b '>", '<b ">', '<b a="', "<div>", "</i>", "<p>", "<div></i>", "<!-- ", "<![CDATA[", "<a<", "&amp", "< ", "</ "])
def test_linear_time(piece):
    start = time.perf_counter()
    hx.blocks(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 20


def test_edges(spark):
    assert hx.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    long = page("<article>" + "<p>word</p>" * 20_000 + "</article>")
    rows = [(1, None, None), (1, None, None), (None, "not a url", "<p>x</p>"), (2, "http://h/", long)]
    docs = spark.createDataFrame([(*r, "t", 3) for r in rows], SCHEMA + ", text string, host int")
    got = sorted(((r.page_id or 0), r.n_chars) for r in hx.extract(docs).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 20_000 * 5 - 1)]
