import itertools
import random
import re
from html import unescape

from palisade.llm import main_text as mt
from palisade.llm.common import table

LONG = "This is the body of the article, and it goes on for a while, with commas and words enough to be one."


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 8)
        good, bad = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda keep: sum(b if k else g for g, b, k in zip(good, bad, keep)) + sum(w for i, j, w in edges if keep[i] != keep[j])  # noqa: B023, E731
        assert cost(mt.cut(good, bad, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_page_parts():
    page = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
      <header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
      <div class="cookie-notice">We use cookies, please accept all of them for a better life.</div>
      <main><article><h1>Head&nbsp;line</h1><p>{LONG}<p>One <b>bo</b>ld &lt;word&gt; a < b &amp; c.
        <div class="ad-box">Buy now, buy this thing.</div><form><input><label>Your mail</label></form><script>if (a<b) x("</p>")</script>
        <blockquote>{LONG}</blockquote><table><tr><td>Cell one<td>Cell two</table></article>
        <section id="comments"><p>{LONG}</p></section></main><aside><p>{LONG}</p></aside><footer>&copy; me</footer></body></html>"""
    assert mt.main_text(page).split("\n") == ["Head line", LONG, "One bold <word> a < b & c.", LONG, "Cell one", "Cell two"]


def test_odd_pages(spark):
    pages = [None, "", "   ", "<p", "plain", "<article><p>" + LONG, f"<article><p>{LONG}</p><p>Torn &am", f"<article><p>{LONG}</p></artic", "</div></p>",
             f"<article><p>{LONG}<!-- never closed", "<script>only", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"]
    rows = [(i, None if i == 3 else "u", h, "x", 1) for i, h in enumerate(pages)] + [(None, "u", pages[5], "x", 1), (5, "u", pages[5], "x", 1)]
    got = mt.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [text[i] for i in (0, 1, 2, 3, 8, 10)] == [""] * 6
    assert text[5] == text[None] == text[7] == text[9] == LONG and text[6] == LONG + "\nTorn &am" and text[11].count("\n") == 2999
    assert mt.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_equal_their_article(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in mt.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        cut = re.sub(r"<[a-z/!][^>]*(>|\Z)", "", re.sub(r"</?(p|h1)(?=[\s>])[^>]*>", "\x00", inner[1].replace("<br>", " ")))
        assert got[r.page_id].split("\n") == [x for x in (" ".join(unescape(y).split()) for y in cut.split("\x00")) if x]


def test_elements_without_text_end_where_they_end():
    for odd in ("<svg class=i viewBox='0 0 1 1' />", "<svg/>", "<math/>", "<button>Share", "<button>Share<svg><path d=x>", "<select><option>A<option>B", "<iframe src=x>", "<object data=x>",
                "<svg><svg><text>t</text></svg><text>t</text></svg>", "<button><div>Share</div></button>"):
        for rest in (f"<p>{LONG}</p>", f"<p>{LONG}</p><div><svg><text>t</text></svg><button>b</button></div>"):
            assert mt.main_text(f"<article><p>{LONG}</p>{odd}{rest}<p>{LONG}</p></article>") == "\n".join([LONG] * 3), (odd, rest)
    assert mt.main_text(f"<article><p>{LONG} <button>Share<p>{LONG}</article><script>only") == LONG + "\n" + LONG
    formula = "<math display=block><semantics><mi>x</mi><mspace width=1 /><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x \\eq 2</annotation></semantics></math>"
    assert mt.main_text(f"<article><p>{LONG} So {formula} holds.</p></article>") == f"{LONG} So x=2 holds."


def test_names_of_wrappers_do_not_lose_the_article():
    body = f"<h1>Headline</h1><p>{LONG}</p><p>Short one.</p><p>{LONG}</p>"
    text = ["Headline", LONG, "Short one.", LONG]
    comments = f"<div id=comments class='comments-area'><h2>Two replies</h2><article class=comment><p>{LONG}</p></article></div>"
    side = f"<div class=sidebar><p>{LONG}</p></div><div class='cookie-notice'>We use cookies, please accept them all.</div>"
    for page in (f"<div class='site has-sidebar'><article>{body}</article>{comments}{side}</div>",
                 f"<div class='content-sidebar-wrap'><main><div class=widget><article>{body}</article></div>{comments}</main>{side}</div>",
                 f"<article class='post comments-open'>{body}</article>{comments}{side}",
                 f"<article class='post social-post'>{body}</article>{comments}{side}",
                 f"<form id=form1><div id=menuPage role=form><div>{body}</div></div>{side}</form>",
                 f"<div class='widget Blog'><div class=post>{body * 2}</div></div>{side}"):
        assert mt.main_text(page).split("\n") == text * page.count("Headline"), page
    long = f"<div id=comments>{f'<p>{LONG}</p>' * 9}</div>"
    assert mt.main_text(f"<div class=post>{body}</div>{long}").split("\n") == text
    assert mt.main_text("<div class=ad>" * 3000 + "x" + "</div>" * 3000 + f"<article>{body}</article>").split("\n") == text
