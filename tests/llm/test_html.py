"""HTML extraction on literal pages and on the whole table of pages."""
import html as std
import re

from pyspark.sql import functions as F

from basketry.llm import html, queries
from helpers import SF


def test_furniture_goes_and_order_stays():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <div id="sidebar"><p>Side text that is fairly long, longer than some of the article itself.</p></div>
    <article><h1>Head &amp; line</h1><p>First   para<b>graph</b><br>goes on.<p>Second &lt;one&gt; &#233;
    <script>var a = "<p>no</p>";</script><form><input><button>Send</button></form>
    <p>.</p><aside>Aside</aside><ul><li>Item one</li><li>Item two</li></ul></article>
    <section class="comments"><p>Reader comment</p></section><footer>Foot</footer></body></html>"""
    assert html.main_text(page) == ("Head & line\nFirst paragraph goes on.\nSecond <one> é\n.\n"
                                    "Item one\nItem two")


def test_pages_without_an_article():
    body = "".join(f"<p>{'A sentence of the main text that is long enough. ' * 4}{i}</p><p>Hm.</p>" for i in range(5))
    links = "".join(f"<a href='/{i}'>l{i}</a> <i>x</i>" for i in range(40))
    got = html.main_text(f"<div>{links}</div><div>{body}</div>")
    assert "l3" not in got and got.count("Hm.") == 5 and got.startswith("A sentence")


def test_odd_pages():
    for page in ("", "   ", "<nav>x</nav>", "<!-- a", "<script>x", "<p", "</p></div>", "<p><p><p>"):
        assert html.main_text(page) == ""
    assert html.main_text("plain text") == "plain text" and html.main_text("a < b") == "a < b"
    assert html.main_text("<p>a<nav>b</nav>c</p>") == "a\nc"
    assert html.main_text("<p>x" * 5000).count("x") == 5000
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


def test_table_rows(spark):
    rows = [(1, "u", None), (1, "u", "<p>a &amp; b"), (None, None, "<p>ü"), (2, "v", "<p>" + "word " * 50_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("TEXT", F.lit("mine"))
    got = {(r["page_id"], r["url"], r["n_chars"]): r["text"] for r in html.extract(d).collect()}
    assert got[1, "u", 0] == "" and got[1, "u", 5] == "a & b" and got[None, None, 1] == "ü"
    assert (2, "v", 249_999) in got and html.extract(d.limit(0)).count() == 0


def test_articles_of_the_pages(spark):
    """The generated pages: the blocks of the article element, found by a regex."""
    def truth(page):
        body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
        blocks = [std.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))
                  for b in re.split(r"</?(?:h1|p)[^>]*>", body)]
        return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)

    pages = {r["page_id"]: r["html"] for r in queries.table(spark, SF, "pages").collect()}
    got = queries.QUERIES["op7_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages) and all(r["text"] == truth(pages[r["page_id"]]) for r in got)


LONG = "A sentence of the main text that is long enough to be one. " * 5
MENU = "".join(f"<li><a href='/{i}'>Menu {i}</a></li>" for i in range(8))


def test_furniture_without_names_goes():
    text = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
    for page in (f"<body><ul>{MENU}</ul>{text}</body>", f"<div><ul>{MENU}</ul>{text}<p>End.</p></div>",
                 f"<body>{text}<ul>{MENU}</ul></body>", f"<div>{text[:400]}<ul>{MENU}</ul>{text}</div>",
                 f"<body><p><a>Menu 1</a> | <a>Menu 2</a></p>{text}</body>",
                 f"<body><div>Menu closes at ten.</div><ul>{MENU}</ul>{text}</body>"):
        got = html.main_text(page)
        assert "Menu" not in got and got.count("long enough") >= 20, page[:80]
    assert html.main_text(f"<div><ul>{MENU}</ul>{text}<p>End.</p></div>").endswith("End.")


def test_regions_are_kept_whole():
    text = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
    short = ("<h2 id='related-work'>Work</h2><section id='side-effects'><p>Nausea.</p></section>"
             "<div class='share-price'>12 EUR</div><table><tr><td>Cell 1</td><td>Cell 2</td></tr></table>"
             "<div>Caption</div><div><div>Far</div><div>away</div><div>from</div><div>text</div></div>")
    kept = "Work Nausea. 12 EUR Cell 1 Cell 2 Caption Far away from text".split()
    for page in (f"<nav>Menu</nav><article>{text}{short}</article>", f"<main>{short}{text}{text}</main><div>Menu</div>",
                 f"<body><ul>{MENU}</ul><div>{text}{short}</div></body>",
                 f"<body><ul>{MENU}</ul><div><div>{text}</div>{short}</div></body>"):
        got = html.main_text(page)
        assert [w for line in got.split("\n") if "long" not in line for w in line.split()] == kept, page[:40]
        assert "Menu" not in got
    page = f"<body><div class='cookie-notice'>{LONG}</div><div id='sidebar'>{LONG}</div><div>{text}</div></body>"
    assert html.main_text(page).count("\n") == 3
    assert "Ad" in html.main_text(f"<article>{text}<div class='ad hoc'>Ad hoc</div></article>")
    assert html.main_text(f"<div class='widget'>{text}<ul>{MENU}</ul></div>").count("\n") == 3


def test_furniture_inside_articles_and_mains_goes():
    text = f"<p>{LONG}</p>"
    kept = " ".join(LONG.split())
    for page in (f"<article>{text}<div class='comments'><p>Nice!</p></div><div class='ad'>Buy</div></article>",
                 f"<main>{text}<div class='notice'>Maintenance at ten.</div></main>",
                 f"<main>{text}<div id='cookie-notice'>We use cookies.</div></main>",
                 f"<article>{text}<article class='comment'><p>I disagree. {LONG}</p></article></article>",
                 f"<article>{text}</article><article class='comment'><p>I disagree. {LONG}{LONG}</p></article>",
                 f"<article>{text}<section class='related-articles'><ul><li>More</ul></section>"
                 "<section class='share social'>Share</section></article>"
                 .replace("related-articles", "related")):
        assert html.main_text(page) == kept, page[-90:]


def test_the_heading_of_an_articles_header_stays():
    page = (f"<header><h1>Site</h1></header><article><header><h1>The <i>title</i></h1><p>By A. Writer</p>"
            f"<nav><h2>Jump</h2></nav></header><p>{LONG}</p><footer><h2>Foot</h2></footer></article>")
    assert html.main_text(page) == "The title\n" + LONG.strip()


def test_one_short_article_beside_long_unnamed_text():
    talk = "".join(f"<div><b>Reader {i}</b><p>{LONG}</p></div>" for i in range(9))
    page = f"<body><article><h1>Title</h1><p>{LONG}</p><p>Short end.</p></article><div>{talk}</div></body>"
    assert html.main_text(page) == f"Title\n{LONG.strip()}\nShort end."
    # an article without a line of the cluster does not decide
    teaser = f"<body><article><p><a href='/x'>Teaser</a></p></article><div>{talk}</div></body>"
    assert html.main_text(teaser).count("long enough") == 45
