import html
import re
import time
from collections import Counter

import pytest

from palimpsest.llm import html_extraction as H
from palimpsest.llm import html_tree as T
from palimpsest.llm import wrappers as W

TAGS = {"<article>": "<div class=k3>", "</article>": "</div>", 'class="ad"': "class=q7", "<nav>": "<div class=z1>", "</nav>": "</div>", "<footer>": "<div class=z2>", "</footer>": "</div>"}


def as_it_is(page):
    return page


def without_telling_names(page):
    """No article, nav or footer, and classes that say nothing."""
    for old, new in TAGS.items():
        page = page.replace(old, new)
    return page


def without_names(page):
    return re.sub(r" class=\w+", "", without_telling_names(page))


@pytest.mark.parametrize("dress", [as_it_is, without_telling_names, without_names])
def test_all_pages_equal_a_plain_reading(spark, dress):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    dressed = spark.createDataFrame([(r["page_id"], r["url"], dress(r["html"])) for r in pages.collect()], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in H.extract(dressed).collect()}
    hosts = Counter(r["url"].split("/")[2] for r in pages.collect())
    for r in pages.collect():
        # What varies from page to page cannot be told from one or two.
        if dress is not as_it_is and hosts[r["url"].split("/")[2]] < 3:
            continue
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


PAGE = """<!doctype html><html><head><title>t</title><style>p{{x}}</style></head><body><header>Site</header><div id=sidebar>side</div><nav><ul><li>menu</ul></nav>
<div class="content"><h1>{0} &amp; more</h1><p>First<br>of {0} <b>bold</b>text<p>Second&nbsp;&lt;{0}&gt;<form>search <input></form><div class="ad-box">buy</div><script>var a="</p>";</script><ul><li>one {0}<li>two</ul></div>
<section class="comments"><p>reader of {0} says a long thing that nobody needs</p></section><div class="cookie-notice">cookies</div><footer>foot {0}</footer>"""
WANT = "{0} & more\n\nFirst of {0} boldtext\n\nSecond <{0}>\n\none {0}\n\ntwo"


def test_pages_without_article(spark):
    rows = [(i, f"https://Plain.example.org:80/{i}", PAGE.format(f"topic{i}")) for i in range(12)] + [(99, "https://single.example.org/x", PAGE.format("alone")), (100, None, None), (101, "x", ""), (102, "https://plain.example.org/odd", "<p>quite another page")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == WANT.format(f"topic{i}") for i in range(12)) and got[99] == WANT.format("alone")
    assert got[100] == got[101] == "" and got[102] == "quite another page"


def test_alignment_finds_options_repeats_and_slots():
    a, b = (W.generalise(T.parse(f"<body><div class=x>fixed</div>{o}<ul>{'<li>i' * n}</ul><p>{t}</p></body>")) for o, n, t in (("", 3, "one"), ("<table><tr><td>n</table>", 1, "two")))
    body = W.align(a, b).parts[0]
    by = {p.signature: p for p in body.parts}
    assert by["table"].optional and by["ul"].parts[0].repeated and by["p"].parts[0].slot and not by["div.x"].parts[0].slot and not by["ul"].optional


def test_no_rows(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string, host string")).count() == 0


def extracted(spark, pages):
    rows = [(i, f"https://one.example.org/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in sorted(H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


MENU = "<div class=top><ul><li>Home<li>About</ul></div>"
LONG = "a long story about {0} and what came of it " * 8


def test_main_outweighs_a_teaser(spark):
    page = f"<body>{MENU}<main><p>{LONG}</p><div class=more><article>teaser {{0}}</article></div></main><div>fixed line</div>"
    assert extracted(spark, [page.format(f"topic{i}") for i in range(4)]) == [f"{LONG.format(f'topic{i}').strip()}\n\nteaser topic{i}" for i in range(4)]


def test_headings_beside_the_body_are_kept(spark):
    page = f"<body>{MENU}<div class=page><h1>Title {{0}}</h1><p class=lead>Lead {{0}}</p><div class=body><h2>Details</h2><p>{LONG}</p><p>more {{0}}</p></div></div><div>fixed line</div>"
    assert extracted(spark, [page.format(f"t{i}") for i in range(4)]) == [f"Title t{i}\n\nLead t{i}\n\nDetails\n\n{LONG.format(f't{i}').strip()}\n\nmore t{i}" for i in range(4)]


def test_articles_under_different_paths_are_all_read(spark):
    page = f"<body>{MENU}<div class=a><article><p>{LONG}</p></article></div><div class=b><article><p>second {{0}}</p></article></div>"
    assert extracted(spark, [page.format(f"t{i}") for i in range(4)]) == [f"{LONG.format(f't{i}').strip()}\n\nsecond t{i}" for i in range(4)]


def test_deep_trees_long_names_and_equal_beginnings(spark):
    deep = "<div>" * 3000 + "deep text"
    assert W.main_text(deep, None) == "deep text"
    same = "the very same beginning of every text here " * 3
    page = f"<body><div class='{'utility ' * 400}'><div class=inner><p>{same}{{0}}</p></div></div><div>fixed line</div>"
    assert extracted(spark, [page.format(f"t{i}") for i in range(4)]) == [f"{same}t{i}" for i in range(4)]


def test_squares_are_found_on_either_side():
    once, thrice = (W.generalise(T.parse("<div>" + "".join(f"<h2>{i}</h2><p>one<p>two</p>" for i in range(n)) + "<hr></div>")) for n in (1, 3))
    for a, b in ((once, thrice), (thrice, once)):
        group, end = W.align(a, b).parts[0].parts
        assert group.group and group.repeated and [p.signature for p in group.parts] == ["h2", "p"] and group.parts[1].repeated and end.signature == "hr"


def test_wrappers_survive_writing():
    page = f"<body>{MENU}<div class=page><h1>Title</h1><div class=body><p>{LONG}</p></div></div>"
    top = W.choose(W.generalise(T.parse(page)))
    assert W.main_text(page, W.loaded(W.dumped(top))) == W.main_text(page, top) == f"Title\n\n{LONG.strip()}"


HOSTILE = {
    "tags that never end": "<a " * 350_000, "quotes that never end": '<a x="' + '<b " y="' * 120_000, "quotes of two kinds": "<a x='" + '<a x="' * 150_000, "ends without beginnings": "</x>" * 200_000,
    "deep blocks": "<div>" * 100_000 + "</span2>" * 100_000, "comments that never end": "<!--" * 200_000, "scripts that never end": "<script>" * 100_000, "less than": "a < b " * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    W.main_text(HOSTILE[name], None)
    assert time.process_time() - began < 20


def test_a_very_long_page_is_read_whole():
    page = "<body><nav><a href=x>menu</a></nav><article>" + "".join(f"<h2>part {i}</h2><p>some words of part {i} that are long enough</p>" for i in range(200_000)) + "</article>"
    began = time.process_time()
    assert len(page) > 12_000_000 and W.main_text(page, None).count("\n\n") == 399_999
    assert time.process_time() - began < 90


def test_quotes_hide_ends_of_tags():
    assert W.main_text("<article><p title=\"a > b\" x='<p>'>one <b>two</b> &lt;three&gt;</p><p a=\"unclosed>four</p></article>", None) == "one two <three>\n\nfour"
