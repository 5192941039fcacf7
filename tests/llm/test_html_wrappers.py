"""A host's wrapper comes of all its pages."""

from functools import reduce

from palimpsest.llm import html_extraction as H
from palimpsest.llm import html_tree as T
from palimpsest.llm import wrappers as W


def test_a_part_that_few_pages_have_is_in_the_wrapper(spark):
    story = "a story about {0} and what came of it " * 8
    page = "<body><div class=x1><ul><li>Home<li>About</ul></div>{1}<div class=x2><p>" + story + "</p><p>more {0}</p></div><div class=x4>fixed line</div>"
    rare = "<div class=x3><p>" + story + "</p><p>rare {0}</p></div>"
    for n in (20, 150):
        rows = [(i, f"https://one.example.org/{i}", page.format(f"t{i}", rare.format(f"r{i}") if i in (3, 7) else "")) for i in range(n)]
        docs = spark.createDataFrame(rows, "page_id long, url string, html string")
        ((host, wrapper),) = map(tuple, H.host_wrappers(docs).collect())
        assert host == "one.example.org"
        top = W.choose(reduce(W.align, (W.generalise(T.parse(r[2])) for r in rows)))
        assert "div.x3" in wrapper and "div.x3" in W.dumped(top)
        assert H.host_wrappers(docs.repartition(7)).first()["wrapper"] == wrapper
        assert W.unpacked(W.packed(top)).pages == n


def test_tags_that_come_again_are_described_once(monkeypatch):
    from palimpsest.llm import html_tree as H

    H._known_description.cache_clear()
    H.parse('<div class="a b"><p class="c">x</p><p class="c">y</p></div>' * 50 + "<p class='" + "z" * 1000 + "'>w</p>")
    known = H._known_description.cache_info()
    assert known.misses == 2 and known.hits == 148


def test_texts_are_not_aligned_level_by_level(monkeypatch):
    from palimpsest.llm import wrappers as W
    from palimpsest.llm.html_tree import parse

    seen, matched = [], W.matched
    monkeypatch.setattr(W, "matched", lambda a, b: seen.append((len(a), len(b))) or matched(a, b))
    W.align(*(W.generalise(parse(f"<h1>{k}</h1><p>a {k}</p><ul><li>{k}</li></ul>")) for k in "xy"))
    assert seen and (0, 0) not in seen
