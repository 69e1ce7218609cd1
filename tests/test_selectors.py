"""Selector grammar and tag-soup tree (plain Python, no Spark)."""

import pytest

from jobsmith.operators.html import PagePlan, SelectorIndex, _matches, _text_parts, _Walk, parse_html, parse_selector


def _elements(root):
    return iter(_Walk(root, SelectorIndex([])).elements)



def first(html, sel):
    s = parse_selector(sel)
    return next((e for e in _elements(parse_html(html)) if _matches(e, s)), None)


def test_grammar():
    assert parse_selector("div.job_seen_beacon") == ("div", ("job_seen_beacon",), None, ())
    assert parse_selector("div#jobDescriptionText") == ("div", (), "jobDescriptionText", ())
    assert parse_selector('span[data-testid="company-name"]') == ("span", (), None, (("data-testid", "=", "company-name"),))
    assert parse_selector('div[class*="date"]')[3] == (("class", "*=", "date"),)
    assert parse_selector(".x")[0] is None and parse_selector("a[href]")[3] == (("href", None, None),)
    with pytest.raises(ValueError):
        parse_selector("div > p")


def test_matching_rules():
    html = ('<div class="a jobsearch-JobComponent-description b" id="jobDescX">t</div>'
            '<span class="my-date">d</span><a>no href</a><a href="">empty</a>')
    assert first(html, 'div[class*="jobsearch-JobComponent-description"]') is not None
    assert first(html, 'div[id*="jobDesc"]') is not None and first(html, "div#jobDesc") is None
    assert first(html, "div.jobsearch-JobComponent-description") is not None
    assert first(html, "div.jobsearch") is None  # class token, not substring
    assert first(html, 'span[class*="date"]').tag == "span"
    assert _text_parts(first(html, "a[href]")) == ["empty"]


def test_tag_soup():
    root = parse_html('<p>a<b>b<p>c</p>d</b>e</p><script>var x="</p>";</script><!-- c --><br>f&amp;g')
    p1 = next(e for e in _elements(root) if e.tag == "p")
    assert "".join(_text_parts(p1)) == "abcde"  # </p> closes the innermost open p only
    assert "".join(_text_parts(root)) == "abcdef&g"  # script body and comment are not text
    # an end tag with no open element of that name is ignored
    root2 = parse_html("<div>x</span>y</div>z")
    assert "".join(_text_parts(next(_elements(root2)))) == "xy"


def test_walk_equals_testing_every_selector():
    import random

    rng = random.Random(1)
    names, classes = ["div", "p", "a", "li", "span"], ["c1", "c2", "c3"]
    selectors = ["div", ".c1", "div.c2", "#i1", "p#i2.c1", "[href]", 'a[href*="x"]', "*", ".c1.c3", "li[data-k]", 'span[data-k="v"]', "[class]", '[class*="c2"]']

    def soup(depth):
        out = ""
        for _ in range(rng.randint(0, 4)):
            tag = rng.choice(names)
            attrs = "".join(rng.sample([f' class="{" ".join(rng.sample(classes, rng.randint(1, 3)))}"', ' id="i1"', ' id="i2"', ' href="/x"', ' href="y"', ' data-k="v"', ' data-k=""'], rng.randint(0, 2)))
            out += f"<{tag}{attrs}>{rng.choice(['', 't', '<br>'])}{soup(depth - 1) if depth else ''}" + (f"</{tag}>" if rng.random() < 0.9 else "")
        return out

    parsed = [parse_selector(x) for x in selectors]
    for _ in range(60):
        root = parse_html(soup(4))
        walk = _Walk(root, SelectorIndex(parsed))

        def below(node):
            return [x for c in node.children if hasattr(c, "tag") for x in [c, *below(c)]]

        assert walk.elements == below(root)
        assert walk.hits == [[i for i, e in enumerate(walk.elements) if _matches(e, p)] for p in parsed]
        assert [walk.ends[i] - i - 1 for i in range(len(walk.elements))] == [len(below(e)) for e in walk.elements]


def test_cost_does_not_grow_with_the_number_of_selectors():
    page = "".join(f'<div class="card"><h2 class="t"><a href="/{i}">x</a></h2><span id="s{i}">y</span></div>' for i in range(50))
    few = PagePlan(cards=["div.card"], card_fields={"title": ["h2.t"]})
    many = PagePlan(cards=["div.card"], card_fields={"title": ["h2.t"], "other": [f"div.none{i}" for i in range(3000)] + [f"#no{i}" for i in range(3000)] + [f"[data-{i}]" for i in range(3000)]})
    assert few.page(page)[:4] == many.page(page)[:4]
    assert many.index.tested == few.index.tested == 100
