"""Listings by selectors: nested, unclosed and stray tags, and the mark-up of some sites."""

import pytest

from attestry.sources import listings

PAGES = "page_id long, url string, html string"


def found(spark, html, specs=listings.SITE_SPECS, url="https://site.vn/news/index.html?x=1"):
    rows = listings.items(spark.createDataFrame([(1, url, html), (2, url, None), (3, url, "")], PAGES), specs).collect()
    return [(r["spec"], r["title"], r["link"], r["day"]) for r in sorted(rows, key=lambda r: (r["spec"], r["pos"]))]


SITES = [
    (
        "AIA_NOTICES",
        '<div class="cmp-accordion__item open"><h3 class="cmp-accordion__header"><button><span>Notice&nbsp;one <b>now</b></span></button></h3><div class="cmp-accordion__body"><p>see <a href="/a.pdf">file</a><p><a href="/b.pdf">b</a></div></div>'
        '<div class="cmp-accordion__item"><h3 class="cmp-accordion__header"><span>No link</span></h3></div>',
        [("Notice one now", "https://site.vn/a.pdf", None)],
    ),
    (
        "VIR_INSURANCE",
        '<div class="article big"><h2 class="article-title"><a class="article-link" title="Full title" href="//cdn.vn/1">Short…</a></h2><span class=\'article-date\'> May 4, 2026 | 10:30 </span></div>'
        '<div class="article"><h3 class="article-title"><a class="other" href="/no">x</a></h3></div>',
        [("Full title", "https://cdn.vn/1", "May 4, 2026 | 10:30")],
    ),
    (
        "TNCK_VN",
        '<article class="story"><h2 class="story__heading"><a href="t1.html">Một</a></h2><time datetime="2026-07-01T08:00:00+0700">hôm nay</time></article>'
        '<article class="story"><h2 class="story__heading"><a href="t1.html">Again</a></h2></article>',
        [("Một", "https://site.vn/news/t1.html", "2026-07-01T08:00:00+0700")],
    ),
    ("BIZHUB_INSURANCE", '<ul><li class="vnn-small-news"><h3 class="meta-data-tit"><a href="https://o.vn/b">B</a></h3><time class="meta-data-source">Friday, Jul 3, 2026</time></ul>', [("B", "https://o.vn/b", "Friday, Jul 3, 2026")]),
    ("VIETNAMNET_LIFE", '<h3 class="horizontalPost__main-title"><a href="/v"> V <i>n</i></a></h3>', [("V n", "https://site.vn/v", None)]),
    ("MVI_LIFE", '<a class="cmp-content-teaser__link x" href="/m"><img src="i.png"/>M</a><a class="y" href="/z">Z</a>', [("M", "https://site.vn/m", None)]),
]


@pytest.mark.parametrize(("spec", "html", "expected"), SITES, ids=[s[0] for s in SITES])
def test_the_markup_of_a_site(spark, spec, html, expected):
    assert found(spark, f"<html><body><script>var x = '<article class=\"story\">';</script>{html}</body></html>") == [(spec, *e) for e in expected]


def test_all_sites_on_one_page_in_one_plan(spark):
    html = "<html>" + "".join(s[1] for s in SITES) + "</html>"
    assert found(spark, html) == sorted((s[0], *e) for s in SITES for e in s[2])


SPEC = (("L", "div.i", "b", "a", None, None),)


@pytest.mark.parametrize(
    ("html", "titles"),
    [
        ('<div class="i"><b>1</b><a href="/1">x</a></div><div class="i"><b>2</b><a href="/2">x</a></div>', ["1", "2"]),
        ('<div class="i"><b>1</b><a href="/1">x</a><div class="i"><b>2</b><a href="/2">x</a></div></div>', ["1", "2"]),
        ('<div class="i"><a href="/1">x</a><div><div></div></div><b>in</b></div><b>out</b>', ["in"]),
        ('<div class="i"><a href="/1">x</a></div><b>out</b>', []),
        ('</div></div></b><div class="i"><b>1</b><a href="/1">x</a></div>', ["1"]),
        ('<div class="i"><b>never closed <a href="/1">x</a>', ["never closed x"]),
        ('<div class="i"><!-- <b>no</b> --><b>yes</b><a href="/1">x</a></div><!-- open <div class="i"><b>2</b>', ["yes"]),
        ('<DIV CLASS="j i"><B>1 &lt; 2</B><A HREF="/1">x</A></DIV>', ["1 < 2"]),
        ('<div class="item"><b>1</b><a href="/1">x</a></div>', []),
        ('<div class="i"><b> </b><a href="/1">x</a></div><div class="i"><b>2</b><a>x</a></div>', []),
    ],
)
def test_nested_unclosed_and_stray_tags(spark, html, titles):
    assert [f[1] for f in found(spark, html, SPEC)] == titles


def test_elements_and_their_ends(spark):
    events = listings.tags(spark.createDataFrame([(1, "u", "<a><b>t</a></b></c><br><a x='>'/><d><a></a>")], PAGES), "page_id", "html")
    ends = {(r["name"], r["pos"]): r["last"] for r in listings.elements(events, "page_id").collect()}
    kinds = [(r["pos"], r["kind"], r["name"]) for r in events.orderBy("pos").collect()]
    assert [k[1:] for k in kinds[:7]] == [("open", "a"), ("open", "b"), ("text", ""), ("close", "a"), ("close", "b"), ("close", "c"), ("void", "br")]
    last = kinds[-1][0]
    assert ends["a", 0] == 3 and ends["b", 1] == 4 and ends["br", 6] == 6 and ends["d", last - 2] == last and ends["a", last - 1] == last
