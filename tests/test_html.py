"""Pages as trees: hand-made pages with tags left open, nested and mixed up; rows of result and statistics pages."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from railside.sources.html import Tree, elements, runner_texts, stats_texts
from railside.sources.result_pages import result_runners


def _outline(page: str) -> list[tuple[str, int, str]]:
    tree = Tree(page)
    return [(tag, tree.depth(n), tree.text(n)) for n, tag in enumerate(tree.tags)]


@pytest.mark.parametrize(
    ("page", "outline"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", [("ul", 0, "abcd"), ("li", 1, "a"), ("li", 1, "bcd"), ("ul", 2, "c"), ("li", 3, "c")]),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>3</table>4", [("table", 0, "1234"), ("tr", 1, "12"), ("td", 2, "1"), ("td", 2, "2"), ("tr", 1, "34"), ("td", 2, "34"), ("table", 3, "3"), ("tr", 4, "3"), ("td", 5, "3")]),
        ("<p>a<br>b<p>c<div>d</p>e</div>", [("p", 0, "ab"), ("br", 1, ""), ("p", 0, "c"), ("div", 0, "de")]),
        ("<b>x</i>y</b></b>z", [("b", 0, "xy")]),
        ("<A HREF='/q?a=1&amp;b=2' href=no>&lt;T&gt;</A><!-- <p> --><script>if (a<b) '<p>'</script>", [("a", 0, "<T>"), ("script", 0, "if (a<b) '<p>'")]),
        ("<div><span>open <div/>in</div> out", [("div", 0, "open in out"), ("span", 1, "open in out"), ("div", 2, "in")]),
        ("", []),
        ("no tags < at all", []),
    ],
)
def test_open_and_nested_tags(page, outline):
    assert _outline(page) == outline


def test_attributes_and_classes():
    tree = Tree("<A HREF='/q?a=1&amp;b=2' href=no class='x  y'>t</A><a disabled class=x>u</a>")
    assert tree.attributes == [{"href": "/q?a=1&b=2", "class": "x  y"}, {"disabled": "", "class": "x"}]
    assert list(tree.find("a", {"class": "y"})) == [0] and list(tree.find("a", {"class": "x"})) == [0, 1] and list(tree.find("a", {"disabled": ""})) == [1]


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet=st.sampled_from("<>/ab pdivtrl='\"&;-! \n"), max_size=80))
def test_any_text_is_a_tree(page):
    tree = Tree(page)
    for n in range(len(tree.tags)):
        assert tree.parents[n] < n < tree.ends[n] <= len(tree.tags)
        assert tree.parents[n] < 0 or tree.ends[n] <= tree.ends[tree.parents[n]]


def test_depth_and_length_are_no_trouble(spark):
    deep, wide = "<div>" * 20_000 + "x", "<p>word " * 50_000
    rows = elements(spark.createDataFrame([("deep", deep), ("wide", wide), ("none", None), ("empty", "")], "url string, html string"))
    assert {r.url: r["count"] for r in rows.groupBy("url").count().collect()} == {"deep": 20_000, "wide": 50_000}
    assert rows.where("url = 'deep'").agg({"parent": "max", "after": "min"}).first()[:] in ((19_998, 20_000), (20_000, 19_998))
    assert elements(rows.selectExpr("url", "own AS html").limit(0)).collect() == []


PAGE = """<html><body><main data-analytics-coursename="Ascot" data-analytics-race-date-time="2024-01-05T14:30:00+00:00">
<span class="rp-raceTimeCourseName_class">(Class 2)</span><h2 class="rp-raceTimeCourseName__title">The Cup Hurdle (Listed Race)</h2>
<span class="rp-raceTimeCourseName_ratingBandAndAgesAllowed">(4yo+, 0-140)</span><span class="rp-raceTimeCourseName_condition">Good</span>
<span data-test-selector="block-distanceInd">2m4f</span><table class="rp-horseTable">
<tr class="rp-horseTable__mainRow"><td><span data-test-selector="text-horsePosition">1<sup class="rp-horseTable__pos__draw"> (7)</sup></span>
 <td><img class="rp-horseTable__silk" src="s.svg"><a data-test-selector="link-silk" href="/profile/owner/77/mr-o"></a><span class="rp-horseTable__saddleClothNo">4.</span>
 <a data-test-selector="link-horseName" href="/profile/horse/12/able"> Able </a><span class="rp-horseTable__horse__country">(IRE)</span><span class="rp-horseTable__horse__price">EvensF</span>
 <td data-test-selector="horse-age">6<td><span data-ending="st">11</span><span data-ending="lb">2</span><span class="rp-horseTable__headGear">p1</span><td data-ending="OR">140<td data-ending="RPR">–
<tr class="rp-horseTable__commentRow ng-cloak"><td>Led, won
<tr data-test-selector="block-pedigreeInfoFullResults"><td>b g <a href="/profile/horse/5/s">Sire</a> - <a href="/profile/horse/6/d">Dam<span>USA</span></a> (<a href="/profile/horse/7/g">Damsire Unregistered</a>)
<tr class="rp-horseTable__mainRow"><td><span data-test-selector="text-horsePosition">2</span><span class="rp-horseTable__pos__length"><span>nk</span></span><a data-test-selector="link-horseName" href="/x">Baker</a>
<tr class="rp-horseTable__mainRow"><td><span data-test-selector="text-horsePosition">PU</span><span class="rp-horseTable__pos__length"><span>2½</span><span>[3]</span></span>
<tr data-test-selector="block-pedigreeInfoFullResults"><td>m <a href="/profile/horse/8/d">Only Dam</a>
</table><table><tr><td><a data-test-selector="link-horseName">not a runner</a></table></main>"""


def test_a_result_page(spark):
    pages = spark.createDataFrame([("https://x.test/results/2/ascot/2024-01-05/99", PAGE), ("https://x.test/results/2/ascot/2024-01-05/98", PAGE.replace(">1<sup", ">VOI<sup").replace(">2</span>", ">VOI</span>").replace(">PU<", ">VOI<")), ("bad", "<p>"), (None, None)], "url string, html string")
    rows = sorted(result_runners(pages).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == ["1", "2", "PU"] and {r.ran for r in rows} == {3} and {(r.race_id, r.course_id, r.race_date, r.off) for r in rows} == {(99, 2, date(2024, 1, 5), "14:30")}
    first, second, third = rows
    assert (first.race_class, first.pattern, first.race_type, first.surface, first.age_band, first.rating_band, first.dist_m) == ("Class 2", "Listed", "Hurdle", "Turf", "4yo+", "0-140", 4023)
    assert (first.num, first.draw, first.horse, first.horse_id, first.country, first.owner_id, first.age, first.lbs, first.headgear, first.official, first.rpr, first.dec, first.comment, first.silk_url) == (4, 7, "Able", 12, "IRE", 77, 6, 156, "p1", 140, None, 2.0, "Led - won", "s.svg")
    assert (first.sex, first.sire, first.sire_country, first.sire_id, first.dam, first.dam_country, first.damsire, first.damsire_country) == ("G", "Sire", "GB", 5, "Dam", "USA", None, None)
    assert (second.horse, second.horse_id, second.btn, second.ovr_btn, second.sire, second.age, second.dec) == ("Baker", None, 0.3, 0.3, None, None, None)
    assert (third.btn, third.ovr_btn, third.horse, third.sex, third.sire, third.dam, third.dam_id) == (2.5, 3.0, None, "M", None, "Only Dam", 8)
    assert runner_texts(pages.limit(0)).collect() == []


def test_statistics_of_all_kinds(spark):
    table = '<table data-test-selector="RC-table"><tr class="ui-table__row"><td data-test-selector="RC-{0}Name__row">N {0}<td data-test-selector="RC-lastWinsRuns__row">3 - 20<td data-test-selector="RC-lastProfit__row">-4.50</table>'
    rows = stats_texts(spark.createDataFrame([(1, "".join(map(table.format, ("horse", "jockey", "trainer", "owner"))))], "k int, html string"), "k").collect()
    assert sorted((r.kind or "", r.name, r.measure, r.value) for r in rows) == sorted((k if k != "owner" else "", f"N {k}", m, v) for k in ("horse", "jockey", "trainer", "owner") for m, v in (("lastWinsRuns", "3 - 20"), ("lastProfit", "-4.50")))
