"""Plain pages are read by cuts at brackets: the same trees as the full parser's; a page counts its own rows."""

import random

from railside.sources.html import Tree, page_runners, race_texts, tree_runners
from railside.sources.result_pages import pedigrees, result_runners, wins_and_runs
from tests.oracle import SMALL

PIECES = ["<p>", "</p>", '<TR class="a b">', "<td class=x/y>", "</td>", "<table>", "</table>", "<br/>", '<a href="/q?a=1&amp;b=2" HREF=no>', "</a>", "t &amp; &lt;", "&nb", "<!-- c <p> - d -->", "<!-->x-->", "<!--a--b-->", "<!doctype html>", "<script>", "if (a<b) x&amp;", "</SCRIPT >", "<div", ">", "<", '"', "\n", "é\xa0", '<a b = "c">', '<a b="c"d="e">', "<x-y>", "<?pi?>", "</>", "<li a b=c>", "</li x>", "&#65"]


class Parsed(Tree):
    def _plain(self, page: str) -> bool:
        return False


def _outline(tree: Tree) -> list[tuple]:
    return [(tag, tree.attributes[n], tree.parents[n], tree.ends[n], tree.text(n), tree.own_text(n)) for n, tag in enumerate(tree.tags)]


def test_cuts_and_parser_make_the_same_trees():
    rng, plain = random.Random(3), 0
    for _ in range(5000):
        page = "".join(rng.choices(PIECES, k=rng.randint(1, 12)))
        assert _outline(Tree(page)) == _outline(Parsed(page)), page
    for page in ("<ul><li>a<li class='x y'>b &amp; c</ul><script>a<b</script><!-- <p> -->", "<p>é<br>"):
        tree = Tree.__new__(Tree)
        tree._begin()
        plain += tree._plain(page)
    assert plain == 2


def test_a_page_counts_its_own_runners(spark):
    page = '<main><table><tr class="rp-horseTable__mainRow"><td>a<tr class="rp-horseTable__mainRow"><td>b</table>'
    rows = result_runners(spark.createDataFrame([("https://x.test/results/2/a/2024-01-05/9", page)] * 3, "url string, html string")).select("race_id", "ran")
    assert [r.ran for r in rows.collect()] == [2] * 6
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_few_bytes_are_dealt_over_all_cores(spark):
    for query in (pedigrees, wins_and_runs):
        assert query(spark, SMALL).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


RESULT = '<main data-analytics-coursename="C &amp; D"><table><tr class="rp-horseTable__mainRow"><td><span data-test-selector="text-horsePosition">{0}</span><!-- <td> --><a data-test-selector="link-horseName" href="/profile/horse/{0}/x"> H <b>{0}</a><tr data-test-selector="block-pedigreeInfoFullResults"><td>b g <a href="/s">Sire {0}</a> - <a href="/d">Dam <span>USA</span></a><tr class="rp-horseTable__mainRow"><td>{0}</table><script>a<b</script></main>'


def test_fields_are_found_without_a_tree(monkeypatch):
    pages = [RESULT.format(i) for i in range(50)]
    expected = [tree_runners(Parsed(page)) for page in pages]
    page_runners(pages[0])
    monkeypatch.setattr(Tree, "__init__", None)  # no page's tree is made,
    monkeypatch.setattr("railside.sources.html.Part.__init__", None)  # and nothing is worked out again
    assert [page_runners(page) for page in pages] == expected
    race, (first, second) = expected[7]
    assert race == {"course": "C & D", "rows": "2"} and first[:1] + second[:1] == ["7", None] and {"H 7", "/profile/horse/7/x", "Sire 7", "/s", "Dam", "USA"} <= set(first)


def test_parts_and_trees_tell_the_same():
    rng = random.Random(4)
    tags = [*PIECES, '<tr class="x rp-horseTable__mainRow">', '<tr class="rp-horseTable__mainRow rp-horseTable__commentRow">', "<tr class=rp-horseTable__commentRow>", '<tr data-test-selector="block-pedigreeInfoFullResults">', '<a data-test-selector="link-horseName" href="/p/1">', '<span data-test-selector="text-horsePosition">', "<span class=rp-raceTimeCourseName_condition>", "</span>", "</tr>", '<a title="q" href="/z" href="/w">', " - "]
    for i in range(8000):
        page = "<table>" * (i % 2) + "".join(rng.choices(tags if i % 3 else tags[len(PIECES) :], k=rng.randint(1, 30)))
        assert page_runners(page) == tree_runners(Parsed(page)), page


def test_many_runners_of_a_page_are_dealt_over_rows(spark):
    page = "<table>" + '<tr class="rp-horseTable__mainRow"><td>' * 25 + "</table>"
    rows = race_texts(spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "k int, html string"), "k", step=10).selectExpr("k", "rows", "size(runners) n").collect()
    assert [tuple(r) for r in rows] == [(1, "25", 10), (1, "25", 10), (1, "25", 5)]
