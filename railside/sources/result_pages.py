"""Result pages, pedigrees and statistics as typed rows, from the texts that ``html`` finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.functions import racing
from railside.plans.racing import Racing
from railside.registry import racing_query, table_query
from railside.sources.html import PARENTS, elements, pedigree_texts, race_texts, stats_texts

# Fixed value: what is white space to a regular expression.
SPACE = " \t\n\x0b\f\r"


def id_of(href: Column | str) -> Column:
    """The number in a profile's address, /profile/horse/123/name."""
    return F.try_element_at(F.split(href, "/"), F.lit(4)).try_cast("long")


def parent_columns() -> list[Column]:
    """Name without its country, country (GB where none is given) and id of sire, dam and damsire; null where unknown."""
    out = []
    for p in PARENTS:
        text = F.regexp_replace(F.col(p), r"^\(|\)$", "") if p != "sire" else F.col(p)
        name = F.nullif(F.trim(F.split(text, r"\(")[0]), F.lit(""))
        if p == "damsire":
            name = F.nullif(name, F.lit("Damsire Unregistered"))
        given = F.coalesce(F.nullif(F.regexp_extract(p, r"\(([^)]*)\)", 1), F.lit("")), F.nullif(F.translate(f"{p}_country", f"(){SPACE}", ""), F.lit("")))
        out += [name.alias(p), F.when(name.isNotNull(), F.coalesce(given, F.lit("GB"))).alias(f"{p}_country"), id_of(f"{p}_href").alias(f"{p}_id")]
    return out


def result_runners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row a runner of result pages. Race id, day and course id are in the page's address.

    What a page lacks is null, and where the number of runners is missing the rows are counted.
    Void races (position VOI) have no rows. Pages without runner rows, null and empty ones have none.
    """
    at = F.split(url, "/")
    part = lambda i: F.try_element_at(at, F.lit(i))
    ages, ratings = racing.bands(F.col("band"))
    metres = racing.metres(F.trim("dist"))
    # what is the race's is worked out once for all of its runners
    races = race_texts(pages, url, html).select(
        F.col(url),
        part(8).try_cast("long").alias("race_id"),
        part(7).try_cast("date").alias("race_date"),
        part(5).try_cast("long").alias("course_id"),
        F.col("course"),
        F.regexp_extract("off", r"T(\d\d:\d\d)", 1).alias("off"),
        F.col("going"),
        racing.surface_of(F.col("going")).alias("surface"),
        F.col("race_name"),
        F.coalesce(F.nullif(F.regexp_replace("race_class", r"^\(|\)$", ""), F.lit("")), racing.race_class(F.col("race_name"))).alias("race_class"),
        racing.race_pattern(F.col("race_name")).alias("pattern"),
        ages.alias("age_band"),
        ratings.alias("rating_band"),
        F.col("dist"),
        metres.alias("dist_m"),
        racing.race_type(F.col("race_name"), metres, fences=F.col("hurdles")).alias("race_type"),
        F.coalesce(F.regexp_extract("ran", r"(\d+)", 1).try_cast("int"), F.col("rows").cast("int")).alias("ran"),
        "runners",
    )
    of_race = [c for c in races.columns if c != "runners"]
    rows = races.select(*of_race, F.inline("runners"))
    own, overall = F.trim(F.split("btn", r"\[")[0]), F.nullif(F.regexp_extract("btn", r"\[([^\]]*)\]", 1), F.lit(""))
    sp = F.trim(F.replace("sp", F.lit("No Odds"), F.lit("")))
    sex = F.split(F.trim("pedigree"), r"\s+")
    position = F.trim("pos")
    typed = rows.select(
        *of_race,
        F.replace("num", F.lit("."), F.lit("")).try_cast("int").alias("num"),
        F.translate("draw", f"(){SPACE}\xa0", "").try_cast("int").alias("draw"),
        position.alias("pos"),
        racing.beaten_lengths(own).alias("btn"),
        racing.beaten_lengths(F.coalesce(overall, own)).alias("ovr_btn"),
        F.trim("horse").alias("horse"),
        id_of("horse_href").alias("horse_id"),
        F.translate("country", f"(){SPACE}", "").alias("country"),
        F.trim("jockey").alias("jockey"),
        id_of("jockey_href").alias("jockey_id"),
        F.trim("trainer").alias("trainer"),
        id_of("trainer_href").alias("trainer_id"),
        id_of("owner_href").alias("owner_id"),
        F.trim("age").try_cast("int").alias("age"),
        (F.trim("stones").try_cast("int") * 14 + F.trim("pounds").try_cast("int")).alias("lbs"),
        F.col("headgear"),
        *[F.nullif(F.trim(c), F.lit("–")).try_cast("int").alias(c) for c in ("official", "rpr", "ts")],
        sp.alias("sp"),
        racing.decimal_odds(sp).alias("dec"),
        F.translate("prize", f",£€${SPACE}", "").try_cast("double").alias("prize"),
        F.replace("comment", F.lit(","), F.lit(" -")).alias("comment"),
        F.upper(F.try_element_at(sex, F.when(F.size(sex) > 1, 2).otherwise(1))).alias("sex"),
        *parent_columns(),
        F.col("silk_url"),
    )
    return typed.where(F.coalesce(F.col("pos"), F.lit("")) != "VOI")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, a few tasks each: pages are many times as large as the few columns that they are made from."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _spaced(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@racing_query(
    "src_results_html",
    """
SELECT race_id, race_date, course_id, concat('Course & ', course_id) AS course, '13:05' AS "off", going, concat('Stakes <', race_id, '> (Grade 2)') AS race_name, 'Class 3' AS race_class, 'Grade 2' AS pattern,
  CASE WHEN race_id % 3 = 0 THEN 'Hurdle' WHEN race_id % 3 = 1 THEN 'Chase' ELSE 'Flat' END AS race_type, CAST(count(*) OVER (PARTITION BY race_id) AS INT) AS ran, num, CASE WHEN num % 2 = 1 THEN draw END AS draw, coalesce(pos_raw, 'F') AS pos,
  concat('Horse ', horse_id) AS horse, horse_id, concat('J ', jockey_id) AS jockey, jockey_id, trainer_id, CAST(128 + num AS INT) AS lbs, CASE WHEN official % 4 <> 0 THEN official END AS official,
  CASE WHEN num % 3 <> 0 THEN 1.0 + num / 2.0 END AS dec, 1234.5 AS prize, concat('led - <caught> ', num) AS comment, CASE WHEN num <> 4 THEN 'G' END AS sex,
  CASE WHEN num < 4 THEN concat('Sire ', horse_id % 7) END AS sire, CASE WHEN num < 4 THEN 'IRE' END AS sire_country, CASE WHEN num < 4 THEN horse_id % 7 END AS sire_id,
  CASE WHEN num <> 4 THEN concat('Dam ', horse_id % 5) END AS dam, CASE WHEN num <> 4 THEN 'FR' END AS dam_country, CASE WHEN num <> 4 AND num <> 2 THEN concat('Damsire ', horse_id % 3) END AS damsire
FROM runners JOIN races USING (race_id)""",
)
def results_from_pages(r: Racing) -> DataFrame:
    """Each race as a result page, with tags left open, in other cases, nested and without quotes, and read back."""
    profile = lambda kind, key: _spaced(f"/profile/{kind}/", key, "/x")
    link = lambda selector, kind, key, text: _spaced(f'<a data-test-selector="link-{selector}" href="', profile(kind, key), '">', text, "</a>")
    parent = lambda kind, key, text: _spaced(f'<a href="/profile/{kind}/', key, '/y">', text, "</a>")

    def row(x: Column) -> Column:
        n, horse = x["num"], x["horse_id"]
        dam = parent("dam", horse % 5, _spaced("Dam ", horse % 5, " <span>(FR)</span>"))
        damsire = F.when(n != 2, _spaced(" ( ", parent("horse", horse % 3, _spaced("Damsire ", horse % 3)), ")")).otherwise(_spaced(" (", parent("horse", F.lit(0), F.lit("Damsire Unregistered")), ")"))
        sire = F.when(n < 4, _spaced(parent("horse", horse % 7, _spaced("Sire ", horse % 7, " (IRE)")), " - ")).otherwise("")
        pedigree = F.when(n == 4, "").otherwise(_spaced('<tr data-test-selector="block-pedigreeInfoFullResults"><td>b g ', sire, dam, damsire))
        return _spaced(
            '<TR class="rp-horseTable__mainRow is-even"><td><span data-test-selector="text-horsePosition">', F.coalesce(x["pos_raw"], F.lit("F")),
            F.when(n % 2 == 1, _spaced("<sup class='rp-horseTable__pos__draw'>&nbsp;(", x["draw"], ")</sup>")).otherwise(""), "</span><!-- <td class=none> -->",
            '<td><span class="rp-horseTable__saddleClothNo">', n, ".</span>", link("horseName", "horse", horse, _spaced(" Horse <b>", horse)),
            F.when(n % 3 != 0, _spaced('<span class="rp-horseTable__horse__price">', n, "/2F</span>")).otherwise('<span class="rp-horseTable__horse__price">No Odds</span>'),
            "<td>", link("jockeyName", "jockey", x["jockey_id"], _spaced("J ", x["jockey_id"])), "</i>", link("trainerName", "trainer", x["trainer_id"], F.lit("T")),
            "<td class=wgt><span data-ending=st>9</span>-<span data-ending=lb>", n + 2, '</span><td data-ending="OR">', F.when(x["official"] % 4 != 0, x["official"].cast("string")).otherwise("–"),
            '<td><div data-test-selector="text-prizeMoney">£1,234.50<br></div></tr><tr class="rp-horseTable__commentRow ng-cloak"><td>led, &lt;caught&gt; ', n, pedigree,
        )

    # values are gathered by race, and become text where the page does
    values = F.struct("num", "horse_id", "jockey_id", "trainer_id", "draw", "pos_raw", "official")
    rows = r.runners.groupBy("race_id").agg(F.sort_array(F.collect_list(values)).alias("runners")).select("race_id", F.array_join(F.transform("runners", row), "\n").alias("rows"))
    fences = F.when(F.col("race_id") % 3 == 0, "8 hurdles").when(F.col("race_id") % 3 == 1, "12 fences").otherwise("")
    page = _spaced(
        '<!doctype html><html><head><title>a</title><script>var x = "<tr class=rp-horseTable__mainRow>";</script><body><Main data-analytics-coursename="Course &amp; ', F.col("course_id"),
        '" data-analytics-race-date-time="2024-01-05T13:05:00+00:00"><p>Open<h2 class="big rp-raceTimeCourseName__title">Stakes &lt;', F.col("race_id"),
        '&gt; (Grade 2)</h2><span class=rp-raceTimeCourseName_class>(Class 3)</span><span class="rp-raceTimeCourseName_condition">', F.col("going"),
        "</span><span data-test-selector=rp-raceTimeCourseName_hurdles>", fences, "</span><table><tbody>", F.col("rows"), "</table></main>",
    )
    url = _spaced("https://example.test/results/", F.col("course_id"), "/c/", F.date_format("race_date", "yyyy-MM-dd"), "/", F.col("race_id"))
    pages = r.races.join(rows, "race_id").select(url.alias("url"), page.alias("html"))
    names = "race_id race_date course_id course off going race_name race_class pattern race_type ran num draw pos horse horse_id jockey jockey_id trainer_id lbs official dec prize comment sex sire sire_country sire_id dam dam_country damsire"
    return result_runners(pages).select(*names.split())


_COUNTED = ("p", "li", "a", "h1", "article", "div", "footer")
_CLEAN = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g')"


@table_query("html_elements", f"SELECT page_id, tag, CAST(len(regexp_extract_all(h, '(?i)<' || tag || '([\\s/][^>]*)?>')) AS BIGINT) AS n FROM (SELECT page_id, {_CLEAN} AS h FROM pages), (SELECT unnest([{', '.join(repr(t) for t in _COUNTED)}]) AS tag) WHERE n > 0")
def count_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often elements of some tags stand in each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return elements(pages, "page_id").where(F.col("tag").isin(*_COUNTED)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@table_query("html_links", f"SELECT page_id, CAST(len(list_distinct(x)) AS BIGINT) AS links FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS x FROM pages) WHERE len(x) > 0")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses that each page links to."""
    found = elements(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").where("tag = 'a'").select("page_id", F.col("attributes")["href"].alias("href")).where("href is not null")
    return found.groupBy("page_id").agg(F.countDistinct("href").alias("links"))


@table_query("src_stats_html", "SELECT o_orderkey AS k, concat('Horse ', o_orderkey % 40) AS name, m AS measure, CAST(o_orderkey % 9 AS INT) AS wins, CAST(o_orderkey % 50 AS INT) AS runs FROM orders, (SELECT unnest(['goingWinsRuns', 'distanceWinsRuns', 'courseWinsRuns']) AS m)")
def wins_and_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics pages: ``wins - runs`` cells of a horse on going, distance and course."""
    k = F.col("o_orderkey")
    cells = [_spaced(f'<td data-test-selector="RC-{m}WinsRuns__row"> ', k % 9, " - ", k % 50) for m in ("going", "distance", "course")]
    page = _spaced('<section data-accordion-row="stats"><table data-test-selector=RC-table><tr class="ui-table__head"><th>Horse<tr class="ui-table__row"><td data-test-selector="RC-horseName__row">Horse <b>', k % 40, "</b>", *cells, "</table><table><tr class=ui-table__row><td>other</table>")
    rows = stats_texts(spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).select(k.alias("k"), page.alias("html")), "k")
    pair = F.split("value", "-")
    return rows.where("kind = 'horse'").select("k", "name", "measure", F.trim(pair[0]).try_cast("int").alias("wins"), F.trim(F.try_element_at(pair, F.lit(2))).try_cast("int").alias("runs"))


@table_query("src_pedigree", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS sire, CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'IRE' ELSE 'GB' END END AS region, p_brand AS dam, 'USA' AS dam_country, p_partkey AS dam_id, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS damsire FROM part")
def pedigrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedigree cells: sire with its country (GB where none is given), dam and damsire; some cells have no sire."""
    k = F.col("p_partkey")
    sire = F.when(k % 3 != 0, _spaced('<a href="/profile/horse/1/s">', F.col("p_name"), F.when(k % 2 == 0, " (IRE)").otherwise(""), "</a> - ")).otherwise("")
    damsire = F.when(k % 4 != 0, F.col("p_type")).otherwise("Damsire Unregistered")
    cell = _spaced('<table><tr data-test-selector="block-pedigreeInfoFullResults"><td>ch f ', sire, '<a href="/profile/horse/', k, '/d">', F.col("p_brand"), '<span> USA </span></a> (<a href="/profile/horse/3/e">', damsire, "</a>)")
    rows = pedigree_texts(spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")).select(k.alias("k"), cell.alias("html")), "k")
    out = rows.select("k", *parent_columns())
    return out.select("k", "sire", F.col("sire_country").alias("region"), "dam", "dam_country", "dam_id", "damsire")
