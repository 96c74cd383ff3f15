"""Race cards: the state that a page's script assigns, as VARIANT, so that its shape need not be known.

The state is parsed once a page. Fields are taken by path and type; one that is missing, or not of
its type, is null, and what else a page holds does no harm. Lists of any length and shape become
rows by ``variant_explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railside.functions.text import title_name
from railside.registry import table_query

# Fields of a profile, their paths and types.
PROFILE = {
    "horse_id": ("$.profile.horseUid", "bigint"),
    "name": ("$.profile.horseName", "string"),
    "age": ("$.profile.age", "string"),
    "dob": ("$.profile.horseDateOfBirth", "string"),
    "sex": ("$.profile.horseSex", "string"),
    "sex_code": ("$.profile.horseSexCode", "string"),
    "colour": ("$.profile.horseColour", "string"),
    "region": ("$.profile.horseCountryOriginCode", "string"),
    "breeder": ("$.profile.breederName", "string"),
    "dam": ("$.profile.damHorseName", "string"),
    "dam_region": ("$.profile.damCountryOriginCode", "string"),
    "sire": ("$.profile.sireHorseName", "string"),
    "sire_region": ("$.profile.sireCountryOriginCode", "string"),
    "grandsire": ("$.profile.siresSireName", "string"),
    "damsire": ("$.profile.damSireHorseName", "string"),
    "damsire_region": ("$.profile.damSireCountryOriginCode", "string"),
    "trainer": ("$.profile.trainerName", "string"),
    "trainer_id": ("$.profile.trainerUid", "bigint"),
    "trainer_location": ("$.profile.trainerLocation", "string"),
    "owner": ("$.profile.ownerName", "string"),
    "comment": ("$.profile.comments[0].individualComment", "string"),
    "spotlight": ("$.profile.comments[0].individualSpotlight", "string"),
}
#: Names that are normalised; days that are cut out of time stamps.
NAMES, DAYS = ("name", "dam", "sire", "grandsire", "damsire", "trainer", "owner"), ("dob",)

# The lists of a state, and the fields of their entries.
LISTS = {
    "trainer": ("$.profile.previousTrainers", {"who": "$.trainerStyleName", "who_id": "$.trainerUid", "day": "$.trainerChangeDate"}),
    "owner": ("$.profile.previousOwners", {"who": "$.ownerStyleName", "who_id": "$.ownerUid", "day": "$.ownerChangeDate"}),
    "medical": ("$.profile.medical", {"what": "$.medicalType", "day": "$.medicalDate"}),
    "quote": ("$.quotes", {"what": "$.notes", "who": "$.horseStyleName", "who_id": "$.horseUid", "day": "$.raceDate", "race_id": "$.raceId"}),
    "stable_tour": ("$.stableTourQuotes", {"what": "$.notes", "who": "$.horseName", "who_id": "$.horseUid"}),
}
ENTRY = {"who": "string", "who_id": "bigint", "what": "string", "day": "string", "race_id": "bigint"}


def state(html: Column | str) -> Column:
    """The state that a page's script assigns, as a variant; null where there is none or it is no JSON."""
    line = F.regexp_extract(html, r"window\.PRELOADED_STATE\s*=([^\n]*)", 1)
    return F.try_parse_json(F.nullif(F.regexp_replace(F.trim(line), r"[;\s]+$", ""), F.lit("")))


def card_runners(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: the runner that it is about. A page without state is known by its address alone.

    Ages are whole years, also of horses that died. Pages with neither state nor a readable address
    have a row without id.
    """
    read = pages.select(F.col(url).alias("url"), state(html).alias("s"))
    fields = {name: F.try_variant_get("s", path, kind) for name, (path, kind) in PROFILE.items()}
    at = F.split("url", "/")
    fields["horse_id"] = F.coalesce(fields["horse_id"], F.try_element_at(at, F.lit(6)).try_cast("bigint"))
    fields["name"] = F.coalesce(fields["name"], F.initcap(F.regexp_replace(F.try_element_at(at, F.lit(7)), "-", " ")))
    fields["age"] = F.split(F.trim(F.regexp_replace(fields["age"], "Died as a", "")), "-")[0].try_cast("int")
    for name in NAMES:
        fields[name] = title_name(fields[name])
    for name in DAYS:
        fields[name] = F.split(fields[name], "T")[0].try_cast("date")
    return read.select("url", *[c.alias(name) for name, c in fields.items()], F.col("s").isNull().alias("broken"))


def histories(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each entry of a page's lists: url, list, pos (from 0), who, who_id, what, day, race_id.

    A list that is missing, null, or no list has no rows; entries without any known field have nulls.
    """
    spark = pages.sparkSession
    read = pages.select(F.col(url).alias("url"), state(html).alias("s")).where("s is not null")
    lists = F.array(*[F.struct(F.lit(name).alias("list"), F.try_variant_get("s", path, "variant").alias("v")) for name, (path, _) in LISTS.items()])
    each = read.select("url", F.explode(lists).alias("l")).select("url", "l.list", "l.v").where(F.schema_of_variant("v").startswith("ARRAY"))
    entries = each.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    out = []
    for field, kind in ENTRY.items():
        found = F.lit(None).cast(kind)
        for name, (_, paths) in LISTS.items():
            if field in paths:
                found = F.when(F.col("list") == name, F.try_variant_get("value", paths[field], kind)).otherwise(found)
        out.append((F.split(found, "T")[0].try_cast("date") if field == "day" else found).alias(field))
    return entries.select("url", "list", "pos", *out)


def _state_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages about parts: every fifth without a script, fields missing here and there, others that nobody asked for."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Horse "), k.cast("string"))
    trainer = lambda i: F.struct(F.concat(F.lit("T "), (k % i).cast("string")).alias("trainerStyleName"), F.when(k % 3 != 0, k % i).alias("trainerUid"), F.lit("2020-01-0" + str(i) + "T00:00:00").alias("trainerChangeDate"))
    profile = F.struct(
        k.alias("horseUid"), name.alias("horseName"), F.concat(F.when(k % 7 == 0, "Died as a ").otherwise(""), F.col("p_size").cast("string"), F.lit("-y-o")).alias("age"),
        F.lit("2015-03-01T00:00:00").alias("horseDateOfBirth"), F.when(k % 2 == 0, F.col("p_brand")).alias("sireHorseName"), F.col("p_type").alias("trainerName"),
        F.when(k % 3 == 0, F.array(F.lit("what"), F.lit("else"))).alias("somethingNew"), F.when(k % 4 != 0, F.array(trainer(2), trainer(3))).alias("previousTrainers"), F.when(k % 4 == 0, "none").alias("medical"),
    )
    text = F.to_json(F.struct(profile.alias("profile"), F.when(k % 2 == 1, F.array(F.struct(F.lit("a; quote").alias("notes"), k.alias("raceId")))).alias("quotes")))
    script = F.when(k % 5 != 0, F.concat(F.lit("<script>window.PRELOADED_STATE = "), text, F.lit(";\n var x = 1</script>"))).otherwise("")
    url = F.concat(F.lit("https://example.test/profile/horse/"), k.cast("string"), F.lit("/horse-"), k.cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(url.alias("url"), F.concat(F.lit("<html><body>"), script).alias("html"))


@table_query(
    "src_racecard_runners",
    "SELECT p_partkey AS horse_id, concat('Horse ', p_partkey) AS name, CASE WHEN s THEN p_size END AS age, CASE WHEN s THEN DATE '2015-03-01' END AS dob, CASE WHEN s AND p_partkey % 2 = 0 THEN concat(p_brand[1:1], lower(p_brand[2:])) END AS sire, NOT s AS broken FROM (SELECT *, p_partkey % 5 <> 0 AS s FROM part)",
)
def runners_of_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_runners(_state_pages(spark, sf_dir)).select("horse_id", "name", "age", "dob", "sire", "broken")


@table_query(
    "src_racecard_history",
    """
WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0)
SELECT k, 'trainer' AS list, CAST(i - 2 AS INT) AS pos, concat('T ', k % i) AS who, CASE WHEN k % 3 <> 0 THEN k % i END AS who_id, CAST(NULL AS VARCHAR) AS what, CAST(concat('2020-01-0', i) AS DATE) AS day, CAST(NULL AS BIGINT) AS race_id FROM p, (VALUES (2), (3)) v(i) WHERE k % 4 <> 0
UNION ALL SELECT k, 'quote', 0, NULL, NULL, 'a; quote', NULL, k FROM p WHERE k % 2 = 1""",
)
def history_of_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histories(_state_pages(spark, sf_dir))
    return rows.select(F.split("url", "/")[5].cast("long").alias("k"), "list", "pos", "who", "who_id", "what", "day", "race_id")
