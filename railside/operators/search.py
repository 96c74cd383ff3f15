"""Name and text search."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railside.functions.stems import STEP_2, STEP_3, STEP_4, stem
from railside.plans.postings import gram_postings, kept, matches, similar, terms_of, word_postings
from railside.plans.racing import Racing, with_racing
from railside.plans.snapshots import state_of
from railside.registry import racing_query, table_query


#: What is searched by name: kind -> the warehouse's frame, its id and its name.
KINDS = {"horse": ("horses", "horse_id", "horse_name"), "trainer": ("trainers", "trainer_id", "trainer_name"), "jockey": ("jockeys", "jockey_id", "jockey_name"), "owner": ("owners", "owner_id", "owner_name"), "course": ("courses", "course_id", "course_name")}

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_NAMED = " UNION ALL ".join(f"SELECT '{kind}' AS type, CAST({id_} AS BIGINT) AS id, {name} AS name, {_GRAMS.format(name)} AS g FROM {frame}" for kind, (frame, id_, name) in KINDS.items())


@racing_query(
    "global_search",
    f"WITH n AS ({_NAMED}), q AS (SELECT {_GRAMS.format("'blue widget'")} AS q), s AS (SELECT type, id, name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS score FROM n, q), b AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, id) AS rn FROM s WHERE score >= 0.3) SELECT type, id, name, score, count(*) OVER () AS total_results FROM b WHERE rn <= 10",
    query="blue widget",
    limit=10,
)
def global_search(r: Racing, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """The most similar names of each kind and the number of all that are returned, from the index of their trigrams.

    Score and id order a kind's list. Each list is a top-k of ``limit`` rows, so the total is over a few.
    """
    frames = [frame for frame, _, _ in KINDS.values()]
    path = kept(r.spark, f"names-{r.state(*frames)[0]}", lambda: gram_postings(all_names(r)))
    best = Window.partitionBy("type").orderBy(F.desc("score"), "id")
    found = similar(r.spark, path, query, least).withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= limit).drop("rn")
    return found.withColumn("total_results", F.count("*").over(Window.partitionBy()))


def all_names(r: Racing) -> DataFrame:
    """type, id and name of everything that is searched by name."""
    return reduce(DataFrame.unionByName, [getattr(r, frame).select(F.lit(kind).alias("type"), F.col(id_).cast("long").alias("id"), F.col(name).alias("name")) for kind, (frame, id_, name) in KINDS.items()])


# For the checking SQL, which knows no stemmer: whatever may follow a query's stem without changing it.
_ENDINGS = sorted({"".join(x) for n in range(3) for x in product(["s", "e", "ed", "ing", "ly", "li", "y", "es", "at", "iz", "ings", *STEP_2, *STEP_3, *STEP_4], repeat=n)})


def _stem_sql(term: str) -> str:
    """SQL: whether the word w has this stem, for words that begin with it."""
    endings = ", ".join(f"'{e}'" for e in _ENDINGS if stem(term + e) == term)
    return f"(starts_with(w, '{term}') AND w[{len(term) + 1}:] IN ({endings}))"


_QUERY = "onan onon"
_HITS_SQL = (
    r"ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM documents), "
    + "p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM ws), "
    + f"h AS (SELECT doc_id, pos, CASE {' '.join(f'WHEN {_stem_sql(t)} THEN {i}' for i, t in enumerate(terms_of(_QUERY)))} END AS t FROM p WHERE starts_with(w, 'on')), "
    + "f AS (SELECT doc_id, CAST(count(*) AS INT) AS hits FROM h WHERE t IS NOT NULL GROUP BY 1 HAVING count(DISTINCT t) = 2), "
    + "r AS (SELECT x.doc_id, 1 - exp(sum(ln(1 - sqrt(0.01 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2)))))) AS rank FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.t = 0 AND y.t = 1 AND abs(x.pos - y.pos) <= 100 GROUP BY 1), "
    + "m AS (SELECT doc_id, hits, coalesce(rank, 0.0) AS rank FROM f LEFT JOIN r USING (doc_id))"
)


def document_index(spark: SparkSession, sf_dir: str) -> str:
    """The index of the documents' words, made if it is not there."""
    path = f"{sf_dir}/documents.parquet"
    return kept(spark, f"words-{state_of(spark, [path])[0]}", lambda: word_postings(spark.read.parquet(path), "doc_id", "text"))


@table_query("fts_match", f"WITH {_HITS_SQL} SELECT doc_id, hits, round(rank, 6) AS rank FROM m")
def text_matches(spark: SparkSession, sf_dir: str, query: str = _QUERY) -> DataFrame:
    """Texts with all of the query's terms, how often they hold any, and their rank, from the index."""
    return matches(spark, document_index(spark, sf_dir), query).select(F.col("id").alias("doc_id"), "hits", F.round("rank", 6).alias("rank"))


#: Comments of runners by analogy: a document's text is the comment of the race and horse of its id.
_COMMENTS = ["doc_id AS runner_id", "doc_id AS race_id", "doc_id AS horse_id", "text AS comment"]


@table_query(
    "search_comments",
    with_racing(
        f"WITH c AS (SELECT {', '.join(_COMMENTS)} FROM documents), {_HITS_SQL}"
        " SELECT runner_id, race_id, race_date, course_name, race_name, horse_name, comment, round(rank, 6) AS rank FROM m JOIN c ON runner_id = doc_id JOIN races USING (race_id) JOIN courses USING (course_id) JOIN horses USING (horse_id)"
        " WHERE race_date BETWEEN DATE '1992-01-01' AND DATE '2001-12-31' AND region_id <= 3 ORDER BY round(rank, 6) DESC, race_date DESC, runner_id LIMIT 100"
    ),
)
def search_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr(*_COMMENTS)
    return matching_comments(Racing.from_tables(spark, sf_dir), comments, document_index(spark, sf_dir), _QUERY, date_from="1992-01-01", date_to="2001-12-31", regions=(0, 1, 2, 3))


def matching_comments(r: Racing, comments: DataFrame, index: str, query: str, date_from: str | None = None, date_to: str | None = None, regions: tuple[int, ...] = (), course_id: int | None = None, limit: int = 100) -> DataFrame:
    """Comments with all of the query's terms: the best rank first, the newest first among equals.

    The index gives runners and ranks; races are filtered by date, region and course, and only the
    best runners' comments are fetched.
    """
    races = r.races.join(r.courses, "course_id")
    for bound, keep in ((date_from, F.col("race_date") >= F.lit(date_from)), (date_to, F.col("race_date") <= F.lit(date_to))):
        races = races.where(keep) if bound else races
    races = races.where(F.col("region_id").isin(*regions)) if regions else races
    races = races if course_id is None else races.where(F.col("course_id") == course_id)
    found = matches(r.spark, index, query).select(F.col("id").alias("runner_id"), F.round("rank", 6).alias("rank"))
    owners = comments.select("runner_id", "race_id", "horse_id")
    rows = found.join(owners, "runner_id").join(races.select("race_id", "race_date", "course_name", "race_name"), "race_id").join(r.horses.select("horse_id", "horse_name"), "horse_id")
    order = [F.desc("rank"), F.desc("race_date"), "runner_id"]
    best = rows.orderBy(*order).limit(limit)
    out = best.join(comments.select("runner_id", "comment"), "runner_id")
    return out.select("runner_id", "race_id", "race_date", "course_name", "race_name", "horse_name", "comment", "rank").orderBy(*order)
