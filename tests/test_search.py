"""Stems against the published examples; what an index reads; ranks and similar names against brute force."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

from railside.functions.stems import measure, stem
from railside.functions.text import trigram_similarity
from railside.operators.search import all_names
from railside.plans.postings import BUCKETS, bucket_of, gram_postings, kept, matches, search, similar, terms_of, word_postings
from railside.plans.racing import Racing
from tests.oracle import SMALL

# The examples of the paper that describes the algorithm, step by step, as whole words.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil connect connect connected connect connecting connect connection connect connections connect""".split()


def test_published_stems():
    assert [(w, stem(w)) for w in PUBLISHED[::2]] == list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    assert [measure(w) for w in "tr ee tree y by trouble oats trees ivy troubles private oaten orrery".split()] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    assert [stem(w) for w in ("", "is", "4th", "été", "running2")] == ["", "is", "4th", "été", "running2"]


TEXTS = [(1, "The runner ran on; runners were running."), (2, None), (3, ""), (4, "running " * 3 + "filler " * 200 + "horse"), (5, "a horse and a runner and horses"), (5, "horse runner"), (None, "horse runner"), (6, "HORSE... Runner!")]


def _index(spark, tmp_path, frame, name="i"):
    return kept(spark, name, lambda: frame, folder=str(tmp_path))


def test_postings_and_what_is_read(spark, tmp_path):
    docs = spark.createDataFrame(TEXTS[:5] + TEXTS[7:], "id long, text string")
    path = _index(spark, tmp_path, word_postings(docs, "id", "text"))
    assert {(r.id, tuple(r.positions)) for r in search(spark, path, ["runner"]).collect()} == {(1, (2, 5)), (5, (5,)), (6, (2,))}
    assert {(r.id, len(r.positions)) for r in search(spark, path, ["run"]).collect()} == {(1, 1), (4, 3)}
    frame = search(spark, path, ["run", "hors"])
    read = {r.f for r in frame.select(F.input_file_name().alias("f")).distinct().collect()}
    assert read and {int(re.search(r"bucket=(\d+)", f)[1]) for f in read} == {bucket_of("run"), bucket_of("hors")}
    assert "PartitionFilters: [bucket" in frame._jdf.queryExecution().executedPlan().toString()
    assert spark.range(1).select(F.pmod(F.crc32(F.lit("hors")), F.lit(BUCKETS))).first()[0] == bucket_of("hors")
    before = os.stat(path).st_mtime_ns
    assert _index(spark, tmp_path, docs.select(F.raise_error(F.lit("made again")).alias("term"))) == path and os.stat(path).st_mtime_ns == before


def _rank(places: list[list[int]]) -> float:
    if len(places) == 1:
        return sum(0.1 / (j + 1) ** 2 for j in range(len(places[0]))) / 1.64493406685
    failed = 1.0
    for i, a in enumerate(places):
        for b in places[i + 1 :]:
            for p in a:
                for q in b:
                    if abs(p - q) <= 100:
                        failed *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
    return 1 - failed


@pytest.mark.parametrize("query", ["runner", "horses running", "the horse, runner", "running runner horse", "horse horses", "the of", "absent horse"])
def test_ranks_by_brute_force(spark, tmp_path, query):
    texts = [(i, t) for i, t in TEXTS[:5] + TEXTS[7:]] + [(9, "horse " * 300 + "runner running " * 50)]
    path = _index(spark, tmp_path, word_postings(spark.createDataFrame(texts, "id long, text string"), "id", "text"), f"q{abs(hash(query))}")
    terms, expected = sorted(terms_of(query)), {}
    for i, t in texts:
        words = [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower())]
        places = [[p for p, w in enumerate(words, 1) if w == x] for x in terms]
        if terms and all(places):
            expected[i] = (sum(map(len, places)), round(_rank(places), 9))
    assert {r.id: (r.hits, round(r["rank"], 9)) for r in matches(spark, path, query).collect()} == expected


def test_names_below_the_bound_are_never_scored(spark, tmp_path):
    names = all_names(Racing.from_tables(spark, SMALL))
    path = _index(spark, tmp_path, gram_postings(names))
    for query in ("blue widget", "Supplier 7", "x", ""):
        expected = {(r.type, r.id): round(r.s, 6) for r in names.withColumn("s", trigram_similarity(F.col("name"), F.lit(query))).where("round(s, 6) >= 0.3").collect()}
        found = similar(spark, path, query)
        assert {(r.type, r.id): r.score for r in found.collect()} == expected
        # what is counted has the right number of trigrams, and shares one; counts alone decide
    plan = similar(spark, path, "blue widget")._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "PartitionFilters: [bucket" in plan
    read = similar(spark, path, "blue widget", 0.0).count()
    assert 0 < read < names.count() / 2
