"""The training-data operators against SQL, brute force and their contracts; edge cases on small frames."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from railside.llm import queries as Q
from railside.llm.decontam import contamination
from railside.llm.exact_dup import exact_duplicates
from railside.llm.language_model import language_model_scores
from railside.llm.licenses import TEMPLATES, license_scan
from railside.llm.mixing import mix_plan, mixture
from railside.llm.near_dup import near_duplicates
from railside.llm.pii import personal_data
from railside.llm.quality import drop_low_quality, quality_scores
from railside.llm.sharding import shard_digest, shard_documents
from railside.llm.warc import convert_pages
from tests.llm.test_hard_cases import _components as components
from tests.oracle import SMALL, differences

SCHEMA = "doc_id long, text string, source string, SHARD int, Key string"
LONG = " ".join(f"word{i}" for i in range(3000))
EDGE = [(1, "", "a", 1, "x"), (2, None, None, 2, "x"), (3, LONG, "a", 3, "x"), (4, LONG, "a", 3, "x"), (5, "one", "b", None, None), (5, "one", "b", None, None), (None, "one two", "b", 1, "x")]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    assert differences(Q.QUERIES[name](spark, SMALL), SMALL, Q.ORACLES[name]) == []


OVER_DOCUMENTS = [mix_plan, mixture, near_duplicates, license_scan, language_model_scores, exact_duplicates, personal_data, quality_scores, drop_low_quality, shard_digest, shard_documents]


@pytest.mark.parametrize("operator", OVER_DOCUMENTS, ids=lambda f: f.__name__)
def test_nulls_repeats_and_empty_tables(edge, operator):
    got = operator(edge).collect()
    assert operator in (mixture, drop_low_quality) or len(got) == len(EDGE)
    assert operator(edge.limit(0)).collect() == []


def test_decontamination_edges(spark, edge):
    items = spark.createDataFrame([(7, "one"), (8, None), (9, "word5 word6")], "item_id long, text string")
    rows = contamination(edge, items).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in rows) == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 2, 1), (4, 2, 1), (5, 1, 1), (5, 1, 1)]
    assert not any(r.contaminated for r in contamination(edge, items.limit(0)).collect())
    blocks = contamination(edge, items, block_bytes=4).collect()
    assert Counter(blocks) == Counter(rows)


def test_mix_meets_targets(spark):
    rows = Q.op1_mixing(spark, SMALL).collect()
    taken, longest = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        own = r.source_size, r.target
        taken[own] += r.taken
        longest[own] = max(longest[own], r["size"])
    for (size, target), words in taken.items():  # whole documents: no nearer than one of them allows
        assert target <= 2 * size and abs(words - target) <= longest[size, target]
    assert sorted(map(repr, rows)) == sorted(map(repr, Q.op1_mixing(spark, SMALL).collect()))


def test_shards_are_gapless_and_grow(spark):
    slots = defaultdict(list)
    for r in Q.op10_sharding(spark, SMALL).collect():
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_warc_edges(spark):
    pages = spark.createDataFrame([(1, "http://a b", "x\r\n\r\ny"), (2, None, None), (3, "u", ""), (4, "v", "x\r\n\r\ny")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in convert_pages(pages).collect()}
    assert got == {1: (6, "response", None), 2: (0, "response", None), 3: (0, "revisit", 2), 4: (6, "revisit", 1)}
    assert convert_pages(pages.limit(0)).collect() == []


def test_licenses(spark):
    text = "intro " * 40 + TEMPLATES["MIT"][2] + " outro" * 40
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, TEMPLATES["GPL-3.0"][1])], "doc_id long, text string")
    assert {r.doc_id: r.licenses for r in license_scan(docs).collect()} == {1: "MIT", 2: "", 3: "GPL-3.0"}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _sound(kind: str, m: str) -> bool:
    digits = [int(x) for x in re.sub("[^0-9]", "", m)]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def _base(text: str) -> list[str]:
    spans = [(m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if _sound(kind, m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]


def test_personal_data_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in personal_data(docs).select("doc_id", "spans", "base_sha256").collect()}
    import hashlib

    for r in docs.select("doc_id", "text").collect():
        base = _base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[r.doc_id].spans.split(",")) or not base


def test_language_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in language_model_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_quality_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.9 and kept[1] - kept[0] > 0.5


def _hit(text: str | None, windows: dict[int, set[tuple]]) -> bool:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return any(tuple(words[i : i + n]) in own for n, own in windows.items() for i in range(len(words) - n + 1))


def test_pipeline_stages(spark, monkeypatch, tmp_path):
    """Each stage's rows by brute force from what it was given."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given, rows = {r.doc_id: r for r in docs.collect()}, {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SMALL).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        assert set(docs.columns) <= set(frame.columns) and (name == "sharding" or frame.columns == docs.columns)
        rows[name] = frame.collect()
        for r in rows[name]:
            assert all(r[c] == given[r.doc_id][c] for c in docs.columns)
    ids = {name: Counter(r.doc_id for r in own) for name, own in rows.items()}
    kept = {r.doc_id for r in quality_scores(docs).collect() if r.kept}
    assert set(ids["quality"]) == kept and set(ids["quality"].values()) == {1}
    group = components({i: given[i].text for i in kept}, 5, 80)
    assert Counter(group[i] for i in ids["near_duplicates"]) == Counter(set(group.values()))
    windows: dict[int, set[tuple]] = defaultdict(set)
    for item in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item.text or "").translate({c: c + 32 for c in range(65, 91)}))
        n = min(10, len(words))
        windows[n] |= {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
    assert ids["decontamination"] == Counter({i: 1 for i in ids["near_duplicates"] if not _hit(given[i].text, windows)})
    plan = {r.doc_id: len(r.mix_shards or []) for r in mix_plan(spark.read.parquet(f"{tmp_path}/decontamination")).collect()}
    assert ids["mixing"] == Counter({i: n for i, n in plan.items() if n}) and max(ids["mixing"].values()) <= 2
    assert ids["sharding"] == ids["mixing"]
    slots = defaultdict(list)
    for r in rows["sharding"]:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_pipeline_keeps_one_folder(spark, monkeypatch, tmp_path):
    made = []
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda _, name: made.append(f"{tmp_path}/{name}") or made[-1])
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [os.path.exists(p) for p in made] == [False, False, False, True]


@pytest.mark.parametrize("table", ["documents", "benchmark"])
def test_the_pipeline_on_an_empty_table(spark, tmp_path, table):
    for t in ("documents", "benchmark"):
        frame = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (frame.limit(0) if t == table else frame).write.parquet(f"{tmp_path}/{t}.parquet")
    assert (corpus_pipeline.run(spark, str(tmp_path)).count() > 0) == (table == "benchmark")
