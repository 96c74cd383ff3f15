"""Edited, cut and repeated notices against brute-force containment."""

import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from railside.llm.licenses import CONTAINMENT, TEMPLATES, WORDS, license_scan


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingles(words: list[str]) -> list[tuple]:
    return [tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)] if len(words) >= WORDS else [tuple(words)] * bool(words)


def _holds(text: str, template: str) -> bool:
    """A window of the template's length holds enough of its shingles."""
    wanted, all_ = set(_shingles(_words(template))), _shingles(_words(text))
    m = len(wanted)
    return any(len(wanted & set(all_[i : i + m])) >= CONTAINMENT * m for i in range(max(1, len(all_) - m + 1)))


def test_recall_and_precision_of_edited_notices(spark):
    draw = random.Random(5)
    rows = []
    for name, texts in TEMPLATES.items():
        for t in texts:
            words = _words(t)
            for kind in ("whole", "one word", "two words", "cut", "half"):
                own = list(words)
                for _ in range({"one word": 1, "two words": 2}.get(kind, 0)):
                    own[draw.randrange(len(own))] = "otherwise"
                if kind in ("cut", "half"):
                    own = own[: int(len(own) * (0.9 if kind == "cut" else 0.5))]
                filler = [f"w{draw.randrange(999)}" for _ in range(60)]
                at = draw.randrange(60)
                rows.append((len(rows), " ".join(filler[:at] + own + filler[at:])))
    got = {r.doc_id: set(filter(None, r.licenses.split(","))) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = {i: {name for name, texts in TEMPLATES.items() if any(_holds(text, t) for t in texts)} for i, text in rows}
    links = sum(map(len, true.values()))
    assert links > len(rows) / 3  # short templates bear no edit
    assert sum(len(true[i] & got[i]) for i in true) >= 0.99 * links
    # windows of half a length more are searched as well: what is found beyond is an interrupted notice, never another text
    assert all(not got[i] - {name for name, texts in TEMPLATES.items() if any(set(_shingles(_words(t))) & set(_shingles(_words(text))) for t in texts)} for i, text in rows)
    assert got[0] and not license_scan(spark.createDataFrame([(1, "quite another text of many words " * 9)], "doc_id long, text string")).first().licenses


def test_each_occurrence_counts(spark):
    mit = TEMPLATES["MIT"][2]
    docs = spark.createDataFrame([(1, f"{mit} {mit}"), (2, f"{mit} {'word ' * 200}{mit} {mit}"), (3, mit), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_matches, r.licenses) for r in license_scan(docs).collect()}
    assert got == {1: (2, "MIT"), 2: (3, "MIT"), 3: (1, "MIT"), 4: (0, ""), 5: (0, "")}


def _occurrences(text: str, template: str) -> list[int]:
    """The definition, literally: first positions of occurrences, taken from the left by their bases."""
    doc, places = _shingles(_words(text)), _shingles(_words(template))
    m = len(set(places))
    hits = sorted((p - t, p, s) for p, s in enumerate(doc) for t, x in enumerate(places) if x == s)
    out, last = [], None
    for base in sorted({d for d, _, _ in hits}):
        inside = [(p, s) for d, p, s in hits if base <= d <= base + m // 2]
        if len({s for _, s in inside}) >= CONTAINMENT * m and (last is None or base > last + m // 2):
            last = base
            out.append(min(p for p, _ in inside))
    return out


def _brute(text: str) -> list[str]:
    return sorted(f"{name}:{i}:{start}" for name, texts in TEMPLATES.items() for i, t in enumerate(texts) for start in _occurrences(text, t))


NOTICES = [("MIT", 2), ("MIT", 3), ("Apache-2.0", 2), ("BSD-3-Clause", 1)]  # none holds another


@pytest.mark.parametrize("gap", [0, 2, 10, 60, None])
def test_planted_notices_are_counted_once_each(spark, gap):
    draw = random.Random(gap)
    rows, planted = [], {}
    for i in range(60):
        text, count = [], draw.randrange(2, 7)
        for _ in range(count):
            name, no = draw.choice(NOTICES)
            text += _words(TEMPLATES[name][no]) + [f"w{draw.randrange(999)}" for _ in range(draw.randrange(70) if gap is None else gap)]
        rows.append((i, " ".join(text)))
        planted[i] = count
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i].n_matches for i in planted} == planted
    for i, text in rows[:12]:
        assert sorted(got[i].matches.split(",")) == _brute(text)


def test_broken_notices_against_the_definition(spark):
    draw = random.Random(11)
    rows = []
    for i in range(80):
        text = []
        for _ in range(draw.randrange(1, 5)):
            words = _words(draw.choice(TEMPLATES[draw.choice(list(TEMPLATES))]))
            cut = draw.choice([0, 0, len(words) // 10, len(words) // 2])
            words = words[cut:] if draw.random() < 0.5 else words[: len(words) - cut]
            at = draw.randrange(len(words) + 1)
            text += words[:at] + ["between"] * draw.choice([0, 0, 0, 3, len(words) // 3]) + words[at:] + ["w"] * draw.choice([0, 0, 1, 40])
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.matches for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    true = {i: _brute(text) for i, text in rows}
    found = {i: sorted(filter(None, m.split(","))) for i, m in got.items()}
    assert sum(map(len, true.values())) > 100
    assert all(set(found[i]) <= set(true[i]) for i in true)  # what is retrieved is verified by the definition
    assert sum(len(found[i]) for i in true) >= 0.99 * sum(map(len, true.values()))


def test_one_notice_very_often_in_one_text(spark):
    mit = TEMPLATES["MIT"][3]
    docs = spark.createDataFrame([(1, " ".join([mit] * 400)), (2, None)], "doc_id long, text string")
    begun = time.perf_counter()
    rows = {r.doc_id: r for r in license_scan(docs).collect()}
    counts = defaultdict(int)
    for m in rows[1].matches.split(","):
        counts[m.rsplit(":", 1)[0]] += 1
    assert counts["MIT:3"] == 400 and time.perf_counter() - begun < 120


def test_templates_from_a_table(spark):
    words = [f"term{i}" for i in range(6000)]  # as long as a whole license
    table = spark.createDataFrame([("Long", " ".join(words)), ("Long", "a few other words that stand here"), (None, "no name"), ("Empty", None)], "license string, text string")
    text = " ".join(["before"] * 30 + words[:2000] + ["changed"] + words[2001:5500] + ["after"] * 30)
    docs = spark.createDataFrame([(1, text), (2, "a few other words that stand here"), (3, "plain")], "doc_id long, text string").withColumn("Row", F.lit(1))
    assert {r.doc_id: r.matches for r in license_scan(docs, table).collect()} == {1: "Long:1:30", 2: "Long:0:0", 3: ""}
    assert {r.n_matches for r in license_scan(docs, table.limit(0)).collect()} == {0}
