"""Hot groups, ties, long texts and clashing names: operators against brute force on small frames."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from railside.llm import queries as Q
from railside.llm.decontam import contamination, drop_contaminated
from railside.llm.exact_dup import drop_duplicates, exact_duplicates, repeated_fingerprints
from railside.llm.mixing import Mix, mix_plan, mixture
from railside.llm.near_dup import drop_near_duplicates, near_duplicates
from railside.llm.pii import personal_data
from railside.llm.quality import drop_low_quality, fit_labellers
from railside.llm.sharding import shard_documents
from railside.llm.words import SPACED, hash_words
from tests.oracle import SMALL


def _components(texts: dict[int, str | None], k: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
    part = {i: i for i in texts}

    def root(i: int) -> int:
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((root(a), root(b)))
                    part[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_a_large_group_of_near_copies(spark, k, percent):
    r = random.Random(k)
    base = [f"w{r.randrange(400)}" for _ in range(150)]
    texts: dict[int, str | None] = {}
    for i in range(260):  # a few to many words changed, so that some copies are linked through others alone
        words = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            words[r.randrange(150)] = f"new{r.randrange(60)}"
        texts[i] = " ".join(words)
    line = " ".join(f"common{i}" for i in range(12))
    for i in range(260, 400):
        texts[i] = line + " " + " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(0, 30)))
    texts |= {400: None, 401: "", 402: "one two", 403: "ONE  two", 404: "one"}
    rows = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), words=k, percent=percent).collect()
    assert {x.doc_id: x.component_id for x in rows} == _components(texts, k, percent)


def test_pairs_at_exactly_the_threshold(spark):
    shared = [f"s{i}" for i in range(17)]  # unigrams: 17 of 20 are 85 percent, 17 of 21 are not
    texts = [(1, " ".join([*shared, "a", "b"])), (2, " ".join([*shared, "c"])), (3, " ".join(f"t{i}" for i in range(17)) + " d e"), (4, " ".join(f"t{i}" for i in range(17)) + " f g")]
    rows = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=1, percent=85).collect()
    assert {x.doc_id: x.component_id for x in rows} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_one_row_of_a_group_stays_whatever_its_id(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text, "a"), (None, text, "b"), (7, text + " end", "c"), (7, text + " end", "c"), (9, None, "d"), (9, None, "d"), (None, "alone here", "e"), (7, "another text with the same id", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, NODE string")
    kept = Counter(r.NODE for r in drop_near_duplicates(docs).collect())
    assert kept == Counter({"c": 1, "d": 2, "e": 1, "f": 1})


def test_hashes_tell_structured_words_apart():
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    words = [a, b, a[:1024], b[:1024], "x" * 8, "x" * 9, "x" * 16, "x" * 17]
    assert len(np.unique(hash_words(words, SPACED))) == len(words)
    assert [int(hash_words([w], SPACED)[0]) for w in words] == [int(h) for h in hash_words(words, SPACED)]


def test_rows_are_judged_by_their_own_text(spark):
    words = " ".join(f"bench{i}" for i in range(12))
    docs = spark.createDataFrame([(None, "x " + words, 1), (1, "clean words", 2), (1, words, 3), (2, None, 4)], "doc_id long, text string, Text_Hash int")
    items = spark.createDataFrame([(5, words), (None, "clean words elsewhere")], "item_id long, text string")
    for block in (1 << 20, 60):
        assert sorted(r.Text_Hash for r in drop_contaminated(docs, items, block_bytes=block).collect()) == [2, 4]
    named = contamination(docs, spark.createDataFrame([(None, "clean words")], "item_id long, text string")).where("contaminated").collect()
    assert [(r.doc_id, r.n_hit, r.n_items) for r in named] == [(1, 2, 0)]


def test_a_phrase_that_very_many_items_share(spark):
    phrase = " ".join(f"p{i}" for i in range(10))
    items = spark.createDataFrame([(i, f"{phrase} item{i} tail") for i in range(20000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " and ".join([phrase] * 500)), (2, "word " * 20000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination(docs, items).collect()}
    assert got == {1: (5499, 5000, 20000), 2: (20000, 0, 0)}


def test_very_many_texts_with_a_phrase_of_very_many_items(spark):
    phrase = " ".join(f"p{i}" for i in range(10))
    items = spark.createDataFrame([(i, f"{phrase} item{i} tail") for i in range(20000)], "item_id long, text string")
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{phrase} own "), "id").alias("text"))
    names = hashlib.sha256(",".join(sorted(map(str, range(20000)))).encode()).hexdigest()
    for block in (1 << 25, 1000):
        rows = contamination(docs, items, block_bytes=block).groupBy("n_words", "n_hit", "n_items", "items_sha256", "contaminated").count().collect()
        assert [tuple(r) for r in rows] == [(12, 10, 20000, names, True, 2000)]


def test_a_joined_benchmark_gives_the_same_rows(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    more = [(1000 + i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(200)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*more, *more[:20], (None, more[0][1]), (5000, None)], "doc_id long, text string"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").unionByName(spark.createDataFrame([(f"x{i}", " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 10, 12])))) for i in range(40)] + [(None, more[3][1]), ("none", None)], "item_id string, text string"))
    held, joined = contamination(docs, items), contamination(docs, items, block_bytes=1)
    assert held.schema.names == joined.schema.names and Counter(held.collect()) == Counter(joined.collect())
    assert Counter(drop_contaminated(docs, items).collect()) == Counter(drop_contaminated(docs, items, block_bytes=1).collect())


@pytest.mark.parametrize("filter_size", [1, 50, 1 << 20])
def test_repeated_fingerprints_over_ranges(spark, filter_size):
    r = np.random.default_rng(3)
    values = [int(x) for x in r.integers(-(1 << 63), 1 << 63, 500)]
    values += values[:200] + values[:50] + [-1, -1, 0, 0, 0, (1 << 63) - 1]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "fp long").repartition(5)
    got = sorted(x.fp for x in repeated_fingerprints(frame, filter_size=filter_size).collect())
    assert got == sorted(v for v, n in Counter(values).items() if n > 1)


def test_exact_copies_that_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (3, "a", "y"), (None, "a", "z"), (4, None, "p"), (5, "", "q")], "doc_id long, text string, FP string")
    assert sorted(r.FP for r in drop_duplicates(docs).collect()) == ["q", "y"]
    assert {r.FP if hasattr(r, "FP") else r.doc_id: r.keep_id for r in exact_duplicates(docs).collect()} == {1: 3, 3: 3, None: 3, 4: 5, 5: 5}


def test_targets_by_hand(spark):
    rows = Q.op1_mixing(spark, SMALL).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    own = Counter()
    for i, d in docs.items():
        own[d.source] += size[i]
    names = sorted(own, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(own.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * own[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * own[s] for s in over}
        left -= sum(2.0 * own[s] for s in over)
        free -= over
    for r in rows:
        source = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], own[source])
        assert abs(r.target - target[source]) < 1e-6 * max(1, target[source])


def test_shards_of_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = {r.doc_id: r for r in mix_plan(docs).collect()}
    placed = defaultdict(list)
    for r in mixture(docs).select("doc_id", "mix_shard").collect():
        placed[r.doc_id].append(r.mix_shard)
    assert {i: sorted(s) for i, s in placed.items()} == {i: sorted(p.mix_shards) for i, p in plan.items() if p.mix_shards}
    mix = Mix(docs, shards=8)
    leaves = Counter(s for r in mix.places.collect() for s in r.places)
    assert len(leaves) == 8 and max(leaves.values()) - min(leaves.values()) <= 3  # halves are rounded at three depths


def test_shards_with_small_buckets_and_clashing_names(spark):
    rows = [(i if i % 3 else None, "t" * (i % 50) if i % 5 else None, i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int").select("*", *[F.lit(i).alias(n) for i, n in enumerate(["_size", "_row", "hash", "cell", "SLOT", "r"])])
    slots, seen = defaultdict(list), []
    for r in shard_documents(docs, 8, bucket_bytes=4000).collect():
        slots[r.shard].append(r.slot)
        seen.append(r.bucket)
        assert r.hash == 2 and r.grown_shard in (r.shard, 8)
    assert sorted(seen) == list(range(900)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    digest = {r.doc_id: r for r in Q.op10_sharding(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        raw = (d.text or "").encode()
        assert (digest[d.doc_id]["size"], digest[d.doc_id].text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"Please contact a{i}@mail{i}.org today") for i in range(20)]
    rows += [(100 + i, f"Please contact agent{i}007 now") for i in range(1)]
    far = "x" * 300
    rows += [(200, f"contact {far} contact agent1234"), (300, "contact A123456 B234567 end"), (400, "seen in 1999 at 3"), (500, None)]
    got = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans == "email:15:24" and got[100].n_email == 0 and got[100].n_added == 1
    assert got[200].spans == "email:317:326"  # a word of 300 characters before the context does no harm
    assert got[300].spans == "email:8:15,email:16:23"  # a list has one context
    assert got[400].n_added == got[500].n_added == 0


def test_rounds_go_on_while_patterns_are_new(spark):
    # what a hop's word finds stands behind the next hop's word as well: the last is found after six rounds
    hops = ["hop" + x for x in "abcdefg"]
    rows = [(f"{hops[0]} a{i}@mail{i}.org and",) for i in range(24)]
    for h in range(6):
        for i in range(19 - h):
            rows += [(f"{hops[h]} user{h}x{i}00{h} then",), (f"{hops[h + 1]} user{h}x{i}00{h} then",)]
    rows += [("hopg last1001 then",), ("hopa b12 then",)]
    docs = spark.createDataFrame(rows, "text string").withColumn("doc_id", F.col("text"))
    few = {"sure": 0.5, "least_seeds": 1}
    got = {r.doc_id: r.n_added for r in personal_data(docs, **few).collect()}
    assert got["hopg last1001 then"] == 1 and got["hopa b12 then"] == 0
    assert {r.doc_id: r.n_added for r in personal_data(docs, least_length=3, **few).collect()}["hopa b12 then"] == 1


def test_very_many_matches_in_one_text(spark):
    text = " ".join(f"a{i}@b.org" for i in range(20000))
    row = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 20000 and row.spans.endswith(f"email:{text.rindex('a19999')}:{len(text)}")


def test_labellers_of_planted_accuracy():
    r = np.random.default_rng(4)
    good = r.random(20000) < 0.7
    keeps = {True: (0.95, 0.9, 0.85), False: (0.2, 0.3, 0.1)}
    votes = ["".join("1" if r.random() < p else "0" for p in keeps[bool(g)]) for g in good]
    posterior = fit_labellers(Counter(votes))
    right = np.mean([(posterior[v] > 0.5) == g for v, g in zip(votes, good, strict=True)])
    best = defaultdict(Counter)
    for v, g in zip(votes, good, strict=True):
        best[v][bool(g)] += 1
    assert right > sum(max(c.values()) for c in best.values()) / len(votes) - 0.02


def test_very_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "a few words of plain text")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id for r in drop_low_quality(docs).collect()} <= {1, 2, 3}
