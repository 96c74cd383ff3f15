"""Near duplicates by fast similarity sketches, banding and exact verification.

A set's sketch has T coordinates. In round i each element is hashed to a bin and a value; a bin keeps
the smallest value of the first round that reaches it. Rounds T to 2T-1 send all elements to one bin
each, so that every coordinate is filled; a set of n elements needs about (T log T) / n rounds. Two
sketches agree in each coordinate with probability near the sets' Jaccard similarity, with
concentration as strong as for independent draws.

BANDS bands of ROWS coordinates give keys. A pair at the lowest similarity that counts shares no key
with probability (1 - t**5)**25: under 5e-7 at t = 0.85, under 5e-5 at t = 0.8.

Documents with the same shingle set are one class: classes, not documents or ids, are linked. In each
bucket the classes meet a hub: the most central one, whose keys lie in the fullest buckets. A hub has
then met its whole bucket and leaves it; buckets of up to HUB_ROUNDS + 1 classes are settled by that
many hubs in turn. What a larger bucket still holds in more than one component goes through an exact
prefix filter: in the order of rarity, the first shingle that two sets share lies early in both, and
where it lies bounds what they can share after it. Only classes outside their bucket's main component
look for partners there. So no bucket is expanded into its pairs, and every pair of one bucket is
decided. Links are confirmed on full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing, small_side
from railside.llm.graph import components
from railside.llm.words import SPACED, Words, grams, mix, small_batches, words_of

BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
#: Hubs in turn that settle a small bucket; larger ones have one hub before the prefix filter.
HUB_ROUNDS = 3
#: Ratio of the bounds of one class of set sizes in the prefix filter.
SIZE_STEP = 1.04


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and their documents.

    A document with fewer than k words, but not none, has its whole sequence as one shingle.
    """
    runs = grams(words.hashes, k)
    whole = words.doc[: len(runs)] == words.doc[k - 1 : k - 1 + len(runs)]
    runs, doc = runs[whole], words.doc[: len(whole)][whole]
    sizes = np.diff(words.begins)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        alone = [grams(words.hashes[words.begins[d] : words.begins[d + 1]], int(sizes[d]))[0] for d in short]
        runs, doc = np.concatenate([runs, np.array(alone, np.uint64)]), np.concatenate([doc, short])
    order = np.lexsort((runs, doc))
    runs, doc = runs[order], doc[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (doc[1:] != doc[:-1])
    return runs[new], doc[new]


def sketches(elements: np.ndarray, doc: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """n rows of t coordinates (0 for empty sets) by rounds of hashed bin placement."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, top, np.uint64)
    open_ = np.bincount(doc, minlength=n) > 0
    for i in range(2 * t):
        mine = open_[doc]
        if not mine.any():
            break
        own, at = elements[mine], doc[mine]
        value = mix(own + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(1)
        spot = at * t + ((value % np.uint64(t)).astype(np.int64) if i < t else i - t)
        free = out[spot] == top
        spot, value = spot[free], value[free]
        now = np.full(n * t, top, np.uint64) if i == 0 else None
        if now is not None:
            np.minimum.at(now, spot, value)
            out = now
        elif len(spot):
            order = np.lexsort((value, spot))
            spot, value = spot[order], value[order]
            first = np.ones(len(spot), bool)
            first[1:] = spot[1:] != spot[:-1]
            out[spot[first]] = value[first]
        open_ &= (out.reshape(n, t) == top).any(1)
    out = out.reshape(n, t)
    out[(out == top).all(1)] = 0
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(len(sketch), BANDS, ROWS)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketch), 1))
    for r in range(ROWS):
        keys = mix(keys + rows[:, :, r])
    return keys.view(np.int64)


def _signature(elements: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Of each set: sums of two independent mixes over its elements."""
    out = []
    for salt in (1, 2):
        total = np.zeros(len(elements) + 1, np.uint64)
        np.cumsum(mix(elements ^ np.uint64(salt * 0x5851F42D4C957F2D % (1 << 64))), out=total[1:])
        out.append(pa.array((total[ends[1:]] - total[ends[:-1]]).view(np.int64)))
    return out


def _sketch_form(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(2), SPACED):
                n = words.last - words.first
                elements, doc = shingle_sets(words, k)
                count = np.bincount(doc, minlength=n).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(count)])
                keys = band_keys(sketches(elements, doc, n)).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys))
                own = [batch.column(i).slice(words.first, n) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(count), *_signature(elements, ends), lists], names=["id", "t", "n_shingles", "s1", "s2", "keys"])

    return run


def _set_form(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(0), SPACED):
                n = words.last - words.first
                elements, doc = shingle_sets(words, k)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(elements.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends).astype(np.int64)), *_signature(elements, ends), sets], names=["n_shingles", "s1", "s2", "elements"])

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b -> those whose full sets reach the similarity."""
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), sets.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """key, node, central, component -> the members of buckets with several components but their hubs, with these."""
    hubs = members.groupBy("key").agg(F.max_by(F.struct("node", "component"), F.struct("central", "node")).alias("hub"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("left")).where("lo <> hi")
    return cut(members.join(hubs.select("key", "hub", "left"), "key").where("node <> hub.node"))


def _star_pairs(stars: DataFrame) -> DataFrame:
    return stars.where("component <> hub.component").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def _labelled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """With each node's component; a node without links is its own."""
    return members.join(parts, "node", "left").withColumn("component", missing(F.col("component"), F.col("node")))


def _needed(n: Column, m: Column, percent: int) -> Column:
    """How many elements sets of n and m elements share at least if they are linked."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent)).cast("int")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """key, node, component -> a, b: pairs of different components that may still be linked.

    Every linked pair of a bucket is among them. A set's shingles are ordered by how many sets hold
    them. Rows are a set's first shingles for each class of partners' sizes, as many as can be the
    first one that is shared; what two sets share from there on must reach what a link needs.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", "main")
    own = cut(members.join(main, "key").groupBy("node").agg(F.min("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("out")))
    shown = sets.join(own.select("node"), "node").select("node", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    often = shown.groupBy("e").agg(F.count("*").alias("often"))
    ranked = shown.join(often, "e").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "e"))).alias("es"))

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")

    n = F.col("n")
    least = F.ceil(n * percent / 100)
    fits = ranked.withColumn("own", size_class(n)).withColumn("partner", F.explode(F.sequence(size_class(least) - 1, size_class(F.floor(n * 100 / percent)) + 1)))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("partner")) - 1e-6))
    length = F.least(n - _needed(n, smallest, percent) + 1, n)
    fits = fits.withColumn("length", length.cast("int")).where("length > 0")
    prefix = fits.select("node", "n", "own", "partner", F.posexplode(F.slice("es", F.lit(1), F.col("length"))).alias("at", "p")).where("p.often > 1").select("node", "n", "own", "partner", "at", F.col("p.e").alias("e"))
    prefix = cut(prefix.join(own, "node"))
    # of each shingle's holders, pairs of different components only, one of them outside the main one
    ends = [F.least("own", "partner").alias("small"), F.greatest("own", "partner").alias("large")]
    told = prefix.select("*", *ends)
    spread = told.groupBy("e", "small", "large").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("out").alias("some")).where("lo <> hi and some").select("e", "small", "large")
    told = told.join(spread, ["e", "small", "large"]).drop("small", "large")
    a, b = told.where("out").alias("a"), told.alias("b")
    fits = (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    fits &= F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= _needed(F.col("a.n"), F.col("b.n"), percent)
    both = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.own") == F.col("b.partner")) & (F.col("a.partner") == F.col("b.own")) & fits)
    return both.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _linked(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """id, text, t -> rows (id, t, n_shingles, s1, s2) and, of classes with a copy or a link, the first row of their component.

    The first row is that with the smallest id (null ids last), then the smallest hash of its text.
    """
    small_batches(texts.sparkSession)
    sketched = cut(texts.select("id", "t", "text").mapInArrow(_sketch_form(words), "id long, t long, n_shingles long, s1 long, s2 long, keys array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    grouped = sketched.where("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
    # numbers are drawn once: the checkpoint keeps them
    classes = cut(grouped.withColumn("node", F.monotonically_increasing_id()))

    # buckets with two classes or more
    banded = classes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("held"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key", "held")
    members = cut(banded.join(shared, "key"))
    central = cut(members.groupBy("node").agg(F.sum("held").alias("central")))
    # the text of one row of each such class
    wanted = small_side(cut(classes.join(central.select("node"), "node").select("node", "s1", "s2", "n_shingles", F.col("first.id").alias("_id"), F.col("first.t").alias("_t"))))
    own = texts.join(wanted.select("_id", "_t"), (F.col("t") == F.col("_t")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    sets = own.select("text").mapInArrow(_set_form(words), "n_shingles long, s1 long, s2 long, elements array<long>")
    sets = cut(sets.join(wanted.select("node", "s1", "s2", "n_shingles"), ["s1", "s2", "n_shingles"]).select("node", "elements").dropDuplicates(["node"]))

    stars = _stars(members.join(central, "node").withColumn("component", F.col("node")))
    tried = cut(_star_pairs(stars).distinct())
    links = cut(_confirm(tried, sets, percent))
    parts = components(links)
    # a hub that has met its bucket has left it
    small = cut(_labelled(stars.where(F.col("left").between(3, HUB_ROUNDS + 1)).select("key", "node", "central"), parts))
    large = cut(_labelled(stars.where(F.col("left") > HUB_ROUNDS + 1).select("key", "node"), parts))
    pairs = _prefix_pairs(large, sets, percent)
    for _ in range(1, HUB_ROUNDS):
        stars = _stars(small)
        pairs = pairs.union(_star_pairs(stars))
        small = stars.where("left > 2").select(*small.columns)
    found = cut(_confirm(cut(pairs.distinct().join(tried, ["a", "b"], "left_anti")), sets, percent))
    if found.limit(1).count():
        parts = components(links.union(found))

    known = _labelled(classes.where("copies > 1").select("node").union(parts.select("node")).distinct(), parts)
    known = known.join(classes.select("node", "s1", "s2", "n_shingles", "first"), "node")
    heads = known.groupBy("component").agg(F.min("first").alias("head"))
    return sketched.drop("keys"), small_side(cut(known.join(heads, "component").select("s1", "s2", "n_shingles", "head")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("t"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_shingles, component_id, kept.

    Sets are distinct shingles of ``words`` words (A-Z lowered, words split at ASCII white space); a
    document with fewer words has one shingle. Documents whose sets' Jaccard similarity is at least
    ``percent`` / 100 are linked; a component is named by its smallest id, which is kept. Empty and
    null texts have no shingles and are linked with nothing. Ids are whole numbers; they only name
    documents: rows that repeat an id with other texts are linked by their texts. A row without id is
    linked too, and is kept only if its component has no id at all, which is then null. An empty
    table gives no rows; other columns are ignored.
    """
    rows, heads = _linked(_texts(docs, id_col, text_col), words, percent)
    out = rows.join(heads, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns, and every row without shingles.

    The row with the smallest id stays (null ids last; of equal ids that with the smallest hash of its
    text; of rows that repeat both, any one).
    """
    rows, heads = _linked(_texts(docs, id_col, text_col), words, percent)
    told = rows.join(heads, ["s1", "s2", "n_shingles"])
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("t") == F.col("head.t"))
    gone = small_side(cut(told.where(~is_head).select(F.col("id").alias("_gone"), F.col("t").alias("_text")).distinct()))
    text = F.xxhash64(F.col(text_col).cast("string"))
    left = docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (text == gone["_text"]), "left_anti")
    # heads that stand more than once: rows that repeat id and text
    again = cut(told.where(is_head).groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_again"), F.col("t").alias("_text")))
    if not again.limit(1).count():
        return left
    again = small_side(again)
    repeats = left[id_col].cast("long").eqNullSafe(again["_again"]) & (text == again["_text"])
    once = left.join(again, repeats, "left_semi").withColumn("_text_hash", text).dropDuplicates([id_col, "_text_hash"]).drop("_text_hash")
    return left.join(again, repeats, "left_anti").unionByName(once)
