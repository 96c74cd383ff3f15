"""Document quality from weak labels.

Overlapping heuristic labellers vote reject, keep or abstain. Expectation
maximisation over the counts of vote patterns (of all documents; at most 3 to the number of
labellers) estimates how each labeller votes on good and on bad documents, and so the probability
that a pattern's documents are good. Those posterior labels, as probabilities, train a linear scorer
over hashed words and shapes of characters; the scorer judges every document. No gold labels are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut
from railside.llm.words import SPACED, Words, hash_words, mix, small_batches, words_of

#: Rows of each posterior class in the scorer's training sample, at most, chosen by a hash of the id.
SAMPLE_ROWS = 2000
#: Hash buckets of each feature family.
BUCKETS = 1024

# Frequent function words of the languages that the labellers know.
FUNCTION_WORDS = "the of and to in is that for it with as was on be by at this are or from que de la el en y los se del las por un con una su para es al lo der die und den von zu das mit sich des auf ist im dem nicht ein eine le les et des du une dans qui par pour au sur pas plus".split()


def _distinct(words: Words, n: int) -> np.ndarray:
    order = np.lexsort((words.hashes, words.doc))
    h, d = words.hashes[order], words.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _raw(column: pa.Array, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of n texts and the document of each byte."""
    part = column.slice(first, n)
    _, offsets, data = part.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, part.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, np.repeat(np.arange(n), np.diff(at))


def _statistics(words: Words, lines: Words, raw: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
    """What labellers look at, by document."""
    n = words.last - words.first

    def share(kind: str, of: np.ndarray) -> np.ndarray:
        return np.bincount(doc[_CLASS[kind][raw]], minlength=n) / np.maximum(of, 1)

    size, count, rows = np.bincount(doc, minlength=n), np.diff(words.begins), np.diff(lines.begins)
    twice = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    common = np.isin(words.hashes, _COMMON)
    kept = Words(words.first, words.last, words.hashes[common], words.doc[common], words.begins)
    # a word byte that starts a word of marks alone: words less words with a letter or digit
    letters = _CLASS["letters"][raw]
    inside = SPACED[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    number = np.cumsum(starts) - 1
    lettered = np.zeros(int(starts.sum()), bool)
    lettered[number[letters & inside]] = True
    bare = np.bincount(doc[starts][~lettered], minlength=n) if len(raw) else np.zeros(n)
    return {
        "words": count,
        "lines": rows,
        "symbols": share("symbols", size),
        "marks": share("marks", size),
        "shouts": share("shouts", size),
        "capitals": share("capitals", size),
        "ends": share("ends", count),
        "bare": bare / np.maximum(count, 1),
        "variety": _distinct(words, n) / np.maximum(count, 1),
        "line variety": _distinct(lines, n) / np.maximum(rows, 1),
        "neighbours": np.bincount(words.doc[1:][twice], minlength=n) / np.maximum(count, 1),
        "function words": _distinct(kept, n),
    }


def _byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_CLASS = {
    "symbols": _byte_class("#$%&*|{}<>^~=\\_"),
    "marks": _byte_class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
    "shouts": _byte_class("!?"),
    "capitals": _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "ends": _byte_class("."),
}
_CLASS["letters"] = ~(_CLASS["marks"] | _byte_class("".join(map(chr, range(33)))))
_COMMON = np.unique(hash_words(FUNCTION_WORDS, SPACED))
_LINE = np.ones(256, bool)
_LINE[10] = False

#: Labeller -> statistic, bound beyond which it votes to reject, bound within which it votes to keep
#: (reject above if the first is larger), and the least words or lines that it needs.
LABELLERS = {
    "symbols": ("symbols", 0.05, 0.01, "words", 1),
    "bare marks": ("bare", 0.2, 0.05, "words", 8),
    "punctuation": ("marks", 0.1, 0.05, "words", 8),
    "shouting": ("shouts", 0.03, 0.005, "words", 8),
    "capitals": ("capitals", 0.4, 0.12, "words", 8),
    "neighbours": ("neighbours", 0.15, 0.02, "words", 12),
    "variety": ("variety", 0.2, 0.35, "words", 30),
    "lines": ("line variety", 0.5, 0.8, "lines", 4),
    "sentences": ("ends", 0.005, 0.02, "words", 60),
    "function words": ("function words", 0.5, 4, "words", 40),
}


def votes(statistics: dict[str, np.ndarray]) -> np.ndarray:
    """Documents by labellers: 0 reject, 1 keep, 2 abstain."""
    columns = []
    for name, bad, good, unit, least in LABELLERS.values():
        x = statistics[name]
        reject, keep = (x > bad, x < good) if bad > good else (x < bad, x > good)
        columns.append(np.where(statistics[unit] < least, 2, np.where(reject, 0, np.where(keep, 1, 2))))
    return np.stack(columns, 1)


def _patterns(v: np.ndarray) -> list[str]:
    return ["".join(map(str, row)) for row in v.tolist()]


def _documents(column: pa.Array) -> Iterator[tuple[int, int, Words, Words, np.ndarray, np.ndarray]]:
    column = column.fill_null("").cast(pa.large_string())
    for words, lines in zip(words_of(column, SPACED), words_of(column, _LINE), strict=True):
        yield words.first, words.last, words, lines, *_raw(column, words.first, words.last - words.first)


def _vote_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, lines, raw, doc in _documents(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(_patterns(votes(_statistics(words, lines, raw, doc))))], names=["id", "votes"])


def fit_labellers(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Vote pattern -> probability that its documents are good, by expectation maximisation.

    Votes are independent given the class. The start, which names the classes, is 0.1 for patterns with
    a vote to reject, 0.95 for those with votes to keep alone and 0.8 for those without votes.
    Pseudo-counts (one vote either way in the bad class, 0.1 to reject and 1.9 to keep in the good
    one) hold where a labeller hardly votes. Patterns without a vote get the prior.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    votes = np.array([[int(x) for x in p] for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    shown = np.stack([(votes == v) for v in (0, 1)], 2).astype(float)  # pattern, labeller, reject or keep
    voted = shown.sum((1, 2))
    # a labeller fires on one kind of badness and most bad documents have one: any reject counts much
    good = np.where(shown[:, :, 0].sum(1) > 0, 0.1, np.where(voted > 0, 0.95, 0.8))
    for _ in range(rounds):
        prior = (n @ good + 1) / (n.sum() + 2)
        weight = np.stack([n * (1 - good), n * good])
        table = np.einsum("cp,plv->clv", weight, shown) + np.array([[[1.0, 1.0]], [[0.1, 1.9]]])
        table /= table.sum(2, keepdims=True)
        log = np.einsum("plv,clv->cp", shown, np.log(table))
        log += np.log(np.array([1 - prior, prior]))[:, None]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return dict(zip(patterns, good.tolist(), strict=True))


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")
_SHAPE[128:] = ord("u")
_SHAPE[[*range(9, 14)]] = ord(" ")
FEATURES = 2 * BUCKETS + 64
_SHAPES = np.unique(_SHAPE)
_CODES = len(_SHAPES)
_CODE = np.zeros(256, np.int32)
_CODE[_SHAPES] = np.arange(_CODES)
_TRIGRAM = (mix(np.arange(_CODES**3, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def features(words: Words, raw: np.ndarray, doc: np.ndarray, statistics: dict[str, np.ndarray]) -> np.ndarray:
    """Square roots of hashed shares of shape trigrams and of words, and binned word statistics."""
    n = words.last - words.first
    out = np.zeros((n, FEATURES), np.float32)
    if len(raw) > 2:
        shape = _SHAPE[raw]
        code = _TRIGRAM[_CODE[shape[:-2]] * _CODES**2 + _CODE[shape[1:-1]] * _CODES + _CODE[shape[2:]]]
        same = doc[:-2] == doc[2:]
        flat = np.bincount(doc[:-2][same] * BUCKETS + code[same], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, :BUCKETS] = np.sqrt(flat / np.maximum(flat.sum(1, keepdims=True), 1))
    scale = np.minimum(np.log2(statistics["words"] + 1).astype(int), 15)
    for k, name in enumerate(("variety", "neighbours")):
        bins = np.minimum((statistics[name] * 8).astype(int), 7) + 16 * k
        out[np.arange(n), BUCKETS + bins] = 0.5
        out[:, BUCKETS + 8 + 16 * k] = statistics[name]
    out[np.arange(n), BUCKETS + 32 + scale] = 0.25
    out[:, BUCKETS + 63] = 1
    bucket = (words.hashes >> np.uint64(20)).astype(np.int64) % BUCKETS
    flat = np.bincount(words.doc * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, BUCKETS + 64 :] = np.sqrt(flat / np.maximum(flat.sum(1, keepdims=True), 1))
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on labels that are probabilities, with balanced classes, by Adam on the whole sample."""
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    share = max(1e-6, min(1 - 1e-6, float(y.mean()))) if len(y) else 0.5
    weight = (y / (2 * share) + (1 - y) / (2 * (1 - share))).astype(np.float32)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (weight * (p - y)) @ x / np.float32(max(1, len(y))) + np.float32(penalty) * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w.astype(np.float32)


def _feature_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, lines, raw, doc in _documents(batch.column(0)):
            x = features(words, raw, doc, _statistics(words, lines, raw, doc))
            own = [batch.column(i).slice(first, last - first) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["good", "h", "x"])


def _judged(column: pa.Array, weights: np.ndarray | None, posterior: dict[str, float]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, posterior, score) of the texts, some at a time."""
    for first, last, words, lines, raw, doc in _documents(column):
        statistics = _statistics(words, lines, raw, doc)
        label = np.array([posterior.get(p, 1.0) for p in _patterns(votes(statistics))])
        score = label
        if weights is not None:  # each row is summed by itself, so that reruns agree
            score = 1 / (1 + np.exp(-np.clip((features(words, raw, doc, statistics) * weights).sum(1, dtype=np.float64), -30, 30)))
        yield first, last, label, score


def _score_form(weights: np.ndarray | None, posterior: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, label, score in _judged(batch.column(1), weights, posterior):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(label), pa.array(score)], names=["id", "posterior", "score"])

    return run


def _fit(texts: DataFrame, sample_rows: int) -> tuple[np.ndarray | None, dict[str, float]]:
    """The scorer's weights (None if only one class has documents) and each vote pattern's posterior."""
    small_batches(texts.sparkSession)
    voted = cut(texts.select(F.xxhash64("text").alias("h"), "text").mapInArrow(_vote_form, "h long, votes string"))
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers
    posterior = fit_labellers(counts)
    picks = []
    for side in ({p for p, x in posterior.items() if x < 0.5}, {p for p, x in posterior.items() if x >= 0.5}):
        own = voted.where(F.col("votes").isin(sorted(side))).select("h", "votes").distinct()
        picks.append([(r["h"], posterior[r["votes"]]) for r in own.orderBy(F.xxhash64(F.lit(9), "h"), "h").limit(sample_rows).collect()])
    if not all(picks):
        return None, posterior
    rows = [pick for own in picks for pick in own]
    chosen = texts.sparkSession.createDataFrame(rows, "h long, good double")
    sample = texts.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    table = sample.select("text", "good", "h").mapInArrow(_feature_form, "good double, h long, x binary").toArrow()
    order = np.argsort(table["h"].to_numpy())
    x = np.stack([np.frombuffer(b, np.float16) for b in table["x"].to_pylist()])[order]
    return train(x.astype(np.float32), table["good"].to_numpy()[order].astype(np.float32)), posterior


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row per document row: id, posterior, score, kept (score of at least ``threshold``).

    ``posterior`` is the label model's probability that the document is good, ``score`` the linear
    scorer's. Vote statistics cover all documents; the scorer is fitted on at most ``sample_rows``
    different texts of each posterior class, chosen by a hash. If only one class has documents, its
    members' posterior stands for the score: nothing distinguishes them. Null counts as empty; texts
    of few words get no votes and are scored all the same; repeated rows score alike; an empty table
    gives no rows; ids may be of any type that Arrow has; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    weights, posterior = _fit(texts, sample_rows)
    kind = texts.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(_score_form(weights, posterior), f"id {kind}, posterior double, score double")
    return scored.select(F.col("id").alias(id_col), "posterior", "score", (F.col("score") >= threshold).alias("kept"))


def drop_low_quality(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps; all their columns. Each row is judged by its own text."""
    weights, posterior = _fit(docs.select(F.col(text_col).cast("string").alias("text")), sample_rows)
    text = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [score >= threshold for _, _, _, score in _judged(batch.column(text).cast(pa.string()), weights, posterior)]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
