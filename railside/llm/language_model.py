"""A gated recurrent language model, trained and applied in numpy on Spark's partitions.

Word counts of all training documents give the vocabulary and the base. The most frequent words
fill the classes of a class-factored softmax: log p(word) = log p(class | state) + log p(word |
class, state). All other words, unknown ones included, are one more class, within which the
probability follows the counts. The output biases start at the counts, so that training starts from
the unigram model. Every training document is used once: its key's hash deals it to one round. In
lanes, documents follow each other without gaps and are cut into windows: gradients are truncated
at a window's start and the state is carried over it, but not from one document into the next. A
document above PIECE words teaches in pieces of that many, so that no lane is left alone with it.
Each partition trains a copy; copies are averaged by the words they saw, after each round. Scoring
carries the state through each whole document, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railside.llm.cluster import cut, missing
from railside.llm.words import SPACED, small_batches, words_of

CLASSES, CLASS_SIZE, HIDDEN = 32, 48, 16
#: Frequent words whose counts every task holds (16 bytes each), at most; all others are joined by shuffle.
HEAD = 1 << 18
#: Rounds of training: each document teaches in one of them.
ROUNDS = 2
#: Words that a round has for each copy, at least, where the corpus has them.
COPY_WORDS = 200_000
#: Words of a window: gradients go back no further.
WINDOW = 16
#: Documents that a partition trains on at once.
LANES = 256
#: Windows that are taken from the lanes at once.
AHEAD = 8
#: Words of a document that teach in one go; the state starts anew after them.
PIECE = 1024
#: Words whose likelihoods are worked out at once.
SCORED = 8192
#: Texts above so many bytes wait for each other, up to so many bytes together, so that they are scored side by side.
LONG_BYTES, WAITING_BYTES = 8192, 16 << 20
#: The token at the end of each document: no word hashes to it but by chance of 2**-64.
END = np.uint64(0)

_TAIL = CLASSES * CLASS_SIZE  # input and target number of every word outside the classes


def tokens_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, token hashes, begins): each document's words and its end token."""
    for words in words_of(column, SPACED):
        n = words.last - words.first
        out = np.full(len(words.hashes) + n, END, np.uint64)
        out[np.arange(len(words.hashes)) + words.doc] = words.hashes
        yield words.first, words.last, out, words.begins + np.arange(n + 1)


def _count_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0

    def emit() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["token", "n"])

    for batch in batches:
        for _, _, tokens, _ in tokens_of(batch.column(0)):
            waiting.append(tokens)
            size += len(tokens)
            if size >= 1 << 22:
                yield emit()
                waiting, size = [], 0
    if size:
        yield emit()


def _placed(tokens: np.ndarray) -> np.ndarray:
    """A table by the tokens' last bits, at most a quarter full: a token's number stands at its place or the next free one."""
    slots = np.full(1 << max(4, (4 * len(tokens)).bit_length()), -1, np.int32)
    number, slot = np.arange(len(tokens), dtype=np.int32), (tokens & np.uint64(len(slots) - 1)).astype(np.int64)
    while len(number):
        free = slots[slot] < 0
        slots[slot[free]] = number[free]  # the last of several takes it
        left = slots[slot] != number
        number, slot = number[left], (slot[left] + 1) % len(slots)
    return slots


class Vocabulary:
    """Counts of the head, and what the model and the base need of the whole."""

    def __init__(self, head: list[tuple[int, int]], total: int, distinct: int):
        tokens = np.array([t for t, _ in head], np.int64).view(np.uint64)
        counts = np.array([n for _, n in head], np.int64)
        self.total, self.distinct = total, distinct
        # the end token has a place in the classes even if no document taught it
        modelled = min(len(head), _TAIL)
        number = np.full(len(head), _TAIL, np.int32)
        number[:modelled] = np.arange(modelled)
        self.tokens, self.counts, self.number = tokens, counts, number
        self.slots = _placed(tokens)
        self.modelled = counts[:modelled]
        # 0.5 for each token of the vocabulary and for one unknown, as in the base
        self.tail_mass = float(total - self.modelled.sum()) + 0.5 * (distinct - modelled + 1)

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether in the head, count (0 if not), number in the model (_TAIL if none)."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64), np.full(len(tokens), _TAIL, np.int32)
        at = np.zeros(len(tokens), np.int32)
        open_, slot = np.arange(len(tokens)), (tokens & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(open_):
            at[open_] = found = self.slots[slot]
            going = (found >= 0) & (self.tokens[found] != tokens[open_])
            open_, slot = open_[going], (slot[going] + 1) % len(self.slots)
        held = at >= 0
        return held, np.where(held, self.counts[at], 0), np.where(held, self.number[at], _TAIL).astype(np.int32)


class Model:
    """Weights: input words' vectors and their gate inputs, recurrent gates, class and word outputs."""

    SHAPES = {"x": (_TAIL + 2, HIDDEN), "i": (HIDDEN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, CLASSES + 1), "cb": (CLASSES + 1,), "w": (CLASSES, HIDDEN, CLASS_SIZE), "wb": (CLASSES, CLASS_SIZE)}

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def views(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The weights that lie in one vector, by name; they share its memory."""
        out, at = {}, 0
        for k, shape in cls.SHAPES.items():
            n = int(np.prod(shape))
            out[k] = flat[at : at + n].reshape(shape)
            at += n
        return out

    @classmethod
    def started(cls, vocabulary: Vocabulary, seed: int = 5) -> np.ndarray:
        """The vector of weights before training: small random ones, and biases from the counts."""
        r = np.random.default_rng(seed)
        flat = (r.standard_normal(cls.size()) * 0.1).astype(np.float32)
        p = cls.views(flat)
        counts = np.zeros(_TAIL)
        counts[: len(vocabulary.modelled)] = vocabulary.modelled + 0.5
        by_class = counts.reshape(CLASSES, CLASS_SIZE)
        gone = -30.0  # places without a word
        shares = by_class / np.maximum(by_class.sum(1, keepdims=True), 1e-9)
        p["wb"][:] = np.where(shares > 0, np.log(np.maximum(shares, 1e-12)), gone)
        mass = np.append(by_class.sum(1), vocabulary.tail_mass)
        p["cb"][:] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)) - log(max(mass.sum(), 1e-9)), gone)
        p["x"] *= 5
        p["i"] *= 2
        p["c"] *= 0.1
        p["w"] *= 0.1
        return flat

    def bound(self) -> None:
        """Keep output weights so small that, with a state within 1, exponentials neither overflow nor all vanish."""
        for k, most in (("c", 2), ("w", 2), ("cb", 30), ("wb", 30)):
            np.clip(self.p[k], -most, most, out=self.p[k])

    def entry(self) -> np.ndarray:
        """What each input word adds to the gates."""
        return self.p["x"] @ self.p["i"]

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One word for each lane, given what it adds to the gates: gates and the new state."""
        b = h @ self.p["u"]
        gates = a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN]
        np.exp(np.negative(gates, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = 2 / (1 + np.exp(-2 * (a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :]))) - 1  # tanh
        return n + z * (h - n), z, r, n, b[:, 2 * HIDDEN :]

    def log_likelihood(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log p of each target after the states h; of the tail class for words beyond."""
        order, ends = _by_class(target // CLASS_SIZE)
        h, target = np.take(h, order, axis=0), target[order]
        logits = h @ self.p["c"]
        logits += self.p["cb"]
        sorted_ = logits[np.arange(len(target)), target // CLASS_SIZE] - np.log(_sums(np.exp(logits, out=logits.copy())))
        for k in np.flatnonzero(np.diff(ends[: CLASSES + 1])):
            first, last = ends[k], ends[k + 1]
            inner = h[first:last] @ self.p["w"][k]
            inner += self.p["wb"][k]
            sorted_[first:last] += inner[np.arange(last - first), target[first:last] % CLASS_SIZE]
            sorted_[first:last] -= np.log(_sums(np.exp(inner, out=inner)))
        out = np.empty_like(sorted_)
        out[order] = sorted_
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray, h: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        """Add those of the summed loss over a window (time, lane) from the state h to g; the state after it.

        Where the input is the start, a document begins, with the state of zeros.
        """
        steps, states = [], []
        going = (inputs != _TAIL + 1)[:, :, None]
        whole = live.all(1)
        word = inputs.ravel()
        vectors = self.p["x"][word]
        a = (vectors @ self.p["i"]).reshape(*inputs.shape, 3 * HIDDEN)
        for t in range(len(inputs)):
            h = h * going[t]
            new, *gates = self.step(a[t], h)
            steps.append((h, *gates))
            h = new if whole[t] else np.where(live[t][:, None], new, h)
            states.append(h)
        # live targets by class, the others after them: each class is one slice
        target, on = targets.ravel(), live.ravel()
        order, ends = _by_class(np.where(on, target // CLASS_SIZE, CLASSES + 1))
        alive = ends[CLASSES + 1]
        held, target = np.take(np.concatenate(states), order[:alive], axis=0), target[order[:alive]]
        d = held @ self.p["c"]
        d += self.p["cb"]
        np.exp(d, out=d)
        d /= _sums(d)[:, None]
        d[np.arange(alive), target // CLASS_SIZE] -= 1
        g["c"] += held.T @ d
        g["cb"] += _columns(d)
        down = np.zeros((len(order), HIDDEN), held.dtype)
        down[:alive] = d @ self.p["c"].T
        for k in np.flatnonzero(np.diff(ends[: CLASSES + 1])):
            first, last = ends[k], ends[k + 1]
            e = held[first:last] @ self.p["w"][k]
            e += self.p["wb"][k]
            np.exp(e, out=e)
            e /= _sums(e)[:, None]
            e[np.arange(last - first), target[first:last] % CLASS_SIZE] -= 1
            g["w"][k] += held[first:last].T @ e
            g["wb"][k] += _columns(e)
            down[first:last] += e @ self.p["w"][k].T
        back_to = np.empty_like(order)
        back_to[order] = np.arange(len(order))
        dh_out = np.take(down, back_to, axis=0)
        dh_out = dh_out.reshape(len(inputs), -1, HIDDEN)
        dh = np.zeros_like(h)
        into = np.empty_like(a)
        back = np.empty_like(a)
        z_, r_, n_ = (slice(i * HIDDEN, (i + 1) * HIDDEN) for i in range(3))
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, n, b = steps[t]
            mask = live[t][:, None]
            d = dh + dh_out[t]
            if not whole[t]:
                d *= mask
            dn = d * (1 - z)
            dn *= 1 - n * n
            into[t, :, z_] = d * (before - n) * z * (1 - z)
            into[t, :, r_] = dn * b * r * (1 - r)
            into[t, :, n_] = dn
            back[t, :, : 2 * HIDDEN] = into[t, :, : 2 * HIDDEN]
            back[t, :, n_] = dn * r
            down = d * z
            down += back[t] @ self.p["u"].T
            dh = (down if whole[t] else np.where(mask, down, dh + dh_out[t])) * going[t]
        # sums over the whole window at once: of gates' weights, and of each input word's vector
        g["u"] += np.concatenate([s[0] for s in steps]).T @ back.reshape(-1, 3 * HIDDEN)
        into = into.reshape(-1, 3 * HIDDEN)
        g["i"] += vectors.T @ into
        place = (word[:, None] * HIDDEN + np.arange(HIDDEN)).ravel()
        g["x"] += np.bincount(place, (into @ self.p["i"].T).ravel(), g["x"].size).reshape(g["x"].shape)
        return h


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by class, and where classes begin in it."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES + 2))])


#: Longest product of a sum: a window's words.
_ONES = np.ones(1 << 16, np.float32)


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ _ONES[: rows.shape[1]]


def _columns(rows: np.ndarray) -> np.ndarray:
    return _ONES[: len(rows)] @ rows


def _lessons(vocabulary: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, live), each (time, lane): all documents, their pieces in order and whole in one lane.

    A piece goes to the lane that has least to do, so at most one waits in each. It begins with the
    start as its input, as a document does.
    """
    lanes: list[list[np.ndarray]] = [[] for _ in range(LANES)]
    waiting = np.zeros(LANES, np.int64)
    size = AHEAD * WINDOW

    def taken() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pairs, live = np.zeros((2, size, LANES), np.int32), np.arange(size)[:, None] < waiting
        for i, lane in enumerate(lanes):
            at = 0
            while lane and at < size:
                part = lane[0][:, : size - at]
                pairs[:, at : at + part.shape[1], i] = part
                at += part.shape[1]
                if part.shape[1] < lane[0].shape[1]:
                    lane[0] = lane[0][:, part.shape[1] :]
                else:
                    lane.pop(0)
            waiting[i] -= at
        return pairs[0], pairs[1], live

    for batch in batches:
        for _, _, tokens, begins in tokens_of(batch.column(0)):
            number = vocabulary.find(tokens)[2]
            before = np.concatenate([[_TAIL + 1], number[:-1]]).astype(np.int32)
            cuts = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(begins[:-1], begins[1:], strict=True)])
            before[cuts] = _TAIL + 1
            for pair in np.split(np.stack([before, number]), cuts[1:], axis=1):
                i = int(waiting.argmin())
                lanes[i].append(pair)
                waiting[i] += pair.shape[1]
                while waiting.min() >= size:
                    yield taken()
    while waiting.any():
        yield taken()


def _train_form(vocabulary: Vocabulary, start: np.ndarray, rate: float = 0.008):
    """Documents of one partition -> (weights, words seen) of a copy trained on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = start.astype(np.float32)
        model = Model(Model.views(flat))
        m, v, total = (np.zeros_like(flat) for _ in range(3))
        sums = Model.views(total)
        seen, turn, words = 0, 0, 0
        h = np.zeros((LANES, HIDDEN), np.float32)

        def learn() -> None:
            nonlocal turn, words, flat
            turn += 1
            scale = 1 / words
            scale *= min(1.0, 1.0 / (1e-9 + scale * float(np.sqrt(total @ total))))
            # fewer words than a full turn's move the weights by less
            pace = rate * min(1.0, 2 * words / (WINDOW * LANES)) / (1 + turn / 2000)
            total[...] *= np.float32(scale)
            m[...] += np.float32(0.1) * (total - m)
            v[...] += np.float32(0.01) * (total * total - v)
            change = np.sqrt(v)
            change *= np.float32(1 / np.sqrt(1 - 0.99**turn))
            change += np.float32(1e-6)
            np.divide(m, change, out=change)
            change *= np.float32(pace / (1 - 0.9**turn))
            flat -= change
            model.bound()
            total[...] = 0
            words = 0

        for inputs, targets, live in _lessons(vocabulary, batches):
            for t in range(0, len(inputs), WINDOW):
                on = live[t : t + WINDOW]
                lanes = np.flatnonzero(on[0])
                if not len(lanes):
                    break
                on = on[:, lanes]
                h[lanes] = model.gradients(inputs[t : t + WINDOW, lanes], targets[t : t + WINDOW, lanes], on, h[lanes], sums)
                n = int(on.sum())
                words += n
                seen += n
                # when few lanes are left, several windows make one turn
                if 2 * words >= WINDOW * LANES:
                    learn()
        if words:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([flat.astype(np.float64).tolist()], pa.list_(pa.float64())), pa.array([seen], pa.int64())], names=["weights", "seen"])

    return run


def _score_form(vocabulary: Vocabulary, flat: np.ndarray):
    log_tail = log(max(vocabulary.tail_mass, 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(Model.views(flat))
        entry = model.entry()
        waiting, size = [], 0
        for batch in batches:
            length = pc.binary_length(batch.column(2))
            long = pc.greater(length, LONG_BYTES)
            yield from _scored(batch.filter(pc.invert(long)), model, entry)
            if pc.any(long).as_py():
                waiting.append(batch.filter(long))
                size += pc.sum(length.filter(long)).as_py()
            if size >= WAITING_BYTES:
                yield from _scored(pa.concat_batches(waiting), model, entry)
                waiting, size = [], 0
        if waiting:
            yield from _scored(pa.concat_batches(waiting), model, entry)

    def _scored(batch: pa.RecordBatch, model: Model, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        sizes, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        numbers: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        strange: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for first, last, tokens, begins in tokens_of(batch.column(2)):
            held, counts, number = vocabulary.find(tokens)
            doc = np.repeat(np.arange(last - first), np.diff(begins))
            own = slice(first, last)
            sizes[own] = np.diff(begins)
            known[own] = np.bincount(doc[held], minlength=last - first)
            logs = np.log10(counts[held] + 0.5)
            base[own] = np.bincount(doc[held], logs, last - first)
            # the model knows words of the head that have no class by their share of the tail
            loose = held & (number == _TAIL)
            score[own] = np.bincount(doc[loose], np.log10(counts[loose] + 0.5), last - first)
            score[own] -= np.bincount(doc[number == _TAIL], minlength=last - first) * (log_tail / log(10))
            rest = tokens[~held].view(np.int64)
            cuts = np.cumsum(np.bincount(doc[~held], minlength=last - first))[:-1]
            for i, (a, b) in enumerate(zip(np.split(number, begins[1:-1]), np.split(rest, cuts), strict=True)):
                numbers[first + i], strange[first + i] = a, b
        # in lockstep, longest first: a lane ends with its document
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        flat_numbers = np.concatenate([numbers[i] for i in order]) if n else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        h = np.zeros((n, HIDDEN), np.float32)
        last_word = np.full(n, _TAIL + 1)
        t, total = 0, np.zeros(n)
        while n and t < lengths[0]:
            states, targets, lanes, held = [], [], [], 0
            while held < SCORED:
                live = int(np.searchsorted(-lengths, -t, "left"))
                if not live:
                    break
                h[:live] = model.step(entry[last_word[:live]], h[:live])[0]
                target = flat_numbers[at[:live] + t]
                states.append(h[:live].copy())
                targets.append(target)
                lanes.append(np.arange(live))
                last_word[:live] = target
                held += live
                t += 1
            lane = np.concatenate(lanes)
            total += np.bincount(lane, model.log_likelihood(np.concatenate(states), np.concatenate(targets).astype(np.int64)), n)
        back = np.empty(n)
        back[order] = total / log(10)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in strange])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(strange) if n else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score + back), lists],
            names=["row", "id", "n_tokens", "head_known", "head_base", "head_score", "strange"],
        )

    return run


def fit(texts: DataFrame, counts: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and trained weights, from training texts (key, text) and all their counts (token, n).

    What reaches the driver has a fixed size: the head's counts and one set of weights.
    """
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    # the head is cut at a step of a histogram of counts (a few thousand rows), so no task sorts the vocabulary
    level = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("tokens")).collect()
    least, room = 1 << 30, head
    for step in sorted(steps, key=lambda s: -s["level"]):
        room -= step["tokens"]
        if room < 0:
            break
        least = step["level"]
    top = counts.where(level >= least).toArrow()
    ordered = sorted(zip(top["token"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(ordered, sums["total"] or 0, sums["distinct"])
    flat = Model.started(vocabulary)
    for turn in range(rounds):
        chosen = texts.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == turn)
        # a copy that sees few words learns little: small corpora are taught in fewer tasks
        chosen = chosen.coalesce(max(1, vocabulary.total // rounds // COPY_WORDS))
        copies = chosen.select("text").mapInArrow(_train_form(vocabulary, flat), "weights array<double>, seen long")
        mean = copies.select("seen", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w"))
        table = mean.toArrow()
        if table.num_rows:
            flat = table["w"].to_numpy()[np.argsort(table["i"].to_numpy())].astype(np.float32)
    return vocabulary, flat


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, **options) -> DataFrame:
    """One row per document row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id as text leaves ``held_fold`` modulo ``folds`` are held out; all
    others teach. A null id counts as the empty text for that. Null text is empty: its one token is
    the end. Scores are log10 probabilities of whole texts: ``base_score`` of the smoothed unigram,
    ``score`` of the recurrent model. Repeated rows teach and are scored each. Without training
    documents every word is unknown. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), missing(F.col(text_col).cast("string"), "").alias("text"), F.monotonically_increasing_id().alias("row"))
    kind = rows.schema["id"].dataType.simpleString()
    fold = F.crc32(missing(F.col("id").cast("string"), "")) % folds
    rows = rows.withColumn("held_out", fold == held_fold)
    taught = rows.where(~F.col("held_out"))
    counts = taught.select("text").mapInArrow(_count_form, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    vocabulary, flat = fit(taught.select(F.coalesce(F.col("id").cast("string"), F.col("row").cast("string")).alias("key"), "text"), counts, **options)
    scored = rows.select("row", "id", "text").mapInArrow(_score_form(vocabulary, flat), f"row long, id {kind}, n_tokens long, head_known long, head_base double, head_score double, strange array<long>")
    scored = cut(scored)
    # words outside the head: their counts come by a join, summed before it by document and word
    strange = scored.select("row", F.explode("strange").alias("token")).groupBy("row", "token").agg(F.count("*").alias("k"))
    found = strange.join(counts, "token", "left").select("row", "k", missing(F.col("n"), 0).alias("n"))
    rest = found.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"))
    out = scored.drop("strange").join(rest, "row", "left")
    mass = vocabulary.total + 0.5 * (vocabulary.distinct + 1)
    logs = missing(F.col("logs"), 0.0)
    return out.select(
        F.col("id").alias(id_col),
        (F.crc32(missing(F.col("id").cast("string"), "")) % folds == held_fold).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + missing(F.col("more"), 0)).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + logs - F.col("n_tokens") * log10(mass)).alias("base_score"),
        (F.col("head_score") + logs).alias("score"),
    )
