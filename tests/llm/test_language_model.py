"""The language model's lessons: what reaches the gated network."""

import re
import uuid
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from railside.llm import language_model as L

TEXTS = [" ".join(f"w{(i * k) % 40}" for k in range(i % 90)) + f" own{i}" for i in range(500)]


def _vocabulary() -> L.Vocabulary:
    tokens = np.concatenate([t for _, _, t, _ in L.tokens_of(pa.array(TEXTS))]).view(np.int64)
    head = Counter(tokens.tolist()).most_common()
    return L.Vocabulary(head, len(tokens), len(head))


def test_every_training_document_teaches_once(spark, monkeypatch, tmp_path):
    form = L._train_form

    def recorded(vocabulary, flat):
        learn = form(vocabulary, flat)

        def run(batches):
            def noted():
                for batch in batches:
                    (tmp_path / uuid.uuid4().hex).write_text("\n".join(batch.column(0).to_pylist()))
                    yield batch

            yield from learn(noted())

        return run

    monkeypatch.setattr(L, "_train_form", recorded)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = L.language_model_scores(docs).collect()
    taught = Counter(t for f in tmp_path.iterdir() for t in f.read_text().split("\n"))
    assert taught == Counter(TEXTS[r.doc_id] for r in rows if not r.held_out)


def test_lessons_hold_every_word_after_its_predecessor():
    vocabulary = _vocabulary()
    got, streams = Counter(), None
    for inputs, targets, live in L._lessons(vocabulary, [pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["text"])]):
        assert len(inputs) % L.WINDOW == 0
        streams = streams or [[] for _ in inputs[0]]
        for i, lane in enumerate(streams):
            lane += zip(inputs[live[:, i], i].tolist(), targets[live[:, i], i].tolist(), strict=True)
    start = L._TAIL + 1
    for lane in streams:
        starts = [j for j, (before, _) in enumerate(lane) if before == start] + [len(lane)]
        for a, b in zip(starts, starts[1:], strict=False):
            words = [w for _, w in lane[a:b]]
            assert [before for before, _ in lane[a:b]] == [start, *words[:-1]]
            got[tuple(words)] += 1
    want = Counter()
    for _, _, tokens, begins in L.tokens_of(pa.array(TEXTS)):
        want.update(tuple(d.tolist()) for d in np.split(vocabulary.find(tokens)[2], begins[1:-1]))
    assert got == want


def test_gradients_stop_at_a_document():
    vocabulary, rng = _vocabulary(), np.random.default_rng(1)
    p = {k: x.astype(np.float64) for k, x in L.Model.views(L.Model.started(vocabulary)).items()}
    words = rng.integers(0, 40, (8, 3))
    inputs = np.concatenate([np.full((1, 3), L._TAIL + 1), words[:-1]])
    inputs[4, 1] = L._TAIL + 1  # lane 1 goes on with another document
    live = np.ones((8, 3), bool)

    def loss(p: dict) -> float:
        m, h, total = L.Model(p), np.zeros((3, L.HIDDEN)), 0.0
        entry = m.entry()
        for t in range(8):
            h = m.step(entry[inputs[t]], h * (inputs[t] != L._TAIL + 1)[:, None])[0]
            total -= m.log_likelihood(h, words[t]).sum()
        return total

    g = {k: np.zeros_like(x) for k, x in p.items()}
    L.Model(p).gradients(inputs, words, live, np.zeros((3, L.HIDDEN)), g)
    for k, x in p.items():
        at = np.unravel_index(int(np.abs(g[k]).argmax()), x.shape)
        kept, step = x[at], 1e-4
        x[at] = kept + step
        up = loss(p)
        x[at] = kept - step
        assert np.isclose((up - loss(p)) / (2 * step), g[k][at], rtol=1e-3, atol=1e-5), k
        x[at] = kept


def _brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """id -> held out, tokens, known ones, training tokens, base score, straight from the definition."""
    upper = {c: c + 32 for c in range(65, 91)}
    texts = {i: [*re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(upper)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    mass = total + 0.5 * (distinct + 1)
    return {i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total, sum(log10((counts[w] + 0.5) / mass) for w in ws)) for i, ws in texts.items()}


@pytest.mark.parametrize("head", [1 << 18, 100, 0])
def test_base_figures_against_brute_force(spark, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = _brute([(r.doc_id, r.text) for r in docs.collect()])
    rows = L.language_model_scores(docs, head=head).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, tokens, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_no_worse_than_the_base_on_held_out_texts(spark, scale):
    docs = spark.read.parquet(f"/root/testdata/{scale}/documents.parquet")
    rows = [r for r in L.language_model_scores(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_scores_are_probabilities():
    """Whatever the state, all classes' words and the tail class have a sum of one."""
    vocabulary = _vocabulary()
    model = L.Model(L.Model.views(L.Model.started(vocabulary)))
    h = np.random.default_rng(2).uniform(-1, 1, (1, L.HIDDEN)).astype(np.float32)
    targets = np.append(np.arange(len(vocabulary.modelled)), L._TAIL)
    assert abs(np.exp(model.log_likelihood(np.repeat(h, len(targets), 0), targets)).sum() - 1) < 1e-3


def test_a_long_document_teaches_in_pieces():
    text = " ".join(f"w{i % 40}" for i in range(5 * L.PIECE // 2))
    starts = words = 0
    for inputs, _, live in L._lessons(_vocabulary(), [pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])]):
        starts += int((inputs[live] == L._TAIL + 1).sum())
        words += int(live.sum())
    assert (starts, words) == (3, 5 * L.PIECE // 2 + 1)
