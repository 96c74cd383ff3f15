"""Fill-in-middle, vector codes and sentence pieces against brute force and the library whose ids they must give."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from railside.llm import queries as Q
from railside.llm.fim import FillInMiddle, Tokens, fill_in_middle, fill_in_middle_digest, restored, select
from railside.llm.pieces import PieceModel, Pieces, Vocabulary, encode_pieces, piece_digest
from railside.llm.vector_codes import encode_vectors, fit_codebooks, nearest, vector_codes
from tests.oracle import SMALL

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
LONG = " ".join(f"word{i}" for i in range(200_000))
EDGE = [(1, "", "a"), (2, None, "b"), (3, LONG, "c"), (4, "a<P>b", "d"), (5, "one é\U0001f600  two\n", "e"), (5, "one é\U0001f600  two\n", "e"), (None, "x", "f")]


@pytest.fixture
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, N string").select("*", *[F.lit(7).alias(c) for c in ("form", "Output", "IDS", "_trip", "fim")])


@pytest.fixture(scope="module")
def pieces():
    return Pieces(Vocabulary.read(MODEL))


# fill-in-middle


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from("abZ .\n0é中\U0001f600\x00<P>S"), min_size=1, max_size=60))
def test_tokens_by_masks(text):
    raw, tokens = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    masks = Tokens(raw)
    assert masks.n == len(tokens)
    for k in range(len(tokens) + 1):
        head = "".join(tokens[:k])
        assert masks.byte_of(k) == len(head.encode()) and masks.chars(0, masks.byte_of(k)) == len(head)


def test_select_finds_every_set_bit():
    bits = random.Random(5).getrandbits(5000)
    places = [i for i in range(5000) if bits >> i & 1]
    assert [select(bits, k) for k in range(len(places))] == places


def test_forms_and_restoring(spark, edge):
    rows = fill_in_middle(edge).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    assert len(rows) == len(EDGE) and set(rows[0].asDict()) == {*edge.columns, "prefix_chars", "middle_chars", "output", "back", "n", "form"} - {"N", "Output", "fim"}
    assert Counter(r.back for r in rows) == Counter(t or "" for _, t, _ in EDGE)
    by_id = {r.doc_id: r for r in fill_in_middle_digest(edge).collect()}
    assert (by_id[1].form, by_id[2].form, by_id[4].form, by_id[1].n, by_id[3].n) == ("plain", "plain", "plain", 0, len(re.findall(r"[A-Za-z]+|[^A-Za-z]", LONG)))
    assert by_id[3].restored_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    many = spark.createDataFrame([(i, "some plain words of a text") for i in range(2000)], "doc_id long, text string")
    forms = Counter(r.form for r in fill_in_middle(many).collect())
    assert abs(forms["plain"] - 200) < 60 and abs(forms["spm"] - 360) < 80
    assert fill_in_middle_digest(edge.limit(0)).collect() == []
    assert {r.form for r in fill_in_middle(many, how=FillInMiddle(cut_share=100, spm_share=100)).collect()} == {"spm"}


# vector codes


def _brute_codes(rows, parts=16, entries=64, rounds=2):
    """By position among kept rows: code, error; and the codebooks, in plain whole numbers."""
    keep = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    keep.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(c) for c in r[1]]))
    size = max(1, -(-max((len(v) for _, v, _ in keep), default=0) // parts))
    whole = [[int(np.floor(256.0 * c)) for c in v] + [0] * (parts * size - len(v)) for _, v, _ in keep]
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(book))

    for _ in range(rounds):
        members = [[[] for _ in b] for b in books]
        for v in cut:
            for p in range(parts):
                members[p][best(v[p], books[p])[1]].append(v[p])
        books = [[tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else old for m, old in zip(ms, b, strict=True)] for ms, b in zip(members, books, strict=True)]
    out = []
    for (i, _, label), v in zip(keep, cut, strict=True):
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def test_codes_of_hard_vectors(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, r.gauss(0, 0.3)]) for _ in range(40)], r.choice([None, 1, 2])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)] + [(5, rows[5][1], None), (None, rows[3][1], 9)]  # a hot vector, repeated and null ids
    rows += [(2000, None, 1), (2001, [1.0, float("nan")], 1), (2002, [float("inf")] * 40, 1), (2003, [0.5, None], 2), (2004, [], 2), (2005, [3.0] * 33, 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", F.lit(1).alias("CODE"), F.lit(2).alias("_x"), F.lit(3).alias("error"))
    expected, digest = _brute_codes(rows)
    of_label = Counter()
    for _, label, _, error in expected:
        of_label[label] += error
    got = vector_codes(frame).collect()
    assert Counter((x.vec_id, x.code, x.error, x.label_error) for x in got) == Counter((i, code, error, of_label[label]) for i, label, code, error in expected)
    assert {x.codebooks_sha256 for x in got} == {digest}
    assert vector_codes(frame.limit(0)).collect() == [] and vector_codes(frame.where("vec_id = 2000")).collect() == []


@pytest.mark.parametrize("largest", [3, 200, 1 << 14, 1 << 26])
def test_screening_never_loses_the_nearest(largest):
    r = np.random.default_rng(largest)
    entries = r.integers(-largest, largest, (64, 4))
    entries[40:] = entries[:24]  # ties
    entries[39] = entries[0] + 1
    x = np.concatenate([r.integers(-largest, largest, (500, 4)), entries + r.integers(-1, 2, entries.shape)])
    distances = np.array([[int(((a - b) ** 2).sum()) for b in entries.astype(object)] for a in x.astype(object)], object)
    codes, errors = nearest(x, entries)
    assert codes.tolist() == [int(np.argmin(d)) for d in distances] and errors.tolist() == distances.min(1).tolist()


def test_codes_lead_back_near_their_vectors(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    books = fit_codebooks(vectors)
    rows = encode_vectors(vectors, books).withColumn("back", books.decode(F.col("code"))).collect()
    assert len(rows) == vectors.count()
    for x in rows:
        off = np.floor(256 * np.array(x.embedding, np.float64)) - np.floor(256 * np.array(x.back))
        assert int((off**2).sum()) == x.error


# sentence pieces


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("▁  \n\tabcdethinger.,=-()/0123éñ中文\U0001f600\x00�<s>")), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_ids_of_any_text(pieces, text):
    expected = LIBRARY.encode(text, add_bos=True, add_eos=True)
    ids = pieces.encode(text)
    assert ids.tolist() == expected and pieces.decode(ids) == LIBRARY.decode(expected)


def test_ids_of_joined_pieces_and_runs(pieces):
    r = random.Random(1)
    known = [p for p in pieces.ids]
    for k in range(4000):
        text = "".join(r.choice(known) for _ in range(r.randrange(1, 7))) if k % 2 else " " * r.randrange(40) + r.choice(["a", "the ", "==", "\n"]) * r.randrange(9)
        assert pieces.encode(text).tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
    run = "".join(r.choice("abcdefghinth") for _ in range(150_000))  # a span longer than a step
    assert pieces.encode(run).tolist() == LIBRARY.encode(run, add_bos=True, add_eos=True)


def test_decoding_of_any_ids(pieces):
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(262) for _ in range(r.randrange(12))]
        assert pieces.decode(np.array(ids, np.int64)) == LIBRARY.decode(ids)


def test_what_a_worker_forgets_changes_nothing(monkeypatch):
    monkeypatch.setattr("railside.llm.pieces.REMEMBERED", 3)
    monkeypatch.setattr("railside.llm.pieces.PAIRS", 5)
    small = Pieces(Vocabulary.read(MODEL))
    text = "the quick brown fox, jumps over  the lazy dog; " * 3
    assert small.encode(text).tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_pieces_of_documents(spark, edge):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for got, texts in ((Q.op13_sentence_pieces(spark, SMALL).collect(), list(docs.items())), (piece_digest(edge, MODEL).collect(), [(i, t) for i, t, _ in EDGE])):
        expected = Counter()
        for i, t in texts:
            ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
            expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert piece_digest(edge.limit(0), MODEL).collect() == []


def test_ids_as_a_column(spark, edge):
    encoded = encode_pieces(edge, MODEL).withColumn("back", PieceModel(spark, MODEL).text(F.col("ids")))
    for r in encoded.where("length(text) < 100 or text is null").collect():
        assert r.ids == LIBRARY.encode(r.text or "", add_bos=True, add_eos=True) and r.back == LIBRARY.decode(r.ids)


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"")
    with pytest.raises(ValueError, match="byte-pair"):
        Vocabulary.read(str(path))
