"""Language, quality, token counts and SentencePiece against libraries and plain rules."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillspark.llm import language, merging, quality, sentencepiece_dropout, token_counts
from tests.llm.fixtures import WORDS, clashing, documents, frame, prose


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, documents())


# Language


def test_languages_of_texts_never_learned_from(spark):
    draw = random.Random(1)
    langs = [draw.choice(sorted(WORDS)) for _ in range(300)]
    rows = [(i, prose(draw, lang, draw.randint(5, 40)), lang, "s", 1) for i, lang in enumerate(langs)]
    docs = frame(spark, rows)
    model = language.fit(docs.filter(~language.held_out()))
    made = language.identified(docs.filter(language.held_out()), model).collect()
    assert len(made) > 30 and sum(r.lang_pred == r.lang for r in made) >= 0.97 * len(made)
    assert all(0 <= r.score <= 1 for r in made)


def test_language_of_awkward_rows(spark, docs):
    model = language.fit(docs)
    made = language.identified(clashing(docs), model).collect()
    assert len(made) == len(documents())
    for r in made:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, True)
        else:
            assert r.lang_pred in WORDS
    by_text = {}
    for r in made:
        by_text.setdefault(r.text, set()).add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in by_text.values())


def test_as_many_languages_as_there_are(spark):
    rows = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * 3} {i:b}".translate(str.maketrans("01", "xq")), f"l{i:03}", "s", 1) for i in range(530)]
    model = language.fit(frame(spark, rows))
    assert len(model.languages) == 530 and model.weights.shape[1] < 200
    assert model.predict(rows[77][1])[0] in model.languages


def test_nothing_or_one_language_learned(spark, docs):
    none = language.fit(frame(spark, []))
    assert language.identified(docs, none).filter("lang_pred != 'und'").count() == 0
    one = language.fit(docs.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.identified(docs, one).collect()} == {"en", "und"}
    assert language.identified(frame(spark, []), one).count() == 0


def test_training_sums_do_not_depend_on_partitions(docs):
    a, b = language.fit(docs.coalesce(1)), language.fit(docs.repartition(6))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 100, 300])
def test_codewords_are_far_apart_and_correct_errors(n):
    codes = language.codewords(n)
    apart = min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i))
    assert len(codes) == n and apart >= max(1, codes.shape[1] // 3)
    assert not (abs(codes.sum(0)) == n).any()


def test_ngram_counts_by_hand():
    counts = language.ngram_counts("Ab")
    # Single letters with the two borders, three pairs, two triples.
    assert counts.sum() == 4 + 3 + 2
    assert language.ngram_counts("12 $") is None and language.ngram_counts(None) is None
    assert (language.ngram_counts("AB..c") == language.ngram_counts("ab c")).all()
    assert language.ngram_counts("𝒜𝒷").sum() == 4 + 3 + 2


# Quality


def test_quality_separates_documents_never_learned_from(spark):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        text = prose(draw, "en", draw.randint(15, 60))
        good = draw.random() < 0.7
        rows.append((i, text if good else " | ".join(w.upper() + "!!" for w in text.split()), "en", "s", 1))
        labels.append((i, int(good)))
    docs = frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, marks.filter(~quality.held_out()))
    made = {r.doc_id: r.score for r in quality.scored(docs.filter(quality.held_out()), model).collect()}
    truth = dict(labels)
    assert len(made) > 80
    assert all((s >= 0.5) == bool(truth[i]) for i, s in made.items())


def test_quality_of_awkward_rows(spark, docs):
    marks = spark.createDataFrame(
        [(i, int(i % 3 > 0)) for i in range(60)] + [(3, 1), (None, 1), (4, None), (999, 0)],
        "doc_id long, quality int",
    )
    made = quality.scored(clashing(docs), quality.fit(docs, marks)).collect()
    assert len(made) == len(documents()) and all(0 <= r.score <= 1 for r in made)
    by_text = {}
    for r in made:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(x) == 1 for x in by_text.values())


def test_quality_without_both_kinds(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    good, bad = (spark.createDataFrame([(1, q), (2, q)], "doc_id long, quality int") for q in (1, 0))
    for marks, passes in ((none, True), (good, True), (bad, False)):
        scores = [r.score for r in quality.scored(docs, quality.fit(docs, marks)).collect()]
        assert all((s >= 0.5) == passes for s in scores)
    assert quality.scored(frame(spark, []), quality.fit(docs, good)).count() == 0


def test_cut_passes_as_many_as_are_good():
    draw = np.random.default_rng(0)
    good = draw.random(500) < 0.8
    vectors = draw.normal(size=(500, 5)) + good[:, None] * np.array([1.5, 0, 0, -1, 0])
    model = quality.rank(vectors, good)
    assert (model.score(vectors) >= 0.5).sum() == good.sum()
    assert np.sign(model.weights[[0, 3]]).tolist() == [1, -1]


def test_cut_is_taken_over_all_labelled_rows(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = draw.random() < 0.6
        # The kinds overlap: some words of both are shouted.
        shouted = draw.random() * (0.7 if good else 1.0)
        text = " ".join(w.upper() if draw.random() < shouted else w for w in prose(draw, "en", 40).split())
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    few = quality.fit(docs, marks, most_labelled=50)
    made = [r.score for r in quality.scored(docs, few).collect()]
    assert sum(s >= quality.PASSES for s in made) == sum(g for _, g in labels)
    whole = quality.fit(docs, marks)
    assert quality.cut_of_all(docs, marks, whole) == pytest.approx(whole.cut, abs=1e-12)


def test_rank_by_gradient_is_the_optimum():
    draw = np.random.default_rng(1)
    good = np.arange(60) % 2 == 0
    vectors = draw.normal(size=(60, 3)) + good[:, None] * 0.7
    model = quality.rank(vectors, good)
    z = np.clip((vectors - model.center) / model.scale, -8, 8)
    rng = np.random.default_rng(6)
    n = min(quality.PAIRS, 30 * 30)
    x = z[rng.choice(np.flatnonzero(good), n)] - z[rng.choice(np.flatnonzero(~good), n)]
    slope = x.T @ (1 - 1 / (1 + np.exp(-x @ model.weights))) / n - quality.PENALTY * model.weights
    assert np.abs(slope).max() < 1e-6


# Token counts

AWKWARD = [
    "a", "B", "é", "ß", "1", "²", "Ⅷ", "中", "'", "s", "re", "ve", "ll", "t", "d", " ", "  ", "\n", "\t", " ",
    "　", "!", "?", "_", "\x00", "<|endoftext|>", "🙂", "́", " ", "\x1c", "\x85", "'s", " '", "​",
    "﻿", "᠎", "the", " the",
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))
    return lambda texts: [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return token_counts.vocabulary()


def test_counts_equal_the_library_on_awkward_texts(library, merges):
    draw = random.Random(5)
    texts = ["".join(draw.choice(AWKWARD) for _ in range(draw.randint(0, 25))) for _ in range(4000)]
    texts += ["".join(draw.choice(AWKWARD) for _ in range(n)) for n in (511, 512, 513, 3000)]
    texts += ["x" * 5000, "ab" * 4000, " " * 3000, "\n" * 1025 + "a"]
    machine = token_counts.Counter(merges[0])
    assert token_counts.counts_of(pa.array(texts), machine, merges[1]).tolist() == library(texts)
    assert token_counts.counts_of(pa.array(texts), machine, merges[1]).tolist() == library(texts)


def test_bounded_states_give_the_same_counts(library, merges):
    texts = [prose(random.Random(i), "de", 50) for i in range(20)]
    small = token_counts.Counter(merges[0], most=10)
    assert token_counts.counts_of(pa.array(texts), small, merges[1]).tolist() == library(texts)
    assert not small.waiting and len(small.machine.sums) == len(merges[0]["sums"])


def test_entries_of_the_vocabulary_are_counted_by_transitions_alone(merges):
    machine = token_counts.Counter(merges[0]).machine
    words = [b"the", b" the", b"ing", b" international", "\u00e9".encode(), b" "]
    tokens, inside = machine.run(*token_counts.laid_out(words))
    assert inside.all() and tokens.tolist() == [1] * len(words)
    assert (machine.edges[:, 3] < 0).any()
    assert len(np.unique(machine.edges[:, :2], axis=0)) == len(machine.edges)  # deterministic
    assert not machine.run(*token_counts.laid_out([b" qzxjvw", b"a" * 49]))[1].any()


def test_the_transducer_takes_in_words_that_left_it(library, merges):
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choice("abcdefgh\u00e9\u4e2d") for _ in range(draw.randint(1, 49))) for _ in range(9000))]
    counter = token_counts.Counter(merges[0])
    before = len(counter.machine.sums)
    for _ in range(3):
        assert token_counts.counts_of(pa.array(texts), counter, merges[1]).tolist() == library(texts)
    assert len(counter.machine.sums) > before and not counter.waiting
    # A word that is a prefix of another one ends in a state made before.
    some = ["".join(draw.choice("abcdefgh") for _ in range(30)) for _ in range(7000)]
    for texts in ([" ".join(some)], [" ".join(w[:20] for w in some)], [" ".join([*some, *(w[:20] for w in some)])]):
        assert token_counts.counts_of(pa.array(texts), counter, merges[1]).tolist() == library(texts)
    full = token_counts.Counter(merges[0], most=before + 1000)
    for _ in range(2):
        assert token_counts.counts_of(pa.array(texts), full, merges[1]).tolist() == library(texts)
    assert before < len(full.machine.sums) <= before + 1000


def test_counted_rows(spark, docs, library):
    made = token_counts.counted(clashing(docs)).select("text", "n_tokens").collect()
    assert len(made) == len(documents())
    assert [r.n_tokens for r in made] == library([r.text or "" for r in made])
    assert token_counts.counted(frame(spark, [])).count() == 0


def test_chunk_maps_compose_to_the_plain_run():
    draw = np.random.default_rng(3)
    classes = draw.integers(0, token_counts.CLASSES, 5000).astype(np.uint8)
    state, want = token_counts.START, []
    for c in classes:
        want.append(bool(token_counts.STARTS[c, state]))
        state = token_counts.AFTER[c, state]
    for chunk in (1, 2, 7, 64, 8192):
        assert token_counts.word_starts(classes, chunk).tolist() == want


# SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return sentencepiece_dropout.Encoder(sentencepiece_dropout.model_arrays())


PIECES = [
    "a", "b", "the", "ing", "é", "ß", "1", "中", "'", " ", "  ", "    ", "\n", "\t", "!", "\x00", "🙂", "②", "執",
    "ab" * 20, "x", "<s>", "<0x0A>",
]


def test_encoding_without_dropout_equals_the_library(encoder):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_dropout.MODEL))
    draw = random.Random(7)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))) for _ in range(3000)]
    texts += ["ing" * 400, " " * 500, "é" * 300]
    got = encoder.encode(texts, np.arange(len(texts)).astype(np.uint64), 0.0).to_pylist()
    assert got == model.encode(texts)
    assert [encoder.decode(x) for x in got] == texts


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_varies_and_stays_lossless(encoder, dropout):
    draw = random.Random(8)
    texts = ["".join(draw.choice([*PIECES, "▁"]) for _ in range(25)) for _ in range(300)] + ["the king " * 300]
    keys = [np.arange(len(texts)).astype(np.uint64) + np.uint64(k) for k in (0, 10**6)]
    one, again, other = (encoder.encode(texts, k, dropout).to_pylist() for k in (keys[0], keys[0], keys[1]))
    assert one == again
    assert (one != other) == (dropout < 1)
    for made in (one, other):
        assert [encoder.decode(x) for x in made] == texts


def test_full_dropout_leaves_characters(encoder):
    made = encoder.encode(["the king"], np.array([1], np.uint64), 1.0).to_pylist()[0]
    assert len(made) == 9


def test_dropout_rate_and_neighbours(encoder):
    # A text alone, or between others, is cut alike; about a tenth of first merges is skipped.
    texts = ["in"] * 4000
    keys = np.arange(4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    made = encoder.encode(texts, keys, 0.1).to_pylist()
    whole = max(set(map(tuple, made)), key=list(map(tuple, made)).count)
    assert 0.02 < sum(tuple(x) != whole for x in made) / 4000 < 0.35
    alone = encoder.encode(["in"], keys[17:18], 0.1).to_pylist()
    assert alone[0] == made[17]


def test_encoded_rows(spark, docs):
    from collections import Counter

    made = sentencepiece_dropout.encoded(clashing(docs))
    rows = made.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, t) for d, t, *_ in documents())
    for r in rows:
        if r.text is None:
            assert r.pieces is None and r.n_pieces is None and r.lossless is None
        else:
            assert r.lossless and r.n_pieces == len(r.pieces)
    again = sentencepiece_dropout.encoded(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), str(r.pieces)) for r in rows) == sorted((str(r.doc_id), str(r.pieces)) for r in again)
    back = sentencepiece_dropout.decoded(made).collect()
    assert all(r.decoded == r.text for r in back)
    assert sentencepiece_dropout.encoded(frame(spark, [])).count() == 0


def test_long_words_through_the_agenda_equal_the_matrix(encoder, monkeypatch):
    draw = random.Random(9)
    texts = ["".join(draw.choice("theinrst") for _ in range(40)) for _ in range(40)]
    keys = np.arange(40).astype(np.uint64)
    made = [encoder.encode(texts, keys, p).to_pylist() for p in (0.0, 0.3)]
    monkeypatch.setattr(merging, "LONGEST", 1)
    assert [encoder.encode(texts, keys, p).to_pylist() for p in (0.0, 0.3)] == made
