"""The registered queries and the pipeline over a small folder of tables, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rillspark.llm import language, mixing, quality, sentencepiece_dropout
from tests.llm.fixtures import clashing, documents, frame, prose
from tests.llm.test_native import spots, targets, words
from tests.llm.test_documents_and_trees import CONVS, conversations
from tests.llm.test_search import PAGES, VECTORS, brute_force, exact, expected, near_copies, pages, vectors

ROWS = documents(60) + [(500 + r[0], r[1], r[2], f"s{r[0] % 5}", r[4]) for r in near_copies(60)]
LABELS = [(i, int(i % 4 > 0), 0) for i in range(0, 60, 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    clashing(frame(spark, ROWS)).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(pages(), PAGES).write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame(vectors(300), VECTORS).write.parquet(f"{where}/embeddings.parquet")
    clashing(spark.createDataFrame(conversations(), CONVS)).write.parquet(f"{where}/conversations.parquet")
    return where


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: entry.queries()[name](spark, folder)


def crc(value):
    return zlib.crc32(str(value).encode())


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_op1(run):
    made = run("op1_sharding").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in made) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ROWS
    )
    assert {r.law for r in made} == {"bytes"} and {r.grown_shard for r in made} == {None}
    for shard in range(8):
        mine = sorted(r.slot for r in made if r.shard == shard)
        assert mine == list(range(len(mine)))


def test_op2(run):
    made = run("op2_language_id").collect()
    assert len(made) == len(ROWS)
    texts = {d: t for d, t, *_ in ROWS}
    for r in made:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 5 == 0)
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1


def test_op3(run):
    made = run("op3_warc").collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made) == expected(pages())


def test_op4(run):
    made = run("op4_ngram_join").collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in made) == Counter(brute_force(ROWS)[0])


def test_op5(run):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t, *_ in ROWS:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 1024] += 1
    made = run("op5_token_counts").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in made) == want


def test_op6(run):
    made = run("op6_quality").collect()
    assert len(made) == len(ROWS)
    for r in made:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op7(run):
    made = run("op7_mixing").collect()
    sizes = Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += words(t)
    want = targets(sizes)
    assert len(made) == len(ROWS)
    for r in made:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in [k * r.size for k in range(4)]


def test_op8(run):
    made = run("op8_fingerprints").collect()
    texts = sorted(((d, t or "") for d, t, *_ in ROWS), key=lambda x: (x[0] is None, -(x[0] or 0)))
    want = Counter()
    for i, (d, t) in enumerate(texts):
        other, half = texts[(i + 1) % len(texts)][1], len(t) // 2
        changed = t[: len(t) - half] + other[:half]
        want[d, len(t), hashlib.sha256(changed.encode()).hexdigest(), " ".join(spots(t)), " ".join(spots(changed))] += 1
    assert want == Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in made)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in made)


def test_op9(run):
    want = exact(vectors(300), 100, 10)
    made = run("op9_neighbours").collect()
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in made} == {
        (q, n + 1, i, d) for q, found in want.items() for n, (d, i) in enumerate(found)
    }


def test_op10(run):
    made = run("op10_sentencepiece").collect()
    assert len(made) == len(ROWS)
    assert all(r.lossless or r.n_pieces is None for r in made)


def test_pipeline_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, rows, results = docs.columns, docs.collect(), []
    first_schema = docs.schema
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        if i < 4:
            assert made.columns == names
        results.append(made.collect())
        docs = spark.createDataFrame(results[-1], made.schema)
    plain = lambda found: Counter((r.doc_id, r.text, r.lang, r.source) for r in found)

    # 1: scores of the same ranking, one row at a time.
    good = {i: q == 1 for i, q, _ in LABELS if crc(i) % 3 != 1}
    learned = [r for r in rows if r.doc_id in good]
    order = sorted(learned, key=lambda r: int(hashlib.md5(f"{r.doc_id}|{int(good[r.doc_id])}".encode()).hexdigest()[:13], 16))
    model = quality.rank(
        np.array([quality.features(r.text) for r in order]), np.array([good[r.doc_id] for r in order])
    )
    kept = [r for r in rows if model.score(quality.features(r.text)[None])[0] >= corpus_pipeline.LEAST_QUALITY]
    assert plain(results[0]) == plain(kept)

    # 2: counts of the same n-grams, one row at a time.
    counts, seen = {}, Counter()
    for r in results[0]:
        n = language.ngram_counts(r.text)
        if r.lang is not None and n is not None and (r.doc_id is None or crc(r.doc_id) % 5 != 0):
            counts[r.lang] = counts.get(r.lang, 0) + n
            seen[r.lang] += 1
    langs = sorted(counts)
    known = language._model(langs, np.array([counts[x] for x in langs], float), np.array([seen[x] for x in langs]))
    kept = [
        r
        for r in results[0]
        if (p := known.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE
    ]
    assert plain(results[1]) == plain(kept)

    # 3: every pair compared.
    classes, _ = brute_force([(r.doc_id, r.text) for r in results[1]])
    assert Counter(r.doc_id for r in results[2]) == Counter({c for _, c, _ in classes})

    # 4: targets met, up to three copies of what was there.
    sizes, taken, before = Counter(), Counter(), plain(results[2])
    for r in results[2]:
        sizes[r.source] += words(r.text)
    for r in results[3]:
        taken[r.source] += words(r.text)
    for source, target in targets(sizes).items():
        largest = max(words(r.text) for r in results[2] if r.source == source)
        assert abs(taken[source] - target) <= largest / 2 + 1
    assert all(before[k] and n <= 3 * before[k] for k, n in plain(results[3]).items())
    dealt = mixing.dealt_copies(spark.createDataFrame(results[2], first_schema)).collect()
    assert Counter(r.doc_id for r in results[3]) == +Counter({r.doc_id: r.copies for r in dealt})

    # 5: the same rows with pieces that spell them.
    assert plain(results[4]) == plain(results[3])
    spelled = sentencepiece_dropout.model_arrays()["spelled"]
    assert all(sentencepiece_dropout.spelled_out(r.pieces, spelled) == r.text for r in results[4])

    whole = corpus_pipeline.run(spark, folder).collect()
    assert plain(whole) == plain(results[4])


def test_pipeline_of_no_documents(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_rejects_what_was_never_learned(spark):
    draw = random.Random(5)
    # Russian stands for a script, noise for letters without a language; neither is in the labels.
    rows = [(i, prose(draw, "en de fr".split()[i % 3], draw.randint(20, 60)), "en de fr".split()[i % 3], "s", 1) for i in range(300)]
    spell = lambda letters: " ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(40))
    rows += [(5 * i + 10_000, spell("абвгдежзийклмнопрстуфхцчшщыьэюя"), None, "s", 1) for i in range(20)]
    rows += [(5 * i + 20_000, spell("abcdefghijklmnopqrstuvwxyz"), None, "s", 1) for i in range(20)]
    made = corpus_pipeline.language_stage(spark, frame(spark, rows), "")
    kept = {r.doc_id for r in made.collect()}
    assert {i for i in kept if i < 10_000} == set(range(300))
    assert not {i for i in kept if 10_000 <= i < 30_000}


def test_quality_stage_cuts_at_the_quantile(spark, tmp_path):
    # Weak features: no score is far from the cut, so a fixed low score would reject next to nothing.
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = draw.random() < 0.6
        shouted = draw.random() * (0.9 if good else 1.0)
        text = " ".join(w.upper() if draw.random() < shouted else w for w in prose(draw, "en", 40).split())
        rows.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    learned = [(i, g) for i, g, _ in labels if crc(i) % 3 != 1]
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, frame(spark, rows), str(tmp_path)).collect()}
    assert len(kept & {i for i, _ in learned}) == sum(g for _, g in learned)
