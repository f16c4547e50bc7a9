"""N-gram join, neighbours, components and WARC against brute force."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import numpy as np
import pytest

from rillspark.llm import components, neighbours, ngram_join, warc
from tests.llm.fixtures import clashing, documents, frame, prose

# N-gram join


def grams(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else None


def brute_force(rows, at_least=0.8):
    """Links per row, and the smallest doc_id of each row's component."""
    sets = [grams(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links, pairs = Counter(), set()
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= at_least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
                pairs.add((i, j))
    ids = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            ids[find(i)] = min(doc_id, ids.get(find(i), doc_id))
    return [(r[0], ids.get(find(i)), links[i]) for i, r in enumerate(rows)], pairs


def near_copies(n, seed=4):
    """Families of texts with a few words changed, at many degrees of likeness."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if not rows or draw.random() < 0.2:
            words = prose(draw, "en", draw.randint(20, 90)).split()
            words = [w + str(draw.randint(0, 400)) for w in words]
        copy = list(words)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = draw.choice(["alpha", "beta", "gamma"])
        rows.append((i, " ".join(copy), "en", "s", 1))
    return rows


def test_links_and_classes_equal_brute_force(spark):
    rows = documents(40) + [(1000 + r[0], *r[1:]) for r in near_copies(150)]
    made = ngram_join.joined(clashing(frame(spark, rows))).collect()
    want, _ = brute_force(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in made) == Counter(want)
    assert sum(r.n_links for r in made) > 80


def test_large_buckets_in_blocks_give_the_same(spark, monkeypatch):
    rows = near_copies(120, seed=5)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    made = ngram_join.joined(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in made) == Counter(brute_force(rows)[0])


def test_pairs_of_the_join(spark):
    rows = near_copies(80, seed=6)
    made = ngram_join.similar_pairs(frame(spark, rows)).collect()
    by_words = {}
    for d, t, *_ in rows:
        by_words.setdefault(" ".join(t.lower().split()), d)
    first = [(d, t) for t, d in by_words.items()]
    want = {tuple(sorted((first[i][0], first[j][0]))) for i, j in brute_force(first)[1]}
    assert {(r.id_a, r.id_b) for r in made} == want and len(made) == len(want)
    texts = dict(first)
    for r in made:
        a, b = grams(texts[r.id_a]), grams(texts[r.id_b])
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b))


def test_one_of_each_class_stays(spark):
    rows = documents(40) + [(1000 + r[0], *r[1:]) for r in near_copies(100)]
    docs = clashing(frame(spark, rows))
    made = ngram_join.one_of_each(docs)
    assert made.columns == docs.columns
    want, _ = brute_force(rows)
    stay = [w[0] for w, r in zip(want, rows, strict=True) if not grams(r[1])]
    stay += {w[1] for w, r in zip(want, rows, strict=True) if grams(r[1])}
    assert Counter(r.doc_id for r in made.select("doc_id").collect()) == Counter(stay)


def test_join_of_nothing(spark):
    assert ngram_join.joined(frame(spark, [])).count() == 0
    assert ngram_join.one_of_each(frame(spark, [])).count() == 0
    alone = ngram_join.joined(frame(spark, [(1, None, "", "", 0), (2, "", "", "", 0)])).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in alone} == {(1, 1, 0), (2, 2, 0)}


@pytest.mark.parametrize(("at_least", "recall"), [(0.8, 0.999), (0.5, 0.9), (0.9, 0.9999)])
def test_bands_reach_the_recall(at_least, recall):
    bands, rows = ngram_join.bands_for(at_least, recall)
    assert 1 - (1 - at_least**rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_minima_agree_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 2**63, 1000, np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])
    same = ngram_join.band_hashes(a, 2000, 1) == ngram_join.band_hashes(b, 2000, 1)
    assert same.mean() == pytest.approx(0.8, abs=0.04)


def test_components_of_chains_stars_and_repeats(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201), (201, 200)]
    draw.shuffle(links)
    made = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {(r.node, r.root) for r in made} == (
        {(i, 0) for i in range(61)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}
    )
    assert len(made) == 61 + 60 + 2
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Neighbours

VECTORS = "vec_id long, embedding array<float>, score int"


def exact(rows, every, k):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and None not in v]
    usable = [(i, v) for i, v in usable if len(v) == 8 and np.isfinite(v).all() and v.any()]
    out = {}
    for q, a in usable:
        if q % every == 0:
            found = {}
            for i, b in usable:
                if i != q:
                    d = float(np.sqrt(((a - b) ** 2).sum()))
                    found[i] = min(d, found.get(i, d))
            out[q] = sorted((round(d, 12), i) for i, d in found.items())[:k]
    return out


def vectors(n, seed=0):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centers[i % 5] + 0.3 * draw.normal(size=8)], 1) for i in range(n)]
    return rows + [
        (n, None, 1),
        (n + 1, [0.0] * 8, 1),
        (n + 2, [float("nan")] * 8, 1),
        (n + 3, [1.0, None] * 4, 1),
        (n + 4, [float("inf")] * 8, 1),
        (n + 5, [1.0, 2.0], 1),
        (None, [1.0] * 8, 1),
        (n + 6, rows[0][1], 1),
        (n + 7, rows[0][1], 1),
    ]


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 12), r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_neighbours_in_one_block_are_exact(spark):
    rows = vectors(200)
    assert got(neighbours.nearest(spark.createDataFrame(rows, VECTORS), 10)) == exact(rows, 10, 10)


def test_neighbours_over_blocks_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rows = vectors(1200, seed=1)
    made, want = got(neighbours.nearest(spark.createDataFrame(rows, VECTORS), 20)), exact(rows, 20, 10)
    assert made.keys() == want.keys() and all(len(x) == 10 for x in made.values())
    hits = sum(len({i for _, i in made[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_a_hot_vector_and_few_candidates(spark):
    rows = [(i, [1.0] * 8, 1) for i in range(500)]
    assert got(neighbours.nearest(spark.createDataFrame(rows, VECTORS), 100)) == exact(rows, 100, 10)
    few = vectors(3)
    assert got(neighbours.nearest(spark.createDataFrame(few, VECTORS), 1)) == exact(few, 1, 10)
    assert neighbours.nearest(spark.createDataFrame([], VECTORS), 1).count() == 0


def test_hilbert_keys_visit_neighbouring_cells():
    side = np.array(np.meshgrid(*[range(8)] * 3)).reshape(3, -1).T
    keys = neighbours.hilbert_keys(side, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(side[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


# WARC

PAGES = "page_id long, url string, html string, payload_digest int"


def pages():
    return [
        (1, "http://a/1", "<p>one</p>", 0),
        (2, "http://a/2", "<p>two</p>", 0),
        (3, "http://a/3\r\nX: y", "<p>one</p>", 0),
        (4, None, None, 0),
        (5, "http://a/5", "", 0),
        (6, "http://a/6", "é中🙂\r\n\r\nWARC/1.1\r\n" * 20, 0),
        (None, "http://a/7", "<p>one</p>", 0),
        (None, "http://a/8", "<p>alone</p>", 0),
        (9, "http://a/9", "x" * 3_000_000, 0),
        (9, "http://a/9", "x" * 3_000_000, 0),
        *((100 + i, f"http://b/{i}", f"page {i % 30} " * (i % 30), 0) for i in range(100)),
    ]


def expected(rows):
    data = [(i, (h or "").encode()) for i, _, h, _ in rows]
    largest = {}
    for i, b in data:
        largest[b] = max([x for x in (i, largest.get(b)) if x is not None], default=None)
    return Counter(
        (
            i,
            len(b),
            base64.b32encode(hashlib.sha1(b).digest()).decode(),
            "response" if i == largest[b] else "revisit",
            None if i == largest[b] else largest[b],
        )
        for i, b in data
    )


def test_records_come_back_whole_from_any_ranges(spark, tmp_path):
    rows = pages()
    written = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), archive_bytes=4000)
    assert written.count() > 1
    listed = warc.archives(spark, str(tmp_path / "w"))
    assert {r.length for r in listed.collect()} == {r.length for r in written.collect()}
    for found, step in ((written, 500), (listed, 10**9), (written.coalesce(1), 2000)):
        made = warc.read_archives(found, step).collect()
        assert all(r.intact for r in made)
        seen = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in made)
        assert seen == expected(rows)
        bodies = {(h or "").encode() for _, _, h, _ in rows}
        assert {bytes(r.payload) for r in made if r.record_type == "response"} == bodies


def test_archives_are_rows_of_gzip_members(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame(pages()[:3], PAGES), str(tmp_path / "w"))
    texts = [gzip.decompress(open(r.path.removeprefix("file://"), "rb").read()) for r in manifest.collect()]
    assert sum(t.count(b"WARC-Type: ") for t in texts) == 3
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)


def test_no_pages(spark, tmp_path):
    manifest = warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert manifest.count() == 0 and warc.read_archives(manifest).count() == 0


def test_each_range_owns_what_starts_in_it_and_damage_is_passed_over():
    members = [warc.record(i, "u", bytes([65 + i]) * (i * 700 + 1), "D", None, False, "d") for i in range(8)]
    data = b"junk\x1f\x8b" + b"".join(members[:4]) + b"\x1f\x8b\x08broken" + b"".join(members[4:]) + members[0][:20]
    whole = [o for o, _ in warc.records_of_range(io.BytesIO(data), 0, len(data))]
    assert len(whole) == 8
    for step in (1, 3, 50, 333):
        cut = [o for s in range(0, len(data), step) for o, _ in warc.records_of_range(io.BytesIO(data), s, s + step)]
        assert cut == whole
