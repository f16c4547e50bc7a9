"""Sharding, mixing and fingerprints against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rillspark.llm import fingerprints, mixing, sharding, tables
from tests.llm.fixtures import clashing, documents, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, documents())


# Sharding


def sharded(docs, tmp_path, shards=8, slots=256):
    return sharding.shard_documents(docs, shards, str(tmp_path / "map"), slots)


def test_shards_hold_every_row_once_with_near_equal_bytes(docs, tmp_path):
    made = sharded(clashing(docs), tmp_path).collect()
    want = Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in documents()
    )
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in made) == want
    loads, places = Counter(), defaultdict(list)
    for r in made:
        loads[r.shard] += r.size
        places[r.shard].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # The very long text fills one shard; the others share the rest.
    others = sorted(loads[s] for s in range(8))[:-1]
    assert others[-1] - others[0] < 600


def test_a_record_repeated_many_times_spreads_over_the_shards(spark, tmp_path):
    made = sharded(frame(spark, [(1, "same text", "en", "s", 9)] * 400), tmp_path, 4).collect()
    counts = Counter(r.shard for r in made)
    assert len(made) == 400 and max(counts.values()) - min(counts.values()) <= 8


def test_an_empty_table_has_no_rows_and_still_a_map(spark, tmp_path):
    assert sharded(frame(spark, []), tmp_path).count() == 0
    assert sharding.stored_map(spark, str(tmp_path / "map")).count() == 256


def test_map_versions_stay_and_only_edited_slots_move(spark):
    first = sharding.first_map(spark, 4, 64)
    sizes = spark.range(64).selectExpr("cast(id as int) slot", "id % 7 + 1 as bytes", "1L as rows")
    same = sharding.edited_map(first, sizes, 4).collect()
    grown = sharding.edited_map(first, sizes, 5).collect()
    total = sum(i % 7 + 1 for i in range(64))
    for made, n in ((same, 4), (grown, 5)):
        loads = Counter()
        for r in made:
            loads[r.shard] += r.bytes
        assert len(made) == 64 and {r.version for r in made} == {2}
        assert max(loads.values()) <= total / n + 7
    moved = [r for r in grown if r.shard != r.shard_before]
    assert {r.shard for r in moved} <= set(range(5)) and len(moved) < 30
    fewer = sharding.edited_map(first, sizes, 2).collect()
    assert {r.shard for r in fewer} == {0, 1}


def test_slots_do_not_depend_on_partitions(docs):
    one = sharding.in_slots(docs.coalesce(1), ["doc_id"]).select("doc_id", "slot")
    many = sharding.in_slots(docs.repartition(7), ["doc_id"]).select("doc_id", "slot")
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


# Mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Share all words by weight; cap at 3 times, share the excess, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        made = {s: left * weight[s] / total for s in free} if total else {}
        over = [s for s in free if made[s] > 3 * sizes[s]]
        if not over:
            return fixed | made
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            free.remove(s)


def test_mix_meets_the_targets(docs):
    made = mixing.dealt_copies(clashing(docs)).collect()
    sizes = Counter()
    for _, text, _, source, _ in documents():
        sizes[source] += words(text)
    want = targets(sizes)
    taken = Counter()
    for r in made:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert len(made) == len(documents())
    for source, target in want.items():
        largest = max(words(t) for _, t, _, s, _ in documents() if s == source)
        assert abs(taken[source] - target) <= largest / 2 + 1


def test_mix_of_many_documents_goes_through_levels_and_agrees_with_itself(spark):
    rows = [(i, "w " * (i % 23 + 1), "en", "abc"[i % 3], 1) for i in range(2400)]
    one = mixing.dealt_copies(frame(spark, rows)).collect()
    two = mixing.dealt_copies(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(one) == sorted(two) and len(one) == 2400
    taken, target = Counter(), {}
    for r in one:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 12 for s in target)


def test_rounding_keeps_expectations(spark):
    rows = [(i, "w " * 10, "en", "ab"[i % 2], 1) for i in range(40)]
    runs = [mixing.dealt_copies(frame(spark, rows), seed=s).collect() for s in range(6)]
    # a shares a third of the words: two of three documents once.
    counts = [sum(r.copies for r in run if r.source == "a") for run in runs]
    assert set(counts) <= {13, 14}
    assert len({tuple(sorted((r.doc_id, r.copies) for r in run)) for run in runs}) > 1


def test_mixed_rows_follow_the_copies(spark, docs):
    dealt = Counter()
    for r in mixing.dealt_copies(docs).collect():
        dealt[r.doc_id, r.source] += r.copies
    made = mixing.mixed(clashing(docs))
    assert made.columns == clashing(docs).columns
    got = Counter((r.doc_id, r.source) for r in made.select("doc_id", "source").collect())
    assert got == Counter({k: n for k, n in dealt.items() if n})
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.dealt_copies(frame(spark, [])).count() == 0


def test_equal_rows_get_their_own_copies(spark):
    equal = [(1, "w " * 10, f"lang {i}", "a", i) for i in range(50)]
    rows = equal + [(i, "w " * 10, "en", "b", 1) for i in range(2, 40)] + [(100, "w w", "en", "c", 1)] * 7
    dealt = mixing.dealt_copies(frame(spark, rows)).collect()
    made = mixing.mixed(frame(spark, rows).repartition(5)).collect()
    mine = Counter(r.n_chars for r in made if r.doc_id == 1)
    want = Counter(r.copies for r in dealt if r.doc_id == 1)
    assert Counter(mine[i] for i in range(50)) == want and max(want) <= 3 and len(want) == 2
    per_id = Counter()
    for r in dealt:
        per_id[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in made) == Counter({k: n for k, n in per_id.items() if n})


def test_copies_in_blocks(spark):
    counted = spark.createDataFrame([("a", 1), ("b", 10), ("c", 3), ("d", 0), ("e", 9), (None, 4)], "k string, n long")
    made = tables.one_row_per_copy(counted, "n", "copy", block=4)
    assert Counter(map(tuple, made.collect())) == Counter((r.k, i) for r in counted.collect() for i in range(r.n))


# Fingerprints


def spots(text, chain=fingerprints.CHAIN, reach=fingerprints.REACH):
    """The definition, word by word."""
    text = text or ""
    found = re.findall(r"[^\W_]+", text.lower())
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    made = set()
    for i, word in enumerate(found):
        if word in fingerprints.ANCHORS:
            anchors, content = 1, []
            for other in found[i + 1 :]:
                if other in fingerprints.ANCHORS:
                    anchors += 1
                    if anchors > reach:
                        break
                else:
                    content.append(other)
                    if len(content) == chain:
                        break
            if content:
                made.add(md5(f"{word}:{' '.join(content)}"))
    if not made:
        made = {md5("w:" + w) for w in found} or {md5("=" + text)}
    return sorted(made)


def test_fingerprints_equal_the_definition(docs):
    made = fingerprints.fingerprinted(clashing(docs)).collect()
    rows = [(d, t or "") for d, t, *_ in documents()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(made) == len(rows)
    want = []
    for i, (doc_id, text) in enumerate(rows):
        other = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        a, b, c = spots(text), spots(changed), spots(other)
        like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
        want.append((doc_id, len(text), changed, a, b, round(like(a, b), 9), round(like(a, c), 9)))
    got = [
        (r.doc_id, r.n_chars, r.edited_text, r.spots, r.edited_spots, round(r.near_edited, 9), round(r.near_next, 9))
        for r in made
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_next_document_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "CHUNK_ROWS", 3)
    ids = [i * i % 1009 * (1 if i % 2 else 1000) for i in range(1, 300)]
    ids = sorted(set(ids))
    made = fingerprints.beside_next(frame(spark, [(i, f"text {i}", "", "", 1) for i in ids])).collect()
    follows = {i: ids[n - 1] for n, i in enumerate(ids)}
    assert {r.doc_id: r.next_text for r in made} == {i: f"text {j}" for i, j in follows.items()}


def test_single_and_no_document(spark):
    one = fingerprints.fingerprinted(frame(spark, [(5, "the river is green", "en", "s", 1)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprinted(frame(spark, [])).count() == 0


def test_near_pairs_equal_brute_force(spark):
    texts = {d: t or "" for d, t, *_ in documents() if d is not None}
    prints = spark.createDataFrame([(d, spots(t)) for d, t in texts.items()], "id long, sets array<string>")
    by_set = defaultdict(list)
    for d, t in texts.items():
        by_set[tuple(spots(t))].append(d)
    classes = {min(ids): set(s) for s, ids in by_set.items()}
    for at_least in (0.5, 0.8):
        want = {
            (a, b)
            for a in classes
            for b in classes
            if a < b and len(classes[a] & classes[b]) / len(classes[a] | classes[b]) >= at_least
        }
        got = fingerprints.near_pairs(prints, "id", "sets", at_least).collect()
        assert {(r.class_a, r.class_b) for r in got} == want


