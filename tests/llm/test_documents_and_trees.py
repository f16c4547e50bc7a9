"""Prefix trie, fill-in-the-middle and url rules against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.llm import fill_in_middle, prefix_trie, url_filters
from tests.llm.fixtures import clashing, documents, frame

CONVS = "conv_id long, turn long, role string, text string"


def conversations(seed=1):
    """Shared beginnings over several hundreds, hot turns, nulls, ties, repeated rows, odd ids and a long one."""
    draw = random.Random(seed)
    rows = []
    for conv in [*range(0, 60), *range(98, 140), 205, 305, 306, -3, -250, -200]:
        same = draw.random() < 0.4
        for turn in range(draw.choice([1, 2, 3, 5, 8])):
            text = "hot" if same else draw.choice(["a", "bé", "🙂🙂", "", None])
            rows.append((conv, turn, draw.choice(["user", None]) if not same else "user", text))
    rows += [(7, None, "user", "first of all"), (8, 3, "user", "tie b"), (8, 3, "user", "tie a"), (8, 3, "assistant", "z")]
    rows += [(9, 1, "user", "twice")] * 3 + [(None, 0, "user", "nobody's")]
    rows += [(400, i, "user", f"t{i % 7}") for i in range(90)] + [(401, i, "user", f"t{i % 7}") for i in range(83)]
    rows += [(402, i, "user", "own") for i in range(3)]
    draw.shuffle(rows)
    return rows


def nodes(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(who) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(built[c]) == len(n)))
        above = min(members[n[:-1]]) if n else None
        out.append((min(who), len(n), above, len(who), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window, shard", [(1024, 4096), (4, 7), (1, 3)])
def test_trie_equals_brute_force(spark, window, shard):
    rows = conversations()
    made = prefix_trie.trie(clashing(spark.createDataFrame(rows, CONVS)), window, shard)
    assert Counter(map(tuple, made.collect())) == nodes(rows)


def test_trie_of_conversations_longer_than_a_window_of_the_query(spark):
    rows = [(c, i, "user", f"t{i // (900 * (c + 1))}") for c in (0, 1, 2) for i in range(2048 + 1000 * c)]
    made, whole = (prefix_trie.trie(spark.createDataFrame(rows, CONVS), w).collect() for w in (1024, 5000))
    assert Counter(map(tuple, made)) == Counter(map(tuple, whole)) and max(r.depth for r in made) == 4048


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], CONVS)).collect() == []
    rows = [(c, 0, "user", "x") for c in range(101, 112)]
    assert Counter(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, CONVS)).collect())) == nodes(rows)


def plain_cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rows = documents(200) + [
        (900 + i, t, "en", "s", 1)
        for i, t in enumerate(["a <P> b", "<S>", "< M > <M", "<<P", "ab" * 40_000 + "é" * 3_000 + " x" * 9_000, "🙂", "\n", ">"] * 3)
    ]
    made = fill_in_middle.transformed(clashing(frame(spark, rows)))
    made = made.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((d, t or "", *plain_cut(d, t)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == want
    assert {r.form for r in made} == {"plain", "psm", "spm"} and {r.size for r in made} == {1}
    assert fill_in_middle.transformed(frame(spark, [])).collect() == []


def test_skip_list_reaches_every_rank():
    draw = random.Random(4)
    for n in (0, 1, 2, 3, 9, 10, 100):
        widths = np.array([draw.randint(1, 9) for _ in range(n)], np.int64)
        lanes = fill_in_middle.SkipList(widths, fan=3)
        assert [lanes.reach(r) for r in range(n + 1)] == [(r, int(widths[:r].sum())) for r in range(n + 1)]


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "http://com", "http://a.com?x=/", "https://Example.COM/en/x?q#f",
    "https://www.example.com/en/", "https://m.www.example.com/en/..", "https://www.example.com/fr/", "https://myexample.com/en/1",
    "ftp://x.net/es/1", "ftp://net/fr/", "http://x.net/en/", "http://x.org/en/", "x://y://example.com/en/", "http://.com/a",
    "http://com./", "http://ÄRGER.com/ü", "http://" + "a." * 5000 + "com/" + "p" * 5000, "http://example.com/EN/", "http://example.com:80/en/",
    "http://a\nb.com/en/\nc",
]


def judged_plainly(url, rules, otherwise="allow"):
    behind = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", behind).group()
    host = raw.translate(str.maketrans(url_filters.UPPER, url_filters.LOWER))
    path = re.match(r"[^?#]*", behind[len(raw) :]).group()
    fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2]) and (r[1] or not host)]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else otherwise


@pytest.mark.parametrize("part_keys", [1, 3, 1000])
def test_url_rules(spark, tmp_path, part_keys):
    more = [("block", "a.com", "/x"), ("allow", "com", "/xyzzy"), ("allow", "twice.org", "/"), ("block", "twice.org", "/"),
            ("block", "ü.de", "/é"), ("block", "", ""), ("block", "one.org", "")]
    urls = [*URLS, "http://b.a.com/xyzzy", "http://twice.org/", "http://ü.de/éa", "http://one.org", "http://2.one.org/?"]
    for name, rules in (("few", url_filters.RULES), ("more", url_filters.RULES + more), ("none", [])):
        manifest = url_filters.write_rules(url_filters.rules_table(spark, rules), f"{tmp_path}/{name}", part_keys)
        pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).repartition(3)
        made = url_filters.judged(pages, manifest).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in made) == Counter(
            (i, *judged_plainly(u, rules)) for i, u in enumerate(urls)
        )


def test_colliding_digests_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(url_filters, "digest", lambda entry: len(entry) % 2)
    rules = url_filters.RULES + [("block", "b.com", "/"), ("allow", "c.com", "/")]
    manifest = url_filters.write_rules(url_filters.rules_table(spark, rules), str(tmp_path))
    assert len({r.first for r in manifest.collect()}) == 1
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "x://b.com/", "x://c.com/"])], "page_id long, url string")
    for r in url_filters.judged(pages, manifest).collect():
        assert (r.host, r.path, r.rule, r.verdict) == judged_plainly(r.url, rules)
