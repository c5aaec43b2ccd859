"""Operators 4 and 6 against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from rallyline.llm import bloom, exact, near, queries
from rallyline.llm.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted_groups(rows):
    """sha-free answer: for each row its normal text, and for each normal text its size and the id that stays."""
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: (len(v), None if min(v)[1] else min(v)[2]) for k, v in groups.items()}


def check_exact(found, rows):
    import hashlib

    groups = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in wanted_groups(rows).items()}
    assert len(found) == len(rows)
    kept = {}
    for r in found:
        size, keep = groups[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (size, keep)
        if r["kept"]:
            assert r["doc_id"] == keep
            kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + 1
    assert kept == dict.fromkeys(groups, 1)


@pytest.fixture(scope="module")
def copies(odd, words):
    rng = random.Random(3)
    base = [" ".join(words[i * 20 : i * 20 + 20]) for i in range(30)]
    rows = odd + [(100 + i, t) for i, t in enumerate(base)]
    rows += [(200 + i, base[0].replace(" ", rng.choice(["  ", "\n", "\t "]))) for i in range(150)]  # a hot group
    return rows + [(400 + i, rng.choice(base)) for i in range(40)]


def test_exact_groups(table_of, copies):
    check_exact(exact.groups(table_of(copies, 5)).collect(), copies)


def test_exact_drop(table_of, copies):
    docs = table_of(copies, 5)
    left = exact.drop_copies(docs)
    assert left.schema == docs.schema
    found = left.collect()
    assert sorted(SPACE.sub("", r["text"] or "") for r in found) == sorted(wanted_groups(copies))
    assert all(r["doc_id"] == wanted_groups(copies)[SPACE.sub("", r["text"] or "")][1] for r in found)


def test_a_small_bitmap_only_sends_more_rows(spark, table_of, copies, monkeypatch):
    monkeypatch.setattr(bloom, "LARGEST", bloom.CHUNK)
    monkeypatch.setattr(bloom, "holds", lambda keys, filled: np.ones(len(keys), bool))
    check_exact(exact.groups(table_of(copies)).collect(), copies)


@pytest.fixture
def small_bitmaps(monkeypatch):
    """Bitmaps with room for 64 keys."""
    monkeypatch.setattr(bloom, "LARGEST", 1 << 10)
    monkeypatch.setattr(bloom, "CHUNK", 1 << 10)


def test_many_ranges_give_the_same_groups(table_of, copies, small_bitmaps):
    docs = table_of(copies, 5)
    assert bloom.ranges_for(len(copies)) > 3
    check_exact(exact.groups(docs).collect(), copies)
    assert sorted(SPACE.sub("", r["text"] or "") for r in exact.drop_copies(docs).collect()) == sorted(wanted_groups(copies))


def test_lone_rows_do_not_shuffle_however_many_they_are(spark, monkeypatch):
    """Ten times the keys that one bitmap has room for, one in ten of them twice."""
    monkeypatch.setattr(bloom, "LARGEST", bloom.CHUNK)
    n = 10 * bloom.LARGEST // bloom.PER_KEY
    rows = spark.range(n).selectExpr("id", "xxhash64(id % int(0.9 * {})) as head".format(n)).repartition(4)
    ranges = bloom.build_ranges(rows, "head", n, least=2)
    assert len(ranges) == 10
    flagged = {r["id"]: r["maybe"] for r in exact._flag(rows, ranges).collect()}
    assert len(flagged) == n
    first = int(0.9 * n)
    lone = range(n - first, first)
    assert all(flagged[i] for i in flagged if i not in lone)
    assert sum(flagged[i] for i in lone) < 0.05 * len(lone)


def test_bitmap_never_loses_a_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 3000)
    twice = keys[:700]
    frame = spark.createDataFrame([(int(k),) for k in [*keys, *twice]], "k long").repartition(4)
    filled = bloom.build(frame, "k", len(keys) + len(twice), least=2).value
    assert bloom.holds(twice, filled).all() and bloom.holds(keys[700:], filled).mean() < 0.1
    once = bloom.build(frame, "k", len(keys), least=1).value
    assert bloom.holds(keys, once).all() and bloom.holds(rng.integers(0, 1 << 62, 1000), once).mean() < 0.1


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows, threshold=0.8):
    """(similar pairs of rows as positions, root position of each row); rows without words are alike."""
    sets = [shingles(t) for _, t in rows]
    alike = []
    for a, b in combinations(range(len(rows)), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] == sets[b] or (either and both >= threshold * either - 1e-9):
            alike.append((a, b))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return alike, [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def near_copies(words):
    """Unrelated texts, chains of small edits, one large group, short texts and shared passages."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(3, 120)))) for i in range(60)]
    for start, n, length, edits in ((1000, 12, 100, 2), (2000, 330, 60, 3), (3000, 8, 400, 8)):
        base = rng.choices(words, k=length)
        for i in range(n):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((start + i, " ".join(own)))
    passage = " ".join(rng.choices(words, k=12))
    rows += [(4000 + i, " ".join(rng.choices(words, k=40)) + " " + passage) for i in range(30)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "a b"), (5004, "a b"), (5005, "a b c"), (5006, rows[0][1]), (5006, rows[0][1])]
    rng.shuffle(rows)
    return rows


def check_near(found, rows):
    alike, root = brute_force(rows)
    ids = [i for i, _ in rows]
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(least.get(r, i), i)
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    sets = [shingles(t) for _, t in rows]
    linked = [0] * len(rows)
    for a, b in alike:
        if sets[a] != sets[b]:
            linked[a] += 1
            linked[b] += 1
    for position, i in enumerate(ids):
        r = by_id[i]
        assert r["class_id"] == least[root[position]], i
        assert r["copies"] == sum(s == sets[position] for s in sets)
        assert r["n_links"] == linked[position], i
        assert r["group_size"] == root.count(root[position])


def test_near_links_and_groups(table_of, near_copies):
    """330 edits of one text fill more than one block of a bucket."""
    check_near(near.join(table_of(near_copies, 4)).collect(), near_copies)


def test_near_links_of_many_ranges(table_of, near_copies, small_bitmaps):
    check_near(near.join(table_of(near_copies[:120], 4)).collect(), near_copies[:120])


def test_near_keep_one(table_of, near_copies):
    docs = table_of(near_copies, 4)
    left = near.keep_one(docs)
    assert left.schema == docs.schema
    _, root = brute_force(near_copies)
    groups = {}
    for (i, _), r in zip(near_copies, root, strict=True):
        groups.setdefault(r, []).append(i)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(min(g) for g in groups.values())


def test_odd_rows(table_of, odd):
    found = near.join(table_of(odd)).collect()
    assert len(found) == len(odd)
    empty = [r for r in found if r["doc_id"] in (1, 2, 3)]
    assert {(r["class_id"], r["copies"], r["n_links"]) for r in empty} == {(1, 4, 0)}
    assert near.keep_one(table_of(odd)).count() == len({shingles(t) for _, t in odd})


def test_empty_tables(table_of):
    none = table_of([])
    assert [f(none).count() for f in (exact.groups, exact.drop_copies, near.join, near.keep_one)] == [0] * 4


def test_banding_reaches_its_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = near.Banding(recall=recall).shape
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("s000", f"s{i:03}") for i in range(1, 200)] + [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    frame = spark.createDataFrame([(a.encode(), b.encode()) for a, b in edges], "a binary, b binary")
    found = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in components(frame).collect()}
    assert set(found) == {x for e in edges for x in e}
    assert all(root == {"p": "p000", "s": "s000", "r": "r0"}[node[0]] for node, root in found.items())


def test_queries(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_exact(queries.op4_exact_dedup(spark, sf_dir).collect(), rows)
    check_near(queries.op6_ngram_jaccard_join(spark, sf_dir).collect(), rows)
