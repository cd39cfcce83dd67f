"""Near-duplicate classes against all pairs."""

import random
import re
from itertools import combinations

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from breathline.llm import queries
from breathline.llm.components import components
from breathline.llm.neardup import _Forest, keep_one, near_duplicates, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(rng, n):
    return ["".join(rng.choices(("ba", "ke", "lo", "mi", "tu", "sha"), k=rng.randint(1, 3))) for _ in range(n)]


def brute(rows, k):
    """Component of every (doc_id, text) by comparing all pairs of exact shingle sets."""
    sets = []
    for _, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, s), (b, t) in combinations(zip((d for d, _ in rows), sets), 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(d, len(s), find(d)) for (d, _), s in zip(rows, sets)]


@pytest.mark.parametrize("k", [4, 5])
def test_classes_equal_all_pairs(spark, k):
    rng = random.Random(k)
    texts = []
    for _ in range(12):
        base = make(rng, rng.randint(2, 150))
        for _ in range(rng.randint(1, 25)):
            t = base[:]
            for _ in range(rng.randint(0, max(1, len(t) // 25))):
                t[rng.randrange(len(t))] = make(rng, 1)[0]
            texts.append(" ".join(t) if rng.random() < 0.8 else "\t".join(t).upper())
    texts += [None, "", " \n", "one", "one", "two words", "Two  Words", "Ä b c", "ä b c"]
    rng.shuffle(texts)
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, k))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_lists_and_clusters_use_blocks(spark, monkeypatch):
    from breathline.llm import neardup

    monkeypatch.setattr(neardup, "LIST_BLOCK", 7)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 5)
    rng = random.Random(9)
    base = make(rng, 120)
    rows = []
    for i in range(70):
        t = base[:]
        for _ in range(3):
            t[rng.randrange(len(t))] = f"w{rng.random()}"
        rows.append((i, " ".join(t)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4))


def near_copies(rng, n, edits=1):
    base = make(rng, 120)
    for i in range(n):
        t = base[:]
        for _ in range(edits):
            t[rng.randrange(len(t))] = f"w{rng.random()}"
        yield i, " ".join(t)


@pytest.mark.parametrize("n", [200, 800])
def test_copies_of_members_grow_with_a_list(spark, monkeypatch, n):
    """Rows dealt to blocks: each member once and the leader once a block, and nothing is left to a second pass."""
    from breathline.llm import neardup

    for name in ("LIST_BLOCK", "CLUSTER_BLOCK"):
        monkeypatch.setattr(neardup, name, 10)
    dealt, spanning = [], neardup._spanning
    monkeypatch.setattr(neardup, "_spanning", lambda rows, linked: dealt.append((linked, rows.count(), rows.groupBy("key").count().agg({"count": "max"}).first()[0])) or spanning(rows, linked))
    got = near_duplicates(spark.createDataFrame(list(near_copies(random.Random(1), n)), "doc_id long, text string"), words=4).collect()
    assert {r.component_id for r in got} == {0}
    texts = [rows for linked, rows, _ in dealt if isinstance(linked, neardup._FullSets)]
    longest = [most for linked, _, most in dealt if isinstance(linked, neardup._Collisions)]
    assert len(texts) == 1 and len(longest) == 1
    assert texts[0] <= 1.2 * n + 2 and longest[0] <= 1.2 * n + 2


def test_rest_of_a_list_is_compared_with_all_blocks(spark, monkeypatch):
    """A list whose members fall into chains that meet across blocks only."""
    from breathline.llm import neardup

    for name in ("LIST_BLOCK", "CLUSTER_BLOCK", "REST_BLOCK"):
        monkeypatch.setattr(neardup, name, 4)
    rng = random.Random(2)
    rows, base = [], make(rng, 100)
    for i in range(60):  # each text is near the one before, and far from most
        base = base[:]
        for j in range(2):
            base[(7 * i + 3 * j) % 100] = f"c{i}x{j}"
        rows.append((i, " ".join(base)))
    rows += [(100 + i, t) for i, t in near_copies(rng, 30, 3)]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4))


def test_keep_one_of_repeated_ids_and_clashing_names(spark):
    a, b, c = (" ".join(make(random.Random(k), 30)) for k in range(3))
    rows = [(1, a, "x", 1), (1, a, "w", 2), (1, b, "v", 3), (2, a, "u", 4), (3, c, "t", 5), (3, c, "t", 5), (None, a, "s", 6), (4, None, "r", 7), (4, None, "q", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, N_rows long")
    out = keep_one(docs)
    assert out.columns == docs.columns
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted([(1, a, "w", 2), (1, b, "v", 3), (3, c, "t", 5), (None, a, "s", 6), (4, None, "q", 8)], key=key)


def test_equals_sql(spark, sf, duck):
    rows = queries.queries()["op5_minhash_near_dedup"](spark, sf).collect()
    result = duck.execute(queries.oracle_sql()["op5_minhash_near_dedup"])
    assert same_rows(rows, [c[0] for c in result.description], result.fetchall())


def test_odd_rows(odd, odd_rows, empty):
    rows = near_duplicates(odd, words=4).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert {by[k].component_id for k in (6, 7, 8, 9, 10)} == {6}
    assert all(by[k].n_shingles == 0 and by[k].component_id == k for k in (0, 1, 2, 3))
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 6, 11, 12] and None in ids
    assert near_duplicates(empty).count() == 0 and keep_one(empty).count() == 0


@pytest.mark.parametrize("hot_rows", [100_000, 3])
def test_components(spark, monkeypatch, hot_rows):
    """With hubs split off too."""
    from breathline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(common, "HOT", 30)
    links = [(i, i + 1) for i in range(60)] + [(200, 100), (150, 100), (7, 7)] + [(300, 310 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100} | {300: 300} | {310 + i: 300 for i in range(40)}


def test_hot_keys_are_split_off(spark, monkeypatch):
    from breathline.llm import common

    rows = spark.createDataFrame([(k, i) for k in range(20) for i in range(60 if k == 3 else 2)] + [(99, 0)], "k long, i long")
    keyed = rows.where("k < 15").groupBy("k").count().withColumn("x", F.col("k") * 10)
    want = sorted(map(tuple, rows.join(keyed, "k", "left").collect()), key=repr)
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT", 5)
    assert common.has_hot(keyed, "count", 99)
    assert sorted(map(tuple, common.with_hot(rows, keyed, "k", "count", 99, "left").collect()), key=repr) == want


def test_sets_are_of_words():
    a, b, c = shingle_sets(["A b C d e", "a  b\tc\nd e", "a b c"], 4)
    assert a.tolist() == b.tolist() and len(a) == 2 and len(c) == 1
    assert len(shingle_sets([None], 4)[0]) == 0


def test_forest():
    import numpy as np

    f = _Forest(np.array([5, 9, 5, 7]))
    f.join(0, np.array([3]))
    assert sorted(zip(*(x.tolist() for x in f.stars(np.array([5, 9, 5, 7]))))) == [(7, 5)]


def test_many_texts_of_one_id(spark):
    """Chunks under one doc_id, short and different: work grows with their number, near copies are found."""
    import time

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    texts = [" ".join(word() for _ in range(12)) for _ in range(5_000)]
    copies = [" ".join([*texts[k].split(), "tail"]) for k in range(0, 5_000, 500)]
    rows = [(7, t) for t in texts] + [(1_000 + k, t) for k, t in enumerate(copies)] + [(9_000, texts[1]), (9_001, word())]
    began = time.time()
    found = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id > 7").collect()}
    assert time.time() - began < 200
    assert all(found[1_000 + k].component_id == 7 for k in range(10)) and found[9_000].component_id == 7 and found[9_001].kept
