"""Ranked search, against SQL and a plain scan."""

import random

import duckdb
import numpy as np
import pytest
from helpers import same_rows

from breathline.llm import lexical
from breathline.llm.queries import OP11_SQL, op11_ranked_search


def words(rng, n, stems=("ba", "ke", "lo", "mi", "tu", "sha")):
    return ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n)]


def plain(docs, items, k=10):
    """Every document scored for every item, as the contract says it."""
    counted = [(d, lexical.words(t)) for d, t in docs if t and lexical.words(t)]
    n_docs, n_terms = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(lexical.words(text))
    out = []
    for item, own in terms.items():
        scored = []
        for d, w in counted:
            m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
            s = sum(lexical.weight(n_docs, df[t]) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 8 * m)) for t in own if t in w)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda e: e[:3])[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_sql(spark, sf, duck):
    found = op11_ranked_search(spark, sf).collect()
    result = duck.execute(OP11_SQL)
    assert same_rows(found, [c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("chars,window,group", [(4_000_000, 256, 200_000), (300, 3, 150)])
def test_equals_plain_scan(spark, monkeypatch, chars, window, group):
    """Small shards and windows, many ties and repeated rows, several groups of items."""
    for name, value in (("SHARD_CHARS", chars), ("WINDOW", window), ("GROUP_TERMS", group)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.choice([1, 3, 8, 20, 60]))) for _ in range(150)]
    docs = [(rng.randint(0, 200), t) for t in texts] + [(9, texts[0]), (9, texts[0]), (None, texts[0]), (None, "!"), (3, None), (4, "")]
    items = [(i, " ".join(words(rng, rng.choice([1, 4, 25])))) for i in range(12)] + [(3, texts[0]), (50, "nowhere"), (51, None), (None, texts[5])]
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == plain(docs, items)


def test_odd_rows(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([("b", 1, odd_rows[6][1]), ("b", 2, "überall"), ("c", 3, odd_rows[12][1])], "item_id string, score int, text string")
    assert rows(lexical.search(odd, items)) == plain([r[:2] for r in odd_rows], [(r.item_id, r.text) for r in items.collect()])
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("a bb ccc dddd eeeee ffffff", "x" * 40, " ", "ab " * 20, "aaaaaaaaaaaa b"):
        assert [w for p in lexical.pieces(text) for w in lexical.words(p)] == lexical.words(text)


def test_pivots_are_few(spark):
    """Lists below the pivot are read at pivots only; most documents are never scored."""
    n = 4_000
    common = np.arange(n), np.full(n, 10), 10
    rare = np.arange(0, n, 400), np.full(n // 400, 1_000), 1_000
    heap = []
    scored = lexical.wand([common, rare], heap, 5, list(range(n)))
    assert scored < lexical.WINDOW + n // 400 + 1
    assert heap == [(1_010, d) for d in (0, 400, 800, 1200, 1600)]


def test_integer_scores_match_duckdb_doubles():
    con = duckdb.connect()
    for n, df in ((10, 1), (51_282, 33), (10**9, 123_456_789), (7, 7)):
        assert con.execute(f"SELECT floor(1000 * ln((2 * {n} + 2)::DOUBLE / (2 * {df} + 1)))::BIGINT").fetchone()[0] == lexical.weight(n, df)
