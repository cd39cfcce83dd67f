"""Exact duplicates by chunk recipes, against SQL and plain grouping."""

import hashlib
import random
import re

from helpers import same_rows
from pyspark.sql import functions as F

from breathline.llm import exact_dedup
from breathline.llm.queries import OP12_SQL, op12_exact_dedup


def words(rng, n, stems=("ba", "ke", "lo", "mi", "tu", "sha")):
    return ["".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(n)]


def plain(docs):
    """(doc_id, keep_id, group_size, kept, sha256) of each row; of repeated rows the first stays."""
    groups = {}
    for i, (d, t) in enumerate(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for text, own in groups.items():
        own.sort()
        keep = docs[own[0][3]][0]
        out += [(docs[e[3]][0], keep, len(own), e is own[0], hashlib.sha256(text.encode()).hexdigest()) for e in own]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_sql(spark, sf, duck):
    found = op12_exact_dedup(spark, sf).collect()
    result = duck.execute(OP12_SQL)
    assert same_rows(found, [c[0] for c in result.description], result.fetchall())


def test_plan_has_no_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    recipes = exact_dedup.normalised(docs).select(F.transform(exact_dedup.chunks(F.col("text")), lambda c: exact_dedup.identifier(c, 0)))
    assert not re.search("Python|Pandas|Arrow", recipes._jdf.queryExecution().executedPlan().toString())


def test_odd_rows(odd, odd_rows, empty):
    assert rows(exact_dedup.exact_duplicates(odd)) == plain([r[:2] for r in odd_rows])
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_small_chunks_and_texts_that_share_most(spark):
    """Texts that share nearly all chunks, in another order too, differ."""
    rng = random.Random(8)
    base = words(rng, 400)
    moved = base[200:] + base[:200]
    docs = [(1, " ".join(base)), (2, "\n".join(base)), (3, " ".join(moved)), (4, " ".join(base[:-1])), (5, " ".join([*base, "x"])), (6, " ".join(["x", *base])), (7, "".join(base)), (7, "".join(base)), (0, "  ".join(base))]
    for least, most in ((4, 30), (256, 2_048)):
        assert rows(exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), least, most)) == plain(docs)


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(1)
    text = "".join(words(rng, 9_000, ("ba", "dei", "lu", "it", "qua", "ren", "日本", "é😀")))
    df = spark.createDataFrame([(0, text), (1, "inserted" + text), (2, "日" * 5_000)], "k int, t string")
    own = {r.k: r.c for r in df.select("k", exact_dedup.chunks(F.col("t")).alias("c")).collect()}
    assert "".join(own[0]) == text and "".join(own[1]) == "inserted" + text and "".join(own[2]) == "日" * 5_000
    assert max(map(len, own[0])) <= exact_dedup.MOST + 3 and all(len(c) >= exact_dedup.LEAST for c in own[0][:-1])
    # An insertion moves the cuts near it only.
    assert len(set(own[0]) & set(own[1])) > 0.7 * len(own[0]) > 20


def test_shared_identifiers_are_drawn_again(spark, monkeypatch):
    """Under the first seeds different chunks share identifiers; the result is exact all the same."""
    whole = exact_dedup.identifier
    asked = []

    def weak(chunk, seed):
        asked.append(seed)
        return whole(F.length(chunk) if seed < 2 else chunk, seed)

    monkeypatch.setattr(exact_dedup, "identifier", weak)
    docs = [(1, "abc"), (2, "abd"), (3, "a b c"), (4, "xyz")]
    assert rows(exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)
    assert max(asked) == 2


def test_hot_group(spark, monkeypatch):
    """A group of most rows is joined by a broadcast of its one key."""
    from breathline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    docs = [(i, "the same text" if i % 3 else f"text {i}") for i in range(300)]
    assert rows(exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == plain(docs)
