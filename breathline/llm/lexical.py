"""Ranked lexical search: WAND within shards of documents, shard heaps merged.

1. Every task cuts its documents into shards and writes an inverted index of each: for
   every term of the items, the shard's documents that hold it and how often. Corpus
   counts (documents, terms, documents of a term) are sums over the index.
2. With the counts, a shard's postings become impacts, and a term has a maximum impact
   there. An item's lists are walked together through windows of documents. The pivot is
   chosen from the maximum impacts: the lists before it can't reach the worst score of the
   item's heap, so documents that only they hold are skipped unread. Of the others, the
   pivot documents are those at which the maxima of the lists that hold them, and of those
   before the pivot, reach that score; the lists before the pivot jump from one to the
   next and give up on each as soon as it can't get there. A task keeps an item's heap
   from window to window and shard to shard, so later shards are skipped mostly.
3. The heaps of all tasks, k rows an item each, are merged by rank.

A shard is one row of the written index, bounded by its text. The items' terms are a
stated query set: they are broadcast in groups of bounded size, each with its own index.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from .common import discard, materialise
from .decontam import words

#: Terms of the items that are broadcast at a time; an item is never cut.
GROUP_TERMS = 200_000
#: Text of a shard, and of what is split into terms at a time.
SHARD_CHARS, PIECE = 4_000_000, 1_000_000

INDEX = "doc_id array<long>, n array<long>, term array<int>, size array<int>, at array<int>, tf array<int>"
#: Documents of a window while a heap isn't full; later, a window is what is left of a shard.
WINDOW = 256


def pieces(text: str) -> Iterator[str]:
    """The text in pieces that end before a blank, where it is long; no term is cut."""
    start = 0
    while len(text) - start > PIECE:
        cut = text.find(" ", start + PIECE)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


class _Shard:
    """Postings of the documents added, until they are given out as one row of the index."""

    def __init__(self, number: dict[bytes, int]):
        self.number, self.chars = number, 0
        self.doc_ids: list[int | None] = []
        self.n: list[int] = []
        self.terms: list[int] = []
        self.tf: list[int] = []
        self.held: list[int] = []  # postings of each document

    def add(self, doc_id: int | None, text: str) -> None:
        n, counts = 0, Counter()
        for piece in pieces(text):
            own = words(piece)
            n += len(own)
            counts.update(map(self.number.get, own))
        self.chars += len(text)
        if not n:
            return
        counts.pop(None, None)
        self.doc_ids.append(doc_id)
        self.n.append(n)
        self.terms.extend(counts.keys())
        self.tf.extend(counts.values())
        self.held.append(len(counts))

    def row(self) -> pa.RecordBatch:
        """Documents by id, null last; postings by term and document."""
        ids = np.array([0 if d is None else d for d in self.doc_ids], np.int64)
        by = np.lexsort((ids, [d is None for d in self.doc_ids]))
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        terms, at = np.array(self.terms, np.int32), np.repeat(place, self.held)
        order = np.lexsort((at, terms))
        present, sizes = np.unique(terms, return_counts=True)
        columns = [pa.array([[self.doc_ids[i] for i in by]], pa.list_(pa.int64()))]
        for values, kind in ((np.array(self.n, np.int64)[by], pa.int64()), *((v.astype(np.int32), pa.int32()) for v in (present, sizes, at[order], np.array(self.tf, np.int32)[order]))):
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind)))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "term", "size", "at", "tf"])


def wand(lists: list[tuple[np.ndarray, np.ndarray, int]], heap: list, k: int, ids: list) -> int:
    """Puts a shard's documents that belong among the k best on the heap; the number of documents that were pivots.

    A list has a term's documents in ascending order, their impacts, and the largest of
    them. The heap is in order: score, its best first, then smaller ids, null ones last.
    """
    lists = sorted(lists, key=lambda x: x[2])
    reach = np.cumsum([most for *_, most in lists])
    start = scored = 0
    while start < len(ids):
        full = len(heap) == k
        floor = 1
        if full:
            worst, worst_id = heap[-1]
            # Ids ascend: where none that comes is smaller than the worst one's, equal scores don't count.
            floor = worst + (ids[start] is None or worst_id is not None and worst_id <= ids[start])
        # Lists before the pivot can't bring a document to the floor, not all of them together.
        pivot = int(np.searchsorted(reach, floor))
        if pivot == len(lists):
            break
        end = len(ids) if full else min(len(ids), start + WINDOW)
        ahead = lists[pivot:]
        if start or end < len(ids):
            cuts = [np.searchsorted(docs, [start, end]) for docs, *_ in ahead]
            ahead = [(docs[a:b], impact[a:b], most) for (docs, impact, most), (a, b) in zip(ahead, cuts)]
        at = np.concatenate([docs for docs, *_ in ahead]) - start
        own, bound = np.zeros((2, end - start), np.int64)
        np.add.at(own, at, np.concatenate([impact for _, impact, _ in ahead]))
        np.add.at(bound, at, np.repeat([most for *_, most in ahead], [len(docs) for docs, *_ in ahead]))
        rest = int(reach[pivot - 1]) if pivot else 0
        at = np.flatnonzero((bound > 0) & (bound >= floor - rest))
        scored += len(at)
        score = own[at]
        for j in range(pivot - 1, -1, -1):  # jumps to the pivots left
            keep = score >= floor - reach[j]
            at, score = at[keep], score[keep]
            if not len(at):
                break
            docs, impact, _ = lists[j]
            place = docs.searchsorted(at + start)
            held = docs.take(place, mode="clip") == at + start
            score = score + held * impact.take(place, mode="clip")
        keep = score >= floor
        found = [(x, ids[d + start]) for d, x in zip(at[keep].tolist(), score[keep].tolist())]
        if found:
            heap[:] = sorted([*heap, *found], key=lambda e: (-e[0], e[1] is None, e[1] or 0))[:k]
        start = end
    return scored


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    A document is a row; null and empty texts have no terms, count nowhere and are never
    found. Repeated rows count and rank each; a null doc_id is kept, last among equal
    scores. Rows of one item_id are one item with the terms of all their texts; a null
    item_id is an item. Items whose terms occur nowhere give no rows. Long texts are split
    into terms piece by piece. Only doc_id, item_id and text are read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    own = items.selectExpr("item_id", "cast(text as string) text")
    found = StructType().add("item_id", items.schema["item_id"].dataType).add("doc_id", LongType()).add("score", LongType())
    # A term and what ends it have two characters at least.
    most = own.agg(F.sum(F.floor(F.length("text") / 2) + 1)).first()[0] or 0
    n_groups = max(1, -(-most // GROUP_TERMS))
    results, indexes = None, []
    for g in range(n_groups):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == g).collect()  # bounded by GROUP_TERMS
        terms: dict = {}
        for item_id, text in rows:
            terms.setdefault(item_id, set()).update(words(text))
        number = {t: i for i, t in enumerate(sorted(set().union(*terms.values())))}
        index, path = materialise(_index(docs, number), "lexical-index")
        indexes.append(path)
        part = _group(index, [(item, sorted(number[t] for t in own_terms)) for item, own_terms in terms.items()], found, k)
        results = part if results is None else results.unionByName(part)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best, _ = materialise(ranked.select("item_id", "rank", "doc_id", "score"), "lexical-best")
    discard(spark, *indexes)
    return best


def _index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """One row a shard: its documents with their numbers of terms, and the postings of the numbered terms."""
    sent = docs.sparkSession.sparkContext.broadcast(number)

    def build(batches):
        shard = _Shard(sent.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shard.add(doc_id, text.as_py() or "")
                if shard.chars >= SHARD_CHARS:
                    if shard.n:
                        yield shard.row()
                    shard = _Shard(sent.value)
        if shard.n:
            yield shard.row()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(build, INDEX)


def _group(index: DataFrame, items: list[tuple[object, list[int]]], found: StructType, k: int) -> DataFrame:
    """The k best documents of each item in each task."""
    size = index.agg(F.sum(F.size("doc_id")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
    n_docs, n_terms = size.docs or 0, size.terms or 0
    held = index.select(F.explode(F.arrays_zip("term", "size")).alias("p")).groupBy(F.col("p.term").alias("term")).agg(F.sum(F.col("p.size").cast("long")).alias("df"))
    weights = {r.term: weight(n_docs, r.df) for r in held.collect()}  # the terms of a group
    types = to_arrow_schema(found)
    sent = index.sparkSession.sparkContext.broadcast((items, weights))

    def find(batches):
        own_items, own_weights = sent.value
        heaps: list[list] = [[] for _ in own_items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, term, size_of, at, tf = (batch.column(c)[r].values for c in ("doc_id", "n", "term", "size", "at", "tf"))
                ids, term, at, tf = ids.to_pylist(), term.to_pylist(), at.to_numpy(), tf.to_numpy().astype(np.int64)
                scale = np.array([100 - 90 + (90 * x * n_docs) // n_terms for x in n.to_pylist()], np.int64)
                ends = np.cumsum(size_of.to_numpy())
                share = (1_000_000_000 * tf) // (1000 * tf + 8 * scale[at])
                impact = np.repeat([own_weights[t] for t in term], size_of.to_numpy()) * share
                starts = dict(zip(term, zip((ends - size_of.to_numpy()).tolist(), ends.tolist())))
                lists: dict[int, tuple[list[int], list[int], int]] = {}
                for heap, (_, terms) in zip(heaps, own_items):
                    mine = []
                    for t in terms:
                        if t not in starts:
                            continue
                        if t not in lists:
                            a, b = starts[t]
                            lists[t] = at[a:b], impact[a:b], int(impact[a:b].max())
                        mine.append(lists[t])
                    if mine:
                        wand(mine, heap, k, ids)
        out = [(item, doc_id, score) for heap, (item, _) in zip(heaps, own_items) for score, doc_id in heap]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], schema=types)

    return index.mapInArrow(find, found)
