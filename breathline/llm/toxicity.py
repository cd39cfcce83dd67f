"""Toxicity scores from non-negative positive-unlabelled learning.

A text is the set of its lower-cased words and of their first bytes, hashed. The
features are those that confirmed toxic texts (P) have more often than unlabelled
ones (U), by a z-test on the bounded training sample; the model is linear. Workers
turn the sample's whole texts into features; counts of the hashes and the chosen
features of each row are what reaches the driver. The
weights minimise, by Adam in numpy, the risk estimator

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))    with logistic loss,

in which the prior corrects for the toxic texts among the unlabelled ones. Where
the estimate of the negative risk falls below zero, the step goes back on it. The
prior is the share of toxic rows among the labelled rows that may be learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .hashing import word_hashes
from .langid import held_out

#: Bounds of the sample that the classifier is fitted on: rows of each kind, with their whole texts.
MAX_POSITIVE, MAX_UNLABELLED = 2_000, 6_000
HASH_BITS, PREFIX_BYTES = 20, 5
#: Features: at most so many, with at least this z, in at least so many toxic texts.
MAX_FEATURES, MIN_Z, MIN_TEXTS = 300, 4.0, 3
STEPS, RATE, DECAY = 100, 0.1, 1e-4

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

#: Everything in ASCII but letters separates words.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word starts of all texts in a row, and the text each belongs to."""
    data = [t.lower().encode().translate(_LETTERS) for t in texts]
    whole, counts, start = word_hashes(data, PREFIX_BYTES)
    text = np.repeat(np.arange(len(texts)), counts)
    both = np.concatenate([whole, start]) >> np.uint64(64 - HASH_BITS)
    return both.astype(np.int64), np.concatenate([text, text])


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs."""
    found = []
    at = 0
    for a, b in slices(texts, 500_000):
        feature, text = features(texts[a:b])
        found.append(np.unique((text + at) << HASH_BITS | feature))
        at += b - a
    pairs = np.concatenate(found) if found else np.empty(0, np.int64)
    return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


def choose(hashes: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """The hashes that P has clearly more often than U, from the number of texts with each."""
    pooled = (in_p + in_u + 1) / (n_p + n_u + 2)
    z = (in_p / n_p - in_u / n_u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    by = np.lexsort((hashes, -z))
    by = by[(z[by] >= MIN_Z) & (in_p[by] >= MIN_TEXTS)]
    return hashes[by[:MAX_FEATURES]]


def minimise(text: np.ndarray, column: np.ndarray, k: int, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Weights of k features and, last, the bias: (text, column) are the features of the texts, those of P first."""
    n = n_p + n_u
    p = np.arange(n) < n_p
    w = np.append(np.zeros(k), _base(prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        g = np.bincount(text, weights=w[column], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss = np.logaddexp(0, g)  # of a negative answer; its slope is s, that of a positive one s - 1
        slope = np.empty(n)
        if loss[~p].mean() - prior * loss[p].mean() >= 0:
            slope[p], slope[~p] = -prior / n_p, s[~p] / n_u
        else:
            slope[p], slope[~p] = prior * s[p] / n_p, -s[~p] / n_u
        gradient = np.append(np.bincount(column, weights=slope[text], minlength=k) + DECAY * w[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def _base(prior: float) -> float:
    """The bias that nothing but the prior gives."""
    return float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))


def logits(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    """Each feature counts once in a text; an empty text has the bias alone."""
    feature, text = features(texts)
    hit = weights[feature] != 0
    pairs = np.unique(text[hit] << HASH_BITS | feature[hit])
    return np.bincount(pairs >> HASH_BITS, weights=weights[pairs & ((1 << HASH_BITS) - 1)], minlength=len(texts)) + bias


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of every hash, bias), fitted on rows that aren't held out: bounded samples of
    rows, in order of a hash of doc_id; of rows that share an id the least text counts.
    """
    spark = docs.sparkSession
    rows = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic is not null")
    usable = rows.where(~held_out("doc_id", 5, 0))
    prior = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))

    def first(ids: DataFrame, n: int) -> list:
        """The n ids that come first by hash; a first cut keeps what each task hands on small."""
        ids = ids.select("doc_id").distinct()
        share = min(1.0, 4 * n / max(1, ids.count()))
        for limit in (int(share * (1 << 40)), 1 << 40):
            found = ids.where(place < F.lit(limit)).orderBy(place, "doc_id").limit(n).collect()
            if len(found) == n or limit == 1 << 40:
                break
        return [r.doc_id for r in found]

    positive = first(usable.where("toxic = 1").join(texts.select("doc_id"), "doc_id", "left_semi"), MAX_POSITIVE)
    unlabelled = first(texts.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)), MAX_UNLABELLED)
    weights, bias = np.zeros(1 << HASH_BITS, np.float32), _base(prior)
    if not positive or not unlabelled or not 0 < prior < 1:
        return weights, bias

    # At most MAX_POSITIVE + MAX_UNLABELLED ids.
    few = F.broadcast(spark.createDataFrame([(d, True) for d in positive] + [(d, False) for d in unlabelled], "doc_id long, toxic boolean"))
    sample = texts.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sets, path = materialise(sample.mapInArrow(_feature_sets, "doc_id long, toxic boolean, features array<int>"), "toxic-features")
    marks = F.col("toxic").cast("long")
    counts = sets.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum(marks).alias("p"), F.sum(1 - marks).alias("u")).where(F.col("p") >= MIN_TEXTS)
    found = np.array(counts.collect(), np.int64).reshape(-1, 3)  # at most 2 ** HASH_BITS rows
    chosen = np.sort(choose(*found.T, len(positive), len(unlabelled)))
    own = F.array_intersect("features", F.lit(chosen.tolist()).cast("array<int>")) if len(chosen) else F.array().cast("array<int>")
    # MAX_FEATURES numbers a row.
    kept = sorted(sets.select("toxic", "doc_id", own.alias("features")).collect(), key=lambda r: (not r.toxic, r.doc_id))
    discard(spark, path)
    text = np.repeat(np.arange(len(kept)), [len(r.features) for r in kept])
    column = np.searchsorted(chosen, np.array([f for r in kept for f in sorted(r.features)], np.int64))
    w = minimise(text, column, len(chosen), len(positive), len(unlabelled), prior)
    weights[chosen] = w[:-1]
    return weights, float(w[-1])


def _feature_sets(batches):
    """Distinct features of every whole text."""
    for batch in batches:
        text, feature = _sets(batch.column("text").to_pylist())
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), sets], ["doc_id", "toxic", "features"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every whole text; a null text is empty.

    Without toxic labels to learn from, all scores are about 0. Repeated rows get
    the same score, and rows with a null id are scored, though never learned from.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # 2 ** HASH_BITS weights

    def run(batches):
        weights, bias = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            g = np.concatenate([logits(texts[a:b], weights, bias) for a, b in slices(texts)] or [np.empty(0)])
            s = 1 / (1 + np.exp(-np.clip(g, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
