"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

Units are the bytes of the text, so an n-gram of up to 7 bytes is one 64-bit
number; its context is the number shifted by 8 bits, its lower order a mask. The
model is counted over all trusted texts. Counts, continuation counts and context
sums are tables that stay distributed, and the distinct n-grams of the documents
meet them in joins sharded by n-gram; only tables that the byte alphabet bounds
(orders 1 and 2) are broadcast.

Documents are dealt to buckets of bounded size, written once with compressed texts. A bucket asks
for each of its distinct n-grams once, whatever its number of documents, gets the
log-probabilities back, and sums them per document. A document is kept where its
perplexity is within the threshold of its language: the quantile of trusted texts of
the language that were not counted, drawn towards the quantile of all languages as
if ``PRIOR_TEXTS`` more texts had that one. The rule is the same at every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices
from .langid import held_out

ORDER = 4
#: Quantile of a language's trusted held-out perplexities up to which documents are kept;
#: a twentieth of these texts may be odd without setting the threshold.
QUANTILE = 0.95
#: Texts that the quantile of all languages counts for in a language's threshold.
PRIOR_TEXTS = 20
#: Bytes of text that a bucket starts within.
BUCKET_BYTES = 1 << 25
BROADCAST_ROWS = 1_000_000
#: Characters of text in a compressed block.
BLOCK_CHARS = 1 << 19
START, END = b"\x02", b"\x03"

SCHEMA = "doc_id long, lang string, perplexity double, threshold double, kept boolean"


def ngrams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts in a row, one for each byte and the end sign, and how many each text has."""
    data = np.frombuffer(b"".join(START * (order - 1) + t + END for t in texts), np.uint8).astype(np.int64)
    grams = np.zeros(len(data) - order + 1, np.int64)
    for k in range(order):
        grams |= data[k : k + len(grams)] << (8 * (order - 1 - k))
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes + order - 1) - sizes - order + 1
    return grams[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(inverse, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def _packed(docs: DataFrame) -> DataFrame:
    """Non-empty texts in buckets of what a task read in a row, many in one compressed block a row.

    bucket, doc_ids, langs, trusted, sizes (bytes of each text), packed. All texts of a
    block are alike trusted, so that counting reads only blocks it needs.
    """
    names = ["bucket", "kind", "doc_ids", "langs", "sizes", "packed"]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def run(batches):
        import zstandard

        first, read, z = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=9)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "trusted", "text"))))
            out = []
            for kind in (0, 1, 2):
                own = [r for r in rows if r[2] == kind and r[3]]
                for a, b in slices([r[3] for r in own], BLOCK_CHARS):
                    texts = [r[3].encode() for r in own[a:b]]
                    sizes = list(map(len, texts))
                    bucket, read = first + read // BUCKET_BYTES, read + sum(sizes)
                    out.append((bucket, kind, [r[0] for r in own[a:b]], [r[1] for r in own[a:b]], sizes, z.compress(b"".join(texts))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return docs.mapInArrow(run, "bucket long, kind int, doc_ids array<long>, langs array<string>, sizes array<long>, packed binary")


def _unpack(packed: bytes, sizes: list[int]) -> list[bytes]:
    import zstandard

    data, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(sizes)
    return [data[e - n : e] for e, n in zip(ends, sizes)]


def _counted(packed: DataFrame, order: int, with_bucket: bool) -> DataFrame:
    """(gram, n) of each task, or (bucket, gram) if asked for."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts = held.setdefault(r["bucket"] if with_bucket else 0, [])
                texts = _unpack(r["packed"], r["sizes"])
                for a, b in slices(texts):
                    parts.append(np.unique(ngrams(texts[a:b], order)[0], return_counts=True))
                    if len(parts) >= 8:
                        parts[:] = [_distinct(parts)]
        for bucket, parts in held.items():
            grams, n = _distinct(parts)
            other = pa.array(np.full(len(grams), bucket, np.int64)) if with_bucket else pa.array(n)
            yield pa.RecordBatch.from_arrays([pa.array(grams), other], ["gram", "bucket" if with_bucket else "n"])

    return packed.select("bucket", "sizes", "packed").mapInArrow(run, "gram long, bucket long" if with_bucket else "gram long, n long")


def model(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame, tuple[float, float, float], str]]:
    """By order from 1: n-gram counts, context sums, discounts, path of the written counts."""
    levels = []
    own = counts
    for k in range(order, 0, -1):
        if k < order:  # continuation counts: distinct n-grams of the next order that end so
            own = levels[-1][0].groupBy(F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")).agg(F.count("*").alias("n"))
        own, path = materialise(own, f"order-{k}")
        n = own.agg(*(F.sum((F.col("n") == j).cast("long")).alias(f"n{j}") for j in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (max(1, x or 0) for x in n)
        y = n1 / (n1 + 2 * n2)
        discounts = tuple(min(max(j - (j + 1) * y * b / a, 0.05), j - 0.05) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        kinds = [F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long")), F.sum((F.col("n") > 2).cast("long"))]
        back = sum((x * d for x, d in zip(kinds, discounts)), F.lit(0.0))
        contexts = own.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), back.alias("back"))
        levels.append((own, contexts, discounts, path))
    return levels[::-1]


def log_probabilities(grams: DataFrame, levels: list, order: int) -> DataFrame:
    """(gram, logp) of distinct n-grams: one join by n-gram and one by context for each order."""
    out = grams.withColumn("p", F.lit(1 / 256))
    for k, (own, contexts, (d1, d2, d3), _) in enumerate(levels, 1):
        mask = (1 << (8 * k)) - 1
        own, contexts = own.withColumnRenamed("gram", "key"), contexts.withColumnRenamed("context", "above")
        if k <= 2:  # at most 256 and 65,536 rows
            own, contexts = F.broadcast(own), F.broadcast(contexts)
        out = out.join(own, F.col("gram").bitwiseAND(mask) == F.col("key"), "left").drop("key")
        out = out.join(contexts, F.shiftright(F.col("gram").bitwiseAND(mask), 8) == F.col("above"), "left").drop("above")
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        seen = F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(F.coalesce(seen, F.lit(0.0)) + F.col("back") / F.col("total") * F.col("p"))
        out = out.select("gram", p.alias("p"))
    return out.select("gram", F.log("p").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, calibrating, perplexity of every row; null perplexity for empty texts.

    Trusted rows are those labelled quality 1; a fifth of them, by crc32 of doc_id,
    is not counted and calibrates the thresholds. Repeated rows are counted and scored
    each; rows with a null doc_id are never trusted.
    """
    spark = docs.sparkSession
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.lit(True).alias("t")).distinct()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(text as string) text")
    kind = F.when(F.col("t").isNull(), 0).when(held_out("doc_id", 5, 0), 2).otherwise(1)
    marked = rows.join(few, rows.doc_id == F.col("id"), "left").withColumn("trusted", kind).select("doc_id", "lang", "text", "trusted")
    packed, packed_path = materialise(_packed(marked), "packed-texts")
    counts = _counted(packed.where("kind = 1"), order, False).groupBy("gram").agg(F.sum("n").alias("n"))
    levels = model(counts, order)
    asked, asked_path = materialise(_counted(packed, order, True), "asked")
    logs, logs_path = materialise(log_probabilities(asked.select("gram").distinct(), levels, order), "log-probabilities")
    answers = asked.join(logs, "gram").select("bucket", "gram", "logp")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of one bucket's documents; its texts are what one task read."""
        grams, logp = right.column("gram").to_numpy(), right.column("logp").to_numpy()
        by = np.argsort(grams)
        grams, logp = grams[by], logp[by]
        doc_ids, langs, kinds, out = [], [], [], []
        for r in left.to_pylist():
            doc_ids += r["doc_ids"]
            langs += r["langs"]
            kinds += [r["kind"]] * len(r["sizes"])
            texts = _unpack(r["packed"], r["sizes"])
            for a, b in slices(texts):
                own, sizes = ngrams(texts[a:b], order)
                values = logp[np.searchsorted(grams, own)]
                out.append(np.exp(-np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes))
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(np.concatenate(out))], ["doc_id", "lang", "trusted", "perplexity"])

    scored = packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(total, "doc_id long, lang string, trusted int, perplexity double")
    empty = rows.where("text is null or text = ''").select("doc_id", "lang", F.lit(0).alias("trusted"), F.lit(None).cast("double").alias("perplexity"))
    result, _ = materialise(scored.unionByName(empty), "perplexities")
    discard(spark, packed_path, asked_path, logs_path, *(path for *_, path in levels))
    return result.select("doc_id", "lang", (F.col("trusted") == 2).alias("calibrating"), "perplexity")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """Perplexity of every row against the threshold of its language.

    A language without calibrating texts, or a null one, takes the threshold of all.
    Empty and null texts have no perplexity and are not kept. Repeated rows are scored
    and count each; a perplexity equal to the threshold is kept. Without trusted texts
    there is no threshold and all other rows are kept.
    """
    found = perplexities(docs, labels, order)
    sample = found.where("calibrating and perplexity is not null")
    at = F.percentile_approx("perplexity", quantile, 100_000)
    overall = F.lit(sample.agg(at).first()[0]).cast("double")
    n = F.col("n")
    own = sample.where("lang is not null").groupBy("lang").agg(at.alias("own"), F.count("*").alias("n"))
    own = own.select("lang", F.exp((n * F.log("own") + PRIOR_TEXTS * F.log(overall)) / (n + PRIOR_TEXTS)).alias("own"))
    judged = found.join(own, "lang", "left").withColumn("threshold", F.coalesce("own", overall))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return judged.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
