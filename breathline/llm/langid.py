"""Language ID by compression.

Texts are lower-cased. Every learned language has a raw-content zstandard dictionary: pieces of a
bounded sample of its labelled texts. A text is cut into blocks; every block is
compressed with every dictionary, and the language with the smallest total wins. Where the
runner-up needs hardly more bytes, as with short texts, whose sizes tie to the byte,
the languages are compared by finer sizes: bits under byte trigrams of the same
dictionaries. The answer is rejected where these hardly differ either.

How narrow a margin may be is calibrated on further pieces of labelled rows: the widest
limit below which answers are at least as often wrong as right.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, release

#: The sample: texts of a language in order of a hash, up to so many, a piece of so many
#: characters at a hash-chosen place of each, up to so many bytes in all; all dictionaries
#: together have at most so many. Documented bounds of the fitted classifier.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES, TOTAL_BYTES = 400, 300, 1 << 17, 1 << 26
#: Further texts of a language, and of all, whose pieces calibrate the margin.
CALIBRATION_TEXTS, CALIBRATION_ROWS = 250, 2_000
#: A language's texts are ranked in so many parts, by hash, and so many of a part go on.
SAMPLE_PARTS, PART_TEXTS = 64, 48
#: Bytes of text that are compressed on their own.
BLOCK_BYTES = 1_024
LEVEL = 6
#: Limits to choose from: an answer is rejected if the runner-up needs less than this share of
#: bytes, then of bits, more.
MARGINS = (0.002, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02)

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32(doc_id as text) mod ``modulus`` is ``remainder``; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@dataclass
class Model:
    dictionaries: dict[str, bytes]
    min_margin: float = MARGINS[0]


def learn(docs: DataFrame) -> Model:
    """Dictionaries and margin from text and non-null lang of the rows that aren't held out.

    Only pieces of sampled texts reach the driver. All languages are learned; where they
    are so many that dictionaries would pass TOTAL_BYTES, each is cut to its share.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "cast(text as string) text").where(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & (F.length("text") > 0))
    # Text is cut before the sort: a document offers one piece, wherever in the text.
    hashed = rows.select("lang", "text", F.xxhash64("text").alias("h"))
    place = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)
    cut = hashed.select("lang", "h", F.col("text").substr(place.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
    # Repeated texts count once. Ranked within parts of a language first, so that the
    # last rank sees at most SAMPLE_PARTS * PART_TEXTS texts of it, however many tasks there are.
    ranked = cut.withColumn("part_of", F.pmod(F.xxhash64("h"), F.lit(SAMPLE_PARTS)))
    for by, most in ((["lang", "part_of"], PART_TEXTS), (["lang"], SAMPLE_TEXTS + CALIBRATION_TEXTS)):
        ranked = ranked.withColumn("r", F.dense_rank().over(W.partitionBy(*by).orderBy("h"))).where(F.col("r") <= most).dropDuplicates(["lang", "h"])
    sample = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "h", "part"))).alias("parts"))
    out, others = {}, []
    for r in sample.orderBy("lang").toLocalIterator():
        out[r.lang] = "\n".join(p.part for p in r.parts if p.r <= SAMPLE_TEXTS).lower().encode()[:DICTIONARY_BYTES]
        others += [(p.h, r.lang, p.part) for p in r.parts if p.r > SAMPLE_TEXTS]
        others = sorted(others)[:CALIBRATION_ROWS]
        if sum(map(len, out.values())) > TOTAL_BYTES:
            out = {k: v[: TOTAL_BYTES // (2 * len(out))] for k, v in out.items()}
    return Model(out, calibrated(out, [(lang, part) for _, lang, part in others]))


def calibrated(dictionaries: dict[str, bytes], rows: list[tuple[str, str]]) -> float:
    """The widest limit of MARGINS whose rejects among labelled texts are at least as often wrong as right."""
    own, chosen = Classifier(Model(dictionaries)), MARGINS[0]
    sized = [(lang, text, own.sizes(text)) for lang, text in rows if any(map(str.isalpha, text))]
    for own.min_margin in MARGINS:
        answers = [(lang, *own.decide(text, sizes)) for lang, text, sizes in sized]
        right = [answer == lang for lang, answer, _, margin in answers if margin < own.min_margin]
        if 2 * sum(right) <= len(right):
            chosen = own.min_margin
    return chosen


class Classifier:
    """Per-worker compressors of all languages."""

    def __init__(self, model: Model):
        import zstandard as z

        dictionaries, self.min_margin = model.dictionaries, model.min_margin
        self.dictionaries, self.counts = dictionaries, {}
        self.languages = sorted(dictionaries)
        self.compressors = []
        for name in self.languages:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def bits(self, name: str, data: bytes) -> float:
        """Bits of a text under interpolated byte trigrams of a dictionary, counted when first asked for."""
        if name not in self.counts:
            d = self.dictionaries[name]
            self.counts[name] = Counter(d), Counter(zip(d, d[1:])), Counter(zip(d, d[1:], d[2:])), len(d)
        one, two, three, n = self.counts[name]
        data, total = b"\n" + data + b"\n", 0.0
        for i in range(1, len(data)):
            b, c = data[i - 1], data[i]
            p = (two[b, c] + 2 * (one[c] + 1) / (n + 256)) / (one[b] + 2)
            if i > 1:
                a = data[i - 2]
                p = (three[a, b, c] + 2 * p) / (two[a, b] + 2)
            total -= log2(p)
        return total

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin as share of the smallest size)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        return self.decide(text, self.sizes(text))

    def decide(self, text: str, sizes: list[int]) -> tuple[str, float, float]:
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        # A byte more is taken as odds of 2.
        odds = sum(0.5 ** min(60, s - best) for s in sizes)
        margin = (sizes[order[1]] - best) / best if len(sizes) > 1 else 1.0
        if len(sizes) > 1 and margin < self.min_margin:
            data = text.lower().encode()
            fine = sorted((self.bits(self.languages[i], data), i) for i in order if sizes[i] - best < self.min_margin * best)
            order, margin = [i for _, i in fine], (fine[1][0] - fine[0][0]) / fine[0][0]
        return self.languages[order[0]], 1.0 / odds, margin


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every whole text; ties that finer sizes don't break go to the alphabetically first language.

    ``und`` with score 0, rejected, where the text is null or has no letter (or
    nothing was learned). ``rejected`` also marks narrow margins; ``lang_pred``
    then still is the best guess. Repeated rows get the same answer each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))  # bounded, see learn()

    def run(batches):
        release()
        own = Classifier(sent.value)
        for batch in parts(batches):
            found = [own.classify(t) for t in batch.column("text").to_pylist()]
            margin = [m for _, _, m in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array(margin, pa.float64()), pa.array([m < own.min_margin for m in margin])],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows whose language is identified, all columns kept; rejected rows go.

    One pass, without a join: rows with null or repeated ids are judged alone. Null
    texts and texts without a letter go, as do ties that finer sizes don't break.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches):
        release()
        own = Classifier(sent.value)
        for batch in parts(batches):
            keep = [own.classify(t)[2] >= own.min_margin for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
