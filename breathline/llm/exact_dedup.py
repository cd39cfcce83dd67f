"""Exact duplicates by recipes of content-defined chunks, in DataFrame functions only.

1. A normalised text is cut where its characters say so: behind three characters of
   fixed classes, at least ``LEAST`` and at most ``MOST`` characters after the cut before.
   An inserted passage moves the cuts near it; beyond, the chunks are the same again.
2. A chunk's identifier is 128 bits of seeded hashes. Identifiers are verified: the
   distinct chunks meet once by content, and none may share an identifier with another.
   If two do, all are drawn again with another seed.
3. A text's recipe is its ordered list of identifiers, which is made where the text lies.
   With verified identifiers, texts are equal just when their recipes are. Groups, the
   row that stays and the join back move recipes only, about a fiftieth of the text.

What moves of the texts is every distinct chunk of a task, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, with_hot

#: What doesn't count in a comparison.
BLANKS = r"[\x20\x09-\x0D]+"
#: Characters between two cuts.
LEAST, MOST = 256, 2_048
#: Remainders of a character's code by 16 that make up the three classes, up to code 255.
CLASSES = (1, 2), (4, 9), (5, 12)


def cut_pattern(least: int = LEAST, most: int = MOST) -> str:
    """Regular expression whose successive matches are the chunks of a text."""
    classes = ("".join(f"\\x{c:02X}" for c in range(33, 256) if c % 16 in own) for own in CLASSES)
    cut = "".join(f"[{c}]" for c in classes)
    return f"(?s).{{{least},{most}}}?{cut}|.{{1,{most}}}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text in order; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(cut_pattern(least, most)), F.lit(0))


def identifier(chunk: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(2 * seed), chunk).alias("a"), F.xxhash64(F.lit(2 * seed + 1), chunk).alias("b"))


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars of the original text, and the text without blanks; null is empty."""
    own = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    return own.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.regexp_replace("text", BLANKS, "").alias("text"))


def verified_seed(texts: DataFrame, least: int = LEAST, most: int = MOST) -> int:
    """The first seed under which no two different chunks of all texts share an identifier."""
    own = texts.select(F.explode(chunks(F.col("text"), least, most)).alias("chunk"))
    seed = 0
    # Distinct chunks are combined within a task before they move; then only identifiers do.
    while not own.groupBy(identifier(F.col("chunk"), seed).alias("id")).agg(F.count_distinct("chunk").alias("n")).where("n > 1").isEmpty():
        seed += 1
    return seed


def exact_duplicates(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks (space, tab to carriage
    return). Of equal texts, the row with the most code points in its original text
    stays, then the smallest doc_id; a null doc_id comes last. Null and blank texts are
    empty, and equal. Of repeated rows, one stays. Texts of any length are compared whole;
    columns other than doc_id and text are ignored. An empty table gives an empty result.
    """
    texts = normalised(docs)
    seed = verified_seed(texts, least, most)
    recipe = F.transform(chunks(F.col("text"), least, most), lambda c: identifier(c, seed))
    # Written once: row numbers must not change when a task runs again.
    own, path = materialise(texts.select("doc_id", "n_chars", F.sha2("text", 256).alias("text_sha256"), recipe.alias("recipe"), F.monotonically_increasing_id().alias("row")), "recipes")
    total = own.count()
    first = F.min_by(F.struct("doc_id", "row"), F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups, groups_path = materialise(own.groupBy("recipe").agg(first.alias("keep"), F.count("*").alias("group_size")), "recipe-groups")
    joined = with_hot(own, groups, "recipe", "group_size", total)
    result, _ = materialise(joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256"), "exact-duplicates")
    discard(docs.sparkSession, path, groups_path)
    return result
