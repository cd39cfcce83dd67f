"""Near-duplicates by an inverted join over MinHash signature coordinates.

1. Every text becomes a set of word shingles, a hash of that set, and a MinHash
   signature of ``COORDINATES`` values. Texts with the same set are one class;
   only a class's representative goes on.
2. Representatives are posted under (coordinate, value) pairs. A pair of texts of
   the wanted similarity agrees on at least ``MATCHES`` coordinates, so it shares
   one of the first COORDINATES - MATCHES + 1 pairs of each in any common order
   (prefix). The order is by frequency: pairs that occur once come first and need
   no posting, very common ones are hardly ever posted.
3. Each posting list counts collisions of signatures between its members. Members
   that a chain of matches joins already are skipped (skip merging), so a list
   gives a spanning set of matches and not all its pairs.
4. Matches join representatives into candidate clusters. A link can only lie
   inside a cluster; there, full shingle sets confirm links, again skipping members
   that links join already.
5. Components of the confirmed links are the classes of near-duplicates.

Long lists and large clusters are dealt to blocks, one copy of each member, and
the leader (the smallest id) is copied to every block. Members of a block that a
chain joins to the leader are of one component, whatever their block. Only the
others, the rest, are compared with the members of all blocks in a second pass. So
copies grow with the list plus its rest times its blocks, and no link is lost.

A pair at the threshold agrees on fewer than MATCHES of 64 coordinates with a
probability of about 1e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, free_name, materialise, parts, release, shuffle_partitions, slices, with_hot
from .components import components
from .hashing import mix, word_hashes

COORDINATES, MATCHES = 64, 34
PREFIX = COORDINATES - MATCHES + 1
#: Members of a posting list, and of a cluster, that one block holds; bytes of sets in a block.
LIST_BLOCK, CLUSTER_BLOCK, CLUSTER_BYTES = 512, 256, 1 << 22
#: Members of a list's rest that are compared with one block at a time.
REST_BLOCK = 256
#: Rows up to which cluster members are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_BLANK = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_A = mix(np.arange(1_000, 1_000 + COORDINATES, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(2_000, 2_000 + COORDINATES, dtype=np.uint64))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a shorter text is one shingle, an empty one none."""
    data = [t.encode().lower().translate(_BLANK) if t else b"" for t in texts]
    hashes, counts = word_hashes(data)
    ends = np.cumsum(counts)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        w = hashes[end - n : end]
        if n >= words:
            s = w[: n - words + 1] * _PLACES[0]
            for k in range(1, words):
                s = s + w[k : n - words + 1 + k] * _PLACES[k]
            s = np.unique(mix(s))
        elif n:
            s = mix((w * _PLACES[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """64 values of 32 bits of a non-empty set."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4_096):
        least = np.minimum(least, (shingles[None, i : i + 4_096] * _A[:, None] + _B[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


class _Forest:
    """Union-find over a block's rows; rows with the same id are one from the start."""

    def __init__(self, ids: np.ndarray):
        _, self.root = np.unique(ids, return_inverse=True)

    def join(self, row: int, others: np.ndarray) -> None:
        old = np.unique(self.root[others])
        self.root[np.isin(self.root, old)] = self.root[row]

    def stars(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links from every id to the smallest one of its tree."""
        least = np.full(int(self.root.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, ids)
        to = least[self.root]
        return ids[to != ids], to[to != ids]


def _grouped(batches, keys: list[str]):
    """Runs of equal keys over sorted batches, as tables; a run may span batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _kernel(batches, keys: list[str], linked):
    """Spanning links (a, b) of every group; ``linked`` tells which others a row meets.

    ``side`` is 0 for rows that meet others, 1 for rows that are only met, 2 for the
    leader of a list that has other blocks too: then rows that no chain joins to it
    are given as (a, null, key).
    """
    release()
    out, n = [], 0
    for key, group in _grouped(batches, keys):
        ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
        forest, data = _Forest(ids), linked.prepare(group)
        across = bool((side == 1).any())
        for row in np.flatnonzero(side != 1).tolist():
            rest = forest.root != forest.root[row]
            rest = rest & (side == 1) if across else rest & (np.arange(len(ids)) > row)
            others = np.flatnonzero(rest)
            if len(others):
                met = linked.met(data, row, others)
                if len(met):
                    forest.join(row, met)
        x, y = forest.stars(ids)
        none = np.full(len(x), None)
        if len(x):
            out.append((x, y, none))
        leaders = np.flatnonzero(side == 2)
        if len(leaders):
            apart = np.unique(ids[~np.isin(forest.root, forest.root[leaders])])
            if len(apart):
                out.append((apart, np.full(len(apart), None), np.full(len(apart), key[0])))
        n += len(ids)
        if out and n > 100_000:
            yield _found_batch(out)
            out, n = [], 0
    if out:
        yield _found_batch(out)


def _found_batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*parts)], ["a", "b", "key"])


class _Collisions:
    """Matches by the number of equal signature coordinates (16 bits of each)."""

    @staticmethod
    def prepare(group: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint16).reshape(-1, COORDINATES)

    @staticmethod
    def met(data: np.ndarray, row: int, others: np.ndarray) -> np.ndarray:
        return others[(data[others] == data[row]).sum(axis=1) >= MATCHES]


class _FullSets:
    """Links by exact set similarity: 100 * intersection >= percent * union."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent

    def prepare(self, group: pa.Table) -> list[np.ndarray]:
        return shingle_sets(group.column("data").to_pylist(), self.words)

    def met(self, sets: list[np.ndarray], row: int, others: np.ndarray) -> np.ndarray:
        own = sets[row]
        sizes = np.array([len(sets[i]) for i in others])
        fits = (100 * np.minimum(sizes, len(own)) >= self.percent * np.maximum(sizes, len(own))) & (sizes > 0)
        others, sizes = others[fits], sizes[fits]
        if not len(others):
            return others
        flat = np.concatenate([sets[i] for i in others])
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
        return others[100 * common >= self.percent * (sizes + len(own) - common)]


def _block(n, seed: int):
    return F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")


def _numbers(n) -> Column:
    return F.explode(F.sequence(F.lit(0), n.cast("int") - 1))


def _dealt(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Each member (key, id, data, blocks) in one block of its list; its leader in all of them."""
    own = rows.withColumns({"i": _block(F.col("blocks"), 7), "side": F.lit(0)})
    return own.unionByName(leaders.withColumns({"i": _numbers(F.col("blocks")), "side": F.lit(2)})).withColumn("j", F.lit(0)).drop("blocks")


def _dealt_again(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """The rest of each list against all its blocks: side 0 is a chunk of the rest, side 1 a block."""
    long = rows.where("blocks > 1")
    members = long.withColumn("i", _block(F.col("blocks"), 7))
    apart = long.join(rest, ["key", "id"], "left_semi")
    sizes = apart.groupBy("key").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).select("key", _numbers(F.col("blocks")).alias("i"), F.ceil(F.col("n") / REST_BLOCK).alias("chunks"))
    # By key and block, so that no long list meets its size in one task.
    against = members.join(sizes, ["key", "i"]).withColumns({"j": _numbers(F.col("chunks")), "side": F.lit(1)})
    asking = apart.withColumn("i", _numbers(F.col("blocks"))).join(sizes, ["key", "i"]).withColumns({"j": _block(F.col("chunks"), 11), "side": F.lit(0)})
    return against.unionByName(asking).drop("blocks", "chunks")


def _spanning(dealt: DataFrame, linked) -> DataFrame:
    keys = ["key", "i", "j"]
    n = shuffle_partitions(dealt.sparkSession)
    # The smaller id first: a group's first row is its leader.
    ordered = dealt.repartition(n, *keys).sortWithinPartitions(*keys, "id")
    return ordered.mapInArrow(lambda batches: _kernel(batches, keys, linked), "a long, b long, key long")


def _links(rows: DataFrame, leaders: DataFrame, linked, name: str) -> tuple[DataFrame, list[str]]:
    """Links (a, b) that join the members of every list as far as they meet; paths to discard."""
    found, path = materialise(_spanning(_dealt(rows, leaders), linked), name)
    links, paths = found.where("b is not null").select("a", "b"), [path]
    rest = found.where("key is not null").select("key", F.col("a").alias("id")).distinct()
    if not rest.isEmpty():
        more, path = materialise(_spanning(_dealt_again(rows, rest), linked), name)
        links, paths = links.unionByName(more.select("a", "b")), [*paths, path]
    return links, paths


def _texts(rows: DataFrame, wanted: DataFrame, several: DataFrame, words: int) -> DataFrame:
    """key, id, data, blocks: a text of each wanted class (node, key, blocks, of, fingerprint).

    Where a doc_id has several texts, its rows' fingerprints tell which class is whose.
    """
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    columns = ["key", F.col("node").alias("id"), F.col("text").alias("data"), "blocks"]
    some = not several.isEmpty()
    single = wanted.join(several, "of", "left_anti") if some else wanted
    texts = rows.join(small(single), rows.doc_id == F.col("of")).select(*columns)
    if not some:
        return texts

    def told(batches):
        release()
        for batch in parts(batches):
            own = batch.column("text").to_pylist()
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for x, y in slices(own) for s in shingle_sets(own[x:y], words)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.binary()), batch.column("text")], ["fingerprint", "text"])

    many = wanted.join(several, "of", "left_semi")
    asked = rows.join(small(many.select(F.col("of").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    known = asked.mapInArrow(told, "fingerprint binary, text string").where("fingerprint is not null").groupBy("fingerprint").agg(F.min("text").alias("text"))
    return texts.unionByName(known.join(many, "fingerprint").select(*columns))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the near-duplicate class of every row.

    component_id is the smallest doc_id reachable over links of at least
    ``percent`` % similarity; kept says that it is the row's own. Null or wordless
    texts have no shingles and no links. Rows that share a doc_id are one node:
    each has the links of all; the work grows with their number. A row with a null doc_id links nothing; its
    component_id is null and it is kept. Ties don't occur: classes are unordered.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def describe(batches):
        release()
        for batch in parts(batches):
            texts = batch.column("text").to_pylist()
            n, fingerprint, sig = [], [], []
            for x, y in slices(texts):
                for s in shingle_sets(texts[x:y], words):
                    n.append(len(s))
                    fingerprint.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fingerprint, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "fingerprint", "sig"])

    described, described_path = materialise(rows.mapInArrow(describe, "doc_id long, n_shingles long, fingerprint binary, sig binary"), "shingles")
    grouped = described.where("fingerprint is not null and doc_id is not null").groupBy("fingerprint")
    grouped = grouped.agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    # Classes are told by numbers of their own: one doc_id may have many texts.
    classes, classes_path = materialise(grouped.withColumn("number", F.monotonically_increasing_id()), "classes")
    numbered = classes.select(F.col("number").alias("id"), "sig")

    # Postings.
    def coordinates(batches):
        place = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            ids = np.repeat(batch.column("id").to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array((sig | place).ravel().astype(np.int64))], ["id", "pair"])

    posted = numbered.mapInArrow(coordinates, "id long, pair long")
    frequent, frequent_path = materialise(posted.groupBy("pair").agg(F.count("*").alias("df")).where("df > 1"), "frequent")
    total = frequent.agg(F.sum("df")).first()[0] or 0
    shared = with_hot(posted, frequent, "pair", "df", total).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "pair"))).alias("pairs"))  # at most 64
    prefix = F.expr(f"slice(pairs, 1, greatest(0, size(pairs) - {COORDINATES - PREFIX}))")
    postings, postings_path = materialise(shared.select("id", F.explode(prefix).alias("p")).select("id", "p.pair", "p.df"), "postings")

    # Matches: signature collisions within posting lists. df counts all texts that have
    # the pair, so it bounds the list's length.
    def halved(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16)[::2].reshape(-1, COORDINATES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sig], pa.binary())], ["id", "sig"])

    short = numbered.mapInArrow(halved, "id long, sig binary")
    blocks = F.ceil(F.col("df") / LIST_BLOCK)
    members = postings.join(short, "id").select(F.col("pair").alias("key"), "id", F.col("sig").alias("data"), blocks.alias("blocks"))
    leaders = members.where("blocks > 1").groupBy("key").agg(F.min_by("data", "id").alias("data"), F.min("id").alias("id"), F.max("blocks").alias("blocks"))
    matches, match_paths = _links(members, leaders, _Collisions(), "matches")
    clusters, clusters_path = materialise(components(matches), "clusters")
    discard(spark, frequent_path, postings_path, *match_paths)

    # Links: full sets within candidate clusters; a cluster's root is its leader.
    sizes = clusters.join(classes.select(F.col("number").alias("node"), "n"), "node").groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / CLUSTER_BLOCK, F.col("shingles") * 8 / CLUSTER_BYTES))
    sizes = sizes.select("root", "members", blocks.alias("blocks"))
    placed = with_hot(clusters, sizes, "root", "members", clusters.count()).select("node", F.col("root").alias("key"), "blocks")
    own = classes.select(F.col("number").alias("node"), F.col("id").alias("of"), "fingerprint")
    wanted, wanted_path = materialise(placed.join(own, "node"), "members")
    several, several_path = materialise(classes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("of")), "several-texts")
    texts = _texts(rows, wanted, several, words)
    links, link_paths = _links(texts, texts.where("id = key and blocks > 1"), _FullSets(words, percent), "confirmed")
    named = links.join(own.select(F.col("node").alias("a"), F.col("of").alias("of_a")), "a").join(own.select(F.col("node").alias("b"), F.col("of").alias("of_b")), "b")
    roots, roots_path = materialise(components(named.where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))), "roots")
    discard(spark, clusters_path, wanted_path, several_path, *link_paths)

    found = classes.select("fingerprint", "copies", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("fingerprint", "copies", F.coalesce("root", "id").alias("root"))
    # A doc_id with several texts takes the smallest root of them.
    own = described.select("doc_id", "n_shingles", "fingerprint")
    full = with_hot(own.where("fingerprint is not null"), found, "fingerprint", "copies", classes.agg(F.sum("copies")).first()[0] or 0, "left")
    out = full.select("doc_id", "n_shingles", "root").unionByName(own.where("fingerprint is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    result = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each near-duplicate class.

    Rows that share the doc_id that stays: of those with the same text one stays (the
    least by its other columns), different texts all stay. Rows with a null doc_id
    stay, as do null and wordless texts, each with its own id. Columns may have any names.
    """
    key, n, rank = (free_name(x, docs.columns) for x in ("kept_id", "n_rows", "row_rank"))
    classes = near_duplicates(docs, words, percent).where("kept and doc_id is not null")
    kept = classes.groupBy("doc_id").agg(F.count("*").alias(n)).withColumnRenamed("doc_id", key)
    joined = docs.where(docs.doc_id.isNotNull()).join(kept, docs.doc_id.cast("long") == F.col(key))
    others = [c for c, t in docs.dtypes if c not in ("doc_id", "text") and "map<" not in t]
    order = W.partitionBy(key, "text").orderBy(*(others or [key]))
    repeated = joined.where(F.col(n) > 1).withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
    return joined.where(F.col(n) == 1).select(docs.columns).unionByName(repeated.select(docs.columns)).unionByName(docs.where(docs.doc_id.isNull()))
