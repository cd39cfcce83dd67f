"""Token-id files of patched frame-of-reference blocks.

Format. A table is a set of Parquet rows, one row per *chunk*: a run of whole
documents in ascending (doc_id, text hash) order. A chunk's ids are cut into
blocks of 256 (the last one padded with its own minimum). Each block stores

* its minimum,
* every value less the minimum, in ``width`` bits; ``width`` is the number of
  bits that the percentile ``PERCENTILE`` of its values needs,
* exceptions: position and high bits of the values that need more.

Values lie in 8 lanes of 32 rows; a lane's values fill ``width`` 32-bit words.
``index`` has one entry per block: where its packed words start, where its
exceptions start, minimum and width, so any block is read alone. All numbers
are little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, slices
from .tokens import encoder

BLOCK, ROWS, LANES = 256, 32, 8
#: Share of a block's values that fit the packed width.
PERCENTILE = 0.95
#: Ids after which a chunk is closed.
CHUNK_IDS = 1 << 19

INDEX = np.dtype([("words", "<u4"), ("exceptions", "<u4"), ("minimum", "<u4"), ("width", "u1")])
FILE_SCHEMA = "shard int, chunk int, n_tokens long, doc_ids array<long>, sizes array<long>, block_index binary, packed binary, positions binary, high_bits binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each uint32 needs (0 for 0)."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0).astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> dict[str, bytes]:
    """Blocks of ``ids`` (uint32): their index, packed words, exceptions."""
    n_blocks = -(-len(ids) // BLOCK)
    values = np.zeros(n_blocks * BLOCK, np.uint32)
    values[: len(ids)] = ids
    if len(ids) % BLOCK:
        values[len(ids) :] = ids[len(ids) // BLOCK * BLOCK :].min()
    values = values.reshape(n_blocks, BLOCK)
    index = np.zeros(n_blocks, INDEX)
    if not n_blocks:
        return {"block_index": b"", "packed": b"", "positions": b"", "high_bits": b""}
    index["minimum"] = values.min(axis=1)
    values = values - index["minimum"][:, None]
    bits = _bits(values)
    rank = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.partition(bits, rank, axis=1)[:, rank]
    index["width"] = width
    over = bits > width[:, None]
    block, position = np.nonzero(over)
    high = values[block, position] >> width[block]
    per_block = over.sum(axis=1)
    index["exceptions"] = np.cumsum(per_block) - per_block
    n_words = width.astype(np.int64) * LANES
    starts = np.cumsum(n_words) - n_words
    index["words"] = starts
    words = np.zeros(int(n_words.sum()), np.uint32)
    for w in np.unique(width):
        w = int(w)
        if not w:
            continue
        own = np.flatnonzero(width == w)
        rows = values[own].reshape(-1, ROWS, LANES)
        if w < 32:
            rows = rows & np.uint32((1 << w) - 1)
        out = np.zeros((len(own), w, LANES), np.uint32)
        for r in range(ROWS):
            word, shift = divmod(r * w, 32)
            out[:, word] |= rows[:, r] << np.uint32(shift)
            if shift + w > 32:
                out[:, word + 1] |= rows[:, r] >> np.uint32(32 - shift)
        words[(starts[own][:, None] + np.arange(w * LANES)).ravel()] = out.ravel()
    return {"block_index": index.tobytes(), "packed": words.astype("<u4").tobytes(), "positions": position.astype(np.uint8).tobytes(), "high_bits": high.astype("<u4").tobytes()}


def unpack(block_index: bytes, packed: bytes, positions: bytes, high_bits: bytes, n_tokens: int, first: int = 0) -> np.ndarray:
    """The ids from ``first`` (inclusive) to ``n_tokens`` (exclusive) of a chunk; whole blocks before are not read."""
    index = np.frombuffer(block_index, INDEX)
    skip = first // BLOCK
    own_index = index[skip:]
    words = np.frombuffer(packed, "<u4")
    out = np.zeros((len(own_index), BLOCK), np.uint32)
    for w in np.unique(own_index["width"]):
        w = int(w)
        if not w:
            continue
        own = np.flatnonzero(own_index["width"] == w)
        at = own_index["words"][own].astype(np.int64)
        lanes = words[(at[:, None] + np.arange(w * LANES)).ravel()].reshape(-1, w, LANES)
        rows = np.zeros((len(own), ROWS, LANES), np.uint32)
        mask = np.uint32(0xFFFFFFFF >> (32 - w))
        for r in range(ROWS):
            word, shift = divmod(r * w, 32)
            rows[:, r] = lanes[:, word] >> np.uint32(shift)
            if shift + w > 32:
                rows[:, r] |= lanes[:, word + 1] << np.uint32(32 - shift)
        out[own] = (rows & mask).reshape(-1, BLOCK)
    if len(own_index):
        low = int(own_index["exceptions"][0])
        position = np.frombuffer(positions, np.uint8)[low:]
        counts = np.diff(np.append(own_index["exceptions"].astype(np.int64), low + len(position)))
        block = np.repeat(np.arange(len(own_index)), counts)
        out[block, position] |= np.frombuffer(high_bits, "<u4")[low:] << own_index["width"][block].astype(np.uint32)
        out += own_index["minimum"][:, None]
    return out.ravel()[first - skip * BLOCK : n_tokens - skip * BLOCK]


def write_token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, path: str | None = None, chunk_ids: int = CHUNK_IDS) -> str:
    """Encode whole texts, append ``end_id`` and write blocks; the table's path.

    Rows lie in ascending (doc_id, text hash) order over shards and chunks, null
    ids first; a null text is empty. The hash also splits a doc_id that very many
    rows share.
    """
    n = shuffle_partitions(docs.sparkSession)

    def run(batches):
        own, shard, chunk = encoder(vocabulary, path), TaskContext.get().partitionId(), 0
        parts, ids_of, sizes, held = [], [], [], 0

        def row():
            nonlocal chunk, held
            ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            fields = {"shard": shard, "chunk": chunk, "n_tokens": len(ids), "doc_ids": list(ids_of), "sizes": list(sizes)} | pack(ids)
            chunk, held = chunk + 1, 0
            for x in (parts, ids_of, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([fields[f.name]], f.type) for f in arrow], schema=arrow)

        arrow = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))] + [(k, pa.binary()) for k in ("block_index", "packed", "positions", "high_bits")])
        for batch in batches:
            texts, doc_ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                ids, lengths = own.encode(texts[a:b])
                ends = np.cumsum(lengths)
                with_end = np.insert(ids, ends, np.uint32(end_id)).astype(np.uint32)
                parts.append(with_end)
                ids_of.extend(doc_ids[a:b])
                sizes.extend((lengths + 1).tolist())
                held += len(with_end)
                if held >= chunk_ids:
                    yield row()
            del batch, texts, doc_ids  # not held while the next batch arrives
        if ids_of:
            yield row()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return materialise(ordered.mapInArrow(run, FILE_SCHEMA), "token-files")[1]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a table: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` is the number of ids before a document in the whole table: running
    sums over the chunks of a shard and over the shards (one row each).
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    chunks = files.select("shard", "chunk", "n_tokens")
    within = chunks.select("shard", "chunk", (F.sum("n_tokens").over(W.partitionBy("shard").orderBy("chunk")) - F.col("n_tokens")).alias("in_shard"))
    totals = chunks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("before"))
    starts = within.join(before, "shard").select("shard", "chunk", (F.col("in_shard") + F.col("before")).alias("chunk_start"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["block_index"], r["packed"], r["positions"], r["high_bits"], r["n_tokens"]).astype("<u4")
                sizes = np.array(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - s : e] for s, e in zip(sizes, ends)]
                n = len(sizes)
                columns = [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["chunk"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                names = ["shard", "chunk", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "shard int, chunk int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    read = files.mapInArrow(run, schema)
    return read.join(starts, ["shard", "chunk"]).selectExpr("doc_id", "chunk_start + at as start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
