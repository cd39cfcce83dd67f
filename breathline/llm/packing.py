"""Best-fit packing of token pieces into sequences of bounded length.

Each partition runs a bounded-space online best-fit: open bins are kept in
lists keyed by free space, and a bitset over the free spaces finds the fullest
bin that still takes a piece. Beyond ``max_open`` open bins the fullest one is
closed. Pieces arrive longest first; those of closed bins leave the worker, so it
holds the pieces of open bins and no more, however many rows a partition has. When a partition ends, its emptiest bins
are opened again and their pieces go to a next round with fewer partitions,
down to one, so unfilled ends don't add up over partitions. What a partition
hands on is bounded by ``HANDED_ON`` bins; other bins are final.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, parts, release, shuffle_partitions, slices
from .tokens import MAX_PIECES, encoder

CAPACITY = 4096
MAX_OPEN = 4096
#: Emptiest bins of a partition whose pieces are packed again in the next round.
HANDED_ON = 64
#: Bytes of rows that a worker holds before it looks for those of closed bins.
HELD_BYTES = 1 << 23
#: Partitions whose handed-on pieces meet in one of the next round.
FAN_IN = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Bounded-space best-fit over integer sizes."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free_spaces = 0  # bit f: some open bin has f free
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def open_numbers(self) -> np.ndarray:
        return np.fromiter((n for own in self.by_free for n in own), np.int64, self.n_open)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece; opens a bin where none has room."""
        fits = self.free_spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.max_open:
                self._take((self.free_spaces & -self.free_spaces).bit_length() - 1)
            number, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - size
        if left:
            if not self.by_free[left]:
                self.free_spaces |= 1 << left
            self.by_free[left].append(number)
            self.n_open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        if not own:
            self.free_spaces ^= 1 << free
        self.n_open -= 1
        return number

    def emptiest(self, n: int, least_free: int) -> set[int]:
        found: set[int] = set()
        for free in range(self.capacity, least_free - 1, -1):
            for number in self.by_free[free]:
                if len(found) == n:
                    return found
                found.add(number)
        return found


def token_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, max_pieces: int = MAX_PIECES) -> DataFrame:
    """Whole texts as ids with ``end_id`` appended, cut only above ``capacity``.

    A null text is empty (one piece, the end id alone). Repeated rows, and rows with
    the same or a null id, each give their pieces. ``with_ids`` adds the ids of a
    piece as little-endian unsigned integers, of 2 bytes where all of them fit, else 4
    (the number of bytes over ``length`` tells). ``max_pieces`` bounds the table of
    encoded pieces in a worker: a smaller one takes less memory and more time.
    """

    def run(batches):
        own = encoder(vocabulary, path, max_pieces)
        for batch in parts(batches):
            texts, doc_ids = [t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist()
            for a, b in slices(texts):
                ids, lengths = own.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id)).astype("<u4")
                ends = np.cumsum(lengths + 1)
                rows = []
                for doc_id, n, end in zip(doc_ids[a:b], (lengths + 1).tolist(), ends.tolist()):
                    for k, at in enumerate(range(0, n, capacity)):
                        x = ids[end - n + at : end - n + min(n, at + capacity)]
                        rows.append((doc_id, k, at, len(x), zlib.crc32(x.tobytes()), (x if x.max() >> 16 else x.astype("<u2")).tobytes() if with_ids else None))
                columns = list(zip(*rows))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
            del batch, texts, doc_ids  # not held while the next ones arrive

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def _round(pieces: DataFrame, partitions: int, level: int, capacity: int, max_open: int) -> DataFrame:
    """One round; ``handed_on`` marks pieces of bins that the next round opens again."""
    last = partitions == 1
    carried = pieces.columns

    def run(batches):
        release()  # the tables of encoded pieces too
        base = (level << 56) + (TaskContext.get().partitionId() << 32)
        bins, held, n, kept = OpenBins(capacity, max_open), [], 0, 0

        def given(table: pa.Table, again) -> Iterator[pa.RecordBatch]:
            flag = pa.array(np.isin(table.column("bin").to_numpy(), again))
            yield from table.set_column(len(carried), "sequence_id", pc.add(table.column("bin"), base)).append_column("handed_on", flag).to_batches()

        for batch in batches:
            placed = np.array([bins.place(x) for x in batch.column("length").to_pylist()], np.int64).reshape(-1, 2)
            held.append(pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0]), pa.array(placed[:, 1])], [*carried, "bin", "offset"]))
            n += held[-1].nbytes
            if n >= HELD_BYTES + 2 * kept:
                table = pa.Table.from_batches(held)
                stays = np.isin(table.column("bin").to_numpy(), bins.open_numbers())
                yield from given(table.filter(pa.array(~stays)), np.empty(0, np.int64))
                held = table.filter(pa.array(stays)).combine_chunks().to_batches()
                n = kept = sum(b.nbytes for b in held)
        if held:
            # With one partition all bins are final.
            again = set() if last else bins.emptiest(HANDED_ON, max(1, capacity // 256))
            yield from given(pa.Table.from_batches(held), np.array(sorted(again), np.int64))

    # Round robin: no key gathers in one partition.
    ordered = pieces.repartition(partitions).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, handed_on boolean"
    return ordered.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> DataFrame:
    """Adds sequence_id and offset to pieces (``length`` among their columns).

    Lengths must be 1 to ``capacity``. Offsets in a sequence run gapless from 0.
    Null and repeated ids are pieces like others; ties of lengths go by the other
    columns. An empty table gives an empty result. Columns called bin, sequence_id,
    offset or handed_on are an error.
    """
    taken = {"bin", "sequence_id", "offset", "handed_on"} & {c.lower() for c in pieces.columns}
    if taken:
        raise ValueError(f"pieces have columns {sorted(taken)} already")
    partitions, level, final = shuffle_partitions(pieces.sparkSession), 0, None
    while True:
        packed, _ = materialise(_round(pieces, partitions, level, capacity, max_open), f"packed-{level}")
        done = packed.where("not handed_on").drop("handed_on")
        final = done if final is None else final.unionByName(done)
        if partitions == 1:
            return final
        pieces = packed.where("handed_on").drop("sequence_id", "offset", "handed_on")
        partitions, level = -(-partitions // FAN_IN), level + 1


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece, as :func:`token_pieces` and :func:`pack` say."""
    return pack(token_pieces(docs, capacity=capacity, with_ids=with_ids, **options), capacity)
