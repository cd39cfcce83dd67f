"""Encoding, counts, files and packing against the library itself."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from breathline.llm import packing, pfor
from breathline.llm.token_count import count_tokens
from breathline.llm.tokens import PieceEncoder

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LIBRARY = {v: Tokenizer.from_file(public_tokenizers.path(v)) for v in (BYTE, WORD)}
ENCODER = {v: PieceEncoder(public_tokenizers.path(v), 500) for v in (BYTE, WORD)}


def ids(vocabulary, text, end=None):
    found = LIBRARY[vocabulary].encode(text or "", add_special_tokens=False).ids
    return found + [end] if end is not None else found


@pytest.mark.parametrize("vocabulary", [BYTE, WORD])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab C.,!?'s0 \n\t  éÉ́日<|>endoftxsr\x1c"), max_size=60), max_size=4))
def test_pieces_equal_the_library(vocabulary, texts):
    texts += ["<|endoftext|> x<|startoftext|>\n"]
    flat, sizes = ENCODER[vocabulary].encode(texts)
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [ids(vocabulary, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_257), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700))
def test_blocks_round_trip(values, first):
    packed = pfor.pack(np.array(values, np.uint32))
    assert pfor.unpack(**packed, n_tokens=len(values)).tolist() == values
    first = min(first, len(values))
    assert pfor.unpack(**packed, n_tokens=len(values), first=first).tolist() == values[first:]


def test_blocks_save_space():
    values = np.random.default_rng(0).geometric(0.01, 100_000).astype(np.uint32)
    assert sum(map(len, pfor.pack(values).values())) < 0.5 * values.nbytes


def test_counts(odd, odd_rows, empty):
    got = sorted(tuple(r) for r in count_tokens(odd.where("doc_id is not null")).collect())
    want = [(r[0], len((r[1] or "").encode()), n := len(ids(BYTE, r[1])), n > 1024) for r in odd_rows if r[0] is not None]
    assert got == sorted(want)
    assert count_tokens(empty).count() == 0 and count_tokens(odd).count() == len(odd_rows)


def test_files(spark, odd, odd_rows, empty):
    got = pfor.read_token_files(spark, pfor.write_token_files(odd, chunk_ids=3_000), with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in odd_rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert sorted(r.ids for r in got) == sorted(ids(BYTE, r[1], 2) for r in odd_rows)
    assert pfor.read_token_files(spark, pfor.write_token_files(empty)).count() == 0


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
        assert sum(r.length for r in own) <= capacity
    return len(by)


def test_packing(odd, odd_rows, empty, documents):
    rows = packing.pack_documents(odd, with_ids=True).collect()
    check_packed(rows, 4096)
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        own = np.frombuffer(r.ids, f"<u{len(r.ids) // r.length}").astype("<u4")
        assert r.start == 4096 * r.piece and r.ids_crc32 == zlib.crc32(own) and len(own) == r.length and len(r.ids) == 2 * r.length
        whole[r.doc_id].extend(own.tolist())
    for doc_id, text, *_ in odd_rows[:6]:
        assert whole[doc_id] == ids(WORD, text, 1)
    assert packing.pack_documents(empty).count() == 0
    got = packing.pack_documents(documents).collect()
    pieces = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece):
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for r in documents.collect():
        own = np.array(ids(WORD, r.text, 1), "<u4")
        cuts = range(0, len(own), 4096)
        assert pieces.pop(r.doc_id) == [(k, at, len(own[at : at + 4096]), zlib.crc32(own[at : at + 4096])) for k, at in enumerate(cuts)]
    assert not pieces
    assert check_packed(got, 4096) <= 1.02 * sum(r.length for r in got) / 4096 + 1


def brute_best_fit(sizes, capacity, max_open):
    """(bin, offset) of each size: the fullest open bin with room, of equal ones the last to get there."""
    free, out, clock, last = {}, [], 0, {}
    n = 0
    for s in sizes:
        fits = [b for b in free if free[b] >= s]
        if fits:
            b = min(fits, key=lambda b: (free[b], -last[b]))
        else:
            if len(free) >= max_open:
                free.pop(min(free, key=lambda b: (free[b], -last[b])))
            b, n = n, n + 1
            free[b] = capacity
        out.append((b, capacity - free[b]))
        free[b] -= s
        clock += 1
        last[b] = clock
        if not free[b]:
            free.pop(b)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_bitset_equals_a_plain_search(sizes, most):
    bins = packing.OpenBins(50, most)
    assert [bins.place(s) for s in sizes] == brute_best_fit(sizes, 50, most)


def test_pieces_of_closed_bins_leave_early(spark, monkeypatch):
    """However few rows are held, a partition's bins are those of a plain search."""
    monkeypatch.setattr(packing, "HELD_BYTES", 400)
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(1, 50, 3_000).tolist(), reverse=True)
    rows = [(k, 0, 0, s, 0) for k, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, packing.PIECES).coalesce(1)
    monkeypatch.setattr(packing, "shuffle_partitions", lambda spark: 1)
    got = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(df, 50, 5).collect()}
    assert [got[k] for k in range(len(rows))] == brute_best_fit(sizes, 50, 5)
    with pytest.raises(ValueError, match="offset"):
        packing.pack(df.selectExpr("*", "1 as Offset"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 6))
def test_open_bins(sizes, most):
    bins, used = packing.OpenBins(50, most), defaultdict(int)
    for s in sizes:
        b, offset = bins.place(s)
        assert offset == used[b]
        used[b] += s
        assert used[b] <= 50 and bins.n_open <= most
