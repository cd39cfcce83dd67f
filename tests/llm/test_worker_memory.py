"""What a stage leaves in a worker is given back by the next one, which may run in the same worker."""

import pyarrow as pa
import pytest

from breathline.llm import common, secret_scan, tokens


@pytest.fixture
def nothing_kept():
    common.release()
    yield
    common.release()


def test_stages_give_back_what_others_kept(nothing_kept):
    encoding, encoder = lambda: secret_scan.encoding("byte_bpe_50k.tiktoken"), lambda: tokens.encoder("word_bpe_49k.json")
    own = encoding()
    assert encoding() is own  # between tasks of one stage
    own = encoder()
    assert not secret_scan._encodings and encoder() is own
    encoding()
    assert not tokens._encoders


def test_parts_are_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 5), (5, 5), (5, 6), (6, 13))]
    found = list(common.parts(iter(batches), 3))
    assert [x for b in found for x in b.column("x").to_pylist()] == list(range(13))
    assert max(b.num_rows for b in found) == 3
