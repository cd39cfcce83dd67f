"""Token counts without ids.

Per slice of texts, the distinct pre-tokens are one small relation (piece, number
of tokens), filled by one library call for each new piece; each document is a
relation (piece, frequency); the count is the sum of frequency x tokens over
their join. Both stay inside the worker, so nothing is shuffled and no list of
ids is made for a document. The piece relation is bounded and is emptied when
full; it is never needed whole.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokens import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, path: str | None = None) -> DataFrame:
    """Tokens of every whole text, as the library counts them.

    Null texts count as empty: 0 bytes, 0 tokens. A null ``doc_id`` is kept.
    Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        own = encoder(vocabulary, path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_bytes, n_tokens = [], []
            for a, b in slices(texts):
                looked = own.look_up(texts[a:b])
                tokens = own.lengths
                for text, pieces in zip(texts[a:b], looked):
                    frequency = Counter(pieces)
                    numbers = list(frequency)
                    n_tokens.append(int(tokens[numbers] @ list(frequency.values())) if numbers else 0)
                    n_bytes.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
