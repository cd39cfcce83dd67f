"""Numpy functions over whole recordings: one exchange by session, many sessions an Arrow batch.

Rows of a store that is clustered by session need no exchange. Spark exchanges and sorts the rows by session and order; a worker cuts its sorted
batches into sessions and gathers the results of many before it hands them on. It
holds the rows of one session and one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of results that are gathered before they leave a worker.
GATHERED = 20_000
#: Rows of recordings that are gathered for a function of many at once.
ABREAST = 60_000


def sessions(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """(session, its rows) over sorted batches; a session may span batches."""
    held: list[pd.DataFrame] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = [*starts(batch, [key]).tolist(), batch.num_rows]
        frame = batch.drop_columns([key]).to_pandas()
        for a, b in zip(cuts, cuts[1:]):
            name = batch.column(key)[a].as_py()
            if held and name != current:
                yield current, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            current = name
            held.append(frame.iloc[a:b])
    if held:
        yield current, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a key changes, the first one included."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in keys:
        column = batch.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """(key values, batches) of each series over sorted batches; a series may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = starts(batch, keys)
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            own = batch.slice(int(a), int(b - a))
            name = tuple(own.column(k)[0].as_py() for k in keys)
            if held and name != last:
                yield last, held
                held = []
            last = name
            held.append(own)
    if held:
        yield last, held


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a series together and in order, with their number in it.

    The window asks Spark for that; a table clustered by the keys has it without an
    exchange. (A repartition of such a table can be left out with its buckets unread.)
    """
    free = "_place" + "_" * max(map(len, df.columns))
    return df.withColumn(free, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def per_series(df: DataFrame, x: str, f: Callable[[np.ndarray], dict], schema: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``f`` for the values of each series in order: a dict of arrays of equal length, the keys aside."""
    fields = StructType.fromDDL(schema)
    full = StructType([*(df.schema[k] for k in keys), *fields])
    types = to_arrow_schema(full)

    def run(batches):
        names, found, n = [], [], 0

        def gathered():
            sizes = [len(d[types.names[-1]]) for d in found]
            own = [pa.array([name[i] for name, size in zip(names, sizes) for _ in range(size)], types.field(k).type) for i, k in enumerate(keys)]
            own += [pa.array(np.concatenate([d[c.name] for d in found]), types.field(c.name).type, from_pandas=False) for c in fields]
            return pa.RecordBatch.from_arrays(own, schema=types)

        for name, own in runs(batches, keys):
            names.append(name)
            found.append(f(np.concatenate([b.column(x).to_numpy(zero_copy_only=False) for b in own]).astype(float)))
            n += len(found[-1][types.names[-1]])
            if n >= GATHERED:
                yield gathered()
                names, found, n = [], [], 0
        if n:
            yield gathered()

    return placed(df.select(*keys, *order, x), keys, order).mapInArrow(run, full)


def per_session(df: DataFrame, columns: list[str], f: Callable[[pd.DataFrame], dict], schema: str, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Rows of ``f`` for each session: a dict of columns of equal length, the key aside.

    ``f`` gets the session's rows in order; ``schema`` tells the types of its columns.
    """
    return per_sessions(df, columns, lambda groups: [f(rows) for rows in groups], schema, key, order, 1)


def per_sessions(df: DataFrame, columns: list[str], f: Callable[[list[pd.DataFrame]], list[dict]], schema: str, key: str = "session_id", order: str = "seq", least: int = ABREAST) -> DataFrame:
    """:func:`per_session` for a function of a list of sessions, which have ``least`` rows together but for the last ones."""
    kinds = dict(df.dtypes)
    full = StructType.fromDDL(f"`{key}` {kinds[key]}, {schema}")
    types = to_arrow_schema(full)

    def run(batches):
        out: list[list] = [[] for _ in types]
        n = 0
        for names, groups in _gathered(sessions(batches, key), least):
            for session, found in zip(names, f(groups)):
                columns_of = [found[name] for name in types.names[1:]]
                size = len(columns_of[0])
                out[0].append([session] * size)
                for column, values in zip(out[1:], columns_of):
                    column.append(values)
                n += size
            if n >= GATHERED:
                yield _batch(out, types)
                out, n = [[] for _ in types], 0
        if n:
            yield _batch(out, types)

    return placed(df.select(key, order, *columns), [key], [order]).mapInArrow(run, full)


def _gathered(found: Iterator[tuple[object, pd.DataFrame]], least: int) -> Iterator[tuple[list, list[pd.DataFrame]]]:
    """Sessions and their rows in lists of ``least`` rows or more."""
    names, groups, n = [], [], 0
    for name, rows in found:
        names.append(name)
        groups.append(rows)
        n += len(rows)
        if n >= least:
            yield names, groups
            names, groups, n = [], [], 0
    if groups:
        yield names, groups


def _batch(parts: list[list], types: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for column, field in zip(parts, types):
        if all(isinstance(x, np.ndarray) and x.ndim == 1 and x.dtype != object for x in column):
            arrays.append(pa.array(np.concatenate(column), field.type, from_pandas=False))
        else:
            arrays.append(pa.array([v for x in column for v in x], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=types)
