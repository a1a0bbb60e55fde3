"""Small groups of rows in Python, many groups a batch.

A frame of pandas for each group costs some milliseconds, more than most groups' work. Here Spark deals and sorts the
rows by key, and a task walks over them as plain values: it holds one group and one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a task returns, about.
BATCH = 2000


def values(column: pa.Array) -> list:
    """``to_pylist``, but lists and structs by their columns, which takes a tenth of its time."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        inner = iter(values(column.flatten()))
        return [None if n is None else list(islice(inner, n)) for n in pc.list_value_length(column).to_pylist()]
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        found = [dict(zip(names, r, strict=True)) for r in zip(*map(values, column.flatten()), strict=True)]
        return [x if there else None for x, there in zip(found, column.is_valid().to_pylist(), strict=True)] if column.null_count else found
    return column.to_pylist()


def _known(column: pa.Array) -> list:
    return values(pc.if_else(pc.is_nan(column), None, column) if pa.types.is_floating(column.type) else column)


def folded(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[list[dict]], Iterable[tuple]], ddl: str, tasks: int | None = None) -> DataFrame:
    """``run`` of each group's rows in ``order`` (missing values last), which gives tuples of ``ddl``.

    A missing value is None, also where it is NaN; rows without a key are one group. With a number of ``tasks`` there
    are so many, however few their bytes.
    """
    schema = StructType.fromDDL(ddl)
    arrow, names, places = to_arrow_schema(schema), rows.columns, [rows.columns.index(k) for k in keys]

    def deal(batches):
        now, held, out = None, [], []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for batch in batches:
            columns = [_known(c) for c in batch.columns]
            for key, row in zip(zip(*[columns[k] for k in places], strict=True), zip(*columns, strict=True), strict=True):
                if held and key != now:
                    out += run(held)
                    held = []
                    if len(out) >= BATCH:
                        yield batch_of()
                        out = []
                now = key
                held.append(dict(zip(names, row, strict=True)))
        if held:
            out += run(held)
        if out:
            yield batch_of()

    return rows.repartition(*([tasks] if tasks else []), *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(deal, schema)
