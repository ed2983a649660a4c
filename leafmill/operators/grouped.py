"""Order-dependent logic on small groups, without a call into pandas for each of them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = dict[str, list]


def grouped(df: DataFrame, key: list[str], order: list[str], each: Callable[[Rows], Rows], schema: str) -> DataFrame:
    """``each`` group of ``df`` by ``key``, its rows in ``order``, as columns of plain values.

    Groups are dealt by their key and sorted in the JVM; a task walks over its rows and holds one
    group at a time. Meant for groups that are small by nature (the items of a page)."""

    def run(batches):
        names, held, now = None, None, None

        def out(rows: Rows):
            done = each(rows)
            for c, values in done.items():
                ready.setdefault(c, []).extend(values)

        ready: Rows = {}
        for batch in batches:
            names = names or batch.schema.names
            columns = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*(columns[names.index(k)] for k in key)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                part = [c[start:i] for c in columns]
                if held is not None and keys[start] == now:
                    for a, b in zip(held, part):
                        a.extend(b)
                else:
                    if held is not None:
                        out(dict(zip(names, held)))
                    held, now = part, keys[start]
                start = i
            if ready and len(next(iter(ready.values()))) >= 10_000:
                yield pa.RecordBatch.from_pydict(ready, target)
                ready.clear()
        if held is not None:
            out(dict(zip(names, held)))
        if ready:
            yield pa.RecordBatch.from_pydict(ready, target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
