"""Column builders for a cluster of lines held as an array of (seq, x0, y0, x1, y1, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from leafmill.functions import clusterarrays as ca
from leafmill.functions.polygons import let


def _by(lines: Column, *names: str) -> Column:
    keyed = F.transform(lines, lambda s: F.struct(*[s[n].alias(f"k{i}") for i, n in enumerate(names)], s.alias("line")))
    return F.transform(F.sort_array(keyed), lambda k: k["line"])


def _parts(lists: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    lines = lists.flatten()
    return np.repeat(np.arange(len(lists)), size), [ca.numbers(lines.field(name)) for name in names]


def _whole(values: np.ndarray) -> pa.Array:
    none = np.isnan(values)
    return pa.array(np.where(none, 0, values).astype("int32"), mask=none)


@arrow_udf(T.IntegerType())
def _column_cuts(lists: pa.Array, gaps: pa.Array) -> pa.Array:
    group, (x0, x1, seq) = _parts(lists, "x0", "x1", "seq")
    return _whole(ca.column_cuts(group, len(lists), x0, x1, seq, gaps[0].as_py() if len(gaps) else 0)[0])


@arrow_udf(T.IntegerType())
def _stacked_cuts(lists: pa.Array) -> pa.Array:
    group, fields = _parts(lists, "x0", "y0", "x1", "y1", "seq")
    return _whole(ca.stacked_cuts(group, len(lists), *fields)[0])


def column_cut(lines: Column, gap: int = 12) -> Column:
    """Where the widest free vertical strip of at least ``gap`` lies, if each line falls wholly on one side
    of it (with 5 pixels of slack) and both sides have some; else null.

    Like ``stacked_cut`` for whole columns only, not inside lambdas: all clusters of a batch at once."""
    return _column_cuts(lines, F.lit(gap))


def cut_columns(lines: Column, gap: int = 12) -> Column:
    """A cluster as one or two clusters, left of the strip and right of it."""
    parts = lambda at: F.array(F.filter(lines, lambda s: s["x0"] < at - 5), F.filter(lines, lambda s: s["x0"] >= at - 5))
    return let(column_cut(lines, gap), lambda at: F.when(at.isNotNull(), parts(at)).otherwise(F.array(lines)))


def stacked_cut(lines: Column) -> Column:
    """How many lines lie above the break of a cluster of four or more; null without one.

    In a tall narrow cluster the first gap of 25 below the second line counts, else the largest of
    at least 28, the first of equals."""
    return _stacked_cuts(lines)


def cut_stacked(lines: Column) -> Column:
    """A cluster as one or two clusters, above the break and below it."""
    parts = lambda k: F.array(F.slice(_by(lines, "y0", "seq"), 1, k), F.slice(_by(lines, "y0", "seq"), k + 1, F.size(lines)))
    return let(stacked_cut(lines), lambda k: F.when(k.isNotNull(), parts(k)).otherwise(F.array(lines)))


def out_of_order(ids: Column) -> Column:
    """Whether ids are not 1, 2, 3, ... in the order of their list."""
    return F.size(F.filter(F.transform(ids, lambda v, i: F.coalesce(v != i + 1, F.lit(True))), lambda wrong: wrong)) > 0


def renumbered(bubbles: Column) -> Column:
    """Bubbles (id, y0, x0, ...) in reading order, with ids 1, 2, 3, ..."""
    return F.transform(_by(bubbles, "y0", "x0", "id"), lambda b, i: b.withField("id", i + 1))
