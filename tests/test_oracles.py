"""Each query with an oracle returns its rows; the others run."""

import datetime
import decimal
from collections import Counter

import pytest

from leafmill.plans.catalog import ORACLES, QUERIES


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert rows or name in ("content_segments",)
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert rows == Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in got.fetchall())
