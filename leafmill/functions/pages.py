"""Pages as masks of gutter cells: their panels by cutting along gutters, rows first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

PANEL = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")]))


def stretches(on: np.ndarray) -> np.ndarray:
    """(start, end) of each run of true values, a row each."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


def between(gutters: np.ndarray, length: int, least: int) -> list[tuple[int, int]]:
    """What lies before, between and behind gutters, of at least ``least``."""
    starts, ends = [0, *gutters[:, 1].tolist()], [*gutters[:, 0].tolist(), length]
    return [(a, b) for a, b in zip(starts, ends) if b - a >= least]


def cut_panels(gutter: np.ndarray, *, share: float = 0.95, panel: float = 0.08, least: int = 40, thick: int = 3, depth: int = 5) -> list[tuple[int, int, int, int]]:
    """Panels (x0, y0, x1, y1) of a page whose gutter cells are true, in the order of the cuts.

    A part is cut along all rows that are gutter by ``share`` over ``thick`` rows, into pieces of a
    panel's height at least; if that gives one piece, along columns. Parts under one and a half
    panels, and those ``depth`` cuts down, stay. The least panel is ``panel`` of the page, and
    ``least`` cells. A page without panels is one. Row and column counts come from one table of sums."""
    height, width = gutter.shape
    low_w, low_h = max(least, int(width * panel)), max(least, int(height * panel))
    thickness = max(thick, int(min(height, width) * 0.003))
    sums = np.zeros((height + 1, width + 1), np.int64)
    sums[1:, 1:] = gutter.cumsum(0).cumsum(1)
    out, waiting = [], [(0, 0, width, height, 0)]
    while waiting:
        x0, y0, x1, y1, cuts = waiting.pop()
        pieces: list[tuple[int, int, int, int]] = []
        if cuts < depth and x1 - x0 >= int(low_w * 1.5) and y1 - y0 >= int(low_h * 1.5):
            rows = np.diff(sums[y0 : y1 + 1, x1] - sums[y0 : y1 + 1, x0]) / (x1 - x0)
            columns = np.diff(sums[y1, x0 : x1 + 1] - sums[y0, x0 : x1 + 1]) / (y1 - y0)
            for profile, low, box in ((rows, low_h, lambda a, b: (x0, y0 + a, x1, y0 + b)), (columns, low_w, lambda a, b: (x0 + a, y0, x0 + b, y1))):
                runs = stretches(profile >= share)
                found = between(runs[runs[:, 1] - runs[:, 0] >= thickness], len(profile), low)
                if len(found) > 1:
                    pieces = [box(a, b) for a, b in found]
                    break
        if pieces:
            waiting += [(*p, cuts + 1) for p in reversed(pieces)]
        elif x1 - x0 >= low_w and y1 - y0 >= low_h:
            out.append((x0, y0, x1, y1))
    return out or [(0, 0, width, height)]


def panels_of(**how):
    """``cut_panels`` for columns of masks (rows of booleans), Arrow-batched; an empty mask has none."""

    @pandas_udf(PANEL)
    def run(masks: pd.Series) -> pd.Series:
        grids = (np.array([list(row) for row in m], bool) if m is not None and len(m) else None for m in masks)
        return pd.Series([[] if g is None else [dict(zip(("x0", "y0", "x1", "y1"), p)) for p in cut_panels(g, **how)] for g in grids])

    return run
