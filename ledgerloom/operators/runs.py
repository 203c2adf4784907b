"""Rows of one key at a time, from partitions that come sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def runs(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, list]]:
    """The columns of each key's rows as lists; only that key's rows are held."""
    held: dict[str, list] = {}
    last = None
    for f in frames:
        if not len(f):
            continue
        marks = [f[k].to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
        columns = {c: f[c].tolist() for c in f.columns}
        for a, e in zip([0, *cut.tolist()], [*cut.tolist(), len(f)]):
            now = tuple(m[a] for m in marks)
            if held and now == last:
                for c in held:
                    held[c] += columns[c][a:e]
                continue
            if held:
                yield held
            held, last = {c: v[a:e] for c, v in columns.items()}, now
    if held:
        yield held
