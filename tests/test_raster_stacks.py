"""Measures of a large batch are taken in stacks of bounded size, with the same values."""

import numpy as np
import pandas as pd

from reprise.operators import rasters


def test_stacks_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    gray = [rng.integers(0, 4, 64) * 60 for _ in range(1000)]
    rgb = [rng.integers(0, 256, 30) for _ in range(1000)]
    width = pd.Series([0 if i % 7 == 0 else 8 for i in range(1000)])
    whole = rasters._stack_measures(np.stack(gray).reshape(1000, 8, 8).astype(np.int16), np.stack(rgb).reshape(1000, 10, 3).astype(np.int16))
    seen, measure = [], rasters._stack_measures
    monkeypatch.setattr(rasters, "_stack_measures", lambda g, c: seen.append(len(g)) or measure(g, c))
    got = next(rasters._measures.func(iter([(width, pd.Series(gray), pd.Series(rgb))])))
    assert sum(seen) == (width == 8).sum() and max(seen) <= 256
    wide = (width == 8).to_numpy()
    for c, values in whole.items():
        assert np.allclose(got.loc[wide, c].astype(float), values[wide]) and got.loc[~wide, c].isna().all()
    assert not got["uniforme"].any()
