"""Hit rate of the cap filters by number and length of vectors, without tables of that size."""

import math

import numpy as np
import pytest

from reprise.llm import caps


def met(dim, rows, n=800):
    """Share of random pairs at exactly the similarity that share a filter of the table's layout."""
    rng = np.random.default_rng(99)
    x = caps.unit(rng.standard_normal((n, dim)))
    off = rng.standard_normal((n, dim))
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = caps.SIMILARITY * x + math.sqrt(1 - caps.SIMILARITY ** 2) * caps.unit(off)
    codes = caps.Codes(dim, *caps.layout(rows, dim))
    return sum(len(np.intersect1d(a, b)) > 0 for a, b in zip(codes.decode(x), codes.decode(y))) / n


@pytest.mark.parametrize("dim", [2, 3, 8, 16, 64])
@pytest.mark.parametrize("rows", [3000, 65_536, 600_000, 2_000_000, 10_000_000])
def test_pairs_meet_at_every_size(dim, rows):
    assert met(dim, rows) >= 0.996


def test_lower_similarities_keep_the_hit_rate():
    words, height, codes = caps.layout(65_536, 16, 0.8)
    hit = caps.hit_rate(16, words, height, 0.8, seed=5)
    assert 1 - (1 - hit) ** codes >= caps.HIT and codes <= caps.MANY_CODES


def test_cap_share_is_exact():
    x = caps.unit(np.random.default_rng(1).standard_normal((200_000, 8)))
    for height in (0.3, 0.7):
        assert abs(caps.cap_share(height, 8) - (x[:, 0] > height).mean()) < 0.002
    assert abs(caps.cap_share(0.5, 2) - 1 / 3) < 1e-6 and caps.cap_share(0.5, 3) == pytest.approx(0.25, abs=1e-6)
