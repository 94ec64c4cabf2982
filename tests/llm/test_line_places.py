"""Places of lines are made as arrays."""

import numpy as np

from reprise.llm import lines


def test_places_order_lines_by_document_line_and_hash():
    rows = [(d, n, s) for d in (-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1) for n in (0, 3, (1 << 31) - 1) for s in (0, -1, -(1 << 63), (1 << 62) + 9)]
    got = lines._places(*(np.array(c, np.int64) for c in zip(*rows))).to_pylist()
    assert list(map(int, got)) == [(d * 2**31 + n) * 2**31 + s % 2**31 for d, n, s in rows]
