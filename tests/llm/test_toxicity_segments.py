"""Maximal segments against their definition."""

import numpy as np
import pytest

from caseflow.llm import toxicity


def _by_definition(scores, lo, hi):
    """The best segment, then the same left and right of it."""
    best = max(((sum(scores[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    return _by_definition(scores, lo, best[1]) + [best] + _by_definition(scores, best[2], hi)


@pytest.mark.parametrize("seed", range(30))
def test_segments_by_definition(seed):
    r = np.random.default_rng(seed)
    scores = r.normal(-0.3, 1, int(r.integers(0, 40)))
    want = _by_definition(scores.tolist(), 0, len(scores))
    got = toxicity.segments(scores)
    assert [x[1:] for x in got] == [x[1:] for x in want]
    assert [x[0] for x in got] == pytest.approx([x[0] for x in want])

