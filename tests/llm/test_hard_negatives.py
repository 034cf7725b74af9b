"""Hard negatives by radix selection, against plain sorting; ties, odd rows and small digits included."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from passagework.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, window long, rank string"


def plain(rows):
    """The contract, by sorting every anchor's scores."""
    usable = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    found = []
    for anchor, kind, vector in (r for r in usable if r[0] % 100 == 0):
        scored = [(-sum(a * b for a, b in zip(vector, other)), i, label) for i, label, other in usable if i != anchor]
        for minus, positive, _ in sorted(x for x in scored if x[2] == kind)[:5]:
            fits = sorted((m, i) for m, i, label in scored if label != kind and 80 * -minus <= 100 * -m <= 100 * -minus)
            found.extend((anchor, positive, rank, i, -minus, -m) for rank, (m, i) in enumerate(fits[:5], 1))
    return sorted(found)


def rows(n, seed, values, dims=3):
    r = random.Random(seed)
    made = [(i if i < n // 2 else r.randrange(-300, n), [r.choice(values) for _ in range(dims)], r.choice([1, 1, 1, 2, 3, None]), 1, 2, "r") for i in range(n)]
    for i in r.sample(range(n), n // 3):  # a vector that a third of the rows share
        made[i] = (made[i][0], [0.5] * dims, *made[i][2:])
    odd = [None, [1.0, None, 1.0], [math.nan, 1.0, 1.0], [math.inf, 1.0, 1.0], [0.0] * dims, [0.5, 0.5], [], [-0.5] * dims]
    return made + [(100 * i, v, 1, 1, 2, "r") for i, v in enumerate(odd)] + [(None, [1.0] * dims, 1, 1, 2, "r")]


@pytest.mark.parametrize("options", [{}, {"anchors": 3, "digits": (5, 3), "few": 2}])
def test_selection_is_sorting(spark, options):
    made = rows(500, 3, [0.25, 0.5, 1.0])
    found = hard_negatives.mined(spark.createDataFrame(made, SCHEMA).repartition(3), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(made)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 50


def test_without_rows_or_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mined(none).count() == 0
    assert hard_negatives.mined(spark.createDataFrame([(1, [1.0], 1, 0, 0, ""), (2, [1.0], 2, 0, 0, "")], SCHEMA)).count() == 0
    lonely = spark.createDataFrame([(100, [1.0], 1, 0, 0, ""), (101, [1.0], 2, 0, 0, "")], SCHEMA)
    assert hard_negatives.mined(lonely).count() == 0  # no positive, so no window


def test_a_window_is_narrowed_without_losing_its_best():
    """The driver's side alone: counts of random scores lead to a cut that keeps at least k rows and few more."""
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        scores = r.integers(-50, 50, r.integers(0, 300))
        ids = np.arange(len(scores))
        w = hard_negatives.Windows(np.array([7]), np.array([0]), np.zeros((1, 1)), False, np.array([[-40]]), np.array([[45]]), 5, 4, 3)
        while w.open.any():
            step, low = int(w.step()[0, 0]), int(w.low[0, 0])
            counts = defaultdict(int)
            for s, i in zip(scores.tolist(), ids.tolist()):
                value = ~i if w.by_id[0, 0] else s
                if low <= value <= w.high[0, 0] and (s == w.score[0, 0] if w.by_id[0, 0] else True):
                    counts[(value - low) // step] += 1
            above, named = 0, []
            for digit in sorted(counts, reverse=True):
                if above + counts[digit] >= w.need[0, 0]:
                    named = [(0, digit, counts[digit], above)]
                    break
                above += counts[digit]
            w.narrow(*(np.array([x[i] for x in named], dtype=np.int64) for i in range(4)), (0, max(0, len(scores) - 1)))
        cut, cut_id = int(w.cut[0, 0]), int(w.cut_id[0, 0])
        kept = {(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if -40 <= s <= 45 and (s > cut or (s == cut and i <= cut_id))}
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if -40 <= s <= 45)[:5]
        assert set(best) <= kept and len(kept) <= 5 + 3
