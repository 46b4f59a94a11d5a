"""Hard negatives against brute force, and the certificate of the shared lists."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from pubmart.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, row string, id int, bound double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], ROWS)


def brute(rows) -> Counter:
    used = []
    for vec, embedding, label in rows:
        if vec is None or label is None or embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in embedding]
        used.append((vec, int(math.fmod(label + 1, 10)) if vec % 7 == 0 else label, q))
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for at, (anchor, label, q) in enumerate(used):
        if anchor % 100:
            continue
        others = sorted((-dot(q, w), vec, own) for k, (vec, own, w) in enumerate(used) if k != at)
        for score, positive, _ in [x for x in others if x[2] == label][:5]:
            fits = [(vec, -s) for s, vec, own in others if own != label and -80 * score <= -100 * s <= -100 * score]
            for rank, (vec, s) in enumerate(fits[:5], 1):
                out[anchor, positive, rank, vec, -score, s] += 1
    return out


def found(frame) -> Counter:
    return Counter(tuple(r) for r in H.mined(frame).collect())


def vectors(seed: int, n: int, width: int, groups: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    own = rng.integers(groups, size=n)
    points = centres[own] + 0.6 * rng.normal(size=(n, width))
    return [(i, [float(x) for x in p], int(k % 10)) for i, (p, k) in enumerate(zip(points, rng.integers(4, size=n) + own))]


def test_all_hard_negatives_are_found(spark):
    rows = vectors(3, 1500, 6, 8)
    assert found(frame(spark, rows).repartition(3)) == brute(rows) and len(brute(rows)) > 100


def test_ties_and_copies(spark):
    rng = random.Random(2)
    few = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0], [-1.0, 0.25]]
    rows = [(i, rng.choice(few), rng.randrange(3)) for i in range(900)]
    assert found(frame(spark, rows).repartition(4)) == brute(rows)


def test_blocks_of_anchors(spark, monkeypatch):
    rows = [(20 * i, v, k) for i, v, k in vectors(4, 400, 5, 4)]
    monkeypatch.setattr(H, "ANCHORS", 17)
    monkeypatch.setattr(H, "GROUP", 4)
    assert found(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(7, 260, 4, 3)
    rows += [
        (None, [1.0] * 4, 1), (300, None, 1), (400, [1.0, nan, 0.0, 0.0], 1), (500, [inf] * 4, 2), (600, [1.0, None], 2), (700, [1.0] * 4, None),
        (800, [], 1), (900, [0.0] * 4, 2), (1000, [2.0, 1.0], 3), (-100, [0.5] * 4, -4), (-700, [0.5] * 4, -1),
        rows[100], rows[100], (100, [0.25] * 4, 2), rows[31], (0, [-1.0] * 4, 1),
    ]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == Counter()
    assert found(frame(spark, rows[1:50])) == Counter()


def test_scores_that_doubles_cannot_hold_are_refused(spark):
    with pytest.raises(ValueError, match="2\\*\\*53"):
        H.mined(frame(spark, [(100, [1e30, 1.0], 1)]))


def test_no_bound_is_below_a_score():
    rng = np.random.default_rng(1)
    anchors, rows = rng.normal(size=(60, 5)) * 50, rng.normal(size=(500, 5)) * 80
    zero = np.zeros(60, dtype=np.int64)
    block = H.Block(np.arange(60), np.arange(60), zero, zero, anchors)
    size = np.linalg.norm(rows, axis=1)
    for g, centre in enumerate(block.centres):
        bound = size * np.cos(np.maximum(0, np.arccos(rows @ centre / size) - block.radius[g]))
        members = slice(block.starts[g], block.stops[g])
        assert (anchors[members] @ rows.T <= block.norms[members, None] * bound + 1e-6 * 1e4).all()


def test_a_walk_ends_early_where_rows_are_grouped(monkeypatch):
    rng = np.random.default_rng(5)
    near = np.array([100.0, 0, 0]) + rng.normal(size=(40, 3))
    far = np.array([0.0, 100, 0]) + rng.normal(size=(20_000, 3))
    rows, seen = np.vstack([near, far]), []
    zero = np.zeros(8, dtype=np.int64)
    block = H.Block(-np.arange(1, 9), zero, zero, zero, near[:8])
    walk = H.Walk(block, True, np.full((8, 1), -np.inf), np.full((8, 1), np.inf), 5)
    enter = walk._enter
    monkeypatch.setattr(walk, "_enter", lambda m, s, i, r: (seen.append(s.size), enter(m, s, i, r)))
    walk.meet(rows, np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), np.arange(len(rows)))
    assert sum(seen) == 8 * H.FIRST_SLAB
    best = np.sort(near[:8] @ rows.T, axis=1)[:, :-6:-1]
    assert np.allclose(walk.score[:, 0], best)
