"""Rays in the tasks of their scenes: against plain loops, and without a row for each step of a ray."""

from __future__ import annotations

import numpy as np
import pytest

from loculus.operators.rays import Boxes, Cells, fill
from loculus.plans import catalog
from tests.conftest import SMALL


def test_cells_by_place_and_by_search():
    rng = np.random.default_rng(1)
    for wide in (6, 2_000_000_000):
        v = rng.integers(-wide, wide, (3, 400))
        cells, other = Cells(lambda: iter([v[:, :100], v[:, 100:]])), rng.integers(-wide, wide, (3, 400))  # noqa: B023
        had = set(map(tuple, v.T))
        assert (cells.keys is None) == (wide == 6)
        number = cells.number(v)
        assert (number >= 0).all() and len(set(number)) == len(had) == len(set(zip(number, map(tuple, v.T))))
        if wide > 6:
            assert (cells.number(other) < 0).sum() == sum(tuple(x) not in had for x in other.T)
    assert (Cells(lambda: iter([])).number(other) == -1).all()


@pytest.mark.parametrize("far", [0, 1_000_000_000])
def test_filling(far):
    """As loops over every box and cell have it; far: boxes too far apart to number cells by place."""
    rng = np.random.default_rng(2)
    low = rng.integers(0, 5, (3, 60)) + far * rng.integers(0, 2, (3, 60))
    high, conf = low + rng.integers(-1, 4, (3, 60)), rng.choice([0.2, 0.4, 0.6, 0.9], 60)
    cells, named = fill(low, high, conf, 0.5)
    by = {}
    for k in range(60):
        for c in np.ndindex(*np.maximum(high[:, k] - low[:, k] + 1, 0)):
            by.setdefault(tuple(low[:, k] + c), []).append(k)
    for c, own in by.items():
        sure = [k for k in own if conf[k] > 0.5]
        want = (sure[-1] if sure else own[0]) if round(float(np.mean(conf[own])), 9) > 0.5 else -1
        assert named[cells.number(np.array(c)[:, None])[0]] == want
    assert (named >= 0).sum() <= len(by)


def test_boxes_in_leaves():
    """The same as every ray with every box, of which few are tested."""
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 60, (3, 1500))
    high, names = low + rng.uniform(0, 2, (3, 1500)), np.array([f"b{k % 700}" for k in range(1500)], object)
    o, d = rng.uniform(-5, 65, (3, 300)), rng.normal(size=(3, 300))
    d[:, ::7] *= np.array([1.0, 0.0, 0.0])[:, None]
    boxes = Boxes(low, high, names)
    ray, t, box = boxes.first(o, d)
    got = {int(r): (x, boxes.names[b]) for r, x, b in zip(ray, t, box)}
    for r in range(300):
        t0, t1 = Boxes._slabs(o[:, [r]], d[:, [r]], low, high)
        hit = np.flatnonzero((t0 <= t1) & (t1 >= 0))
        assert (r in got) == (len(hit) > 0)
        if len(hit):
            want = min((round(max(float(t0[k]), 0.0), 9), names[k]) for k in hit)
            assert got[r][1] == want[1] and got[r][0] == pytest.approx(want[0], abs=1e-8)
    assert boxes.tested < 300 * 1500 / 8


@pytest.mark.parametrize("name", ["j14_ray_visibility", "j17_occluded", "j18_box_hits"])
def test_no_row_for_a_step(spark, name):
    """Neither steps nor cells of rays become rows that are sent, and each answer comes from the task of its scene."""
    plan = catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Generate" not in plan and "Join" not in after and "Aggregate" not in after
