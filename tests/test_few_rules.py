"""Short ways of the page pass against the long ones, and formulas that name their values once."""

import random

import numpy as np

from folioflow.functions import geometry as G
from folioflow.operators import figures as FG
from folioflow.operators import ruled as R


def test_lists_for_few_rules_equal_arrays_for_many(monkeypatch):
    random.seed(11)
    for _ in range(400):
        number = lambda n, most: np.array([random.randrange(most * 4) / 4 for _ in range(n)])
        k, m = random.randrange(1, 40), random.randrange(0, 30)
        s = R.Segments(number(k, 30), start := number(k, 40), start + 0.25 + number(k, 20))
        pos, lo = number(m, 30), number(m, 50)
        edges, n = (pos, lo, lo + number(m, 15)), random.randrange(1, 50)
        links = np.array([[random.randrange(n), random.randrange(n)] for _ in range(m)], np.int64).reshape(-1, 2).T
        few = R.merged(s), R.cover(s, *edges), R.spread(n, *links)
        with monkeypatch.context() as patch:
            patch.setattr(R, "FEW", -1)
            many = R.merged(s), R.cover(s, *edges), R.spread(n, *links)
        assert few[0].rows() == many[0].rows()
        assert np.array_equal(few[1], many[1]) and np.array_equal(few[2], many[2])


def test_rules_apart_by_just_more_than_the_gap_stay_apart():
    s = R.Segments(np.array([-10.0, 2.0, 1.8]), np.array([11.0, np.nextafter(0.3 + 3.0, 4.0), 0.05]), np.array([61.0, 9.0, 0.3]))
    assert s.start[1] > s.end[2] + 3.0
    assert len(R.merged(s).pos) == 3


def test_image_places_once_each_in_order():
    boxes = np.array([[50.0, 50, 90, 90], [0, 0, 90, 90], [50, 50, 90, 90], [0, 0, np.inf, 9]])
    photos, ornaments = FG.image_kinds(boxes, np.zeros((0, 2)), 10_000.0)
    assert photos.tolist() == [[50.0, 50, 90, 90], [0, 0, 90, 90]] and not len(ornaments)


def test_a_box_is_rounded_once(spark):
    df = spark.range(1).selectExpr("id + 0.1D AS x0", "id + 0.2D AS y0", "id + 0.1D AS x1", "id + 0.4D AS y1").select(G.unit_box(G.box()).alias("b"))
    assert df._jdf.queryExecution().analyzed().toString().lower().count("floor(") == 8  # of four sides, and of four widened ones
    assert tuple(df.first()["b"]) == (0.1, 0.2, 0.101, 0.4)
